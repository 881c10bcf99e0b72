"""Comparables, signals, rules, scores and decisions on small fixtures."""

from pyspark.sql import functions as F
from samples import brief, frame, listing, rent, sold

from parcelscope.functions.tags import has_media
from parcelscope.operators import briefs as B, checks as K, comps as C, inspections as I, market as M, scoring as V, signals as S
from parcelscope.plans import decision as D, reports as R


def near(spark):
    return C.neighbour_table(spark)


def comp_ids(spark, pool, subject, rule=C.SOLD, **kw):
    rows = C.comparables(frame(spark, *pool), frame(spark, subject), near(spark), rule, **kw)
    return [r.comp_id for r in rows.orderBy("rank").collect()]


def test_comps_prefer_area_type_and_beds(spark):
    pool = [
        sold("exact", 920000, "2026-06-01"), sold("adjacent", 880000, "2026-05-01", beds=1.0),
        sold("house", 1400000, "2026-06-02", property_type="House"), sold("far", 900000, "2026-06-03", suburb="Randwick"),
    ]
    assert comp_ids(spark, pool, listing(id="t")) == ["exact", "adjacent"]


def test_neighbouring_area_helps(spark):
    pool = [sold("nearby", 930000, "2026-06-01", suburb="Waterloo"), sold("away", 940000, "2026-06-02", suburb="Manly")]
    r = C.price_read(frame(spark, *pool), frame(spark, listing(id="t", price_from=950000, price_to=950000)), near(spark)).collect()[0]
    assert (r.n, r.top_comps[0].id, r.price_per_bed) == (1, "nearby", 475000.0)


def test_enum_and_display_types_match(spark):
    pool = [sold(f"d{i}", p, f"2026-05-0{i}", property_type="Apartment / Unit / Flat") for i, p in enumerate((1000000, 1030000, 1060000), 1)]
    assert len(comp_ids(spark, pool, listing(id="t", property_type="APARTMENT_UNIT_FLAT"))) == 3


def test_hot_profile_is_dealt_over_tasks(spark):
    """Nine subjects in ten share one profile (another one has NULLs); without broadcasts of tables the largest join task stays near the median."""
    n = 20000
    subjects = spark.range(n).select(
        F.col("id").cast("string").alias("id"),
        F.when(F.col("id") % 10 > 0, "hot").when(F.col("id") % 20 > 0, F.concat(F.lit("a"), (F.col("id") % 70).cast("string"))).alias("area"),
        F.when(F.col("id") % 10 > 0, "house").alias("kind"), F.lit(2.0).alias("beds"),
    )
    counted = subjects.groupBy(*C.PROFILE).agg(F.count("*").alias("subjects"))
    profiles = counted.withColumn("value", F.concat_ws("/", "area", "kind", "beds")).withColumn("shared", F.col("subjects"))
    assert [tuple(r) for r in C.hot_profiles(profiles, 1500).collect()] == [("hot", "house", 2.0, 12)]
    keys = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(keys, ("-1", "false", "6"), strict=True):
            spark.conf.set(k, v)
        rows = C.attach(subjects, profiles, 250).withColumn("task", F.spark_partition_id())
        sizes = sorted(r["count"] for r in rows.groupBy("task").count().collect())
        assert sum(sizes) == n and len(sizes) == 6 and sizes[-1] <= 1.6 * sizes[3]
        plain = C.attach(subjects, profiles.drop("subjects")).collect()
        assert {(r.id, r.value, r.shared) for r in rows.collect()} == {(r.id, r.value, r.shared) for r in plain}
    finally:
        for k, v in keys.items():
            spark.conf.set(k, v)


def test_subject_without_area_sees_everything(spark):
    pool = [sold("a", 900000, "2026-06-01", suburb="Manly"), sold("b", 900000, "2026-06-02", beds=5.0)]
    # type alone scores 2, which is not enough; equal beds add 3
    assert comp_ids(spark, pool, listing(id="t", suburb=None)) == ["a"]


def test_pool_limit_and_self(spark):
    pool = [sold(f"s{i:03d}", 900000 + i, "2026-05-01") for i in range(100)]
    got = comp_ids(spark, pool, pool[0])
    assert got == [f"s{i:03d}" for i in range(12)]
    assert comp_ids(spark, pool, pool[0], exclude_self=True) == [f"s{i:03d}" for i in range(1, 13)]


def test_underquote_and_fair(spark):
    pool = [sold(f"c{i}", p, f"2026-05-0{i}") for i, p in enumerate((1000000, 1020000, 1050000, 1080000), 1)]
    subjects = frame(spark, listing(id="low", price_from=820000, price_to=820000), listing(id="ok", price_from=1030000, price_to=1030000))
    got = {r.id: r for r in C.price_read(frame(spark, *pool), subjects, near(spark)).collect()}
    assert got["low"].underquote.gap_pct >= 12 and got["low"].underquote.severity == "high" and got["ok"].underquote is None
    assert (got["ok"].fairness, got["ok"].confidence) == ("fair", "medium")


def test_rent_read(spark):
    pool = [rent(f"r{i}", w) for i, w in enumerate((820, 850, 880, 900))]
    r = C.rent_read(frame(spark, *pool), frame(spark, rent("t", 850)), near(spark), F.lit(900.0)).collect()[0]
    assert (r.n, r.fairness, r.affordability, r.annual_burden, r.rent_per_bed) == (4, "fair", "within budget", 44200.0, 425.0)


def test_same_bed_median_and_reconcile(spark):
    pool = [
        sold("a", 1000000, "2026-05-01"), sold("b", 1020000, "2026-05-02"),
        sold("c", 700000, "2026-05-03", beds=1.0), sold("d", 720000, "2026-05-04", beds=1.0),
    ]
    rows = S.valuation_case(frame(spark, *pool), frame(spark, listing(id="t")), near(spark)).collect()[0]
    by = {s.method: s for s in rows.signals}
    assert by["comparable_median"].point == 1010000
    points = [s.point for s in rows.signals]
    assert min(points) <= rows.estimate.point <= max(points)
    assert rows.estimate.low < rows.estimate.point < rows.estimate.high


def test_captured_estimate_by_id_then_address(spark):
    cache = spark.createDataFrame(
        [("t", None, "Automated", 1e6, 9e5, 1.1e6, None), ("2 other st", "p", "avm", None, 8e5, 9e5, "high")],
        "key string, provider string, method string, point double, low double, high double, confidence string",
    )
    subjects = frame(spark, listing(id="t"), listing(id="u", address_display=" 2  Other   St "), listing(id="v", address_display=None))
    got = {r.id: r.avm for r in S.captured_estimates(subjects, cache).collect()}
    assert (got["t"].method, got["t"].confidence, got["t"].point) == ("avm", "medium", 1e6)
    assert (got["u"].low, got["u"].confidence, got["v"]) == (8e5, "high", None)


def risks_of(spark, row, **brief_changes):
    rows = B.with_brief(frame(spark, row), brief(spark, **brief_changes))
    return K.with_risks(rows).collect()[0].risks


def test_risks(spark):
    risky = listing(cars=0.0, description="Beautiful ground floor apartment on a busy main road with no parking and limited natural light.")
    r = risks_of(spark, risky)
    labels = [i.label for i in r.items]
    assert labels[0] == "Parking shortfall" and r.has_dealbreaker
    assert {"Noise or road exposure", "Ground-floor exposure", "Light/aspect concern", "High-density suburb"} <= set(labels)
    easement = risks_of(spark, listing(property_type="House", description="Shared driveway with an easement."))
    assert "Easement/access issue" in [i.label for i in easement.items]
    renter = risks_of(spark, rent("r", 800) | {"cars": 0.0, "description": "Available now. Air conditioning. Street parking only, no storage."}, objective="rent")
    assert "Parking/storage shortfall" in [i.label for i in renter.items]


def test_diligence_and_actions(spark):
    rows = B.with_brief(frame(spark, listing()), brief(spark))
    rows = K.with_diligence(K.with_risks(rows))
    rows = rows.withColumn("fairness", F.lit("fair")).withColumn("confidence", F.lit("low")).withColumn("posture", F.lit(""))
    r = K.with_actions(rows).collect()[0]
    assert [i.category for i in r.diligence.items][:2] == ["legal", "strata"] and r.diligence.critical_count == 2
    assert [a.type for a in r.actions] == ["inspect", "request_contract", "request_strata", "run_comps"]
    missing = listing(price_display=None, price_from=None, price_to=None, agents=[], inspections=[], images=[])
    m = K.with_diligence(B.with_brief(frame(spark, missing), brief(spark))).collect()[0]
    assert {"inspection", "price", "agent", "layout", "finance"} <= {i.category for i in m.diligence.items}


def test_decision_and_recommendation(spark):
    pool = [sold(f"c{i}", p, f"2026-05-0{i}") for i, p in enumerate((900000, 950000, 1000000), 1)]
    good = listing(id="good", price_from=920000, price_to=990000, description="North-facing apartment with lift, air conditioning, balcony and secure parking.")
    bad = listing(id="bad", cars=0.0, description="Ground floor on a main road, no parking.")
    dec = D.decide(frame(spark, good, bad), frame(spark, *pool), brief(spark), near(spark))
    got = {r.id: r for r in D.summary(dec).collect()}
    assert got["good"].viability_score > got["bad"].viability_score
    assert got["bad"].next_action.startswith("Pass") and got["good"].next_action == "Inspect in person"
    rec = R.recommendation(dec).collect()[0]
    assert rec.standout == "good" and rec.confidence == "low" and "thin" in rec.why_wrong[0]
    assert [r.id for r in R.shortlist(dec, 1).collect()] == ["good"]


def test_investor_yield(spark):
    rows = B.with_brief(frame(spark, listing(price_from=1000000, price_to=1000000)), brief(spark, buyer_type="investor"))
    v = V.with_viability(K.with_risks(rows).withColumn("weekly_rent", F.lit(800.0))).collect()[0].viability
    assert (v.lens, v.gross_yield_pct) == ("investor", 4.16)


def test_inspection_run(spark):
    second = listing(id="b", address_display="2 Test Street", suburb="Randwick", inspections=[("2026-06-06T10:15:00", "2026-06-06T10:45:00")])
    rows = frame(spark, second, listing(id="c", inspections=[]), listing(id="a"))
    rows = rows.withColumn("brief_id", F.lit("me")).withColumn("fit_score", F.lit(8.5)).withColumn("action", F.lit("inspect"))
    run = I.inspection_run(I.visits(rows)).orderBy("start").collect()
    assert [(r.id, r.clash, str(r.day)) for r in run] == [("a", False, "2026-06-06"), ("b", True, "2026-06-06")]
    assert run[1].travel_note.startswith("Move from Zetland to Randwick") and run[0].priority == "must inspect"
    assert [r.id for r in I.unscheduled(rows).collect()] == ["c"]


def test_sales_without_dates_stay_in_open_reports(spark):
    rows = frame(spark, sold("a", 900000, "2026-06-01"), listing(id="b", mode="sold", price_from=None, price_to=None, price_display="$1,050,000"),
                 listing(id="c", mode="sold", price_display="Price Withheld", price_from=None, price_to=None))
    got = {r.id: r.sold_price for r in M.sales(rows, days=None).collect()}
    assert got == {"a": 900000.0, "b": 1050000.0, "c": None}
    assert [r.id for r in M.sales(rows, as_of="2026-06-05", days=30).collect()] == ["a"]
    assert M.sales_summary(rows, days=None).collect()[0].sold_count == 2


def test_searches_from_brief(spark):
    got = {r.name: r.filters for r in B.filter_map(B.searches(brief(spark, objective="both", track_sold=True, sort="dateupdated-desc"))).collect()}
    assert set(got) == {"buy-zetland", "rent-zetland", "sold-zetland"}
    assert got["buy-zetland"]["price_max"] == "1100000" and "price_max" not in got["sold-zetland"]
    assert got["sold-zetland"]["sort"] == "solddate-desc" and "region" not in got["buy-zetland"]


def test_briefs_without_a_suburb_meet_listings(spark):
    rows = frame(spark, listing()).withColumn("region", F.lit("North"))
    none = F.array().cast("array<string>")
    plain = brief(spark).withColumn("suburbs", none).withColumn("region", F.lit(None).cast("string"))
    assert B.with_brief(rows, plain).count() == 1
    assert B.with_brief(rows, plain.withColumn("region", F.lit(" NORTH "))).count() == 1
    assert B.with_brief(rows, plain.withColumn("region", F.lit("south"))).count() == 0


def test_a_repeated_cache_key_gives_one_estimate(spark):
    subjects = spark.createDataFrame([("1", "1 Example St")], "id string, address_display string")
    kind = "key string, provider string, method string, point double, low double, high double, confidence string, captured_at date"
    day = lambda d: __import__("datetime").date(2026, 1, d)
    cache = spark.createDataFrame([("1", "p", "avm", 5.0, 4.0, 6.0, "high", day(1)), ("1", "q", "avm", 7.0, 6.0, 8.0, "high", day(2))], kind)
    (got,) = S.captured_estimates(subjects, cache).collect()
    assert got.avm.point == 7.0


def test_score_says_why(spark):
    rows = spark.createDataFrame(
        [
            ("a", 1.0, 1.0, 0.0, 2.0, 2.0, 1.0, 1_200_000, 1_000_000, "Ground floor on a main road", "owner_occupier", None),
            ("b", 3.0, 2.0, 2.0, 2.0, None, None, 840_000, 1_000_000, "Set on a busy road", "investor", 700.0),
            ("c", None, None, None, 2.0, 0.0, 0.0, None, 1_000_000, "Quiet", "investor", 700.0),
            ("d", 2.0, 1.0, 1.0, 2.0, 1.0, 1.0, 1_050_000, 1_000_000, "Quiet", "", None),
        ],
        "id string, beds double, baths double, cars double, beds_min double, baths_min double, cars_min double, price_exact bigint, buy_max bigint, description string, buyer_type string, weekly_rent double",
    ).select("*", F.lit(None).cast("bigint").alias("price_from"), F.lit(None).cast("bigint").alias("price_to"), F.lit("").alias("headline"), F.array().cast("array<string>").alias("features"))
    label = F.struct(F.lit("Overlay").alias("label"))
    risks = F.struct((F.col("id") == "a").alias("has_dealbreaker"), F.lit(0.1).alias("penalty"), F.array(label).alias("top"))
    got = {r.id: r.viability for r in V.with_viability(rows.withColumn("risks", risks)).collect()}
    assert got["a"].violations == [
        "1 beds, 2 or more asked", "1 baths, 2 or more asked", "0 car spaces, 1 or more asked", "20% over the buy ceiling", "Ground floor on a main road",
        "The brief asks for parking and none is in sight", "Deal-breaker: Overlay",
    ]
    assert got["a"].signals == [] and got["b"].violations == []
    assert got["b"].signals == ["16% under the buy ceiling", "A main road may be near; listen for noise", "Gross yield 4.3% at a rent of $700 a week"]
    assert got["c"].violations == ["0 beds, 2 or more asked"] and got["c"].signals == ["No rents are known to read a yield from"]
    assert got["d"].signals == ["Just over the budget at the middle of the guide"]
    assert all(len(v.matched) + len(v.missing) == 10 for v in got.values())


def test_media_kind_falls_back_to_the_category(spark):
    images = "array<struct<url:string,type:string,category:string>>"
    rows = spark.createDataFrame(
        [("type", [("u", "FloorPlan", None)]), ("category", [("u", None, "floorplan")]), ("empty", [("u", "", "Floorplan")]), ("other", [("u", "photo", "floorplan")]), ("none", [("u", None, None)]), ("no list", None)],
        f"id string, images {images}",
    )
    assert {r.id for r in rows.where(has_media(rows, "floorplan")).collect()} == {"type", "category", "empty"}
    plain = rows.withColumn("images", F.transform("images", lambda i: F.struct(i["url"].alias("url"), i["type"].alias("type"))))
    assert {r.id for r in plain.where(has_media(plain, "floorplan")).collect()} == {"type"}


def test_doubts_name_what_is_missing(spark):
    rows = spark.createDataFrame(
        [("nothing", None, None, None), ("read", "high", 9, "minor"), ("thin", "low", 2, "major"), ("unscanned", "high", 9, None)], "id string, confidence string, n int, severity string"
    )
    risk = F.when(F.col("severity").isNotNull(), F.struct("severity", F.lit("Noise").alias("label")))
    notes = R.doubts(F.col("confidence"), F.col("n"), F.lit(0), risk, F.lit("inspect"), F.col("confidence"), None, F.col("confidence").isNotNull(), F.col("severity").isNotNull())
    got = {r.id: r.notes for r in rows.select("id", notes.alias("notes")).collect()}
    assert got == {
        "nothing": ["There is no price read.", "There is no risk scan."], "read": [],
        "thin": ["The comparables are thin; the price read may change.", "One risk may outweigh the rest: Noise."], "unscanned": ["There is no risk scan."],
    }
