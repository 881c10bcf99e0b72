"""Comparable selection and the comparable-led price read.

The comparables of a subject depend only on its area, type and bedrooms. So they are
chosen once per distinct (area, type, beds) profile, not per subject:

1. each area's most recent rows (a group limit before the shuffle cuts the big table),
2. per subject area, the most recent of its own and its neighbours' rows, as one array,
3. per profile, score the array and keep the best,
4. statistics of the kept array, joined back to the subjects by profile.

Every step after (1) works on at most areas x pool rows; the subjects are read once and
take part in one equi join whose other side is one row per profile.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from parcelscope import vocab
from parcelscope.functions import labels as L, numbers as N, text as X
from parcelscope.functions.tags import first_of
from parcelscope.functions.payload import area_source
from parcelscope.operators.skew import first_k
from parcelscope.session import settle

PROFILE = ("area", "kind", "beds")
HOT_PROFILES = 64  # profiles that may be split; any other one holds less than a 64th of the subjects
SPLIT_ROWS = 1_000_000  # subjects of one profile that one task may join


@dataclass(frozen=True)
class CompRule:
    mode: str
    pool: int
    keep: int = vocab.COMP_LIMIT
    min_score: int = 3


SOLD = CompRule("sold", vocab.SOLD_POOL)
RENT = CompRule("rent", vocab.RENT_POOL)


def _price(rule: CompRule) -> Column:
    shown = N.display_price(F.col("price_display"))
    low, high = N.present(F.col("price_from").cast("double")), N.present(F.col("price_to").cast("double"))
    if rule.mode == "sold":
        return F.coalesce(N.present(F.col("sold_price").cast("double")), low, high, shown)
    rent = F.coalesce(low, high, shown)
    return F.when(rent <= vocab.MAX_WEEKLY_RENT, rent)


def _recency(rule: CompRule) -> Column:
    return F.coalesce("sold_date", "last_seen") if rule.mode == "sold" else F.col("last_seen")


def profiled(subjects: DataFrame) -> DataFrame:
    """Add the profile columns ``area``, ``kind`` (canonical type) to listings."""
    return subjects.withColumn("area", F.lower("suburb")).withColumn(
        "kind", X.type_canon(F.col("property_type"))
    )


def neighbour_table(spark, nearby: dict[str, tuple[str, ...]] = vocab.NEARBY) -> DataFrame:
    """The directed area -> neighbour table of the default market."""
    pairs = [(a, n) for a, names in nearby.items() for n in names]
    return spark.createDataFrame(pairs, "area string, neighbour string")


def reach(areas: DataFrame, neighbours: DataFrame) -> DataFrame:
    """subject area -> candidate area: its own and its (directed) neighbours."""
    own = areas.select("area", F.col("area").alias("candidate"))
    near = areas.join(neighbours.select("area", F.col("neighbour").alias("candidate")), "area")
    return own.unionByName(near).distinct()


def pool(listings: DataFrame, areas: DataFrame, neighbours: DataFrame, rule: CompRule) -> DataFrame:
    """Per subject area (NULL: anywhere) the most recent rows, newest first, as an array."""
    dated = F.col("sold_date") if rule.mode == "sold" else F.col("last_seen")
    carried, sqm = area_source(listings)  # raw text is parsed for the kept rows only
    rows = listings.where(F.col("mode") == rule.mode).select(
        F.lower("suburb").alias("candidate"),
        "id",
        _recency(rule).alias("recency"),
        dated.alias("dated"),
        _price(rule).alias("price"),
        F.col("beds").cast("double").alias("beds"),
        X.type_canon(F.col("property_type")).alias("kind"),
        F.col(carried),
    )
    newest = [F.desc_nulls_last("recency"), F.col("id")]
    named = areas.where(F.col("area").isNotNull())
    per_area = first_k(rows.where(F.col("candidate").isNotNull()), ["candidate"], newest, rule.pool, "r").drop("r")
    near = per_area.join(reach(named, neighbours), "candidate")
    near = first_k(near, ["area"], newest, rule.pool, "position")
    # a subject without an area looks at the newest rows anywhere
    anywhere = rows.orderBy(*newest).limit(rule.pool)
    anywhere = first_k(anywhere.withColumn("area", F.lit(None).cast("string")), ["area"], newest, rule.pool, "position")
    entries = near.unionByName(anywhere).withColumn("sqm", sqm)
    entry = F.struct("position", "id", "candidate", "price", "beds", "kind", "dated", "sqm")
    return entries.groupBy("area").agg(F.sort_array(F.collect_list(entry)).alias("pool"))  # rule.pool at most


def _score(c: Column) -> Column:
    delta = N.bed_delta(F.col("beds"), c["beds"])
    beds = F.when(delta <= 0.5, 3).when(delta <= 1, 1).otherwise(0)
    kind = F.when(X.type_match(F.col("kind"), c["kind"]), 2).otherwise(0)
    # every entry of a named area's pool is the area itself or a neighbour
    place = F.when(F.col("area").isNull() | c["candidate"].isNull(), 0).when(F.col("area") == c["candidate"], 3).otherwise(1)
    return beds + kind + place


def profile_comps(
    listings: DataFrame, subjects: DataFrame, neighbours: DataFrame, rule: CompRule, exclude_self: bool = False
) -> DataFrame:
    """One row per distinct profile with ``comps``: the best entries, best first, and ``subjects``, how many share it."""
    profiles = profiled(subjects).groupBy(*PROFILE).agg(F.count("*").alias("subjects"))
    pools = pool(listings, profiles.select("area").distinct(), neighbours, rule)
    rows = profiles.join(pools, profiles["area"].eqNullSafe(pools["area"])).drop(pools["area"])

    def fits(c: Column) -> Column:
        clash = F.col("kind").isNotNull() & c["kind"].isNotNull() & ~X.type_match(F.col("kind"), c["kind"])
        return N.present(c["price"]).isNotNull() & ~clash

    def ranked(c: Column) -> Column:
        return F.struct(
            (-_score(c)).alias("key"),
            F.coalesce(-F.unix_date(c["dated"]), F.lit(2**31 - 1)).alias("age"),
            c["position"].alias("position"),
            _score(c).alias("score"),
            c["id"].alias("id"),
            c["price"].alias("price"),
            c["beds"].alias("beds"),
            c["dated"].alias("dated"),
            c["sqm"].alias("sqm"),
            N.per_bed(c["price"], c["beds"]).alias("per_bed"),
        )

    scored = F.filter(F.transform(F.filter("pool", fits), ranked), lambda c: c["score"] >= rule.min_score)
    keep = rule.keep + 1 if exclude_self else rule.keep  # one spare entry per subject
    best = rows.select(*PROFILE, "subjects", F.slice(F.sort_array(scored), 1, keep).alias("comps"))
    return settle(best, f"{rule.mode}-profiles")


def hot_profiles(per_profile: DataFrame, split: int = SPLIT_ROWS) -> DataFrame:
    """Profiles shared by more than ``split`` subjects, the ``HOT_PROFILES`` largest at most, and the parts to deal each into."""
    parts = F.ceil(F.col("subjects") / split).cast("int")
    return per_profile.where(F.col("subjects") > split).orderBy(F.desc("subjects"), *PROFILE).limit(HOT_PROFILES).select(*PROFILE, parts.alias("parts"))


def _meets(rows: DataFrame, right: DataFrame, keys: tuple[str, ...] = PROFILE) -> DataFrame:
    """Left join on columns of the same names, NULL equal to NULL."""
    right = right.withColumnsRenamed({c: f"_{c}" for c in keys})
    on = F.lit(True)
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(right, on, "left").drop(*[f"_{c}" for c in keys])


def attach(subjects: DataFrame, per_profile: DataFrame, split: int = SPLIT_ROWS) -> DataFrame:
    """Left join of per-profile columns onto subjects carrying the profile columns.

    If the profiles know how many ``subjects`` share them, hot ones are dealt: their subjects go to parts by a hash of the
    id, and their row is copied into these parts only. The list of hot profiles is at most ``HOT_PROFILES`` rows and
    is broadcast to both sides. The counts steer the balance only; any counts give the same rows.
    """
    if "subjects" not in per_profile.columns:
        return _meets(subjects, per_profile)
    hot = F.broadcast(hot_profiles(per_profile, split))
    parts = F.coalesce("parts", F.lit(1))
    left = _meets(subjects, hot).withColumn("_part", F.pmod(F.xxhash64("id"), parts).cast("int")).drop("parts")
    right = _meets(per_profile, hot).withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts", "subjects")
    return _meets(left, right, (*PROFILE, "_part")).drop("_part")


def comparables(
    listings: DataFrame, subjects: DataFrame, neighbours: DataFrame, rule: CompRule = SOLD, exclude_self: bool = False
) -> DataFrame:
    """One row per subject and comparable: subject_id, rank, comp_id, score, price, ..."""
    best = profile_comps(listings, subjects, neighbours, rule, exclude_self)
    rows = attach(profiled(subjects).select("id", *PROFILE), best)
    comps = F.col("comps")
    if exclude_self:
        comps = F.slice(F.filter("comps", lambda c: c["id"] != F.col("id")), 1, rule.keep)
    return rows.select(F.col("id").alias("subject_id"), F.posexplode(comps).alias("p", "c")).select(
        "subject_id",
        (F.col("p") + 1).alias("rank"),
        F.col("c.id").alias("comp_id"),
        "c.score", "c.price", "c.beds", "c.per_bed", "c.dated",
    )


def _values(comps: Column, field: str) -> Column:
    return F.filter(F.transform(comps, lambda c: c[field]), lambda v: N.present(v).isNotNull())


def comp_stats(per_profile: DataFrame) -> DataFrame:
    """Per profile: n, low, high, median, median per bed, and the comparables."""
    prices, per_bed = _values(F.col("comps"), "price"), _values(F.col("comps"), "per_bed")
    n = F.size(prices)
    return per_profile.select(
        "*",
        n.alias("n"),
        F.array_min(prices).alias("low"),
        F.array_max(prices).alias("high"),
        N.array_median(prices).alias("median"),
        N.array_median(per_bed).alias("median_per_bed"),
        L.evidence_confidence(n).alias("confidence"),
    )


def price_read(
    listings: DataFrame, subjects: DataFrame, neighbours: DataFrame, stats: DataFrame | None = None, shown: int | None = 6
) -> DataFrame:
    """Comparable-led read of each subject's asking price (sale side). ``shown`` of the ``n`` comparables are listed (None: all)."""
    stats = comp_stats(profile_comps(listings, subjects, neighbours, SOLD)) if stats is None else stats
    ask = N.ask_price(F.col("price_exact"), F.col("price_from"), F.col("price_to"))
    rows = attach(profiled(subjects), stats).withColumn("ask", ask)
    none = F.coalesce("n", F.lit(0))
    rows = rows.withColumn("n", none).withColumn("confidence", F.coalesce("confidence", F.lit("none")))
    label = L.fairness(F.col("ask"), F.col("median"), F.col("low"), F.col("high"))
    return (
        rows.withColumn("fairness", label)
        .withColumn("underquote", L.underquote(F.col("ask"), F.col("median"), F.col("n"), F.col("confidence")))
        .withColumn("posture", L.posture(F.col("fairness")))
        .withColumn("price_per_bed", N.per_bed(F.col("ask"), F.col("beds")))
        .withColumn("top_comps", first_of(F.col("comps"), shown))
    )


def rent_read(
    listings: DataFrame,
    subjects: DataFrame,
    neighbours: DataFrame,
    budget: Column | None = None,
    stats: DataFrame | None = None,
    shown: int | None = 6,
) -> DataFrame:
    """Comparable-led read of each subject's weekly rent. ``shown`` of the ``n`` comparables are listed (None: all)."""
    stats = comp_stats(profile_comps(listings, subjects, neighbours, RENT)) if stats is None else stats
    ask = N.ask_price(F.col("price_exact"), F.col("price_from"), F.col("price_to"))
    rows = attach(profiled(subjects), stats).withColumn("ask", ask)
    rows = rows.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("confidence", F.coalesce("confidence", F.lit("none")))
    label = L.fairness(F.col("ask"), F.col("median"), F.col("low"), F.col("high"))
    budget = F.lit(None).cast("double") if budget is None else budget
    return (
        rows.withColumn("fairness", label)
        .withColumn("posture", L.rent_posture(F.col("fairness")))
        .withColumn("rent_per_bed", N.per_bed(F.col("ask"), F.col("beds")))
        .withColumn("affordability", L.rent_budget_read(F.col("ask"), budget))
        .withColumn("annual_burden", F.col("ask") * 52)
        .withColumn("urgency", L.rent_urgency(F.col("fairness"), F.col("confidence")))
        .withColumn("top_comps", first_of(F.col("comps"), shown))
    )


def area_rents(listings: DataFrame) -> DataFrame:
    """Number of advertised weekly rents per (area, beds, rent): the base of `weekly_rent`."""
    rent = F.coalesce(
        N.present(F.col("price_from").cast("double")),
        N.present(F.col("price_to").cast("double")),
        N.display_price(F.col("price_display")),
    )
    return (
        listings.where("mode = 'rent'")
        .select(F.lower("suburb").alias("area"), F.col("beds").cast("int").alias("rent_beds"), rent.alias("rent"))
        .where("area is not null and rent between 100 and 5000")
        .groupBy("area", "rent_beds", "rent")
        .agg(F.count("*").alias("c"))
    )


def weekly_rent(listings: DataFrame, subjects: DataFrame) -> DataFrame:
    """(area, beds) -> median advertised weekly rent of the area within one bedroom.

    Missing or zero bedrooms on either side pass. Rents enter as counts per distinct
    value, and the median is read from cumulative counts: per (area, beds) at most the
    distinct rents up to 5000 are ordered.
    """
    wanted = subjects.select(F.lower("suburb").alias("area"), F.col("beds").alias("beds")).where("area is not null").distinct()
    b, r = N.present(F.col("beds").cast("int")), N.present(F.col("rent_beds"))
    near = b.isNull() | r.isNull() | (F.abs(b - r) <= 1)
    counts = (
        wanted.join(area_rents(listings), "area").where(near).groupBy("area", "beds", "rent").agg(F.sum("c").alias("c"))
    )
    w = Window.partitionBy("area", "beds")
    upto = F.sum("c").over(w.orderBy("rent").rowsBetween(Window.unboundedPreceding, 0))
    rows = counts.withColumn("upto", upto).withColumn("n", F.sum("c").over(w))
    middle = rows.where(
        (F.col("upto") > F.floor((F.col("n") - 1) / 2)) & (F.col("upto") - F.col("c") <= F.floor(F.col("n") / 2))
    )
    return middle.groupBy("area", "beds").agg(
        F.bround((F.min("rent") + F.max("rent")) / 2.0).alias("weekly_rent"), F.max("n").alias("rent_n")
    )
