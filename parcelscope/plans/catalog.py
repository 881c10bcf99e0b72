"""Named queries: every operator over the whole given tables.

Each query takes (spark, folder of the tables). Outputs are plain numbers and texts;
times are microseconds since the epoch, dates ISO texts, lists joined texts.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from parcelscope import vocab
from parcelscope.functions import labels as L, numbers as N, tags as G, text as X
from parcelscope.functions.payload import internal_area
from parcelscope.operators import (
    agents as A, briefs as B, checks as K, comps as C, facts as FX, history as H, hunts as U, inspections as I,
    market as M, scoring as V, signals as S,
)
from parcelscope.operators.rules import exploded
from parcelscope.operators.store import Store, newest_wins
from parcelscope.operators.versions import Version, read_versions, write_version
from parcelscope.plans import decision as D, reports as R
from parcelscope.session import once, settle, shared_folder, spread
from parcelscope.sources import connectors, pages as P, providers, raw as W, tables as T
from parcelscope.streaming import observe as O

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
AS_OF = "2001-08-02"
SEEDS = ("NATION_1", "NATION_7")
BUDGET = 200000.0


def query(fn: Query) -> Query:
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


def us(c: str | Column) -> Column:
    return F.unix_micros(F.col(c) if isinstance(c, str) else c)


def iso(c: str) -> Column:
    return F.col(c).cast("string").alias(c)


def whole(*names: str) -> list[Column]:
    return [F.col(n).cast("bigint").alias(n.split(".")[-1]) for n in names]


def flag(c: Column) -> Column:
    return c.cast("int").cast("bigint")


def listed(c: Column | str, sep: str = "|") -> Column:
    return F.array_join(c, sep)


# ---- market -----------------------------------------------------------------------


@query
def sales_summary(spark, sf):
    rows = M.sales_summary(T.listings(spark, sf), days=None)
    return rows.select("suburb", *whole("sold_count", "median_price", "min_price", "max_price", "price_per_bed"), iso("first_sold"), iso("last_sold"))


@query
def sales_window(spark, sf):
    rows = M.sales_summary(T.listings(spark, sf), as_of=AS_OF, days=365, beds_min=2)
    return rows.select("suburb", *whole("sold_count", "median_price", "min_price", "max_price", "price_per_bed"), iso("first_sold"), iso("last_sold"))


@query
def recent_sales(spark, sf):
    scope = T.neighbours(spark, sf).where(F.col("area").isin([s.lower() for s in SEEDS])).select(F.col("neighbour").alias("suburb"))
    rows = M.recent_sales(T.listings(spark, sf), limit=50, as_of=AS_OF, days=900, suburbs=scope)
    return rows.select("id", "suburb", "address", N.whole(F.col("sold_price")).alias("sold_price"), iso("sold_date"), "sale_method", "beds", "property_type")


@query
def area_stats(spark, sf):
    rows = M.area_stats(T.listings(spark, sf))
    return rows.select(*M.AREA, *whole("n", "min_price", "max_price"), N.rounded(F.col("avg_price"), 2).alias("avg_price"), N.rounded(F.col("avg_beds"), 4).alias("avg_beds"))


@query
def area_rank(spark, sf):
    return M.area_rank(T.listings(spark, sf), "sold", budget_min=20000.0, budget_max=BUDGET, min_count=5)


@query
def area_activity(spark, sf):
    return M.area_rank(T.listings(spark, sf), "rent").drop("affordability")


@query
def area_candidates(spark, sf):
    listings = T.listings(spark, sf)
    seeds = T.nation_areas(spark, sf).where(F.col("n_name").isin(*SEEDS)).select(F.col("n_name").alias("suburb"))
    return M.area_candidates(listings, seeds, mode="sale").select(*M.AREA, *whole("n"))


@query
def mode_rollup(spark, sf):
    return M.mode_counts(T.listings(spark, sf)).select(F.coalesce("mode", F.lit("all")).alias("mode"), *whole("n"))


@query
def brief_searches(spark, sf):
    rows = B.filter_map(B.searches(T.briefs(spark, sf)))
    pairs = F.array_sort(F.transform(F.map_entries("filters"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return rows.select("brief_id", "name", listed(pairs).alias("filters"))


@query
def search_matches(spark, sf):
    rows = M.search(T.listings(spark, sf), B.searches(T.briefs(spark, sf)))
    return rows.select("q_name", "id", "mode", "suburb", "beds")


@query
def search_unbounded(spark, sf):
    """Matches of searches that name a region only or no locality; counted, as those without any meet every listing."""
    asks = B.searches(T.open_briefs(spark, sf)).withColumn("name", F.concat_ws("/", "brief_id", "name"))
    rows = M.search(T.listings(spark, sf), asks)
    return rows.groupBy("q_name").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.countDistinct("suburb").alias("suburbs"))


@query
def cache_latest(spark, sf):
    return S.latest_estimates(T.estimate_captures(spark, sf), ("captured_at", "seq"))


@query
def search_results(spark, sf):
    rows = M.search(T.listings(spark, sf), B.searches(T.briefs(spark, sf)))
    return M.search_page(rows, "price-asc", page=2, size=5).select("q_name", *whole("position"), "id", *whole("price_from"))


@query
def search_own_pages(spark, sf):
    """Every search's own order, page and page size at once; buy and rent searches take theirs from the brief's number."""
    nth = F.regexp_extract("brief_id", r"\d+", 0).cast("int")
    orders = F.array(*[F.lit(o) for o in ("price-asc", "price-desc", "dateupdated-desc", "id")])
    asks = B.searches(T.briefs(spark, sf)).withColumn("name", F.concat_ws("/", "brief_id", "name"))
    asks = asks.withColumn("sort", F.when(F.col("mode") == "sold", F.col("sort")).otherwise(F.get(orders, nth % 4)))
    asks = asks.withColumn("page", 1 + nth % 2).withColumn("size", 2 + nth % 3)
    rows = M.search_own_pages(M.search(T.listings(spark, sf), asks))
    return rows.select("q_name", "q_sort", *whole("position"), "id", *whole("price_from"))


# ---- expressions ------------------------------------------------------------------


@query
def price_text_parse(spark, sf):
    price, k = F.col("o_totalprice"), F.col("o_orderkey")
    dollars = lambda c: F.concat(F.lit("$"), F.format_number(N.whole(c), 0))
    text = (
        F.when(k % 6 == 0, F.concat(dollars(price), F.lit(" - "), dollars(price * 1.1)))
        .when(k % 6 == 1, F.concat(F.lit("From $"), N.whole(price / 1000).cast("string"), F.lit("k")))
        .when(k % 6 == 2, F.concat(F.lit("$"), N.whole(price / 1e5).cast("string"), F.lit(".5m to $9m")))
        .when(k % 6 == 3, F.lit("Contact agent"))
        .when(k % 6 == 4, F.concat(dollars(price / 500), F.lit(" per week")))
        .otherwise(F.concat(F.lit("Guide "), F.format_number(N.whole(price), 0)))
    )
    rows = T.table(spark, sf, "orders").select(k.alias("id"), text.alias("t"))
    return rows.select("id", N.display_price(F.col("t")).alias("shown"), N.first_amount(F.col("t")).alias("amount"))


@query
def ask_prices(spark, sf):
    ask = N.ask_price(F.col("price_exact"), F.col("price_from"), F.col("price_to"))
    best = N.effective_price(F.col("sold_price"), F.col("price_from"), F.col("price_to"), F.col("price_display"))
    return T.listings(spark, sf).select(
        "id", ask.alias("ask"), best.alias("effective"), N.per_bed(ask, F.col("beds")).alias("per_bed"),
        N.sold_price(F.col("sold_price"), F.col("price_display")).alias("sold"),
        N.as_int(F.concat(F.col("beds").cast("string"), F.when(F.col("beds") > 3, "x").otherwise(""))).alias("beds_int"),
    )


@query
def tax_bands(spark, sf):
    price = F.col("l_extendedprice") * 20
    rows = T.table(spark, sf, "lineitem").select(N.transfer_duty(price).alias("duty"), N.cash_to_buy(price).alias("cash"))
    return rows.groupBy("duty", "cash").agg(F.count("*").alias("n"))


@query
def localities(spark, sf):
    slug = X.locality_slug(F.concat(F.col("c_name"), F.lit(" NSW "), (F.col("c_custkey") % 900 + 2000).cast("string")))
    rows = T.table(spark, sf, "customer").select("c_custkey", slug.alias("slug"))
    place = X.slug_locality(F.col("slug"))
    return rows.select(F.col("c_custkey").alias("id"), "slug", place["suburb"].alias("suburb"), place["state"].alias("state"))


@query
def url_localities(spark, sf):
    place = X.url_locality(F.col("url"))
    return T.table(spark, sf, "pages").select("page_id", place["suburb"].alias("suburb"), place["state"].alias("state"))


@query
def payload_areas(spark, sf):
    return T.listings(spark, sf).select("id", internal_area(F.col("raw_json")).alias("area"))


@query
def tag_reads(spark, sf):
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "d MMM yyyy")
    text = (
        F.when(k % 6 == 0, F.concat(F.lit("Sold by private treaty "), day))
        .when(k % 6 == 1, F.concat(F.lit("Sold at auction "), day))
        .when(k % 6 == 2, F.concat(F.lit("Leased "), day))
        .when(k % 6 == 3, F.lit("Under offer"))
        .when(k % 6 == 4, F.concat(F.lit("Sold prior to auction "), F.date_format("o_orderdate", "dd MMMM yyyy")))
        .otherwise(F.lit("New"))
    )
    cls = F.when(k % 10 == 0, "is-undercontract").otherwise("is-new")
    off = G.off_market(text, cls)
    rows = T.table(spark, sf, "orders").select(k.alias("id"), off.alias("off"))
    return rows.select("id", F.col("off.status").alias("status"), F.col("off.sale_method").alias("method"), F.col("off.sold_date").cast("string").alias("sold_date"))


@query
def preference_flags(spark, sf):
    rows = T.text_listings(spark, sf)
    rows = V.with_phrases(once(rows, text=V.score_text(rows)).select("id", "text"), "text", likes="f")
    return rows.select("id", *[flag(F.col(f"f.{n}")).alias(n) for n, *_ in vocab.PREFERENCES])


@query
def media_groups(spark, sf):
    m = G.grouped_media(F.col("images"))
    return T.listings(spark, sf).select(
        "id", listed(m["photos"]).alias("photos"), listed(m["floorplans"]).alias("floorplans"), listed(m["other"]).alias("other")
    )


# ---- history ----------------------------------------------------------------------


def _stale(spark, sf) -> DataFrame:
    gone = U.vanished(T.run_listings(spark, sf), T.runs(spark, sf))
    return gone.select("id", F.col("run_at").alias("observed_at")).distinct()


def _events(spark, sf) -> DataFrame:
    return H.lifecycle_events(T.observations(spark, sf), _stale(spark, sf))


def _event_rows(events: DataFrame) -> DataFrame:
    return events.select("id", us("observed_at").alias("at_us"), *whole("seq", "ord"), "event_type", "previous_value", "current_value", "summary")


@query
def snapshot_diff(spark, sf):
    rows = H.snapshots(T.observations(spark, sf))
    return rows.select("id", us("observed_at").alias("at_us"), *whole("seq"), "price_display", *whole("price_from", "price_to"), "status")


@query
def price_events(spark, sf):
    return _event_rows(H.price_events(T.observations(spark, sf)))


@query
def price_history_events(spark, sf):
    rows = H.price_events(T.price_history(spark, sf))
    return rows.groupBy("id", "event_type").agg(F.count("*").alias("n"))


@query
def status_events(spark, sf):
    return _event_rows(H.status_events(T.observations(spark, sf)))


@query
def inspection_changes(spark, sf):
    return _event_rows(H.inspection_events(T.observations(spark, sf)))


@query
def lifecycle(spark, sf):
    return _event_rows(_events(spark, sf))


@query
def latest_event(spark, sf):
    return H.latest_event(H.price_events(T.observations(spark, sf))).select("id", us("observed_at").alias("at_us"), "event_type")


@query
def latest_changes(spark, sf):
    rows = H.latest_changes(H.price_events(T.observations(spark, sf)), 5)
    return rows.select("id", *whole("rank"), us("observed_at").alias("at_us"), "event_type")


@query
def state_fold(spark, sf):
    rows = H.state_fold(T.observations(spark, sf))
    return rows.select("id", "mode", "status", "headline", "price_display", *whole("price_from"), us("first_seen").alias("first_us"), us("last_seen").alias("last_us"))


@query
def state_merge(spark, sf):
    """The fold of the later half merged into the fold of the earlier half."""
    rows = T.observations(spark, sf).drop("inspections")
    cut = F.lit("2024-01-16").cast("timestamp")
    merged = H.merge_state(H.state_fold(rows.where(F.col("observed_at") < cut)), H.state_fold(rows.where(F.col("observed_at") >= cut)))
    return merged.select("id", "mode", "status", "headline", "price_display", *whole("price_from"), us("first_seen").alias("first_us"), us("last_seen").alias("last_us"))


CUTS = ("0001-01-01", "2024-01-11", "2024-01-21", "9999-01-01")  # instalments in which stored tables are merged


def _instalments(rows: DataFrame, time: str) -> list[DataFrame]:
    at = F.col(time)
    return [rows.where((at >= F.lit(a).cast("timestamp")) & (at < F.lit(b).cast("timestamp"))) for a, b in zip(CUTS, CUTS[1:], strict=False)]


def _stored(spark, purpose, like: DataFrame, key=("id",)) -> Store:
    return Store(spark, shared_folder(spark, purpose), like.schema, key)


@query
def state_stored(spark, sf):
    """State kept in a stored table: three instalments merged one after the other, the last one twice."""
    folds = [H.state_fold(part) for part in _instalments(T.observations(spark, sf).drop("inspections"), "observed_at")]
    store = _stored(spark, "state", folds[0])
    for fold in [*folds, folds[-1]]:
        store.merge(fold, H.merge_state)
    return store.read().select("id", "mode", "status", "headline", "price_display", *whole("price_from"), us("first_seen").alias("first_us"), us("last_seen").alias("last_us"))


@query
def hunts_stored(spark, sf):
    """Search definitions upserted run by run: the latest record stays, with the first and last run."""
    store, rule = None, newest_wins(("hunt",), ("first_run",), ("last_run",))
    for part in _instalments(T.runs(spark, sf), "run_at"):
        latest = U.latest_runs(part).select("hunt", "total_results", "blocked", F.col("run_at").alias("last_run"))
        rows = latest.join(part.groupBy("hunt").agg(F.min("run_at").alias("first_run")), "hunt")
        store = store or _stored(spark, "hunts", rows, ("hunt",))
        store.merge(rows, rule)
    return store.read().select("hunt", *whole("total_results"), flag(F.col("blocked")).alias("blocked"), us("first_run").alias("first_us"), us("last_run").alias("last_us"))


@query
def seen_stored(spark, sf):
    """Membership of the last instalment, marked new against the stored set of what each search saw before; that set then takes it up."""
    *earlier, last = _instalments(T.run_listings(spark, sf), "run_at")
    rule = newest_wins(("hunt", "id"), ("first_run",), ("last_run",))
    spans = lambda part: part.groupBy("hunt", "id").agg(F.min("run_at").alias("first_run"), F.max("run_at").alias("last_run"))
    store = _stored(spark, "seen", spans(last), ("hunt", "id"))
    for part in earlier:
        store.merge(spans(part), rule)
    marked = settle(U.record_members(last, store.read()), "marked")
    store.merge(spans(last), rule)
    rows = marked.join(store.read(), ["hunt", "id"])
    return rows.select("hunt", us("run_at").alias("run_us"), "id", flag(F.col("is_new")).alias("is_new"), us("first_run").alias("first_us"), us("last_run").alias("last_us"))


@query
def stored_versions(spark, sf):
    """Listings written by three generations of a table: columns added with defaults, whole numbers that became wider."""
    listings, folder = T.listings(spark, sf), shared_folder(spark, "versions")
    some = lambda c: F.when(F.col("listing_key") % 5 > 0, F.col(c)).alias(c)
    base = [F.col("id"), F.col("suburb")]
    generations = {
        1: [*base, F.col("price_from").cast("int"), F.col("beds").cast("smallint")],
        2: [*base, F.col("price_from").cast("int"), F.col("beds").cast("int"), some("listing_type")],
        3: [*base, F.col("price_from").cast("bigint"), F.col("beds").cast("double"), some("listing_type"), some("status")],
    }
    defaults = {2: {"listing_type": "listing"}, 3: {"status": "unknown"}}
    versions = []
    for number, columns in generations.items():
        rows = listings.where(F.col("listing_key") % 3 == number - 1).select(*columns)
        write_version(rows, folder, number)
        versions.append(Version(number, rows.schema, defaults.get(number, {})))
    return read_versions(spark, folder, versions).withColumn("version", F.col("version").cast("bigint"))


@query
def why_now(spark, sf):
    return H.why_now(_events(spark, sf))


@query
def lifecycle_summary(spark, sf):
    rows = H.lifecycle_summary(T.observations(spark, sf), _events(spark, sf))
    return rows.select("id", us("first_seen").alias("first_us"), us("last_seen").alias("last_us"), "status", *whole("snapshot_count", "price_drops"), flag(F.col("changed")).alias("changed"))


@query
def inspection_table(spark, sf):
    rows = H.inspection_table(T.observations(spark, sf))
    return rows.select("id", "start", "end")


@query
def media_table(spark, sf):
    rows = T.listings(spark, sf).select("id", F.col("last_seen").alias("observed_at"), F.col("listing_key").alias("seq"), "images")
    return H.media_table(rows).select("id", "url", "media_type", *whole("position"))


# ---- hunts ------------------------------------------------------------------------


def _runs(spark, sf):
    return T.run_listings(spark, sf), T.runs(spark, sf)


def _run_rows(rows: DataFrame) -> DataFrame:
    return rows.select("hunt", us("run_at").alias("run_us"), "id")


@query
def new_listings(spark, sf):
    return _run_rows(U.new_listings(*_runs(spark, sf)))


@query
def stale_listings(spark, sf):
    return _run_rows(U.vanished(*_runs(spark, sf)))


@query
def relisted(spark, sf):
    return _run_rows(U.returned(*_runs(spark, sf)))


@query
def hunt_diff(spark, sf):
    members, runs = _runs(spark, sf)
    rows = U.latest_diff(members, runs, H.price_events(T.observations(spark, sf)))
    return rows.select("hunt", us("run_at").alias("run_us"), "id", "section")


@query
def changed_since(spark, sf):
    return hunt_diff(spark, sf).where("section = 'changed'").drop("section")


@query
def hunt_report(spark, sf):
    members, runs = _runs(spark, sf)
    rows = U.hunt_report(members, runs, H.price_events(T.observations(spark, sf)))
    return rows.select(
        "hunt", us("run_at").alias("run_us"), flag(F.col("blocked")).alias("blocked"),
        *whole("total_results", "new_count", "changed_count", "stale_count", "delta"), "direction",
    )


@query
def run_totals(spark, sf):
    members, runs = _runs(spark, sf)
    rows = U.run_totals(U.hunt_report(members, runs, H.price_events(T.observations(spark, sf))))
    return rows.select(*whole("hunts", "total_new", "total_changed", "total_stale"))


@query
def stale_preview(spark, sf):
    return U.stale_preview(*_runs(spark, sf)).select("hunt", *whole("rank"), "id")


@query
def run_membership(spark, sf):
    members, _ = _runs(spark, sf)
    first = members.groupBy("hunt").agg(F.min("run_at").alias("first_at"))
    known = members.join(first, "hunt").where("run_at = first_at").select("hunt", "id")
    later = members.join(first, "hunt").where("run_at > first_at").drop("first_at")
    rows = U.record_members(later, known)
    return rows.select("hunt", us("run_at").alias("run_us"), "id", flag(F.col("is_new")).alias("is_new"))


@query
def supply_trend(spark, sf):
    rows = U.supply_trend(T.runs(spark, sf))
    history = F.transform("history", lambda h: h["total_results"].cast("string"))
    return rows.select("hunt", *whole("current", "previous", "delta", "avg_recent", "n_runs"), "pct_change", "direction", listed(history).alias("history"))


# ---- agents -----------------------------------------------------------------------


def _agent_metrics(spark, sf):
    return A.agent_metrics(T.listings(spark, sf), T.agent_links(spark, sf), H.price_events(T.price_history(spark, sf)))


@query
def agent_metrics(spark, sf):
    rows = _agent_metrics(spark, sf)
    return rows.select("agent_id", *whole("listings_seen", "listings_sold", "price_drops_observed", "underquote_signals"), "avg_guide_vs_sold")


@query
def agent_rank(spark, sf):
    rows = A.agent_rank(_agent_metrics(spark, sf), T.agents(spark, sf), min_seen=5)
    return rows.select("agent_id", "name", "agency", *whole("listings_seen", "price_drops_observed", "underquote_signals"), "guide_read")


def _sightings(spark, sf):
    rows = T.listings(spark, sf)
    return rows.withColumn("observed_at", F.col("last_seen")).withColumn("seq", F.col("listing_key")).withColumn("agency_name", F.col("suburb"))


@query
def agent_directory(spark, sf):
    return A.agent_table(_sightings(spark, sf)).select("name", "agency", "mobile", "email")


@query
def agent_listings(spark, sf):
    rows = A.listing_links(_sightings(spark, sf))
    names = A.agent_table(_sightings(spark, sf)).select(F.col("agent_key").alias("agent_id"), "name", "agency")
    return rows.join(names, "agent_id").groupBy("name", "agency").agg(F.count("*").alias("n"))


# ---- comparables and value --------------------------------------------------------


def _market(spark, sf):
    return T.listings(spark, sf), T.neighbours(spark, sf)


def _comp_rows(rows: DataFrame) -> DataFrame:
    return rows.select("subject_id", *whole("rank"), "comp_id", *whole("score"), "price", "per_bed")


@query
def sold_comps(spark, sf):
    listings, near = _market(spark, sf)
    return _comp_rows(C.comparables(listings, listings.where("mode = 'sale'"), near, C.SOLD))


@query
def sold_comps_others(spark, sf):
    """Sold subjects, each without itself among its comparables."""
    listings, near = _market(spark, sf)
    return _comp_rows(C.comparables(listings, listings.where("mode = 'sold'"), near, C.SOLD, exclude_self=True))


@query
def rental_comps(spark, sf):
    listings, near = _market(spark, sf)
    return _comp_rows(C.comparables(listings, listings.where("mode = 'rent'"), near, C.RENT))


@query
def comp_valuation(spark, sf):
    listings, near = _market(spark, sf)
    rows = C.price_read(listings, listings.where("mode = 'sale'"), near)
    return rows.select(
        "id", "ask", *whole("n"), "low", "high", "median", "median_per_bed", "price_per_bed", "fairness", "confidence", "posture",
        listed(F.transform("top_comps", lambda c: c["id"])).alias("comps"),
    )


@query
def rent_valuation(spark, sf):
    listings, near = _market(spark, sf)
    rows = C.rent_read(listings, listings.where("mode = 'rent'"), near, F.lit(2500.0))
    return rows.select("id", "ask", *whole("n"), "low", "high", "median", "rent_per_bed", "fairness", "confidence", "affordability", "annual_burden", "urgency")


@query
def underquote(spark, sf):
    listings, near = _market(spark, sf)
    rows = C.price_read(listings, listings.where("mode = 'sale'"), near).where("underquote is not null")
    return rows.select("id", F.col("underquote.severity").alias("severity"), F.col("underquote.gap_pct").alias("gap_pct"), *whole("underquote.implied_price"))


@query
def area_weekly_rent(spark, sf):
    listings, _ = _market(spark, sf)
    return C.weekly_rent(listings, listings).select("area", "beds", "weekly_rent", *whole("rent_n"))


def _signals(spark, sf) -> DataFrame:
    listings, near = _market(spark, sf)
    return S.signals(listings, listings.where("mode = 'sale'"), near, T.avm_cache(spark, sf))


def _signal(spark, sf, method: str) -> DataFrame:
    rows = S.signal_rows(_signals(spark, sf)).where(F.col("method") == method)
    return rows.select("id", "point", "low", "high", "confidence", *whole("n"))


@query
def signal_median(spark, sf):
    return _signal(spark, sf, "comparable_median")


@query
def signal_per_bed(spark, sf):
    return _signal(spark, sf, "per_bed")


@query
def signal_per_sqm(spark, sf):
    return _signal(spark, sf, "per_sqm")


@query
def signal_yield(spark, sf):
    return _signal(spark, sf, "yield_implied")


@query
def signal_captured(spark, sf):
    return _signal(spark, sf, "avm")


@query
def signal_provided(spark, sf):
    """Signals of a value provider that a caller adds: here what a listing's line items add up to, in thousands."""
    listings, near = _market(spark, sf)

    def priced(subjects: DataFrame) -> DataFrame:
        parts = T.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("id")).agg(F.count("*").alias("n"), F.max("l_extendedprice").alias("top"))
        point = N.whole(F.col("top") * 3)
        given = S.signal(F.col("n") > 3, "provided", point, point - 1000, point + 1000, F.lit("medium"), F.col("n"), "line items")
        return subjects.select("id").join(parts, "id").select("id", given.alias("value"))

    rows = S.signals(listings, listings.where("mode = 'sale'"), near, T.avm_cache(spark, sf), [priced])
    rows = S.signal_rows(rows).where("method = 'provided'")
    return rows.select("id", "point", "low", "high", "confidence", *whole("n"))


@query
def signal_hedonic(spark, sf):
    return _signal(spark, sf, "hedonic")


@query
def hedonic_texts(spark, sf):
    rows = once(T.text_listings(spark, sf), _text=S.hedonic_text())
    text = F.col("_text")
    return rows.select("id", N.rounded(S.hedonic_adjustment(text), 4).alias("adjustment"), listed(S.hedonic_reasons(text)).alias("reasons"))


@query
def signal_order(spark, sf):
    rows = S.signal_rows(_signals(spark, sf))
    return rows.select("id", *whole("rank"), "method", N.rounded(F.col("weight"), 4).alias("weight"))


@query
def reconcile(spark, sf):
    rows = S.reconcile(_signals(spark, sf)).where("estimate is not null")
    return rows.select("id", *whole("estimate.point", "estimate.low", "estimate.high", "estimate.signal_count"), F.col("estimate.confidence").alias("confidence"), F.col("estimate.agreement").alias("agreement"))


@query
def ask_position(spark, sf):
    listings, near = _market(spark, sf)
    rows = S.valuation_case(listings, listings.where("mode = 'sale'"), near, T.avm_cache(spark, sf)).where("asking is not null")
    return rows.select("id", *whole("asking.asking", "asking.negotiation_headroom"), F.col("asking.position").alias("position"), F.col("asking.verdict").alias("verdict"))


# ---- rules and scores -------------------------------------------------------------


def _paired(spark, sf):
    return B.with_brief(T.text_listings(spark, sf), T.briefs(spark, sf))


@query
def risk_flags(spark, sf):
    rows = K.with_risks(_paired(spark, sf))
    sev = K.severity_counts(F.col("risks.items"))
    return rows.select(
        "brief_id", "id", F.size("risks.items").cast("bigint").alias("n"), F.col("risks.penalty").alias("penalty"),
        flag(F.col("risks.has_dealbreaker")).alias("has_dealbreaker"), F.col("risks.summary").alias("top_risk"),
        listed(F.transform("risks.top", lambda r: r["label"])).alias("top"),
        sev["major"].cast("bigint").alias("majors"), sev["unknown"].cast("bigint").alias("unknowns"),
    )


@query
def risk_items(spark, sf):
    rows = K.with_risks(_paired(spark, sf)).withColumn("items", F.col("risks.items"))
    return exploded(rows, "items", ("brief_id", "id")).select("brief_id", "id", *whole("rank"), "severity", "category", "label", "evidence", flag(F.col("known")).alias("known"))


@query
def diligence(spark, sf):
    rows = K.with_diligence(_paired(spark, sf))
    return rows.select(
        "brief_id", "id", *whole("diligence.critical_count", "diligence.unknown_count"), F.col("diligence.summary").alias("summary"),
        listed(F.transform("diligence.items", lambda i: F.concat_ws(":", i["category"], i["status"], i["severity"]))).alias("items"),
    )


def _decisions(spark, sf, subjects: DataFrame, deal: bool = True) -> DataFrame:
    listings, near = _market(spark, sf)
    return D.decide(subjects, listings, T.briefs(spark, sf), near, T.avm_cache(spark, sf), deal)


@query
def actions(spark, sf):
    rows = _decisions(spark, sf, T.text_listings(spark, sf), deal=False)
    return rows.select("brief_id", "id", listed(F.transform("actions", lambda a: a["type"])).alias("actions"), F.col("best_action.label").alias("best"))


def _scored(spark, sf, paired: DataFrame) -> DataFrame:
    """Listings scored for their briefs. The rents asked for are those of all listings, so that no text is read for them."""
    listings = T.listings(spark, sf)
    rents = settle(C.weekly_rent(listings, listings).select("area", "beds", "weekly_rent"), "rents")
    return V.with_viability(K.with_risks(paired.withColumn("area", F.lower("suburb")).join(rents, ["area", "beds"], "left")))


@query
def viability(spark, sf):
    rows = _scored(spark, sf, _paired(spark, sf))
    v = lambda c: F.col(f"viability.{c}").alias(c)
    return rows.select(
        "brief_id", "id", *map(v, ("score", "band", "lens", "hard_criteria", "budget_fit", "yield_or_lifestyle", "preference_match", "dealbreaker_penalty", "gross_yield_pct"))
    )


@query
def viability_notes(spark, sf):
    """What speaks against each listing, what else there is to know, and which wishes it meets."""
    rows = _scored(spark, sf, _paired(spark, sf))
    v = lambda c: listed(F.col(f"viability.{c}")).alias(c)
    return rows.select("brief_id", "id", v("violations"), v("signals"), v("matched"), v("missing"))


@query
def decision(spark, sf):
    rows = D.summary(_decisions(spark, sf, T.dealt_listings(spark, sf), deal=False))
    return rows.select("*").withColumn("independent_estimate", F.col("independent_estimate").cast("bigint"))


@query
def shortlist(spark, sf):
    rows = R.shortlist(_decisions(spark, sf, T.listings(spark, sf)), limit=20)
    return rows.select("brief_id", "id", "score", "band", "suburb", "fairness", "confidence", "top_risk")


def _raw_listings(spark, sf) -> DataFrame:
    """Every listing as stored text only: its fields as JSON, at a place that differs from listing to listing."""
    listings = spread(T.listings(spark, sf), "listing_key")
    model = F.to_json(F.struct("*"))
    deep = F.concat(F.lit('{"props":{"pageProps":[{"ad":1},{"componentProps":{"listingModel":'), model, F.lit('}}],"build":"x"}}'))
    flat = F.concat(F.lit('{"listingModel":'), model, F.lit("}"))
    inner = F.concat(F.lit('{"results":[[{"listingModel":'), model, F.lit("}]]}"))
    place = F.col("listing_key") % 3
    return listings.select("id", F.when(place == 0, flat).when(place == 1, deep).otherwise(inner).alias("stored"))


@query
def raw_models(spark, sf):
    """Listing objects found at unknown places of stored text."""
    found = W.find_objects(_raw_listings(spark, sf), "stored", "listingModel", narrow=True)
    schema = T.listings(spark, sf).select("price_from", "beds", "suburb", "images").schema
    rows = W.typed(found, "found", schema, ("id", "depth"))
    return rows.select("id", *whole("depth", "price_from", "beds"), "suburb", F.size("images").cast("bigint").alias("n_images"))


@query
def raw_shortlist(spark, sf):
    """All active sale listings scored again from their stored text."""
    found = W.find_objects(_raw_listings(spark, sf), "stored", "listingModel", (), narrow=True)
    subjects = W.typed(found, "found", T.listings(spark, sf).schema).where("mode = 'sale'")
    rows = R.shortlist(_decisions(spark, sf, settle(subjects, "from-raw")), limit=None, beds_max=None)
    return rows.select("brief_id", "id", "score", "band", "suburb", "fairness", "confidence", "top_risk")


@query
def ranked_properties(spark, sf):
    rows = R.ranked(_decisions(spark, sf, T.listings(spark, sf)), 5)
    return rows.select("brief_id", *whole("rank"), "id", "fit")


@query
def recommendation(spark, sf):
    rows = R.recommendation(_decisions(spark, sf, T.listings(spark, sf)))
    return rows.select("brief_id", "standout", "summary", "confidence", *[listed(c).alias(c) for c in ("reasons", "watch", "next_actions", "why_wrong")])


@query
def folio(spark, sf):
    rows = R.folio(_decisions(spark, sf, T.listings(spark, sf)), limit=10)
    return rows.select(
        "brief_id", *whole("position"), "id", "headline", "address", "price", "config", "hero", "floorplan", "fit", "brief_match",
        "budget_fit", "lens_fit", "preference_match", "penalty", "fairness", "confidence", "top_risk", "next_action",
    )


@query
def folio_people(spark, sf):
    """The report frame with stored agents and times, for listings that name nobody reachable or no times."""
    decisions = _decisions(spark, sf, T.listings(spark, sf))
    rows = R.folio(decisions, T.reachable_agents(spark, sf), H.inspection_table(T.observations(spark, sf)), limit=10)
    people = F.transform("people", lambda a: F.concat_ws(":", a["name"], a["mobile"]))
    return rows.select(
        "brief_id", *whole("position"), "id", listed(F.array_sort(people)).alias("people"), *whole("n_photos"),
        F.size("times").cast("bigint").alias("n_times"), F.get("times", F.lit(0))["start"].alias("first_time"),
    )


@query
def digest_scored(spark, sf):
    """New, changed and stale orders of quarterly searches; new ones by the score of the listing. Only new ones are scored."""
    members = T.shipment_members(spark, sf)
    diff = settle(U.latest_diff(members, T.runs_of(members), H.price_events(T.price_history(spark, sf))), "diff")
    fresh = diff.where("section = 'new'").select("id").distinct()
    scores = D.summary(_decisions(spark, sf, T.listings(spark, sf).join(fresh, "id", "left_semi")))
    return R.digest(diff, scores, top=20).select("section", *whole("rank"), "hunt", "id", "score")


@query
def digest(spark, sf):
    members, runs = _runs(spark, sf)
    events = _events(spark, sf)
    rows = R.digest(U.latest_diff(members, runs, events), reasons=H.why_now(events))
    return rows.select("section", *whole("rank"), "hunt", "id", F.coalesce("why_now", F.lit("")).alias("why_now"))


@query
def card_summaries(spark, sf):
    return R.cards(T.listings(spark, sf))


# ---- inspections and facts --------------------------------------------------------


@query
def inspection_days(spark, sf):
    return I.target_days(T.visits(spark, sf)).select("brief_id", iso("day"), *whole("n"))


@query
def inspection_run(spark, sf):
    rows = I.inspection_run(T.visits(spark, sf))
    return rows.select("brief_id", iso("day"), "id", us("start").alias("start_us"), us("end").alias("end_us"), flag(F.col("clash")).alias("clash"), "travel_note", "priority")


@query
def inspection_summary(spark, sf):
    listings = T.listings(spark, sf).withColumn("brief_id", F.col("suburb")).withColumn("fit_score", F.col("beds")).withColumn("action", F.lit("inspect"))
    rows = I.run_summary(I.inspection_run(I.visits(listings)), I.unscheduled(listings))
    return rows.select("brief_id", iso("day"), *whole("stops", "clashes", "unscheduled"), "summary")


@query
def fact_latest(spark, sf):
    return FX.latest_facts(T.facts(spark, sf)).select("key", "label", "value", "observed_at", "published_at", *whole("freshness_days"))


@query
def fact_freshness(spark, sf):
    return FX.assessed(FX.latest_facts(T.facts(spark, sf)), AS_OF).select("key", "status")


@query
def fact_citations(spark, sf):
    return FX.cited(FX.latest_facts(T.facts(spark, sf))).select("key", "citation")


@query
def source_status(spark, sf):
    rows = FX.source_status(FX.assessed(FX.latest_facts(T.facts(spark, sf)), AS_OF), ["label"])
    return rows.select("label", *whole("facts", "stale", "unknown"), "status", listed("warnings").alias("warnings"))


PAGE_PATTERNS = (
    {"key": "heading", "label": "Heading", "pattern": r"<h1[^>]*>([^<]*)</h1>"},
    {"key": "language", "label": "Language", "pattern": r'<html lang="([a-z]+)"', "freshness_days": 120},
    {"key": "rate", "label": "Rate", "pattern": r"rose\s+([0-9]+(?:\.[0-9]+)?\s*%)", "unit": "percent"},
)


@query
def page_facts(spark, sf):
    rows = FX.facts_from_text(T.table(spark, sf, "pages").select("page_id", "html"), PAGE_PATTERNS)
    return rows.select("page_id", "key", "value", "notes")


# ---- pages ------------------------------------------------------------------------


@query
def page_class(spark, sf):
    rows = P.classified(T.table(spark, sf, "pages"))
    return rows.select("page_id", "page_key", flag(F.col("structured")).alias("structured"), flag(F.col("marked")).alias("marked"), flag(F.col("denied")).alias("denied"), "page_class")


@query
def page_titles(spark, sf):
    return T.table(spark, sf, "pages").select("page_id", P.page_title(F.col("html")).alias("title"))


@query
def page_status(spark, sf):
    """Availability records of the captured pages, and of the raw web pages."""
    both = T.captured_search_pages(spark, sf).unionByName(T.table(spark, sf, "pages").select("url", "html"))
    rows = P.availability(both)
    return rows.select("url", "status", listed("blocked_markers").alias("markers"), *whole("search_result_count", "returned"), listed("sample_listing_ids").alias("sample"))


@query
def page_cards(spark, sf):
    rows = providers.search("captured_search_pages", T.captured_search_pages(spark, sf))
    off = G.off_market(F.col("tag_text"), F.col("tag_class"))
    return rows.select(
        "source_url", *whole("position"), "id", "listing_type", "url", "price_display", "suburb", "postcode", "beds", "cars", "property_type",
        F.size("images").cast("bigint").alias("images"), F.size("agents").cast("bigint").alias("agents"), off["sold_date"].cast("string").alias("off_date"),
        "source_provider", F.size("sources").cast("bigint").alias("sources"),
    )


def _text_files(rows: DataFrame, purpose: str) -> str:
    """Rows as text files of one JSON object a line; their folder."""
    path = shared_folder(rows.sparkSession, purpose)
    rows.select(F.to_json(F.struct("*"))).write.text(path)
    return path


@query
def source_cards(spark, sf):
    """Cards of captured pages that lie in a folder of text files, read by the source's name."""
    connectors.register(spark)
    folder = _text_files(T.captured_search_pages(spark, sf), "captures")
    rows = providers.search("captured_search_pages", settle(spark.read.format("captured_folder").load(folder), "captured"))
    return rows.select("source_url", *whole("position"), "id", "listing_type", "url", "price_display", "suburb", "beds", "source_provider")


@query
def source_searches(spark, sf):
    """Enabled searches of definition files, one search for each customer, and what they would match by area and size."""
    connectors.register(spark)
    key, areas = F.col("c_custkey"), T.nation_areas(spark, sf)
    customers = T.table(spark, sf, "customer").join(areas, F.col("c_nationkey") == F.col("n_nationkey"))
    filters = F.struct(F.lit("sale").alias("mode"), F.array(F.col("n_name")).alias("suburbs"), (key % 4).cast("int").alias("beds_min"))
    hunt = F.struct(
        F.concat(F.lit("search-"), key.cast("string")).alias("name"), F.when(key % 5 == 0, False).when(key % 5 > 2, True).alias("enabled"),
        (key % 50).cast("int").alias("max_items"), filters.alias("filters"),
    )
    folder = _text_files(customers.select(F.array(hunt).alias("hunts")), "definitions")
    asks = spark.read.format("saved_searches").load(folder)
    asked = asks.select("name", "max_items", F.col("filters.mode").alias("mode"), F.explode("filters.suburbs").alias("suburb"), F.col("filters.beds_min").alias("beds_min"))
    supply = T.listings(spark, sf).groupBy("mode", "suburb", "beds").agg(F.count("*").alias("c"))  # searches meet counts, not listings
    found = asked.join(supply, ["mode", "suburb"], "left")
    n = F.coalesce(F.sum(F.when(F.col("beds") >= F.col("beds_min"), F.col("c"))), F.lit(0))
    return found.groupBy("name", "max_items", "suburb", "beds_min").agg(n.alias("n")).select("name", "suburb", *whole("max_items", "beds_min", "n"))


@query
def page_details(spark, sf):
    rows = providers.search("captured_detail_pages", T.captured_detail_pages(spark, sf))
    return rows.select(
        "id", "status", "url", "headline", "price_display", *whole("price_from", "price_to"), "suburb", "beds", "cars", "property_type",
        *whole("sold_price"), iso("sold_date"), "sale_method", flag(F.size(F.filter("images", lambda i: i["type"] == "floorplan")) > 0).alias("floorplan"),
        listed(F.transform("agents", lambda a: F.concat_ws(":", a["name"], a["mobile"]))).alias("people"),
        listed(F.transform("inspections", lambda i: F.concat_ws("/", i["start"], i["end"]))).alias("times"), listed("features").alias("features"),
    )


@query
def page_open_homes(spark, sf):
    rows = P.page_events(P.search_pages(T.captured_search_pages(spark, sf)))
    return rows.select("source_url", "type", "start_date", "address")


@query
def daily_report(spark, sf):
    cards = P.search_cards(T.captured_search_pages(spark, sf))
    details = P.detail_pages(T.captured_detail_pages(spark, sf)).select("id", "headline", "price_from", "beds")
    rows = R.daily(cards, details, max_items=12, enrich_max=5)
    return rows.select("source_url", *whole("item"), "id", flag(F.col("enriched")).alias("enriched"), "headline", *whole("price_from"), "beds")


# ---- streams ----------------------------------------------------------------------


def _event_stream(spark, sf, columns):
    schema = T.table(spark, sf, "events").schema
    return O.file_stream(spark, sf, "events.parquet", schema, columns)


def _change_log(spark, sf, purpose, **settings):
    stream = _event_stream(spark, sf, T.observation_columns())
    return O.drain(spark, O.change_log(stream, **settings), purpose)


@query
def stream_events(spark, sf):
    return _event_rows(O.logged_events(_change_log(spark, sf, "stream-events")))


@query
def stream_snapshots(spark, sf):
    rows = O.logged_snapshots(_change_log(spark, sf, "stream-snapshots"))
    return rows.select("id", us("observed_at").alias("at_us"), *whole("seq"), "price_display", *whole("price_from", "price_to"), "status")


@query
def stream_lifecycle(spark, sf):
    """Events with disappearances and returns: sightings also renew the search that saw them."""
    seen = [*T.observation_columns(), *T.seen_by_columns()]
    calendar = U.calendar(T.runs(spark, sf))
    stream = _event_stream(spark, sf, seen)
    return _event_rows(O.logged_events(O.drain(spark, O.change_log(stream, "0 seconds", calendar, "run_at"), "stream-lifecycle")))


@query
def stream_vanished(spark, sf):
    rows = O.drain(spark, O.vanished(_event_stream(spark, sf, T.observation_columns()), "12 hours"), "stream-vanished")
    return rows.select("id", us("first_seen").alias("first_us"), us("vanished_at").alias("vanished_us"), *whole("sightings"))


@query
def stream_supply(spark, sf):
    hunts = [F.col("event_type").alias("hunt"), F.col("user_id").cast("string").alias("id"), F.col("ts").cast("timestamp").alias("observed_at")]
    rows = O.drain(spark, O.supply(_event_stream(spark, sf, hunts)), "stream-supply")
    return rows.select("hunt", us("run_at").alias("run_us"), *whole("total_results"))
