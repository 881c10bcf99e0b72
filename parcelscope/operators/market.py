"""Area statistics, rankings and sales roll-ups over the listings table."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from parcelscope.functions import numbers as N
from parcelscope.operators.briefs import by_locality
from parcelscope.operators.skew import first_k, group_profile
from parcelscope.session import settle

AREA = ("suburb", "state", "postcode")


def area_stats(listings: DataFrame, mode: str = "sold", min_count: int = 3) -> DataFrame:
    """Count, mean, min and max price per area.

    The three prices fall back in different orders: the mean to the whole-number
    midpoint first, the minimum to the lower bound, the maximum to the upper one.
    """
    mid = F.expr("(price_from + price_to) div 2")
    return (
        listings.where((F.col("mode") == mode) & F.col("suburb").isNotNull())
        .groupBy(*AREA)
        .agg(
            F.count("*").alias("n"),
            F.avg(F.coalesce("sold_price", mid, "price_from", "price_to")).alias("avg_price"),
            F.min(F.coalesce("sold_price", "price_from", "price_to")).alias("min_price"),
            F.max(F.coalesce("sold_price", "price_to", "price_from")).alias("max_price"),
            F.avg("beds").alias("avg_beds"),
        )
        .where(F.col("n") >= min_count)
        .orderBy(F.desc("n"), *AREA)
    )


def area_rank(
    listings: DataFrame,
    mode: str = "sold",
    budget_min: float | None = None,
    budget_max: float | None = None,
    min_count: int = 1,
) -> DataFrame:
    """Areas ranked by affordability and activity, with exact medians."""
    priced = listings.where((F.col("mode") == mode) & F.col("suburb").isNotNull()).select(
        *AREA,
        N.effective_price(F.col("sold_price"), F.col("price_from"), F.col("price_to"), F.col("price_display")).alias("price"),
        N.present(F.col("beds")).alias("beds"),
    ).where(F.col("price").isNotNull())
    if budget_min:
        priced = priced.where(F.col("price") >= budget_min)
    # one row per area; the busiest one is looked up over all of them, small ones included
    areas = settle(group_profile(priced, AREA, {"price": F.col("price"), "beds": F.col("beds")}), "areas")
    busiest = areas.agg(F.max("price_n")).first()[0] or 1
    areas = areas.withColumn("activity", F.col("price_n") / float(busiest)).withColumn(
        "affordability", N.affordability(F.col("price_median"), F.lit(budget_max).cast("double"))
    )
    activity, afford = F.col("activity"), F.col("affordability")
    score = F.when(afford.isNotNull(), afford * (0.4 + 0.6 * activity)).otherwise(activity)
    return (
        areas.where(F.col("price_n") >= min_count)
        .select(
            *AREA,
            F.col("price_n").cast("bigint").alias("count"),
            N.whole(F.col("price_median")).alias("median_price"),
            N.whole(F.col("price_min")).alias("min_price"),
            N.whole(F.col("price_max")).alias("max_price"),
            N.rounded(F.col("beds_median"), 1).alias("avg_beds"),
            N.whole(F.col("price_median") / F.col("beds_median")).alias("price_per_bed"),
            N.rounded(afford, 3).alias("affordability"),
            N.rounded(activity, 3).alias("activity"),
            N.rounded(score, 4).alias("score"),
        )
        .orderBy(F.desc("score"), *AREA)
    )


def area_candidates(
    listings: DataFrame,
    seeds: DataFrame | None = None,
    seed_postcodes: DataFrame | None = None,
    mode: str | None = None,
    limit: int = 25,
) -> DataFrame:
    """Busiest areas sharing a postcode with the seed areas (all areas without seeds).

    ``seeds`` has one column ``suburb``; ``seed_postcodes`` one column ``postcode``.
    """
    codes = seed_postcodes
    if seeds is not None:
        named = (
            listings.where(F.col("postcode").isNotNull())
            .join(seeds.select("suburb"), "suburb", "left_semi")
            .select("postcode")
            .distinct()
        )
        codes = named if codes is None else codes.union(named).distinct()
    rows = listings.where(F.col("suburb").isNotNull())
    if mode:
        rows = rows.where(F.col("mode") == mode)
    counted = rows.groupBy(*AREA).agg(F.count("*").alias("n"))
    if codes is not None:
        # the semi join runs on the area counts, not on the listings
        counted = counted.join(codes, "postcode", "left_semi").select(*AREA, "n")
    return counted.orderBy(F.desc("n"), *AREA).limit(limit)


def sales(
    listings: DataFrame,
    as_of: date | str | None = None,
    days: int | None = 90,
    suburbs: Sequence[str] | DataFrame | None = None,
    beds_min: float | None = None,
) -> DataFrame:
    """Sold rows in scope. Undated rows stay only when there is no date window."""
    rows = listings.where(F.col("mode") == "sold")
    if days is not None:
        since = F.date_sub(F.lit(as_of).cast("date") if as_of else F.current_date(), days)
        rows = rows.where(F.col("sold_date") >= since)
    if beds_min:
        rows = rows.where(F.coalesce("beds", F.lit(0.0)) >= beds_min)
    if isinstance(suburbs, DataFrame):
        wanted = suburbs.select(F.lower("suburb").alias("_area")).distinct()
        rows = rows.join(wanted, F.lower("suburb") == F.col("_area"), "left_semi")
    elif suburbs:
        rows = rows.where(F.lower("suburb").isin([s.lower() for s in suburbs]))
    return rows.withColumn("sold_price", N.sold_price(F.col("sold_price"), F.col("price_display")))


def recent_sales(listings: DataFrame, *, limit: int = 50, **scope) -> DataFrame:
    return (
        sales(listings, **scope)
        .select("id", "suburb", F.col("address_display").alias("address"), "sold_price", "sold_date",
                "sale_method", "beds", "baths", "cars", "property_type", "url")
        .orderBy(F.desc_nulls_last("sold_date"), F.desc_nulls_last("sold_price"), "id")
        .limit(limit)
    )


def sales_summary(listings: DataFrame, **scope) -> DataFrame:
    """Per suburb name: count, median, range, price per bed, first and last sale."""
    scope.setdefault("days", 180)
    priced = sales(listings, **scope).where(F.col("sold_price").isNotNull())
    stats = group_profile(
        priced,
        ["suburb"],
        {
            "price": F.col("sold_price"),
            "beds": N.present(F.col("beds")),
            "day": F.unix_date("sold_date"),
        },
    )

    def day(c: str) -> Column:
        return F.date_from_unix_date(F.col(c).cast("int"))

    return stats.select(
        "suburb",
        F.col("price_n").cast("bigint").alias("sold_count"),
        N.whole(F.col("price_median")).alias("median_price"),
        N.whole(F.col("price_min")).alias("min_price"),
        N.whole(F.col("price_max")).alias("max_price"),
        N.whole(F.col("price_median") / F.col("beds_median")).alias("price_per_bed"),
        day("day_min").alias("first_sold"),
        day("day_max").alias("last_sold"),
    ).orderBy(F.desc("sold_count"), "suburb")


def mode_counts(listings: DataFrame) -> DataFrame:
    """Listings per mode, with the total on the row whose mode is NULL."""
    return listings.rollup("mode").agg(F.count("*").alias("n"))


def search(listings: DataFrame, searches: DataFrame) -> DataFrame:
    """Listings matching each saved search (one row per search and listing).

    ``searches``: name, mode, suburbs, region, price_min/max, beds_min/max, baths_min,
    cars_min, ptypes, features, keywords, exclude_under_offer. NULL or empty means no
    bound. How searches meet listings: ``briefs.by_locality``.
    """
    s = searches.select([F.col(c).alias(f"q_{c}") for c in searches.columns])
    pairs = by_locality(listings, s, "q_suburbs", "q_region")

    def at_least(value: str, bound: str) -> Column:
        return F.col(bound).isNull() | (F.col(value) >= F.col(bound))

    def at_most(value: str, bound: str) -> Column:
        return F.col(bound).isNull() | (F.col(value) <= F.col(bound))

    price = N.effective_price(F.col("sold_price"), F.col("price_from"), F.col("price_to"), F.col("price_display"))
    kind = F.lower("property_type")
    offers = F.lower(F.coalesce("status", F.lit(""))).contains("under offer")
    text = F.lower(F.concat_ws(" ", "headline", "description", F.array_join("features", " ")))
    empty = F.array().cast("array<string>")
    return (
        pairs.withColumn("_price", price)
        .where(F.col("mode") == F.coalesce("q_mode", F.lit("sale")))
        .where(at_least("_price", "q_price_min") & at_most("_price", "q_price_max"))
        .where(at_least("beds", "q_beds_min") & at_most("beds", "q_beds_max"))
        .where(at_least("baths", "q_baths_min") & at_least("cars", "q_cars_min"))
        .where((F.coalesce(F.size("q_ptypes"), F.lit(0)) <= 0) | F.exists("q_ptypes", lambda t: kind.contains(F.lower(t))))
        .where(F.forall(F.coalesce("q_features", empty), lambda f: F.coalesce(F.exists("features", lambda x: F.lower(x) == F.lower(f)), F.lit(False))))
        .where(F.col("q_keywords").isNull() | text.contains(F.lower("q_keywords")))
        .where(~F.coalesce("q_exclude_under_offer", F.lit(False)) | ~offers)
        .drop("_price")
    )


def search_page(matches: DataFrame, sort: str = "id", page: int = 1, size: int = 20) -> DataFrame:
    """One result page per search, in the search's order."""
    order = {
        "price-asc": [F.asc_nulls_last("price_from"), F.col("id")],
        "price-desc": [F.desc_nulls_last("price_from"), F.col("id")],
        "dateupdated-desc": [F.desc_nulls_last("last_seen"), F.col("id")],
        "solddate-desc": [F.desc_nulls_last("sold_date"), F.col("id")],
        "id": [F.col("id")],
    }[sort]
    return first_k(matches, ["q_name"], order, page * size, "position").where(
        F.col("position") > (page - 1) * size
    )


def _order_keys() -> tuple[Column, Column]:
    """Price and time that a match is sorted by in its own search's order, smallest first; NULL comes last."""
    asked, price = F.coalesce("q_sort", F.lit("id")), F.col("price_from").cast("double")
    seen, sold = (F.unix_micros(F.col(c).cast("timestamp")) for c in ("last_seen", "sold_date"))
    by_price = F.when(asked == "price-asc", price).when(asked == "price-desc", -price)
    return by_price, F.when(asked == "dateupdated-desc", -seen).when(asked == "solddate-desc", -sold)


def search_own_pages(matches: DataFrame, keys: Sequence[str] = ("q_name",), page: int = 1, size: int = 20, parts: int = 32) -> DataFrame:
    """The page each search asks for, in the search's own order; adds ``position``, counted from the first page.

    ``matches`` are rows of ``search``. Per search, optional columns ``q_sort`` (an order of ``search_page``; any other
    one, or NULL, is by id), ``q_page`` and ``q_size``; where they are missing, NULL or under 1, ``page`` and ``size`` hold. Ties
    are by id. All orders go through the same two windows: a search's matches are dealt into ``parts`` by id, each
    part keeps what could still be on the page, and only these rows are ranked together.
    """
    for name in ("q_sort", "q_page", "q_size"):
        if name not in matches.columns:
            matches = matches.withColumn(name, F.lit(None).cast("string" if name == "q_sort" else "int"))

    def asked(name: str, default: int) -> Column:
        return F.when(F.col(name) >= 1, F.col(name)).otherwise(default).cast("long")

    number, length = asked("q_page", page), asked("q_size", size)
    by_price, by_time = _order_keys()
    rows = matches.withColumn("_price", by_price).withColumn("_time", by_time).withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(parts)))
    order = [F.asc_nulls_last("_price"), F.asc_nulls_last("_time"), F.col("id")]
    near = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))
    rows = rows.withColumn("position", near).where(F.col("position") <= number * length)
    rows = rows.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return rows.where((F.col("position") > (number - 1) * length) & (F.col("position") <= number * length)).drop("_price", "_time", "_part")
