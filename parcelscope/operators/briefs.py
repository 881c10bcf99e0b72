"""Buyer and renter briefs: the searches they ask for, and listings paired with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parcelscope.functions.text import locality_slug

BRIEF = (
    "brief_id", "objective", "buyer_type", "beds_min", "baths_min", "cars_min", "buy_max", "rent_max", "yield_band",
)


def with_brief(listings: DataFrame, briefs: DataFrame) -> DataFrame:
    """Listings paired with the briefs they fall under; see ``by_locality``."""
    region = F.col("region") if "region" in briefs.columns else F.lit(None).cast("string")
    asks = briefs.select(*BRIEF, F.col("suburbs").alias("_suburbs"), region.alias("_region"))
    return by_locality(listings, asks, "_suburbs", "_region").drop("_suburbs", "_region")


def by_locality(listings: DataFrame, asks: DataFrame, suburbs: str, region: str) -> DataFrame:
    """Listings paired with briefs or searches: by area, else by region, else with all listings.

    One that names areas meets the listings of those, one that names a region only those
    of the region, one without either every listing. A listing carries a key for each
    form, so all are one equi join. Case does not matter.
    """
    plain = lambda c: F.lower(F.trim(c))
    places = F.array_distinct(F.transform(suburbs, lambda x: F.concat(F.lit("a:"), plain(x))))
    part = F.nullif(plain(F.col(region)), F.lit(""))
    keys = F.when(F.coalesce(F.size(suburbs), F.lit(0)) > 0, places).otherwise(F.array(F.coalesce(F.concat(F.lit("r:"), part), F.lit("*"))))
    asks = asks.withColumn("_key", F.explode(keys))
    own = [F.concat(F.lit("a:"), plain(F.col("suburb"))), F.lit("*")]
    if "region" in listings.columns:
        own.append(F.concat(F.lit("r:"), plain(F.col("region"))))
    return listings.withColumn("_key", F.explode(F.array_compact(F.array(*own)))).join(asks, "_key").drop("_key")


def objective() -> Column:
    """The brief's objective, else the listing's mode, else buy."""
    empty = F.lit("")
    return F.lower(F.coalesce(F.nullif(F.col("objective"), empty), F.nullif(F.col("mode"), empty), F.lit("buy")))


def searches(briefs: DataFrame) -> DataFrame:
    """The searches of each brief: buy, rent and sold, with unset filters left out."""
    one = F.size("suburbs") == 1
    tag = (
        F.when(one, locality_slug(F.element_at("suburbs", 1)))
        .when(F.coalesce("region", F.lit("")) != "", locality_slug(F.col("region")))
        .otherwise("multi")
    )
    goal = F.lower(F.coalesce("objective", F.lit("buy")))
    none = F.lit(None).cast("bigint")

    def ask(when: Column, kind: str, mode: str, low: Column, high: Column, offers: Column, order: Column) -> Column:
        return F.when(
            F.coalesce(when, F.lit(False)),
            F.struct(
                F.concat(F.lit(f"{kind}-"), tag).alias("name"), F.lit(mode).alias("mode"), low.alias("price_min"),
                high.alias("price_max"), offers.alias("exclude_under_offer"), order.alias("sort"),
            ),
        )

    offers = F.coalesce("exclude_under_offer", F.lit(False))
    wanted = F.array_compact(
        F.array(
            ask(goal.isin("buy", "both"), "buy", "sale", F.col("buy_min"), F.col("buy_max"), offers, F.col("sort")),
            ask(goal.isin("rent", "both"), "rent", "rent", F.col("rent_min"), F.col("rent_max"), offers, F.col("sort")),
            ask(F.col("track_sold"), "sold", "sold", none, none, F.lit(False), F.lit("solddate-desc")),
        )
    )

    def listed(c: str) -> Column:
        return F.when(F.size(c) > 0, F.col(c))

    return briefs.select("*", F.explode(wanted).alias("s")).select(
        "brief_id", "s.name", "s.mode",
        listed("suburbs").alias("suburbs"),
        F.nullif("region", F.lit("")).alias("region"),
        "s.price_min", "s.price_max", "beds_min", "beds_max", "baths_min", "cars_min",
        listed("property_types").alias("ptypes"),
        F.lit(None).cast("array<string>").alias("features"),
        F.lit(None).cast("string").alias("keywords"),
        "s.exclude_under_offer",
        F.nullif("s.sort", F.lit("")).alias("sort"),
    )


def filter_map(searches: DataFrame) -> DataFrame:
    """Searches as (name, filters) with unset filters dropped from the map."""
    keys = [c for c in searches.columns if c not in ("brief_id", "name")]
    pairs = [x for k in keys for x in (F.lit(k), _as_text(searches, k))]
    filters = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull() & (v != ""))
    return searches.select("brief_id", "name", filters.alias("filters"))


def _as_text(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType.simpleString()
    return F.array_join(column, ",") if kind.startswith("array") else F.col(column).cast("string")
