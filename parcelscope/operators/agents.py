"""Agents: table and links from listings, observed performance, ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from parcelscope.functions.labels import guide_read
from parcelscope.functions.numbers import midpoint, present, rounded
from parcelscope.operators.skew import newest_known

ORDER = ("observed_at", "seq")
CONTACTS = ("email", "mobile", "landline", "profile_url", "photo", "agent_id")


def agent_entries(observations: DataFrame) -> DataFrame:
    """One row per sighting and named agent; the listing's agency fills a missing one."""
    fields = observations.schema["agents"].dataType.elementType.fieldNames()
    own = F.col("a.agency") if "agency" in fields else F.lit(None).cast("string")
    listed = F.col("agency_name") if "agency_name" in observations.columns else F.lit(None).cast("string")
    rows = observations.select("*", F.explode("agents").alias("a")).where(F.coalesce("a.name", F.lit("")) != "")
    agency = F.coalesce(F.nullif(own, F.lit("")), F.nullif(listed, F.lit("")), F.lit(""))
    return rows.select(
        "id", *ORDER, "a.name", agency.alias("agency"),
        *[(F.col(f"a.{c}") if c in fields else F.lit(None).cast("string")).alias(c) for c in CONTACTS],
    ).withColumn("agent_key", F.xxhash64("name", "agency"))


def agent_table(observations: DataFrame) -> DataFrame:
    """(name, agency) -> latest known contact fields."""
    return agent_entries(observations).groupBy("agent_key", "name", "agency").agg(
        *[newest_known(c, ORDER).alias(c) for c in CONTACTS]
    )


def listing_links(observations: DataFrame) -> DataFrame:
    return agent_entries(observations).select("id", F.col("agent_key").alias("agent_id")).distinct()


def agent_metrics(listings: DataFrame, links: DataFrame, events: DataFrame) -> DataFrame:
    """Observed counters per agent.

    Price drops are counted per listing first, so the join to the links is by listing and
    the agent shuffle only moves partial sums.
    """
    drops = events.where("event_type = 'price_drop'").groupBy("id").agg(F.count("*").alias("drops"))
    mid = midpoint(F.col("price_from"), F.col("price_to"))
    delta = (present(F.col("sold_price").cast("double")) - mid) / mid
    per_listing = listings.select("id", present(F.col("sold_price")).isNotNull().alias("sold"), delta.alias("delta"))
    rows = links.join(per_listing, "id").join(drops, "id", "left")
    return rows.groupBy("agent_id").agg(
        F.count("*").alias("listings_seen"),
        F.count_if("sold").alias("listings_sold"),
        rounded(F.avg("delta"), 4).alias("avg_guide_vs_sold"),
        F.coalesce(F.sum("drops"), F.lit(0)).alias("price_drops_observed"),
        F.count_if(F.col("delta") >= 0.10).alias("underquote_signals"),
    )


def agent_rank(metrics: DataFrame, agents: DataFrame, min_seen: int = 1, limit: int = 20) -> DataFrame:
    return (
        metrics.where(F.col("listings_seen") >= min_seen)
        .join(agents, "agent_id")
        .withColumn("guide_read", guide_read(F.col("avg_guide_vs_sold")))
        .orderBy(F.desc("underquote_signals"), F.desc("price_drops_observed"), F.desc("listings_seen"), "name", "agent_id")
        .limit(limit)
    )
