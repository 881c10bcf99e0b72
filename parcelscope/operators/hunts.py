"""Saved-search runs: new, changed, vanished and returned listings, and supply.

``runs``: hunt, run_at, total_results, blocked. ``members``: hunt, run_at, id, off_market.
Seen sets are kept as first/last run per (hunt, listing), never as all memberships.
A blocked run still records what it saw, and a listing first seen in it is new there; it
only never says that a listing changed or is gone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from parcelscope.functions.numbers import rounded, whole
from parcelscope.operators.skew import first_k


def calendar(runs: DataFrame) -> DataFrame:
    """Runs of each hunt, numbered in time, with the number of the next run that was not blocked."""
    w = Window.partitionBy("hunt").orderBy("run_at")
    numbered = runs.select("hunt", "run_at", "blocked", F.row_number().over(w).alias("run_no"))
    usable = F.when(~F.col("blocked"), F.col("run_no"))
    return numbered.select("hunt", "run_at", "run_no", F.min(usable).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("next_open"))


def presence(members: DataFrame, runs: DataFrame) -> DataFrame:
    return members.dropDuplicates(["hunt", "run_at", "id"]).join(calendar(runs), ["hunt", "run_at"])


def record_members(members: DataFrame, known: DataFrame) -> DataFrame:
    """Run membership rows with ``is_new``; ``known`` holds (hunt, id) seen before."""
    seen = known.select("hunt", "id").distinct().withColumn("_seen", F.lit(True))
    return (
        members.dropDuplicates(["hunt", "run_at", "id"])
        .join(seen, ["hunt", "id"], "left")
        .withColumn("is_new", F.col("_seen").isNull())
        .drop("_seen")
    )


def new_listings(members: DataFrame, runs: DataFrame) -> DataFrame:
    """Listings at the first run that saw them, unless off-market there."""
    return (
        presence(members, runs)
        .groupBy("hunt", "id")
        .agg(F.min("run_at").alias("run_at"), F.min_by("off_market", "run_at").alias("off_market"))
        .where(~F.col("off_market"))
        .select("hunt", "run_at", "id")
    )


def _gaps(members: DataFrame, runs: DataFrame) -> DataFrame:
    """Presence rows not followed by another one up to the next run that was not blocked."""
    w = Window.partitionBy("hunt", "id").orderBy("run_no")  # at most one row per run
    following = presence(members, runs).select(
        "hunt", "id", "next_open",
        F.lead("run_no").over(w).alias("next_no"),
        F.lead("run_at").over(w).alias("next_at"),
        F.lead("off_market").over(w).alias("next_off"),
    )
    return following.where(F.col("next_open").isNotNull() & (F.col("next_no").isNull() | (F.col("next_no") > F.col("next_open"))))


def vanished(members: DataFrame, runs: DataFrame) -> DataFrame:
    """The first usable run that misses a listing after each presence; once per absence."""
    gaps = _gaps(members, runs).select("hunt", "id", F.col("next_open").alias("run_no"))
    return gaps.join(calendar(runs), ["hunt", "run_no"]).select("hunt", "run_at", "id")


def returned(members: DataFrame, runs: DataFrame) -> DataFrame:
    """The run that sees a vanished listing again, unless it is off-market there."""
    return _gaps(members, runs).where(F.col("next_no").isNotNull() & ~F.col("next_off")).select(
        "hunt", F.col("next_at").alias("run_at"), "id"
    )


def latest_runs(runs: DataFrame) -> DataFrame:
    """Latest run of each hunt with the time of the one before."""
    two = first_k(runs, ["hunt"], [F.desc("run_at")], 2)
    return two.groupBy("hunt").agg(
        F.max("run_at").alias("run_at"),
        F.min(F.when(F.col("rank") == 2, F.col("run_at"))).alias("previous_run_at"),
        F.max_by("blocked", "run_at").alias("blocked"),
        F.max_by("total_results", "run_at").alias("total_results"),
    )


def latest_diff(members: DataFrame, runs: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """(hunt, id, section) of the latest run: new, changed or stale.

    ``events``: id, observed_at. A listing changed when it has an event after the
    previous run. A blocked latest run yields new listings only.
    """
    spans = presence(members, runs).groupBy("hunt", "id").agg(
        F.min("run_at").alias("first_at"),
        F.max("run_at").alias("last_at"),
        F.max_by("off_market", "run_at").alias("off_market"),
    )
    now = latest_runs(runs).select("hunt", "run_at", "previous_run_at", "blocked")
    rows = spans.join(now, "hunt")
    if events is None:
        rows = rows.withColumn("event_at", F.lit(None).cast("timestamp"))
    else:
        rows = rows.join(events.groupBy("id").agg(F.max("observed_at").alias("event_at")), "id", "left")
    here, live, usable = F.col("last_at") == F.col("run_at"), ~F.col("off_market"), ~F.col("blocked")
    moved = F.col("event_at") > F.coalesce("previous_run_at", F.lit("0001-01-01").cast("timestamp"))
    section = (
        F.when(~here & usable, "stale")
        .when((F.col("first_at") == F.col("run_at")) & live, "new")
        .when(here & usable & (F.col("first_at") < F.col("run_at")) & live & moved, "changed")
    )
    return rows.select("hunt", "run_at", "id", section.alias("section")).where("section is not null")


def hunt_report(members: DataFrame, runs: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """Counts per hunt for the latest run, with its supply read."""
    counts = latest_diff(members, runs, events).groupBy("hunt").agg(
        *[F.count_if(F.col("section") == s).alias(f"{s}_count") for s in ("new", "changed", "stale")]
    )
    zero = F.lit(0).cast("bigint")
    trend = supply_trend(runs).select("hunt", "current", "previous", "delta", "direction")
    return (
        latest_runs(runs)
        .join(counts, "hunt", "left")
        .join(trend, "hunt", "left")
        .select(
            "hunt", "run_at", "total_results", "blocked",
            *[F.coalesce(f"{s}_count", zero).alias(f"{s}_count") for s in ("new", "changed", "stale")],
            "current", "previous", "delta", "direction",
        )
    )


def run_totals(report: DataFrame) -> DataFrame:
    return report.agg(
        F.count("*").alias("hunts"), F.sum("new_count").alias("total_new"),
        F.sum("changed_count").alias("total_changed"), F.sum("stale_count").alias("total_stale"),
    )


def stale_preview(members: DataFrame, runs: DataFrame, limit: int = 10) -> DataFrame:
    """First stale listings per hunt, by id."""
    rows = latest_diff(members, runs).where("section = 'stale'")
    return first_k(rows, ["hunt"], [F.col("id")], limit).drop("section")


def supply_trend(runs: DataFrame, history: int = 12) -> DataFrame:
    """Result counts of each hunt's latest readings: level, change and direction."""
    recent = first_k(
        runs.where(F.col("total_results").isNotNull()), ["hunt"], [F.desc("run_at")], history
    )
    at = lambda k: F.max(F.when(F.col("rank") == k, F.col("total_results")))
    series = F.sort_array(F.collect_list(F.struct("run_at", "total_results")))  # `history` rows at most
    read = recent.groupBy("hunt").agg(
        at(1).alias("current"),
        at(2).alias("previous"),
        whole(F.avg("total_results")).alias("avg_recent"),
        F.count("*").alias("n_runs"),
        series.alias("history"),
    )
    delta = F.col("current") - F.col("previous")
    level = (
        F.when(delta.isNull(), "first-reading").when(delta > 0, "rising").when(delta < 0, "falling").otherwise("flat")
    )
    pct = rounded(delta / F.nullif(F.col("previous"), F.lit(0)) * 100, 1)
    rows = read.select(
        "hunt", "current", "previous", delta.alias("delta"), pct.alias("pct_change"),
        "avg_recent", "n_runs", level.alias("direction"), "history",
    )
    quiet = runs.select("hunt").distinct().join(rows, "hunt", "left_anti")
    return rows.unionByName(
        quiet.select("hunt", F.lit(0).cast("bigint").alias("n_runs"), F.lit("no-data").alias("direction")),
        allowMissingColumns=True,
    )
