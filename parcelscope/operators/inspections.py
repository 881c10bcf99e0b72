"""Inspection runs: the day to go, the ordered stops, clashes and hand-over notes.

``visits``: brief_id, id, suburb, address, start, end, fit_score, action (type).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from parcelscope.functions.labels import visit_priority
from parcelscope.functions.text import parse_time
from parcelscope.operators.skew import first_k, with_previous


def visits(listings: DataFrame, brief: str = "brief_id") -> DataFrame:
    """Appointments from the listings' inspection arrays (ISO or long texts)."""
    rows = listings.select(brief, "id", "suburb", F.col("address_display").alias("address"), "fit_score", "action", F.explode("inspections").alias("i"))
    return rows.select(
        F.col(brief).alias("brief_id"), "id", "suburb", "address",
        parse_time(F.col("i.start")).alias("start"), parse_time(F.col("i.end")).alias("end"), "fit_score", "action",
    ).where("start is not null")


def unscheduled(listings: DataFrame, brief: str = "brief_id") -> DataFrame:
    """Listings without any inspection time."""
    none = F.coalesce(F.size(F.filter("inspections", lambda i: i["start"].isNotNull())), F.lit(0)) <= 0
    return listings.where(none).select(
        F.col(brief).alias("brief_id"), "id", F.col("address_display").alias("address"), "suburb",
        F.lit("No inspection time visible").alias("reason"),
        F.lit("Call the agent and request access.").alias("action"),
    )


def target_days(stops: DataFrame) -> DataFrame:
    """Busiest day per brief; Saturdays win when there are any, earlier days break ties."""
    days = stops.groupBy("brief_id", F.to_date("start").alias("day")).agg(F.count("*").alias("n"))
    saturday = F.weekday("day") == 5
    return first_k(days, ["brief_id"], [saturday.desc(), F.desc("n"), F.asc("day")], 1).select("brief_id", "day", "n")


def inspection_run(stops: DataFrame, day: str | None = None) -> DataFrame:
    """Stops of the target day in time order, each compared with the stop before it.

    The comparison splits a day into hours, so no task sorts a whole day of a busy brief.
    """
    dated = stops.withColumn("day", F.to_date("start")).withColumn("suburb", F.coalesce("suburb", F.lit("")))
    if day is None:
        dated = dated.join(target_days(stops).select("brief_id", "day"), ["brief_id", "day"], "left_semi")
    else:
        dated = dated.where(F.col("day") == F.lit(day).cast("date"))
    dated = dated.withColumn("free_at", F.coalesce("end", "start"))
    rows = with_previous(
        dated, ["brief_id"], ["start", "suburb", "address", "id"], ["free_at", "suburb"], F.date_trunc("hour", "start")
    )
    before = F.coalesce("prev.suburb", F.lit(""))
    note = (
        F.when(before == "", "Start here.")
        .when(before == F.col("suburb"), F.concat(F.lit("Stay in "), "suburb", F.lit(".")))
        .otherwise(F.concat(F.lit("Move from "), before, F.lit(" to "), "suburb", F.lit("; confirm travel time.")))
    )
    return rows.select(
        "brief_id", "day", "id", "suburb", "address", "start", "end",
        F.coalesce(F.col("start") < F.col("prev.free_at"), F.lit(False)).alias("clash"),
        note.alias("travel_note"),
        visit_priority(F.col("action"), F.col("fit_score")).alias("priority"),
    )


def run_summary(run: DataFrame, waiting: DataFrame | None = None) -> DataFrame:
    counts = run.groupBy("brief_id").agg(
        F.max("day").alias("day"), F.count("*").alias("stops"), F.count_if("clash").alias("clashes")
    )
    if waiting is not None:
        idle = waiting.groupBy("brief_id").agg(F.count("*").alias("unscheduled"))
        counts = counts.join(idle, "brief_id", "full_outer").fillna(0, ["stops", "clashes", "unscheduled"])
    text = F.concat(F.col("stops").cast("string"), F.lit(" scheduled inspections"))
    text = F.concat(text, F.when(F.col("clashes") > 0, F.concat(F.lit(" · "), F.col("clashes").cast("string"), F.lit(" clash(es)"))).otherwise(""))
    if waiting is not None:
        more = F.concat(F.lit(" · "), F.col("unscheduled").cast("string"), F.lit(" need agent follow-up"))
        text = F.concat(text, F.when(F.col("unscheduled") > 0, more).otherwise(""))
    return counts.withColumn("summary", text)
