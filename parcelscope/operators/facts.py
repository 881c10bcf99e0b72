"""Dated external facts: latest value per key, freshness, source roll-up, extraction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from parcelscope import vocab
from parcelscope.functions.text import citation, parse_time


def freshness(value: Column, published: Column, observed: Column, days: Column, now: Column) -> Column:
    anchor = F.coalesce(parse_time(published), parse_time(observed))
    age = F.floor((F.unix_timestamp(now) - F.unix_timestamp(anchor)) / 86400)
    limit = F.coalesce(F.nullif(days.cast("int"), F.lit(0)), F.lit(vocab.FRESHNESS_DAYS))
    unknown = (F.coalesce(value, F.lit("")) == "") | anchor.isNull()
    return F.when(unknown, "unknown").when(age > limit, "stale").otherwise("fresh")


def assessed(facts: DataFrame, now: str | Column | None = None) -> DataFrame:
    """Add ``status``: fresh, stale or unknown."""
    at = F.current_timestamp() if now is None else (F.lit(now) if isinstance(now, str) else now).cast("timestamp")
    status = freshness(F.col("value"), F.col("published_at"), F.col("observed_at"), F.col("freshness_days"), at)
    return facts.withColumn("status", status)


def latest_facts(facts: DataFrame, order: Sequence[str] = ("observed_at", "seq")) -> DataFrame:
    """One row per key: the whole latest record, as a combinable aggregate."""
    fields = [c for c in facts.columns if c != "key"]
    return (
        facts.groupBy("key")
        .agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("f"))
        .select("key", *[f"f.{c}" for c in fields])
    )


def cited(facts: DataFrame) -> DataFrame:
    date = F.coalesce(F.nullif("published_at", F.lit("")), F.col("observed_at"))
    text = citation(F.col("label"), F.col("key"), F.col("value"), F.col("source_name"), date)
    return facts.withColumn("citation", text)


def source_status(facts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Roll-up of assessed facts: status, counts and warnings (per group if asked)."""
    counted = facts.groupBy(*by).agg(
        F.count("*").alias("facts"),
        F.count_if(F.col("status") == "stale").alias("stale"),
        F.count_if(F.col("status") == "unknown").alias("unknown"),
    )
    note = lambda c, t: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(t)))
    warnings = F.array_compact(
        F.array(
            F.when(F.col("facts") == 0, vocab.NO_SOURCES),
            note("stale", " market source(s) are stale."),
            note("unknown", " market source(s) could not be freshness-checked."),
        )
    )
    status = (
        F.when(F.col("facts") == 0, "missing").when(F.col("stale") + F.col("unknown") > 0, "needs_review").otherwise("fresh")
    )
    return counted.withColumn("status", status).withColumn("warnings", warnings)


def facts_from_text(pages: DataFrame, patterns: Sequence[dict], text: str = "html") -> DataFrame:
    """One fact per page and pattern: the pattern's first group, or a note.

    ``patterns``: dicts with key, label, pattern, and optionally unit, freshness_days,
    source_name. The few patterns become one array per page, so no join is needed.
    """
    none = F.lit(None).cast("string")
    found = []
    for p in patterns:
        hit = F.regexp_extract(text, "(?is)" + p["pattern"], 1)
        value = F.nullif(F.trim(hit), F.lit(""))
        found.append(
            F.struct(
                F.lit(p["key"]).alias("key"), F.lit(p["label"]).alias("label"), value.alias("value"),
                F.lit(p.get("unit")).cast("string").alias("unit"),
                F.lit(p.get("freshness_days", vocab.FRESHNESS_DAYS)).alias("freshness_days"),
                F.lit(p.get("source_name")).cast("string").alias("source_name"),
                F.when(value.isNull(), vocab.FACT_NOT_FOUND).otherwise(none).alias("notes"),
            )
        )
    return pages.select("*", F.explode(F.array(*found)).alias("f")).select(
        *[c for c in pages.columns if c != text], "f.*"
    )
