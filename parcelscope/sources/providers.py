"""Named listing sources and saved-search definitions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from parcelscope import schema
from parcelscope.functions.tags import with_source
from parcelscope.sources import pages as P

Reader = Callable[[DataFrame], DataFrame]
_READERS: dict[str, Reader] = {}


def register(name: str, reader: Reader) -> None:
    """Register a reader: captured pages -> normalized listing rows with ``source_url``."""
    _READERS[name] = reader


def readers() -> dict[str, Reader]:
    return dict(_READERS)


def attributed(rows: DataFrame, provider: str) -> DataFrame:
    """Stamp provider and url, and append them to the row's source list."""
    sources = F.col("sources") if "sources" in rows.columns else F.lit(None).cast("array<struct<provider:string,url:string>>")
    return (
        rows.withColumn("sources", with_source(sources, F.lit(provider), F.col("source_url")))
        .withColumn("source_provider", F.lit(provider))
    )


def search(name: str, captured: DataFrame) -> DataFrame:
    return attributed(_READERS[name](captured), name)


def blocked_markers(value: Column, kind: str) -> Column:
    """A block flag of any captured form (boolean, text, list) as an array of markers."""
    none = F.array().cast("array<string>")
    if kind == "boolean":
        return F.when(F.coalesce(value, F.lit(False)), F.array(F.lit("blocked"))).otherwise(none)
    if kind.startswith("array"):
        return F.coalesce(value.cast("array<string>"), none)
    return F.when(F.coalesce(value, F.lit("")) != "", F.array(value)).otherwise(none)


def hunts(spark: SparkSession, path: str) -> DataFrame:
    """Enabled saved searches of a definition file (or folder of files)."""
    rows = spark.read.schema(schema.HUNTS).json(path, multiLine=True)
    h = rows.select(F.explode("hunts").alias("h")).where(F.coalesce("h.enabled", F.lit(True)))
    return h.select("h.name", "h.max_items", F.coalesce("h.enrich", F.lit(False)).alias("enrich"), "h.filters.*")


register("captured_search_pages", P.search_cards)
register("captured_detail_pages", P.detail_pages)
