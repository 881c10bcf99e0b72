"""Shards that all match the mixture of sources, by proportional stratified interleaving.

Rows of a source are shuffled by a seeded hash of their id and ranked; row r of n gets the
fractional rank (r + 1/2) / n. Rows sorted by it, sources side by side, are cut into runs of
equal length: every run holds each source in proportion. Shard sizes differ by one row at
most (law ``rows``).

Ranks and positions are number of rows in lower cells plus the rank within the cell; cells
are leading digits of the hash, and of the fractional rank, so that neither a source nor the
whole table is ordered in one task.

Defined results: a null text has no bytes and counts as the empty one; a null source is a
source of its own; repeated rows are placed one by one; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .base import known

DIGITS = 3  # hexadecimal digits of the hash that make a cell: 4096 cells
CELLS = 16**DIGITS
PAST = (Window.unboundedPreceding, -1)


def _numbered(rows: DataFrame, by: list[str], cell: str, order: list[Column], name: str) -> DataFrame:
    """Rank from 0 of each row among those with equal ``by``, in the order of cell and ``order``; and their number ``n``."""
    counts = rows.groupBy(*by, cell).agg(F.count("*").alias("here"))
    base = F.coalesce(F.sum("here").over(Window.partitionBy(*by).orderBy(cell).rowsBetween(*PAST)), F.lit(0))
    counts = counts.select(*[F.col(c).alias(f"_{c}") for c in [*by, cell]], base.alias("_base"), F.sum("here").over(Window.partitionBy(*by)).alias("n"))
    match = F.lit(True)
    for c in [*by, cell]:
        match = match & F.col(c).eqNullSafe(F.col(f"_{c}"))
    within = F.row_number().over(Window.partitionBy(*by, cell).orderBy(*order)) - 1
    found = rows.withColumn("_within", within).join(counts, match)
    return found.withColumn(name, F.col("_base") + F.col("_within")).drop("_base", "_within", *[f"_{c}" for c in [*by, cell]])


def shard(docs: DataFrame, shards: int = 8, seed: int = 23) -> DataFrame:
    """One row per document: doc_id, source, size, text_crc32, law, shard, slot, grown_shard."""
    mark = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    rows = docs.select(
        F.col("doc_id").cast("long"),
        F.col("source").cast("string"),
        (F.octet_length(known()) + 1).cast("long").alias("size"),
        F.crc32(known().cast("binary")).alias("text_crc32"),
        mark.alias("mark"),
    ).withColumn("cell", F.substring("mark", 1, DIGITS))
    ties = [F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    ranked = _numbered(rows, ["source"], "cell", [F.col("mark"), *ties], "rank").withColumn("share", (F.col("rank") + 0.5) / F.col("n")).drop("n", "cell", "rank")
    ranked = ranked.withColumn("cell", F.floor(F.col("share") * CELLS).cast("int"))
    placed = _numbered(ranked, [], "cell", [F.col("share"), F.col("source").asc_nulls_last(), F.col("mark"), *ties], "place")
    number = F.expr(f"place * {shards} div n").cast("int")
    placed = placed.withColumn("shard", number)
    first = F.expr(f"(cast(shard as long) * n + {shards - 1}) div {shards}")
    return placed.select(
        "doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("place") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
