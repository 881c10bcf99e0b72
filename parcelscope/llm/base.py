"""What the operators share: input, worker imports, settled tables, fitted values sent to tasks."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from parcelscope.session import settle

__all__ = ["ascii_lower", "documents", "held_out", "known", "labelled_sample", "mapped", "ready", "settle", "table", "text_sample"]

WORD = r"[^\x20\x09-\x0D]+"


def ready(spark: SparkSession) -> None:
    """Let Python workers started from now on import this package."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def known(text: str | Column = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _released(batches: Iterator[pa.RecordBatch], task: Callable[..., Iterator[pa.RecordBatch]], **fixed: object) -> Iterator[pa.RecordBatch]:
    """Run a task, then give memory that Arrow keeps for later back: workers are used again by other tasks."""
    try:
        yield from task(batches, **fixed)
    finally:
        pa.default_memory_pool().release_unused()


def mapped(df: DataFrame, task: Callable[..., Iterator[pa.RecordBatch]], schema: str, **fixed: object) -> DataFrame:
    """Run ``task(batches, **fixed)`` on each partition."""
    ready(df.sparkSession)
    return df.mapInArrow(functools.partial(_released, task=task, **fixed), schema)


def held_out(fold: int = 2, folds: int = 4) -> Column:
    """Whether a document is kept from learning, by its id alone."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column | None, rows: int) -> DataFrame:
    """(turn, doc_id, label, text) of at most ``rows`` labelled documents, those whose ids have the smallest hashes."""
    turn = F.xxhash64(F.col("doc_id").cast("long")).alias("turn")
    marked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    if train is not None:
        marked = marked.where(train)
    marked = marked.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label)).cast("double").alias("label"))
    chosen = marked.select(turn, "doc_id", "label").orderBy("turn", "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), known().alias("text"))
    found = chosen.join(texts, F.col("doc_id") == F.col("_id")).drop("_id")
    return found.orderBy("turn", "doc_id", F.xxhash64("text")).limit(rows)


def text_sample(docs: DataFrame, groups: list[Column], rows: int) -> DataFrame:
    """(text) of about ``rows`` distinct texts, and no more, of each group (a condition on ``text``), by hash.

    The groups are counted; the share of hash values that is wanted follows. So nothing is
    ordered, and only the sample itself is shuffled.
    """
    texts = docs.select(known().alias("text")).withColumn("turn", F.xxhash64("text"))
    sizes = texts.agg(*[F.count(F.when(g, True)).alias(str(i)) for i, g in enumerate(groups)]).first()
    picks = []
    for group, n in zip(groups, sizes, strict=True):
        upto = min((1 << 63) - 1, int((1 << 64) * min(1.0, rows / max(1, n))) - (1 << 63))
        few = texts.where(F.col("turn") <= upto).where(group)
        picks.append(few.groupBy("turn").agg(F.min("text").alias("text")).limit(rows).select("text"))
    return functools.reduce(DataFrame.unionByName, picks)
