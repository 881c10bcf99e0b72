"""Stored keyed tables: a merge reads and rewrites only the shards that its update touches.

A table lies in a folder, partitioned by ``shard`` (a hash of the key) and bucketed by the key inside. Buckets let a merge join
the stored rows where they lie: only the update is shuffled. An update names the shards it touches, the others are
neither read nor written; a touched shard whose rows come out as they were is not written either, so the same update
twice changes nothing. Files are written in full before they replace a shard's old ones.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from parcelscope.session import made_folder, settle

OVERWRITE = "spark.sql.sources.partitionOverwriteMode"
MergeRule = Callable[[DataFrame, DataFrame], DataFrame]


class Store:
    """One stored table. ``shards`` and ``buckets`` are fixed when it is made; shards bound what is read to the driver."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: tuple[str, ...] = ("id",), shards: int = 16, buckets: int = 4):
        self.spark, self.path, self.schema, self.key, self.shards, self.buckets = spark, path, schema, key, shards, buckets
        self.name = f"store_{zlib.crc32(path.encode()):08x}"
        made_folder(spark, path)
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({fields}, shard INT) USING parquet PARTITIONED BY (shard) "
            f"CLUSTERED BY ({', '.join(key)}) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
        spark.sql(f"MSCK REPAIR TABLE {self.name}")  # shards that an earlier session wrote

    def _sharded(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("shard", F.expr(f"cast(pmod(xxhash64({', '.join(self.key)}), {self.shards}) AS int)"))

    def read(self, shards: list[int] | None = None) -> DataFrame:
        rows = self.spark.table(self.name)
        return (rows if shards is None else rows.where(F.col("shard").isin(shards))).drop("shard")

    def _checksums(self, rows: DataFrame) -> DataFrame:
        value = F.xxhash64(*[F.col(f.name) for f in self.schema])
        return self._sharded(rows).groupBy("shard").agg(F.sum(value.cast("decimal(20,0)")).alias("sum"), F.count("*").alias("n"))

    def merge(self, update: DataFrame, rule: MergeRule) -> list[int]:
        """Merge by ``rule(current, update)``; the shards that were rewritten. The update is evaluated once."""
        update = settle(update, "store-update")
        touched = [r[0] for r in self._sharded(update).select("shard").distinct().orderBy("shard").collect()]  # at most ``shards``
        if not touched:
            return []
        columns = [f.name for f in self.schema]
        merged = settle(rule(self.read(touched), update).select(columns), "store-merged")
        before = self._checksums(self.read(touched)).withColumnsRenamed({"sum": "old", "n": "old_n"})
        both = self._checksums(merged).join(before, "shard", "left")
        changed = [r[0] for r in both.where(~F.col("sum").eqNullSafe(F.col("old")) | ~F.col("n").eqNullSafe(F.col("old_n"))).select("shard").orderBy("shard").collect()]
        if changed:
            rows = self._sharded(merged).where(F.col("shard").isin(changed)).select(*columns, "shard")
            rows = rows.repartition(self.buckets, *self.key)  # one file for each bucket of a shard
            mode = self.spark.conf.get(OVERWRITE)  # an option of the writer is not heard by insertInto
            self.spark.conf.set(OVERWRITE, "dynamic")
            try:
                rows.write.mode("overwrite").insertInto(self.name)
            finally:
                self.spark.conf.set(OVERWRITE, mode)
            self.spark.catalog.refreshTable(self.name)
        return changed


def newest_wins(key: tuple[str, ...], first: tuple[str, ...] = (), last: tuple[str, ...] = ()) -> MergeRule:
    """Rule of an upsert: an update's row replaces the stored one; ``first`` columns keep the least value, ``last`` the greatest."""

    def rule(current: DataFrame, update: DataFrame) -> DataFrame:
        a, b = current.alias("a"), update.alias("b")
        on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key]

        def field(c: str):
            if c in key:
                return F.coalesce(f"a.{c}", f"b.{c}")
            if c in first:
                return F.least(f"a.{c}", f"b.{c}")
            if c in last:
                return F.greatest(f"a.{c}", f"b.{c}")
            return F.when(F.col(f"b.{key[0]}").isNotNull(), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))

        return a.join(b, on, "full_outer").select(*[field(c).alias(c) for c in current.columns])

    return rule
