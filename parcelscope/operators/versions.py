"""Stored tables whose files were written under several versions of their schema, read as one table.

Files of version N lie under ``version=N``. A table is read under one merged schema: a column has the widest type of its
versions, and the scan widens old values itself (no cast, filters still reach it). Rows of versions from before a column
was added take its default; a NULL written by a later version stays NULL. Columns that later versions dropped stay, NULL there.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import (
    ArrayType, ByteType, DataType, DateType, DecimalType, DoubleType, FloatType, IntegerType, LongType, MapType, NullType, ShortType,
    StructField, StructType, TimestampNTZType,
)

WHOLE = (ByteType(), ShortType(), IntegerType(), LongType())
EXACT = WHOLE[:3]  # whole numbers that a double holds exactly
WIDER = (*[(a, b) for i, a in enumerate(WHOLE) for b in WHOLE[i + 1:]], *[(a, DoubleType()) for a in EXACT], (FloatType(), DoubleType()), (DateType(), TimestampNTZType()))


@dataclass(frozen=True)
class Version:
    """One version of a table: its columns, and the defaults of those it added for rows written before it."""

    number: int
    columns: StructType
    defaults: Mapping[str, Any] = field(default_factory=dict)


def widest(a: DataType, b: DataType, name: str = "value") -> DataType:
    """The type that holds all values of both without loss; a TypeError if there is none."""
    if a == b or isinstance(b, NullType):
        return a
    if isinstance(a, NullType) or (a, b) in WIDER:
        return b
    if (b, a) in WIDER:
        return a
    if isinstance(a, DecimalType) and isinstance(b, DecimalType):
        scale = max(a.scale, b.scale)
        digits = max(a.precision - a.scale, b.precision - b.scale) + scale
        if digits <= 38:
            return DecimalType(digits, scale)
    if isinstance(a, ArrayType) and isinstance(b, ArrayType):
        return ArrayType(widest(a.elementType, b.elementType, f"{name}[]"))
    if isinstance(a, MapType) and isinstance(b, MapType):
        return MapType(widest(a.keyType, b.keyType, f"{name} key"), widest(a.valueType, b.valueType, f"{name} value"))
    if isinstance(a, StructType) and isinstance(b, StructType):
        return merged(a, b, name)
    raise TypeError(f"{name}: {a.simpleString()} and {b.simpleString()} have no common type")


def merged(a: StructType, b: StructType, name: str = "") -> StructType:
    """Columns of both, those of ``a`` first, each as wide as needed and nullable."""
    types = {f.name: f.dataType for f in a}
    for f in b:
        types[f.name] = widest(types[f.name], f.dataType, f"{name}.{f.name}".lstrip(".")) if f.name in types else f.dataType
    return StructType([StructField(n, t) for n, t in types.items()])


def write_version(rows: DataFrame, path: str, number: int, mode: str = "append") -> None:
    """Add rows of one version, in the schema they have."""
    rows.write.mode(mode).parquet(f"{path.rstrip('/')}/version={number}")


def read_versions(spark: SparkSession, path: str, versions: list[Version]) -> DataFrame:
    """All rows of a stored table under the merged schema, with ``version``. Versions without files have no rows."""
    versions = sorted(versions, key=lambda v: v.number)
    columns = versions[0].columns
    for v in versions[1:]:
        columns = merged(columns, v.columns)
    since: dict[str, int] = {}
    defaults: dict[str, Any] = {}
    for v in versions:
        for f in v.columns:
            since.setdefault(f.name, v.number)
        for name, value in v.defaults.items():
            if since.get(name) != v.number:
                raise ValueError(f"version {v.number} names a default for {name}, but does not add it")
            defaults[name] = value
    rows = spark.read.schema(StructType([*columns, StructField("version", IntegerType())])).parquet(path)
    shown = [
        F.when(F.col("version") < since[f.name], F.lit(defaults[f.name]).cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name)
        if f.name in defaults else F.col(f.name)
        for f in columns
    ]
    return rows.select(*shown, "version")
