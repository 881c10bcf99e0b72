"""Stored raw payload text of any depth, read as VARIANT.

A payload is parsed once. Objects are looked for wherever they stand, level by level: each level is written, so a deep
payload costs one pass for each level of what is still open, and no schema of the whole has to be known.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DateType, StructType

from parcelscope.session import once, settle


def fields(value: Column) -> Column:
    """An object as a map of its fields, NULL for anything else."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def _holds_values(node: Column) -> Column:
    """Whether a node is an object or a list; all others end here and are not written."""
    return fields(node).isNotNull() | F.try_variant_get(node, "$", "array<variant>").isNotNull()


def _written(nodes: DataFrame) -> DataFrame:
    """Nodes written and read back, each in a list of one: a VARIANT that is a column of its own is written taken apart into
    a column for each field, which costs several times as much, on the way back too."""
    held = settle(nodes.withColumn("_node", F.array("_node")), "raw-level")
    return held.withColumn("_node", F.get("_node", F.lit(0)))


def _named(raw: str, key: str) -> Column:
    """How many fields of this name a text has at most, NULL if escapes may hide some."""
    text, name = F.col(raw), f'"{key}"'
    times = (F.length(text) - F.length(F.replace(text, F.lit(name), F.lit("")))) / len(name)
    plain = key.isascii() and key.replace("_", "").isalnum()
    return F.when(~text.contains("\\u") if plain else F.lit(False), times.cast("int"))


def find_objects(
    payloads: DataFrame, raw: str, key: str, keep: tuple[str, ...] = ("id",), levels: int | None = None, narrow: bool = False
) -> DataFrame:
    """(keep, depth, found): every object that is the value of ``key`` anywhere in the text ``raw``, nested ones too.

    Text that is no JSON holds none. ``levels`` limits how deep is looked; None is down to the last level. ``narrow`` finds the
    same, but counts the name in the text first and does not look below the last object that it can stand for.
    """
    node, left, found, depth = F.col("_node"), F.col("_left"), [], 0
    more = left.isNull() | (left > 0)  # NULL: not known
    bound = _named(raw, key) if narrow else F.lit(None).cast("int")
    open_nodes = once(payloads.select(*keep, raw), _left=bound, _node=F.try_parse_json(raw)).select(*keep, "_left", "_node")
    open_nodes = open_nodes.where(node.isNotNull() & more)
    while True:
        open_nodes = _written(open_nodes)
        hits = once(open_nodes, found=F.try_variant_get(node, f"$.{key}", "variant"))
        found.append(hits.where(fields(F.col("found")).isNotNull()).select(*keep, F.lit(depth).alias("depth"), "found"))
        depth += 1
        if levels is not None and depth >= levels:
            break
        hit = fields(F.try_variant_get(node, f"$.{key}", "variant")).isNotNull()
        parents = open_nodes.withColumn("_left", left - hit.cast("int")).where(more)
        below = parents.lateralJoin(parents.sparkSession.tvf.variant_explode(node.outer()))
        open_nodes = below.select(*keep, "_left", F.col("value").alias("_node")).where(_holds_values(node))
        if open_nodes.isEmpty():
            break
    return reduce(DataFrame.unionByName, found)


def typed(rows: DataFrame, value: str, schema: StructType, keep: tuple[str, ...] = ()) -> DataFrame:
    """Fields of a VARIANT object by name and type; a missing field, or one of another type, is NULL."""

    def read(f) -> Column:
        if isinstance(f.dataType, DateType):
            return F.try_variant_get(value, f"$.{f.name}", "string").try_cast("date").alias(f.name)
        return F.try_variant_get(value, f"$.{f.name}", f.dataType.simpleString()).alias(f.name)

    return rows.select(*keep, *[read(f) for f in schema])
