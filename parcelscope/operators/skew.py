"""Group operators that stay bounded per task when one key holds most of the rows.

* ``group_profile`` - exact count/min/median/max per group without gathering a group
* ``with_previous`` - previous row per key, splitting long keys into time chunks
* ``newest`` / ``newest_known`` - latest value per key as a map-side combinable aggregate
* ``first_k`` - top rows per key; Spark plans a group limit before the shuffle
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

CELLS = 1024  # slots that a group's range is cut into
SALTS = 16  # parts that a group's distinct values are dealt into where they meet its range


def same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def middle_range(counts: DataFrame, grain: Sequence[str], levels: int = 2, cells: int = CELLS) -> DataFrame:
    """Per group of ``counts`` (``grain``, value, c; values distinct): a range that holds both middle values.

    ``n``, ``low`` and ``high`` describe the whole group, ``first`` and ``last`` the range, ``before`` counts the rows below it.
    Each level cuts the range into ``cells`` equal slots and keeps what lies between the least and the greatest value of
    the middle slot, so that the width follows the group's own values: an outlier is gone after one level, and cents or
    shares are split as well as millions. If the two middle values lie in two slots, the range is just these two.
    """
    grain = list(grain)
    ranges = counts.groupBy(*grain).agg(F.sum("c").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    ranges = ranges.withColumns({"first": F.col("low"), "last": F.col("high"), "before": F.lit(0).cast("bigint")})
    by_key = Window.partitionBy(*grain).orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    left_mid, right_mid = middle_positions()
    known = ["n", "low", "high"]
    for _ in range(levels):
        width = F.col("last") - F.col("first")
        place = F.when(width > 0, F.floor((F.col("value") - F.col("first")) / width * cells)).otherwise(0)
        slots = (
            within_range(counts, ranges, grain)
            .groupBy(*grain, F.least(place, F.lit(cells - 1)).alias("slot"))
            .agg(
                F.sum("c").alias("c"), F.min("value").alias("least"), F.max("value").alias("greatest"),
                F.max_by("c", "value").alias("c_greatest"), *[F.first(x).alias(x) for x in (*known, "before")],
            )
            .withColumn("upto", F.col("before") + F.sum("c").over(by_key))
        )
        middle = slots.where((F.col("upto") - F.col("c") <= right_mid) & (F.col("upto") > left_mid))
        two = F.count("*") == 2
        ranges = middle.groupBy(*grain).agg(
            *[F.first(x).alias(x) for x in known],
            F.when(two, F.min("greatest")).otherwise(F.min("least")).alias("first"),
            F.when(two, F.max("least")).otherwise(F.max("greatest")).alias("last"),
            F.when(two, F.min("upto") - F.min_by("c_greatest", "slot")).otherwise(F.min(F.col("upto") - F.col("c"))).alias("before"),
        )
    return ranges


def middle_positions() -> tuple[Column, Column]:
    """Zero-based positions of the two middle rows of ``n``."""
    return F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)


def within_range(counts: DataFrame, ranges: DataFrame, grain: Sequence[str], salts: int = SALTS) -> DataFrame:
    """Rows of ``counts`` inside their group's range. A hot group's values are dealt over ``salts`` parts, each with a copy of the range."""
    part = F.pmod(F.xxhash64("value"), F.lit(salts)).cast("int")
    dealt = counts.withColumn("_part", part)
    copies = ranges.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    on = same(dealt, copies, [*grain, "_part"]) & dealt["value"].between(copies["first"], copies["last"])
    return dealt.join(copies, on).select(*[dealt[k] for k in grain], *[copies[c] for c in ranges.columns if c not in grain], "value", "c")


def group_profile(df: DataFrame, keys: Sequence[str], measures: dict[str, Column], levels: int = 2, cells: int = CELLS) -> DataFrame:
    """Per group: ``<m>_n``, ``<m>_min``, ``<m>_median``, ``<m>_max`` of each measure.

    The median is exact. Rows are first reduced to one count per distinct value, which
    combines map-side and spreads a hot group over its values. ``middle_range`` then narrows each group to the values
    around its middle, and only those are ordered: about a ``cells ** levels``-th of its distinct values, if they lie evenly.
    """
    keys = list(keys)
    shown = F.explode(
        F.array(*[
            F.struct(F.lit(name).alias("measure"), value.cast("double").alias("value"))
            for name, value in measures.items()
        ])
    )
    grain = [*keys, "measure"]
    counts = (
        df.select(*keys, shown.alias("cell"))
        .select(*keys, "cell.measure", "cell.value")
        .where(F.col("value").isNotNull())
        .groupBy(*grain, "value")
        .agg(F.count("*").alias("c"))
    )
    inside = within_range(counts, middle_range(counts, grain, levels, cells), grain)
    running = Window.partitionBy(*grain).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    left_mid, right_mid = middle_positions()
    picked = inside.withColumn("upto", F.col("before") + F.sum("c").over(running)).where(
        (F.col("upto") > left_mid) & (F.col("upto") - F.col("c") <= right_mid)
    )
    stats = []
    for name in measures:
        of = F.col("measure") == name
        stats += [
            F.max(F.when(of, F.col("n"))).alias(f"{name}_n"),
            F.max(F.when(of, F.col("low"))).alias(f"{name}_min"),
            ((F.min(F.when(of, F.col("value"))) + F.max(F.when(of, F.col("value")))) / 2.0).alias(f"{name}_median"),
            F.max(F.when(of, F.col("high"))).alias(f"{name}_max"),
        ]
    return picked.groupBy(*keys).agg(*stats)


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Sequence[str],
    chunk: Column,
    out: str = "prev",
    known: Sequence[str] = (),
) -> DataFrame:
    """Add ``out``: struct of the previous row's ``values`` per key (NULL on the first).

    Keys are split into ``chunk`` pieces (a truncated time, say), so that one key's rows
    are spread over tasks. A second window looks across the pieces; only the rows at the
    edges of a key's pieces meet in it, a few of each. The input is read once, without a join.
    ``order`` must sort ascending, be total within a key, and agree with ``chunk``.
    For each column of ``known`` there is ``<out>_<column>``, on rows that have the column
    themselves: its last value before the row that is not NULL.
    """
    keys, packed = list(keys), F.struct(*values)
    past = (Window.unboundedPreceding, -1)
    within = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    rows = df.withColumn("_chunk", chunk).withColumns({
        "_here": F.lag(packed).over(within),
        "_first": F.row_number().over(within) == 1,
        "_final": F.lead(F.lit(1)).over(within).isNull(),
        **{f"_here_{c}": F.last(c, ignorenulls=True).over(within.rowsBetween(*past)) for c in known},
    })
    edge = F.col("_first") | F.col("_final")
    for c in known:
        edge = edge | (F.col(c).isNotNull() & F.col(f"_here_{c}").isNull())
    rows = rows.withColumn("_edge", edge).withColumn("_piece", F.when(~F.col("_edge"), F.col("_chunk")))
    across = Window.partitionBy(*keys, "_edge", "_piece").orderBy(*order)

    def tail(c: str) -> Column:
        return F.when(F.col("_final"), F.coalesce(c, f"_here_{c}"))

    rows = rows.withColumns({
        "_carry": F.lag(packed).over(across),
        **{f"_carry_{c}": F.last(tail(c), ignorenulls=True).over(across.rowsBetween(*past)) for c in known},
    })
    return (
        rows.withColumn(out, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_here")))
        .withColumns({f"{out}_{c}": F.when(F.col(c).isNotNull(), F.coalesce(f"_here_{c}", f"_carry_{c}")) for c in known})
        .drop("_chunk", "_here", "_first", "_final", "_edge", "_piece", "_carry", *[f"_{k}_{c}" for c in known for k in ("here", "carry")])
    )


def newest(value: str | Column, order: Sequence[str]) -> Column:
    """Value on the latest row, NULL included."""
    return F.max_by(value, F.struct(*order))


def newest_known(value: str, order: Sequence[str]) -> Column:
    """Latest non-NULL value."""
    return F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order)))


def first_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)
