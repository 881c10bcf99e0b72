"""Mix sources to target weights by Efraimidis-Spirakis sampling.

A source that is owed e whole times its size and a rest gives every document e times; the
rest is drawn without replacement: document i gets the exponential key -ln(u_i) / w_i with
u_i from a seeded hash of its id and w_i its quality weight; ascending keys are an
Efraimidis-Spirakis sample, taken until their sizes reach the rest. Sizes are summed per
coarse cell of the key first, then per fine cell of the one coarse cell in which the rest of a
source ends; only the rows of one fine cell, about a two-millionth of the source, are sorted.

Defined results: a null text has no words; a null source is a source of its own, last in
order; a row that occurs several times is drawn each time; sources without words take
none; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .base import WORD, known, settle

COARSE, FINE = 512, 4096  # coarse cells of one unit of the key, fine cells of a coarse one
TEXT_NOISE = r"[#*$%&|<>!]"


def quality_weight(text: str | Column = "text", floor: float = 0.25) -> Column:
    """1 for clean text, less by the share of symbols in it (ten times), ``floor`` at least."""
    clean = known(text)
    share = F.regexp_count(clean, F.lit(TEXT_NOISE)) / F.greatest(F.char_length(clean), F.lit(1))
    return F.greatest(F.lit(floor), F.lit(1.0) - F.lit(10.0) * share)


def exponential_key(seed: int, weight: Column) -> Column:
    """-ln(u) / weight, u from 52 bits of a hash of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double")
    return -F.ln((bits + 0.5) / float(1 << 52)) / weight


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: int = 3) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Sources in code point order, null last, have the weights in turn and share the sum of all
    sizes. None gets more than ``most`` times its size; the excess is shared anew by weight.
    The fixed point is min(most * size, level * weight) for the one level at which the sum is
    right: sources are capped in the order of cap / weight until the level is below the next.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1
    rows = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), turn.cast("int")))
    rows = rows.withColumn("cap", most * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rows = rows.withColumns({
        "capped_before": F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "weight_before": F.coalesce(F.sum("w").over(before), F.lit(0.0)),
        "all_size": F.sum("source_size").over(everything),
        "all_weight": F.sum("w").over(everything),
    })
    # the level if all sources before this one are capped; the first at which this one is not
    level = (F.col("all_size") - F.col("capped_before")) / (F.col("all_weight") - F.col("weight_before"))
    rows = rows.withColumn("level", level).withColumn("nth", F.row_number().over(by_ratio))
    free = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct("nth", "level"))
    rows = rows.withColumn("fits", F.min(free).over(everything)["level"])
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("fits") * F.col("w"), F.col("cap").cast("double")))
    return rows.select("source", "source_size", target.alias("target"))


def _sized(docs: DataFrame, seed: int, weight: Column | None, payload: Column) -> DataFrame:
    return docs.select(
        payload.alias("payload"),
        F.col("doc_id").cast("long"),
        F.col("source").cast("string"),
        F.regexp_count(known(), F.lit(WORD)).cast("long").alias("size"),
        exponential_key(seed, quality_weight() if weight is None else weight).alias("key"),
        F.xxhash64(known()).alias("tie"),
    ).withColumn("cell", F.floor(F.col("key") * float(COARSE * FINE)))


def _ends(cells: DataFrame, owed: DataFrame) -> DataFrame:
    """(s, cell, before) of the cell of each source in which its rest ends, and the sizes before it.

    ``cells``: source, cell, here. ``owed``: s, rest, and ``before``, sizes that come before all these cells.
    """
    upto = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    ends = cells.withColumn("upto", F.sum("here").over(upto)).join(owed, F.col("source").eqNullSafe(F.col("s")))
    ends = ends.withColumn("upto", F.col("before") + F.col("upto")).withColumn("before", F.col("upto") - F.col("here"))
    return ends.where("upto > rest and before <= rest").select("s", "cell", "before", "rest")


def _plan(rows: DataFrame, weights: tuple[float, ...], most: int) -> DataFrame:
    """Per source: target, whole times, rest, and the fine cell in which the rest ends."""
    coarse = F.floor(F.col("cell") / FINE)
    cells = rows.groupBy("source", coarse.alias("cell")).agg(F.sum("size").alias("here"))
    sizes = cells.groupBy("source").agg(F.sum("here").alias("source_size"))
    owed = targets(sizes, weights, most)
    owed = owed.withColumn("times", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    owed = settle(owed.withColumn("rest", F.floor(F.col("target") - F.col("times") * F.col("source_size") + 0.5).cast("long")), "mix-sources")
    near = settle(_ends(cells, owed.select(F.col("source").alias("s"), "rest", F.lit(0).cast("long").alias("before"))), "mix-ends")
    there = near.select(F.col("s").alias("n"), F.col("cell").alias("near"))
    inside = rows.join(there, F.col("source").eqNullSafe(F.col("n")) & (coarse == F.col("near")), "left_semi")
    cells = inside.groupBy("source", "cell").agg(F.sum("size").alias("here"))
    ends = _ends(cells, near.drop("cell")).select(F.col("s").alias("e"), F.col("cell").alias("end_cell"), F.col("before").alias("end_before"))
    plan = owed.withColumnRenamed("source", "s").join(ends, F.col("s").eqNullSafe(F.col("e")), "left").drop("e")
    return settle(plan, "mix-plan")


def _drawn(rows: DataFrame, plan: DataFrame, whole: bool) -> DataFrame:
    """The rows with ``taken`` words."""
    placed = rows.join(plan, F.col("source").eqNullSafe(F.col("s")))
    at_end = F.coalesce(F.col("cell") == F.col("end_cell"), F.lit(False))
    order = Window.partitionBy("source").orderBy("key", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("rest") - F.col("end_before") - F.coalesce(F.sum("size").over(order), F.lit(0))
    last = placed.where(at_end).withColumn("room", room)
    part = F.least(F.col("size"), F.greatest(F.lit(0), F.col("room")))
    if whole:
        part = F.when((F.col("room") > 0) & (2 * F.col("room") >= F.col("size")), F.col("size")).otherwise(F.lit(0))
    last = last.withColumn("part", part.cast("long")).drop("room")
    below = F.col("end_cell").isNull() | (F.col("cell") < F.col("end_cell"))
    others = placed.where(~at_end).withColumn("part", F.when(below & (F.col("rest") > 0), F.col("size")).otherwise(F.lit(0)).cast("long"))
    return others.unionByName(last).withColumn("taken", (F.col("times") * F.col("size") + F.col("part")).cast("long"))


def mix(
    docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: int = 3, seed: int = 17, weight: Column | None = None, whole: bool = False
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken.

    ``size`` counts words; ``taken`` those that the mix takes, repeats counted. The last
    document of a source is cut to the words left, or with ``whole`` taken or left as a whole,
    whichever is nearer. ``weight`` defaults to ``quality_weight``.
    """
    rows = settle(_sized(docs, seed, weight, F.lit(0)), "mix-rows")
    return _drawn(rows, _plan(rows, weights, most), whole).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: int = 3, seed: int = 17, weight: Column | None = None) -> DataFrame:
    """The documents as often as the mix takes them, whole, all columns kept; those without words not at all.

    Only the documents of the one cell in which a source's rest ends are shuffled.
    """
    plan = _plan(settle(_sized(docs, seed, weight, F.lit(0)), "mix-rows"), weights, most)
    rows = _sized(docs, seed, weight, F.struct("*"))
    drawn = _drawn(rows, plan, whole=True).where("taken > 0")
    return drawn.select("payload", F.explode(F.sequence(F.lit(1), F.expr("taken div size").cast("int"))).alias("n")).select("payload.*")
