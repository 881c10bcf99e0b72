"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .base import settle


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node that each node of an edge is connected with.

    Every round gives each node the smallest of itself and its neighbours, and replaces the
    ends of edges by those; edges between equal ends go. The number of edges falls
    quickly, as a rule in two or three rounds. Rounds are written, so that a lost executor costs one of them.
    """
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct()
    edges = settle(edges, "edges")
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root"))
        least = settle(least, "roots")
        rounds.append(least)
        of_a = least.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        of_b = least.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        merged = edges.join(of_a, "a").join(of_b, "b").where("ra <> rb")
        edges = settle(merged.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = rounds[0]
    for later in rounds[1:]:
        step = later.select(F.col("node").alias("root"), F.col("root").alias("next"))
        found = found.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return found
