"""Plans of the scored queries: texts are read once, and rows are dealt while they are short."""

import re

from pyspark.sql import functions as F

from parcelscope.functions import numbers as N
from parcelscope.operators import checks as K, rules, scoring as V
from parcelscope.plans.catalog import QUERIES
from parcelscope.sources import tables as T
from samples import brief, frame, listing

SF = "/root/testdata/sf0.001"


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rents_are_found_without_reading_texts(spark):
    for name in ("viability_notes", "viability"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"FileScan.*documents\.parquet", plan)) == 1, name


def test_a_score_lists_no_risks(spark):
    from parcelscope.operators import briefs as B

    rows = B.with_brief(frame(spark, listing()), brief(spark)).withColumn("weekly_rent", F.lit(800.0))
    scored = V.with_viability(K.with_risks(rows))
    assert "regexp_extract" not in optimized(scored.select("id", "viability.score", "viability.band"))
    assert "regexp_extract" in optimized(scored.select("id", "risks.items"))


def test_rules_tell_the_same_with_and_without_their_list(spark):
    made = rules.RuleSet(("severity", "label"))
    for n, (severity, weight) in enumerate((("minor", 0.3), ("major", 0.65), ("minor", 0.3), ("watch", 0.15))):
        made.add(F.col("n").bitwiseAND(1 << n) > 0, severity, f"rule {n}", weight=weight)
    rows = made.flagged(spark.range(16).toDF("n"))
    rows = rows.select("n", made.hits().alias("hits"), made.load().alias("load"), made.first("label").alias("first"), made.any_of("severity", "major").alias("major"))
    for r in rows.collect():
        held = sorted(((-w, i, f"rule {i}") for i, w in enumerate((0.3, 0.65, 0.3, 0.15)) if r.n >> i & 1))
        assert [(h.order, h.ordinal, h.label) for h in r.hits] == held
        total = 0.0
        for order, *_ in held:
            total -= order
        assert r.load == total and r["first"] == (held[0][2] if held else None)
        assert r.major == any(i == 1 for _, i, _ in held)


def test_rounding_to_whole_numbers_is_as_bround(spark):
    values = [x / 8 for x in range(-40, 41)] + [0.49999999999999994, 2.675, 1.005, -0.3, 1e15 + 0.5, 1e300, None]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", N.rounded(F.col("v"), 0).alias("a"), F.bround("v").alias("b")).collect()
    assert [str(r.a) for r in rows] == [str(r.b) for r in rows]


def test_listings_are_dealt_while_their_rows_are_short(spark):
    plan = optimized(T.dealt_listings(spark, SF).select("id", "description", "images"))
    assert 0 <= plan.index("images") < plan.index("RepartitionByExpression") and "North-facing" not in plan[plan.index("RepartitionByExpression") :]
