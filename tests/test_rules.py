"""Rule arrays in their long form."""

from pyspark.sql import functions as F

from parcelscope.operators.rules import RuleSet, exploded
from parcelscope.sources import tables as T


def test_long_form_works_out_each_rule_once(spark):
    """No filter below the explode may repeat the steps that the array is made of."""
    rows = spark.createDataFrame([("a", "main road"), ("b", "none"), ("c", None)], "id string, t string").repartition(2)
    rules = RuleSet(("label", "words"))
    rules.add(F.col("found") != "", "Road", F.col("found"), weight=1.0)
    rules.add(F.col("found").contains("road"), "Noise", F.col("found"), weight=2.0)
    rows = rows.withColumn("found", F.regexp_extract("t", r"\bmain road\b", 0)).withColumn("items", rules.hits())
    long = exploded(rows, "items", ("id",))
    assert [tuple(r) for r in long.orderBy("rank").collect()] == [("a", 1, "Noise", "main road"), ("a", 2, "Road", "main road")]
    plan = long._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract" in plan
    assert not [line for line in plan.splitlines() if "Filter" in line and "regexp_extract" in line]


def test_texts_are_dealt_over_tasks_however_few_row_groups_there_are(spark):
    """The orders are one file of one row group; the rules over their texts must not be one task's."""
    rows = T.text_listings(spark, "/root/testdata/sf0.001")
    sizes = [r["n"] for r in rows.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == T.listings(spark, "/root/testdata/sf0.001").count()
    assert len(sizes) >= spark.sparkContext.defaultParallelism and max(sizes) < sum(sizes) / 4
