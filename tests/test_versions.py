"""Stored tables over versions of their schema."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from parcelscope.operators.versions import Version, merged, read_versions, write_version


def ddl(text):
    return StructType.fromDDL(text)


GENERATIONS = [
    ("id string, n int, f float, tags array<int>, old string", [("a", 7, 0.5, [1, None], "x"), (None, None, None, None, None)], {}),
    ("id string, n bigint, f double, tags array<bigint>, kind string, place struct<lat:float>", [("b", 2**40, 1e300, [2**40], None, (0.5,)), ("c", 1, 1.0, [], "house", None)], {"kind": "flat"}),
    ("id string, n int, f double, tags array<bigint>, kind string, place struct<lat:double,lng:double>, open boolean", [("d", 3, 2.0, None, "d", (1.5, 2.5), None)], {"open": True}),
]


def test_three_versions_read_as_one(spark, tmp_path):
    path, versions = str(tmp_path / "t"), []
    for number, (text, rows, defaults) in enumerate(GENERATIONS, 1):
        write_version(spark.createDataFrame(rows, text), path, number)
        versions.append(Version(number, ddl(text), defaults))
    table = read_versions(spark, path, versions[::-1])
    got = sorted((tuple(r) for r in table.collect()), key=str)
    assert table.columns == ["id", "n", "f", "tags", "old", "kind", "place", "open", "version"]
    assert dict(table.dtypes)["n"] == "bigint" and dict(table.dtypes)["place"] == "struct<lat:double,lng:double>"
    assert got == sorted([
        ("a", 7, 0.5, [1, None], "x", "flat", None, True, 1), (None, None, None, None, None, "flat", None, True, 1),
        ("b", 2**40, 1e300, [2**40], None, None, (0.5, None), True, 2), ("c", 1, 1.0, [], None, "house", None, True, 2),
        ("d", 3, 2.0, None, None, "d", (1.5, 2.5), None, 3),
    ], key=str)
    picked = table.where("n > 100 and version < 3").select("id")
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert [r.id for r in picked.collect()] == ["b"] and "GreaterThan(n,100)" in plan and "PartitionFilters: [isnotnull(version" in plan


def test_types_without_a_common_one_are_refused(spark):
    for a, b in (("x int", "x string"), ("x bigint", "x double"), ("x struct<y:int>", "x struct<y:date>"), ("x decimal(38,0)", "x decimal(38,10)")):
        with pytest.raises(TypeError, match="x"):
            merged(ddl(a), ddl(b))
    assert merged(ddl("x decimal(10,2)"), ddl("x decimal(9,4)")) == ddl("x decimal(12,4)")


def test_default_only_for_an_added_column(spark, tmp_path):
    with pytest.raises(ValueError, match="n"):
        read_versions(spark, str(tmp_path), [Version(1, ddl("n int")), Version(2, ddl("n int"), {"n": 5})])


def test_version_without_files_and_empty_files(spark, tmp_path):
    path = str(tmp_path / "t")
    write_version(spark.createDataFrame([], "n int"), path, 1)
    versions = [Version(1, ddl("n int")), Version(2, ddl("n bigint, m string"), {"m": "x"})]
    assert read_versions(spark, path, versions).count() == 0
    write_version(spark.range(3).select(F.col("id").cast("int").alias("n")), path, 1)
    assert sorted(tuple(r) for r in read_versions(spark, path, versions).collect()) == [(0, "x", 1), (1, "x", 1), (2, "x", 1)]
