"""Objects at unknown places of stored JSON text."""

import json

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from parcelscope.sources import raw as W


def payloads(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, stored string")


def plain(value, key, depth=0):
    """The same search in plain Python."""
    if isinstance(value, dict):
        if isinstance(value.get(key), dict):
            yield depth, value[key]
        for v in value.values():
            yield from plain(v, key, depth + 1)
    elif isinstance(value, list):
        for v in value:
            yield from plain(v, key, depth + 1)


def test_every_object_is_found_at_any_depth(spark):
    docs = [
        {"m": {"a": 1}}, {"x": [1, {"y": {"m": {"a": 2, "m": {"a": 3}}}}], "m": "text"}, {"m": [{"m": {"a": 4}}]}, [], 5, None, {"m": {}},
        [[[[[[{"m": {"a": 6}}]]]]]], {"m": None, "n": {"m": {"b": [1, {"m": {"a": 7}}]}}},
    ]
    found = W.find_objects(payloads(spark, *map(json.dumps, docs)), "stored", "m")
    got = sorted((r.id, r.depth, json.dumps(json.loads(r.found.toJson()), sort_keys=True)) for r in found.collect())
    want = sorted((i, depth, json.dumps(m, sort_keys=True)) for i, d in enumerate(docs) for depth, m in plain(d, "m"))
    assert got == want


def test_text_that_is_no_json_holds_nothing(spark):
    assert W.find_objects(payloads(spark, "{broken", None, "", "<html>"), "stored", "m").collect() == []


def test_levels_limit_the_search(spark):
    rows = payloads(spark, '{"m":{"a":1},"x":{"m":{"a":2}}}')
    assert W.find_objects(rows, "stored", "m", levels=1).count() == 1
    assert W.find_objects(rows, "stored", "m").count() == 2


def test_fields_of_other_types_are_null(spark):
    found = W.find_objects(payloads(spark, '{"m":{"a":"12","b":"no","c":["x"],"d":"2026-01-02","e":[{"u":"v"}]}}', '{"m":{"a":7,"b":3.5}}'), "stored", "m")
    schema = StructType.fromDDL("a bigint, b double, c array<string>, d date, e array<struct<u:string>>")
    one, two = sorted(W.typed(found, "found", schema, ("id",)).collect())
    assert (one.a, one.b, one.c, str(one.d), one.e[0].u) == (12, None, ["x"], "2026-01-02", "v")
    assert (two.a, two.b, two.c, two.d, two.e) == (7, 3.5, None, None, None)


def test_plain_values_are_not_written_level_by_level(spark, monkeypatch):
    """Only objects and lists can hold what is looked for; empty ones, nulls and plain values end where they stand."""
    written = []
    monkeypatch.setattr(W, "settle", lambda df, purpose: written.append(df.cache()) or written[-1])
    text = '{"a":1,"b":"x","c":null,"d":[1,2,{"m":{"v":1,"m":{"v":2}}}],"e":{},"f":[],"m":{"v":3}}'
    rows = spark.createDataFrame([("p", text), ("q", "[]"), ("r", "7"), ("s", "no json")], "id string, t string")
    found = W.find_objects(rows, "t", "m")
    got = found.select("id", "depth", F.try_variant_get("found", "$.v", "int").alias("v")).collect()
    assert sorted(tuple(r) for r in got) == [("p", 0, 3), ("p", 2, 1), ("p", 3, 2)]
    # d, e, f, m; then the object in d; then m in it; then m in that
    assert [level.count() for level in written] == [3, 4, 1, 1, 1]


def test_a_narrow_search_finds_the_same(spark):
    docs = [
        '{"m":{"a":1}}', '{"x":[{"y":{"m":{"a":2,"m":{"a":3}}}},{"m":{}}],"m":"m"}', '{"x":{"\\u006d":{"a":4}},"m":{"n":{"\\u006d":{}}}}',
        '{"t":"\\"m\\": and \\"m\\"","u":[[{"m":[{"m":{"a":5}}]}]]}', '{"m":null,"v":{"m":{"m":{"m":{"a":6}}}}}', '{"n":{"m":7}}', "[]", '"m"', "{broken", None,
    ]
    rows = payloads(spark, *docs)

    def shown(found):
        return sorted((r.id, r.depth, r.found.toJson()) for r in found.collect())

    every = shown(W.find_objects(rows, "stored", "m"))
    assert len(every) == 11
    assert shown(W.find_objects(rows, "stored", "m", narrow=True)) == every


def test_a_narrow_search_ends_with_the_last_named_object(spark, monkeypatch):
    """Nodes stand in lists, as a column of VARIANT is taken apart when written."""
    written = []
    monkeypatch.setattr(W, "settle", lambda df, purpose: written.append(df.cache()) or written[-1])
    text = '{"p":{"m":{"a":{"b":{"c":[1,[2]]}},"d":[{"e":{}}]}}}'
    found = W.find_objects(payloads(spark, text, '{"m":{"f":{"g":{}}}}', '{"f":{"g":{}}}'), "stored", "m", narrow=True)
    assert sorted((r.id, r.depth) for r in found.collect()) == [(0, 1), (1, 0)]
    assert [level.count() for level in written] == [2, 1]
    assert {level.schema["_node"].dataType.simpleString() for level in written} == {"array<variant>"}
