"""Stored tables: merges touch only their shards, repeats change nothing, sessions find what others wrote."""

import os

from pyspark.sql import functions as F

from parcelscope.operators import history as H
from parcelscope.operators.store import Store, newest_wins

SCHEMA = "id string, price_from long, mode string, first_seen timestamp, last_seen timestamp"


def rows(spark, ids, price, day):
    data = [(f"x{i}", price + i, "sale") for i in ids]
    at = F.lit(f"2026-06-{day:02d}").cast("timestamp")
    return spark.createDataFrame(data, "id string, price_from long, mode string").withColumns({"first_seen": at, "last_seen": at})


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def content(df):
    return sorted(map(str, df.collect()))


def test_merge_rewrites_only_touched_shards(spark, tmp_path):
    path = str(tmp_path / "state")
    store = Store(spark, path, rows(spark, [1], 0, 1).schema)
    assert len(store.merge(rows(spark, range(200), 1000, 1), H.merge_state)) == 16
    before = files(path)
    update = rows(spark, [3, 4, 900], 5000, 2)
    touched = store.merge(update, H.merge_state)
    after = files(path)
    assert 1 <= len(touched) <= 3
    kept = {f for f in before if int(f.split("shard=")[1].split("/")[0]) not in touched}
    assert kept and all(after[f] == before[f] for f in kept)
    assert all("shard=" + str(s) + "/" in f for f in set(after) - set(before) for s in [int(f.split("shard=")[1].split("/")[0])] if s in touched)
    got = {r.id: r for r in store.read().collect()}
    assert len(got) == 201 and got["x3"].price_from == 5003 and got["x5"].price_from == 1005
    assert str(got["x3"].first_seen)[:10] == "2026-06-01" and str(got["x3"].last_seen)[:10] == "2026-06-02"


def test_same_update_twice_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "state")
    store = Store(spark, path, rows(spark, [1], 0, 1).schema)
    store.merge(rows(spark, range(50), 1000, 1), H.merge_state)
    update = rows(spark, range(40, 60), 2000, 2)
    assert store.merge(update, H.merge_state)
    before, shown = files(path), content(store.read())
    assert store.merge(update, H.merge_state) == []
    assert files(path) == before and content(store.read()) == shown
    assert store.merge(update.limit(0), H.merge_state) == []


def test_stored_rows_are_joined_without_a_shuffle(spark, tmp_path):
    store = Store(spark, str(tmp_path / "state"), rows(spark, [1], 0, 1).schema)
    store.merge(rows(spark, range(50), 1000, 1), H.merge_state)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = H.merge_state(store.read(), rows(spark, range(9), 1, 3))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning") == 1, plan  # the update alone


def test_a_new_session_finds_the_shards(spark, tmp_path):
    path = str(tmp_path / "state")
    schema = rows(spark, [1], 0, 1).schema
    store = Store(spark, path, schema)
    store.merge(rows(spark, range(20), 1000, 1), H.merge_state)
    shown = content(store.read())
    spark.sql(f"DROP TABLE {store.name}")
    assert content(Store(spark, path, schema).read()) == shown


def test_upsert_keeps_first_and_last(spark, tmp_path):
    rule = newest_wins(("hunt", "id"), ("first",), ("last",))
    first = spark.createDataFrame([("a", "1", 5, 5, "x"), ("a", "2", 5, 5, "x")], "hunt string, id string, first long, last long, note string")
    store = Store(spark, str(tmp_path / "seen"), first.schema, ("hunt", "id"), shards=4)
    store.merge(first, rule)
    store.merge(spark.createDataFrame([("a", "1", 3, 3, None), ("b", "1", 9, 9, "z")], first.schema), rule)
    assert content(store.read()) == content(spark.createDataFrame([("a", "1", 3, 5, None), ("a", "2", 5, 5, "x"), ("b", "1", 9, 9, "z")], first.schema))
