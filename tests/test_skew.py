"""Group operators against brute force, with one key holding most rows."""

import random
import statistics

from pyspark.sql import functions as F

from parcelscope.operators import skew


def test_group_profile_matches_statistics(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.6 else rng.choice("abc"), None if rng.random() < 0.05 else rng.choice([rng.uniform(-9e3, 9e6), 500.0, 1024.0])) for _ in range(4000)]
    rows += [(None, 7.0), (None, 9.0), ("one", 3.5)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r for r in skew.group_profile(df, ["k"], {"v": F.col("v"), "w": F.col("v") * 2}).collect()}
    by = {}
    for k, v in rows:
        if v is not None:
            by.setdefault(k, []).append(v)
    assert set(got) == set(by)
    for k, vs in by.items():
        r = got[k]
        assert (r.v_n, r.v_min, r.v_max, r.v_median) == (len(vs), min(vs), max(vs), statistics.median(vs))
        assert r.w_median == statistics.median([2 * v for v in vs])


def test_middle_range_follows_each_groups_own_values(spark):
    """Shares, cents, millions and a far outlier: each group's middle is a few values, whatever their width."""
    n = 60000
    wide = {"share": F.col("id") / n, "narrow": 5e6 + F.col("id") / 1e6, "large": F.col("id") * 977.0, "outlier": F.when(F.col("id") == 7, 1e15).otherwise(F.col("id") / 7)}
    df = spark.range(n)
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), v.alias("value")) for k, v in wide.items()]))
    counts = df.select(cells.alias("x")).select("x.*").groupBy("k", "value").agg(F.count("*").alias("c"))
    inside = skew.within_range(counts, skew.middle_range(counts, ["k"]), ["k"]).groupBy("k").count()
    left = {r["k"]: r["count"] for r in inside.collect()}
    assert set(left) == set(wide) and max(left.values()) <= 60  # one level leaves an outlier's group whole, the second splits it
    got = {r.k: r for r in skew.group_profile(counts, ["k"], {"v": F.col("value")}).collect()}
    for k, v in wide.items():
        values = [r[0] for r in df.select(v.cast("double")).collect()]
        assert (got[k].v_n, got[k].v_median, got[k].v_max) == (n, statistics.median(values), max(values))


def test_group_profile_of_repeats_and_odd_values(spark):
    rows = [("two", 1.0)] * 3 + [("two", 9.0)] * 3 + [("inf", float("inf")), ("inf", 1.0), ("inf", 2.0)] + [("same", 4.0)] * 5 + [("tiny", 5e-324), ("tiny", 0.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    for levels in (0, 1, 3):
        got = {r.k: (r.v_n, r.v_min, r.v_median, r.v_max) for r in skew.group_profile(df, ["k"], {"v": F.col("v")}, levels, 4).collect()}
        assert got == {"two": (6, 1.0, 5.0, 9.0), "inf": (3, 1.0, 2.0, float("inf")), "same": (5, 4.0, 4.0, 4.0), "tiny": (2, 0.0, 0.0, 5e-324)}


def test_with_previous_crosses_chunks(spark):
    rng = random.Random(9)
    rows, seq = [], 0
    for k, n in (("hot", 500), ("b", 3), ("c", 1)):
        t = 0
        for _ in range(n):
            t += rng.choice([0, 60, 4000, 200000])
            seq += 1
            rows.append((k, t, seq, rng.choice([None, rng.randint(1, 9)])))
    shuffled = rows[:]
    rng.shuffle(shuffled)
    df = spark.createDataFrame(shuffled, "k string, t long, seq int, v int").withColumn("ts", F.timestamp_seconds("t"))
    for grain in ("hour", "day"):
        out = skew.with_previous(df, ["k"], ["ts", "seq"], ["seq", "v"], F.date_trunc(grain, "ts"))
        got = {r.seq: (tuple(r.prev) if r.prev else None) for r in out.collect()}
        before = {}
        for k, _, s, v in rows:
            assert got[s] == before.get(k), (grain, s)
            before[k] = (s, v)


def test_with_previous_remembers_known_values(spark):
    """One key, many rows a piece (a hot day), values often missing."""
    rng = random.Random(3)
    rows = [("hot", 40 * i if i < 1500 else 86400 * i, i, rng.randint(1, 9) if rng.random() < 0.1 else None) for i in range(1600)] + [("b", 5, 1, None)]
    df = spark.createDataFrame(rows, "k string, t long, seq int, v int").withColumn("ts", F.timestamp_seconds("t"))
    out = skew.with_previous(df, ["k"], ["ts", "seq"], ["seq"], F.date_trunc("day", "ts"), known=["v"])
    got = {(r.k, r.seq): r.prev_v for r in out.collect()}
    last = {}
    for k, _, seq, v in rows:
        assert got[k, seq] == (last.get(k) if v is not None else None)
        last[k] = v or last.get(k)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 4  # two, each in both forms of the plan


def test_first_k_limits_groups_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    top = skew.first_k(df, ["k"], [F.desc("id")], 2)
    assert top._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 2
    assert sorted((r.k, r.id) for r in top.collect()) == [(0, 96), (0, 99), (1, 94), (1, 97), (2, 95), (2, 98)]
