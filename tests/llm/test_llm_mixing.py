"""Mixing and sharding against brute force."""

import math
import zlib
from collections import Counter, defaultdict

import pytest
from parcelscope.llm import mixing, sharding
from pyspark.sql import functions as F


def n_words(text):
    return sum(1 for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w)


def shares(sizes, weights=(1, 2, 3), most=3):
    """Reshare the excess by weight, round by round, until no source is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left, free = total - sum(most * sizes[s] for s in capped), [s for s in order if s not in capped]
        target = {s: most * sizes[s] if s in capped else left * w[s] / sum(w[f] for f in free) for s in order}
        above = {s for s in free if target[s] > most * sizes[s] + 1e-9}
        if not above:
            return target
        capped |= above


def check_mix(table, rows, whole=False):
    sizes, taken, longest = Counter(), Counter(), Counter()
    for d in table.collect():
        sizes[d.source] += n_words(d.text)
    want = shares(dict(sizes)) if sizes else {}
    source = {d.doc_id: d.source for d in table.collect()}
    known_sources = set(sizes) - {d.source for d in table.collect() if d.doc_id is None}  # of a null id the row is not known
    assert sorted((str(r.doc_id), r.size) for r in rows) == sorted((str(d.doc_id), n_words(d.text)) for d in table.collect())
    for r in rows:
        s = source[r.doc_id]
        assert 0 <= r.taken <= 3 * r.size
        if r.doc_id is not None:
            assert r.source_size == sizes[s] and math.isclose(r.target, want[s], rel_tol=1e-9, abs_tol=1e-6)
            taken[s] += r.taken
            longest[s] = max(longest[s], r.size)
    for s in taken:
        if s in known_sources:
            assert abs(taken[s] - want[s]) <= (longest[s] if whole else 1), s


@pytest.mark.parametrize("name", ["docs", "odd"])
@pytest.mark.parametrize("whole", [False, True])
def test_mix_reaches_targets(request, name, whole):
    table = request.getfixturevalue(name)
    rows = mixing.mix(table, whole=whole).collect()
    check_mix(table, rows, whole)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(table.repartition(5), whole=whole).collect()))


def test_mix_of_nothing(none):
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0


def test_targets_are_the_fixed_point(spark):
    for sizes in ({"a": 10, "b": 1, "c": 1000, None: 3}, {"a": 5}, {"a": 1, "b": 1, "c": 1}, {"x": 0, "y": 9}, {"a": 0}):
        rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(rows).collect()}
        assert all(math.isclose(got[s], t, rel_tol=1e-12, abs_tol=1e-9) for s, t in shares(sizes).items()), (sizes, got)


def test_heavier_documents_come_first(spark):
    rows = [(i, "w " * 10 + ("#" * 8 if i % 2 else ""), "b" if i < 400 else "a") for i in range(500)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.taken / r.size for r in mixing.mix(table).collect()}
    clean, noisy = (sum(got[i] for i in range(400) if i % 2 == k) for k in (0, 1))
    assert clean > 1.2 * noisy


def test_mixed_documents_follow_the_plan(odd, docs):
    for table in (odd, docs):
        got = mixing.mixed_documents(table)
        assert got.columns == table.columns
        want = Counter()
        for r in mixing.mix(table, whole=True).collect():
            want[r.doc_id] += r.taken // r.size if r.size else 0
        assert Counter(r.doc_id for r in got.collect()) == Counter({k: v for k, v in want.items() if v})


def test_mix_runs_no_python(docs):
    for plan in (mixing.mix(docs), sharding.shard(docs)):
        assert not any(w in plan._jdf.queryExecution().toString() for w in ("Python", "Arrow", "Pandas"))


@pytest.mark.parametrize("name", ["docs", "odd", "none"])
def test_shards(request, name):
    table = request.getfixturevalue(name)
    rows = sharding.shard(table, 4).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted((str(d.doc_id), len((d.text or "").encode()) + 1, zlib.crc32((d.text or "").encode())) for d in table.collect())
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.grown_shard is None and r.law == "rows"
    if rows:
        counts = [len(slots[i]) for i in range(4)]
        assert max(counts) - min(counts) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_match_the_mixture(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 10 < 7, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 10)).alias("source"))
    counts = {(r.source, r.shard): r["count"] for r in sharding.shard(rows).groupBy("source", "shard").count().collect()}
    for s, n in (("hot", 2800), ("s7", 400), ("s8", 400), ("s9", 400)):
        assert all(abs(counts[s, k] - n / 8) <= 1 for k in range(8))


def test_rest_of_a_hot_source_ends_among_few_rows(spark):
    docs = spark.range(30_000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("one two three "), F.col("id").cast("string")).alias("text"), F.when(F.col("id") % 10 > 0, "hot").otherwise("small").alias("source")
    )
    rows = mixing._sized(docs, 17, None, F.lit(0))
    plan = mixing._plan(rows, (1.0, 2.0, 3.0), 3)
    at_end = rows.join(plan, (F.col("source") == F.col("s")) & (F.col("cell") == F.col("end_cell"))).groupBy("source").count().collect()
    assert all(r["count"] <= 8 for r in at_end)
    taken = mixing.mix(docs).groupBy("source_size").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert len(taken) == 2 and all(abs(r.taken - r.target) <= 0.5 for r in taken)
    assert any(0 < r.target % r.source_size for r in taken)
