"""Exact and near duplicates against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from parcelscope.llm import exact_dedup, jaccard
from parcelscope.llm.words import find_words, shingles, slices


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="abé", max_size=8), st.none() | st.integers(0, 9)), max_size=30), st.booleans())
def test_trie_owns_every_string_once(rows, largest):
    trie, want = exact_dedup.Patricia(largest), defaultdict(list)
    for text, number in rows:
        key = b"12345678abcdefgh" + text.encode()
        trie.add(key, number, 1)
        want[key].append(number)
    got = {k: (best, n) for k, best, n in trie.spill()}
    pick = max if largest else min
    assert got == {k: (pick((x for x in v if x is not None), default=None), len(v)) for k, v in want.items()}
    assert trie.held == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.binary(max_size=5), min_size=1, max_size=40), st.integers(1, 400))
def test_ordered_spill_gives_each_string_once(bodies, budget):
    rows = sorted((len(b), hash(b) % 5, b, i, 1) for i, b in enumerate(bodies))
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["size", "mark", "body", "best", "n"])
    got = [r for b in exact_dedup.owners_task(iter([batch]), False, budget, True) for r in b.to_pylist()]
    assert sorted((r["body"], r["n"]) for r in got) == sorted((b, bodies.count(b)) for b in set(bodies))


def check_exact(rows, table, largest):
    groups = defaultdict(list)
    for d in table.collect():
        groups[hashlib.sha256(lower(d.text).encode()).hexdigest()].append(d.doc_id)
    pick = max if largest else min
    assert sorted((r.text_sha256, str(r.doc_id)) for r in rows) == sorted((k, str(i)) for k, v in groups.items() for i in v)
    for r in rows:
        own = groups[r.text_sha256]
        assert r.group_size == len(own) and r.keep_id == pick((i for i in own if i is not None), default=None)
        assert not r.kept or r.doc_id == r.keep_id
    kept = defaultdict(int)
    for r in rows:
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) <= {1}


@pytest.mark.parametrize("largest", [True, False])
@pytest.mark.parametrize("budget", [exact_dedup.BUDGET, 2000])
def test_exact_groups(docs, odd, largest, budget):
    for table in (docs, odd):
        check_exact(exact_dedup.exact_groups(table, largest, budget).collect(), table, largest)


def test_keep_one_keeps_all_columns(odd, none):
    kept = exact_dedup.keep_one(odd)
    assert kept.columns == odd.columns
    texts = [lower(r.text) for r in kept.collect()]
    assert sorted(texts) == sorted({lower(r.text) for r in odd.collect()})
    assert exact_dedup.keep_one(none).count() == 0 and exact_dedup.exact_groups(none).count() == 0


def sets(text, size=5):
    w = [x for x in (text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if x]
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def check_links(rows, table, least_recall=1.0):
    docs = [(d.doc_id, sets(d.text)) for d in table.collect()]
    links, root = defaultdict(int), list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (a, x) in enumerate(docs):
        for j in range(i):
            b, y = docs[j]
            if x and y and len(x & y) >= 0.8 * len(x | y):
                links[a] += 1
                links[b] += 1
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (a, _) in enumerate(docs):
        groups[find(i)].append(a)
    want = {a: min((b for b in groups[find(i)] if b is not None), default=None) for i, (a, _) in enumerate(docs)}
    got, found = {r.doc_id: r.class_id for r in rows}, {}
    for r in rows:
        found[r.doc_id] = found.get(r.doc_id, 0) + r.n_links
    assert len(rows) == len(docs)
    assert sum(found.values()) >= least_recall * sum(links.values()) and all(found[a] <= links[a] for a in found)
    if least_recall == 1.0:
        assert got == want


def test_links_of_real_documents(docs):
    check_links(jaccard.jaccard_links(docs).collect(), docs)


def test_links_of_odd_documents(odd, none):
    odd = odd.where("doc_id <> 8 and doc_id is not null")
    check_links(jaccard.jaccard_links(odd).collect(), odd)
    assert jaccard.jaccard_links(none).count() == 0


def test_large_group_in_many_blocks(spark, monkeypatch):
    """Near copies of one text, more than a block holds, and a far text that shares a passage."""
    draw, words = random.Random(5), [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        own = list(words)
        for _ in range(draw.randint(0, 12)):
            own[draw.randrange(300)] = f"x{draw.randrange(9)}"
        rows.append((i, " ".join(own)))
    rows += [(100 + i, " ".join(words[:40] + [f"z{i}{k}" for k in range(200)])) for i in range(10)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard, "BLOCK_CLASSES", 16)
    check_links(jaccard.jaccard_links(table, recall=0.9999, trees=24).collect(), table, 0.995)


def test_near_copies_leave_one(odd, docs, none):
    kept = jaccard.keep_one_near(odd)
    assert kept.columns == odd.columns
    got = sorted(str(r.doc_id) for r in kept.collect())
    assert got.count("7") == 1 and "8" not in got and got.count("None") == 2
    groups = {r.class_id for r in jaccard.jaccard_links(docs).collect()}
    assert sorted(r.doc_id for r in jaccard.keep_one_near(docs).collect()) == sorted(groups)
    assert jaccard.keep_one_near(none).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\té", max_size=30), min_size=1, max_size=6))
def test_shingles_of_a_batch_are_those_of_each_text(texts):
    whole = [(sh[off[i] : off[i + 1]].tolist()) for _, _, d, o in slices(pa.array(texts)) for sh, off in [shingles(find_words(d, o), 5)] for i in range(len(o) - 1)]
    for text, got in zip(texts, whole, strict=True):
        assert len(set(got)) == len(sets(text))
        (alone,) = [shingles(find_words(d, o), 5)[0] for _, _, d, o in slices(pa.array([text]))]
        assert alone.tolist() == got


def test_overlap_counts():
    draw = np.random.default_rng(1)
    a = [np.unique(draw.integers(0, 60, n, dtype=np.uint64)) for n in (5, 30, 1)]
    b = [np.unique(draw.integers(0, 60, n, dtype=np.uint64)) for n in (40, 3)]
    assert jaccard.overlap(a, b).tolist() == [[len(set(x.tolist()) & set(y.tolist())) for y in b] for x in a]


def test_prefix_is_shortened_until_the_recall():
    assert jaccard.prefix_length(0.8, 16, 8, 0.5) > jaccard.prefix_length(0.8, 16, 8, 0.999)
    with pytest.raises(ValueError, match="more trees"):
        jaccard.prefix_length(0.1, 2, 8, 0.99)
