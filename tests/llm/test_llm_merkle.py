"""Merkle manifest against a plain tree, its bitmaps against counting."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from parcelscope.llm import merkle


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row.doc_id, row.source, row.lang, row.n_chars, text)))


def tree(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][a : a + 8])) for a in range(0, len(out[-1]), 8)])
    return out


def siblings(levels, i):
    out = []
    for nodes in levels[:-1]:
        run = nodes[i // 8 * 8 : i // 8 * 8 + 8]
        out.append(("".join(run[: i % 8]), "".join(run[i % 8 + 1 :])))
        i //= 8
    return out


def lower(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def expected(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r.lang].append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    own = {x: sorted([((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)), n, r) for n, r in enumerate(groups[x])], key=lambda z: z[:2]) for x in langs}
    trees = {x: tree([k[2] for k, _, _ in own[x]]) for x in langs}
    top = tree([trees[x][-1][0] for x in langs])
    out = []
    for place, x in enumerate(langs):
        for i, (key, _, r) in enumerate(own[x]):
            way = siblings(trees[x], i) + siblings(top, place)
            node = leaf(r, lower(r.text)) if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0 else key[2]
            for left, right in way:
                node = digest(left + node + right)
            out.append((r.doc_id, key[2], trees[x][-1][0], top[-1][0], digest("".join(a + b for a, b in way)), node, node == top[-1][0]))
    return out


def shown(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_given_documents(docs):
    assert shown(merkle.manifest(docs, merkle.tampering()).collect()) == shown(expected(docs.collect()))


def test_odd_rows(odd, none):
    assert shown(merkle.manifest(odd, merkle.tampering()).collect()) == shown(expected(odd.collect()))
    assert merkle.manifest(none, merkle.tampering()).collect() == []


def test_several_tiers_ties_and_repeats(spark):
    rows = [(i * 37 - 5000, f"Text {i}", "en", "a", i) for i in range(1200)] + [(5, f"Other {i}", "en", "b", 1) for i in range(30)] + [(9, "Same", "fr", None, 1)] * 70
    rows += [(1, "alone", "it", "a", None), ((1 << 62) + 3, "far", "fr", "a", 2), (-(1 << 61), "near", None, "a", 2), (None, "none", "fr", "a", 2), (None, "more", "fr", "a", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    assert shown(merkle.manifest(docs, merkle.tampering()).collect()) == shown(expected(docs.collect()))


def test_unchanged_rows_verify_and_changed_ones_do_not(docs):
    for r in merkle.manifest(docs).collect():
        assert r.verified and r.folded_root == r.root
    changed = merkle.manifest(docs, merkle.tampering()).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in changed:
        assert r.verified == (zlib.crc32(str(r.doc_id).encode()) % 3 != 0 or lower(texts[r.doc_id]) == texts[r.doc_id])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, merkle.BLOCK - 1), min_size=1, max_size=60), st.integers(0, 3))
def test_rank_counts_rows_below(offsets, dense):
    counts = np.bincount(np.array(offsets), minlength=merkle.BLOCK)
    if dense:
        counts[:: dense + 1] += 1
    made = merkle.packed(counts)
    assert (merkle.unpacked(*made) == counts).all()
    bits = len(made[0]) == merkle.BLOCK // 8
    directory = np.concatenate([[0], np.cumsum((counts > 0).reshape(-1, 64).sum(axis=1))[:-1]]).astype("<u2").tobytes() if bits else b""
    assert bits == bool(dense)
    low = np.flatnonzero(counts)
    assert merkle.rank(low, *made, directory).tolist() == (np.cumsum(counts) - counts)[low].tolist()


@pytest.mark.parametrize("n", [1, 8, 9, 64, 65, 512])
def test_levels_of_a_lone_record_end_in_one_node(n):
    nodes = [digest(str(i)) for i in range(n)]
    assert merkle.levels(nodes, True) == tree(nodes)
