"""Quality rules: statistics of a document, hard limits, and gradient-boosted trees.

The trees are fitted with second-order boosting on binned statistics, flattened into node arrays and
scored for all documents of a batch at once, a level at a time. Chosen statistics are
constrained: a larger share of repeats, symbols or equal lines never raises the score.
Trees are fitted by one task on at most ``rows`` labelled documents; the arrays have a fixed size.

Defined results: a null text has no words and fails; null labels are not learned from; with labels of one
kind only, the trees keep everything; repeated rows are judged each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .base import known, labelled_sample, mapped, ready
from .words import GRAM, LOWER, SPACE, find_words, mix, repeated, slices, spans, totals

MIN_WORDS = 50
FIT_ROWS = 4_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Name of each statistic that trees see, and whether the score may only fall (-1) as it grows.
STATISTICS = {
    "word_length": 0, "symbols_per_char": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": 0, "digit_share": 0,
    "stop_share": 0, "same_as_before": -1, "distinct_share": 0, "words_per_line": 0, "other_sign_share": 0, "longest_word": 0,
}
SYMBOL, STOP, SIGN = (np.zeros(256, dtype=bool) for _ in range(3))
SYMBOL[list(b"#*$%&|<>")] = True
STOP[list(b".,;:")] = True
SIGN[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def _total(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    return totals(mask, off).astype(np.int64)


def statistics(data: np.ndarray, doc_off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts (documents x COUNTS) and statistics (documents x STATISTICS) of whole texts."""
    words = find_words(data, doc_off)
    n, docs = words.count, len(doc_off) - 1
    h, owner = words.hashes(), words.owner()
    salt = mix(np.arange(docs, dtype=np.uint64) + np.uint64(77))

    seen = ~SPACE[data] & ((data & 0xC0) != 0x80)
    chars = _total((data & 0xC0) != 0x80, doc_off)
    word_chars = _total(seen, doc_off)
    symbols = _total(SYMBOL[data], doc_off)

    line_end = data == 10
    starts = np.flatnonzero(np.concatenate([[False], line_end[:-1]])) if len(data) else np.zeros(0, np.int64)
    starts = np.union1d(starts, doc_off[:-1][np.diff(doc_off) > 0])
    ends = np.append(starts[1:], len(data))[: len(starts)]
    ends = ends - line_end[np.maximum(ends - 1, 0)] * (ends > starts)
    line_owner = np.searchsorted(doc_off, starts, side="right") - 1
    worded = np.searchsorted(words.start, ends) > np.searchsorted(words.start, starts)
    lines = mix(spans(data, starts, ends) + (ends - starts).astype(np.uint64) * GRAM[5]) ^ salt[line_owner]
    lines, line_owner = lines[worded], line_owner[worded]
    order = np.lexsort((lines, line_owner))
    again = np.zeros(len(lines), dtype=np.int64)
    again[1:] = (lines[order][1:] == lines[order][:-1]) & (line_owner[order][1:] == line_owner[order][:-1])
    dup_lines = np.bincount(line_owner[order], weights=again, minlength=docs).astype(np.int64)
    n_lines = np.bincount(line_owner, minlength=docs)

    covered = np.zeros(len(h), dtype=bool)
    if len(h) > 2:
        at = np.flatnonzero(owner[2:] == owner[:-2])
        hits = at[repeated(mix(h[at] * GRAM[0] + h[at + 1] * GRAM[1] + h[at + 2] * GRAM[2]) ^ salt[owner[at]])]
        for k in range(3):
            covered[hits + k] = True
    repeats = _total(covered, words.off)

    low = words.hashes(LOWER[data])
    same = np.zeros(len(h), dtype=bool)
    same[1:] = (low[1:] == low[:-1]) & (owner[1:] == owner[:-1])
    distinct = n - _same_words(low, words.off)
    length = words.end - words.start
    longest = np.zeros(docs)
    some = np.flatnonzero(n)
    if len(some):
        longest[some] = np.maximum.reduceat(length, words.off[:-1][some])
    w, c = np.maximum(n, 1), np.maximum(chars, 1)
    table = np.stack([
        word_chars / w, symbols / c, dup_lines / np.maximum(n_lines, 1), repeats / w,
        _total((data >= 65) & (data <= 90), doc_off) / c, _total((data >= 48) & (data <= 57), doc_off) / c, _total(STOP[data], doc_off) / w,
        _total(same, words.off) / w, distinct / w, n / np.maximum(n_lines, 1), _total(SIGN[data] & ~STOP[data], doc_off) / c, longest,
    ], axis=1)
    return np.stack([n, word_chars, symbols, dup_lines, repeats], axis=1), table


def _same_words(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Words of each document that equal an earlier one of it."""
    out = np.zeros(len(off) - 1, dtype=np.int64)
    for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
        out[i] = (b - a) - len(np.unique(h[a:b]))
    return out


class Trees:
    """Boosted trees as node arrays: children of node i are at ``left[i]`` and ``right[i]``, itself at a leaf."""

    def __init__(self, roots: list[int], feature: np.ndarray, limit: np.ndarray, left: np.ndarray, right: np.ndarray, value: np.ndarray, depth: int, base: float):
        self.roots, self.feature, self.limit, self.left, self.right, self.value, self.depth, self.base = roots, feature, limit, left, right, value, depth, base

    @classmethod
    def keeping_all(cls) -> Trees:
        return cls([0], np.zeros(1, int), np.zeros(1), np.zeros(1, int), np.zeros(1, int), np.zeros(1), 0, 30.0)

    def raw(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))[:, None]
        node = np.broadcast_to(np.array(self.roots, dtype=np.int64), (len(x), len(self.roots))).copy()
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.limit[node], self.left[node], self.right[node])
        return self.base + self.value[node].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.raw(x), -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 48, l2: float = 1.0, least: float = 1.0) -> Trees:
    """Fit trees to labels 0/1; ``signs`` constrains each column of x (1 rising, -1 falling, 0 free)."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    total = np.full(len(y), base)
    feature, limit, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        for a in (feature, left, right):
            a.append(0)
        limit.append(0.0)
        value.append(0.0)
        left[-1] = right[-1] = len(value) - 1
        return len(value) - 1

    def weight(g: float, h: float, low: float, high: float) -> float:
        return min(max(-g / (h + l2), low), high)

    for _ in range(trees):
        p = 1.0 / (1.0 + np.exp(-total))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        roots.append(node())
        todo = [(roots[-1], np.arange(len(y)), 0, -np.inf, np.inf)]
        while todo:
            at, rows, level, low, high = todo.pop()
            best = (1e-6, -1, 0)
            gs, hs = g[rows].sum(), h[rows].sum()
            value[at] = rate * weight(gs, hs, low, high)
            total[rows] += value[at] if level == depth else 0
            if level == depth:
                continue
            for f in range(x.shape[1]):
                gl = np.cumsum(np.bincount(binned[rows, f], weights=g[rows], minlength=len(edges[f]) + 1))[:-1]
                hl = np.cumsum(np.bincount(binned[rows, f], weights=h[rows], minlength=len(edges[f]) + 1))[:-1]
                gr, hr = gs - gl, hs - hl
                gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - gs**2 / (hs + l2)
                bad = (hl < least) | (hr < least)
                if signs[f]:
                    bad |= signs[f] * (-gr / (hr + l2) + gl / (hl + l2)) < 0
                gain = np.where(bad, -1.0, gain)
                if len(gain) and gain.max() > best[0]:
                    best = (float(gain.max()), f, int(gain.argmax()))
            if best[1] < 0:
                total[rows] += value[at]
                continue
            _, f, cut = best
            goes = binned[rows, f] <= cut
            a, b = node(), node()
            feature[at], limit[at], left[at], right[at], value[at] = f, float(edges[f][cut]), a, b, 0.0
            low_a = low_b = low
            high_a = high_b = high
            if signs[f]:
                middle = sum(weight(g[r].sum(), h[r].sum(), low, high) for r in (rows[goes], rows[~goes])) / 2
                low_a, high_a, low_b, high_b = (low, middle, middle, high) if signs[f] > 0 else (middle, high, low, middle)
            todo += [(a, rows[goes], level + 1, low_a, high_a), (b, rows[~goes], level + 1, low_b, high_b)]
    arrays = [np.array(v) for v in (feature, limit, left, right, value)]
    return Trees(roots, *arrays, depth, base)


def fit_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["turn"], r["doc_id"], r["text"]))
    y = np.array([r["label"] for r in rows])
    if len(set(y.tolist())) < 2:
        model = Trees.keeping_all()
    else:
        parts = [statistics(data, off)[1] for _, _, data, off in slices(pa.array([r["text"] for r in rows], pa.string()))]
        model = grow(np.concatenate(parts), y, list(STATISTICS.values()))
    out = {"roots": [model.roots], "feature": [model.feature.tolist()], "lim": [model.limit.tolist()], "left": [model.left.tolist()], "right": [model.right.tolist()], "value": [model.value.tolist()], "depth": [model.depth], "base": [model.base]}
    kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.int64(), pa.float64()]
    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))


def fit_trees(docs: DataFrame, labels: DataFrame, label: str = "quality", train: Column | None = None, rows: int = FIT_ROWS) -> Trees:
    sample = labelled_sample(docs, labels, label, train, rows)
    schema = "roots array<long>, feature array<long>, lim array<double>, left array<long>, right array<long>, value array<double>, depth long, base double"
    r = mapped(sample.coalesce(1), fit_task, schema).first()
    if r is None:
        return Trees.keeping_all()
    return Trees(list(r.roots), np.array(r.feature, int), np.array(r.lim), np.array(r.left, int), np.array(r.right, int), np.array(r.value), r.depth, r.base)


def judge_documents(docs: DataFrame, trees: Trees, threshold: float = 0.5) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, score, kept."""
    ready(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(trees)
    fields = ", ".join(f"{c} long" for c in COUNTS)

    @F.arrow_udf(f"{fields}, score double")
    def judge(texts: pa.Array) -> pa.Array:
        counts, scores = [np.zeros((0, len(COUNTS)), np.int64)], [np.zeros(0)]
        for _, _, data, off in slices(texts):
            found, table = statistics(data, off)
            counts.append(found)
            scores.append(sent.value.probability(table))
        all_counts = np.concatenate(counts)
        columns = [pa.array(all_counts[:, i]) for i in range(len(COUNTS))]
        return pa.StructArray.from_arrays([*columns, pa.array(np.concatenate(scores))], names=[*COUNTS, "score"])

    rows = docs.select(F.col("doc_id").cast("long"), judge(known()).alias("found")).select("doc_id", "found.*")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold))
