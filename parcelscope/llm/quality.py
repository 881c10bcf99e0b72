"""Quality classifier: logistic regression on hashed word n-grams, trained with FTRL-proximal updates.

Features of a text are its word n-grams, each in a hash bucket of its own family: lower-cased
words and pairs of them, shapes of words (character classes, ends, length) and pairs of
shapes, and repeats (which of the three words before is the same). Their weight is the
share of the n-grams of a document, so the length itself tells nothing. A score is one sparse dot
product: the mean weight of a document's n-grams, over all of its text.

The model is fitted by one task on at most ``rows`` labelled documents, those with the smallest hash of
their id; its table of weights has a fixed size. It reads text and label, no other column.

Defined results: a null text is empty; a text without words scores by the intercept alone;
null labels are not learned from; without labels of both kinds every score is 0.5; repeated rows are scored
each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .base import known, labelled_sample, mapped, ready
from .words import GRAM, LOWER, SPACE, Words, find_words, mix, slices, totals

BITS = 18
FAMILIES = 5
SCALE = 32.0  # logit per unit of mean weight
FIT_ROWS = 4_000  # bound of the training sample
EPOCHS = 2

KIND = np.zeros(256, dtype=np.uint64)  # character classes: lower, upper, digit, stop, other ASCII sign, multi-byte
KIND[97:123], KIND[65:91], KIND[48:58] = 1, 2, 4
KIND[33:48] = KIND[58:65] = KIND[91:97] = KIND[123:127] = 16
KIND[[33, 44, 46, 58, 59, 63]] = 8
KIND[128:] = 32


def shapes(words: Words) -> np.ndarray:
    """A number for the classes in a word, those at its ends, and its length up to 20."""
    if not len(words.start):
        return np.zeros(0, np.uint64)
    kinds = KIND[words.data]
    edges = np.stack([words.start, np.minimum(words.end, len(kinds) - 1)], axis=1).reshape(-1)
    have = np.bitwise_or.reduceat(np.where(SPACE[words.data], np.uint64(0), kinds), edges)[::2]
    if words.end[-1] == len(kinds):  # reduceat has no end after the last byte
        have[-1] = np.bitwise_or.reduce(kinds[words.start[-1] :])
    length = np.minimum(words.end - words.start, 20).astype(np.uint64)
    return have + np.uint64(64) * kinds[words.start] + np.uint64(4096) * kinds[words.end - 1] + np.uint64(262144) * length


def features(words: Words, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (families one after the other in one table) of the n-grams at each word; bucket of the first word's pairs is of the word alone."""
    h = words.hashes(LOWER[words.data])
    shape = shapes(words)
    n = len(h)
    first = np.zeros(n, dtype=bool)
    first[words.off[:-1][words.count > 0]] = True
    pair, shape_pair = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    pair[1:], shape_pair[1:] = h[:-1] * GRAM[1], shape[:-1]
    pair[first] = shape_pair[first] = 0
    owner = words.owner()
    same = np.zeros(n, np.uint64)
    for back in (1, 2, 3):
        same[back:] += ((h[back:] == h[:-back]) & (owner[back:] == owner[:-back])).astype(np.uint64) << np.uint64(back)
    salts = GRAM[9] * np.arange(1, FAMILIES + 1, dtype=np.uint64)
    grams = [h, h * GRAM[0] + pair, mix(shape), mix(shape * np.uint64(8191) + shape_pair * GRAM[2]), same + np.uint64(16)]
    top = np.uint64(64 - bits)
    table = np.stack([(mix(g + salts[k]) >> top) + np.uint64(k << bits) for k, g in enumerate(grams)], axis=1)
    return table.astype(np.int32), owner


def fit(texts: list[str], labels: np.ndarray, bits: int = BITS, epochs: int = EPOCHS, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.001, l2: float = 0.01, seed: int = 3) -> np.ndarray:
    """Weights of all buckets and, last, the intercept."""
    size = (FAMILIES << bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    docs: list[tuple[np.ndarray, np.ndarray, float]] = []  # buckets, counts in few bytes, weight of one
    for _, _, data, doc_off in slices(pa.array(texts, pa.string())):
        words = find_words(data, doc_off)
        table, _ = features(words, bits)
        for a, b in zip(words.off[:-1], words.off[1:], strict=True):
            ids, counts = np.unique(table[a:b], return_counts=True)
            few = counts.astype(np.min_scalar_type(counts.max(initial=0)))
            docs.append((np.append(ids, np.int32(size - 1)), few, SCALE / max(1, (b - a) * FAMILIES)))
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(docs)):
            ids, counts, unit = docs[i]
            x = np.append(counts * unit, 1.0)
            zi, ni = z[ids], n[ids]
            w = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            g = (1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30))) - labels[i]) * x
            z[ids] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[ids] += g * g
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2)).astype(np.float32)


def score(column: pa.Array, weights: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Probability of label 1 of each text."""
    out = np.zeros(len(column))
    for low, high, data, doc_off in slices(column):
        words = find_words(data, doc_off)
        table, _ = features(words, bits)
        each = weights[table].sum(axis=1, dtype=np.float64)
        mean = totals(each, words.off) / np.maximum(1, words.count * FAMILIES)
        out[low:high] = 1.0 / (1.0 + np.exp(-np.clip(SCALE * mean + weights[-1], -30, 30)))
    return out


def fit_task(batches: Iterator[pa.RecordBatch], **settings: float) -> Iterator[pa.RecordBatch]:
    rows = [r for b in batches for r in b.to_pylist()]
    rows.sort(key=lambda r: (r["turn"], r["doc_id"], r["text"]))
    labels = np.array([r["label"] for r in rows], dtype=np.float64)
    both = len(set(labels.tolist())) == 2
    weights = fit([r["text"] for r in rows], labels, **settings) if both else np.zeros((FAMILIES << BITS) + 1, np.float32)
    yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary())], names=["weights"])


def fit_model(docs: DataFrame, labels: DataFrame, label: str = "quality", train: Column | None = None, rows: int = FIT_ROWS) -> np.ndarray:
    """Weights fitted on at most ``rows`` labelled documents for which ``train`` (of doc_id) holds."""
    sample = labelled_sample(docs, labels, label, train, rows)
    row = mapped(sample.coalesce(1), fit_task, "weights binary").first()
    return np.frombuffer(row[0], dtype=np.float32) if row else np.zeros((FAMILIES << BITS) + 1, np.float32)


def score_column(docs: DataFrame, weights: np.ndarray, text: str = "text") -> Column:
    """Score of a text column; the table of weights, of fixed size, is sent to each executor once."""
    ready(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    @F.arrow_udf("double")
    def judge(texts: pa.Array) -> pa.Array:
        return pa.array(score(texts, sent.value))

    return judge(known(text))


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", train: Column | None = None, rows: int = FIT_ROWS, threshold: float = 0.7) -> DataFrame:
    """One row per document: doc_id, score, predicted."""
    weights = fit_model(docs, labels, label, train, rows)
    scored = docs.select(F.col("doc_id").cast("long"), score_column(docs, weights).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", train: Column | None = None, rows: int = FIT_ROWS, threshold: float = 0.7) -> DataFrame:
    """The documents that score at least the threshold, all columns kept."""
    weights = fit_model(docs, labels, label, train, rows)
    return docs.where(score_column(docs, weights) >= threshold)
