"""Toxicity classifier with a counterfactual penalty: swapping identity terms must not change a score.

Features of a text, each in a hash bucket of its own family: its lower-cased words, once each, however long the text is; and
the share of its words that start with a run of ``HEADS`` bytes, for stems in any language. A logistic model is
fitted by follow-the-regularised-leader steps. Beside each labelled text stand counterfactual pairs: a sentence of it with its
identity terms swapped for others of their list (the neutral word of the list among them). Their
features differ by d; the step for the pair is that of ``penalty * (w . d)^2``, so weight that sits on the mention of a
group, as labels of real texts suggest, goes. Where a text names no group, a mention is put into one of its sentences.

The model is fitted by one task on at most ``rows`` labelled documents, those with the smallest hash of their id, half of
the bound for each label; its table of weights has a fixed size. It reads text and label, no other column.

Defined results: a null text is empty; a text without words scores by the intercept; null labels are not learned from;
without labels of both kinds every score is 0.5; repeated rows are scored each; very long texts are read whole; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .base import known, labelled_sample, mapped, ready
from .words import GRAM, LOWER, Words, find_words, mix, slices, spans, totals

BITS = 18
HEADS = (4, 5, 6)  # bytes
FAMILIES = 1 + len(HEADS)
SHARE = 20.0  # value of a head that every word starts with
FIT_ROWS = 4_000
STEPS = 40_000  # documents gone through while fitting: passes over a small sample are repeated, 20 times at most
PENALTY = 4.0
VARIANTS = 2  # counterfactuals of a sentence

#: Identity terms, a list for each kind of group and language; the first word is neutral.
IDENTITY = (
    ("people", "women", "men", "girls", "boys"), ("people", "muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("people", "immigrants", "refugees", "foreigners", "asians", "africans", "europeans", "latinos"), ("people", "gays", "lesbians", "straights", "bisexuals"),
    ("neutral", "muslim", "christian", "jewish", "hindu", "buddhist"), ("neutral", "black", "white", "asian", "african", "european", "latino"),
    ("neutral", "gay", "lesbian", "straight", "bisexual", "transgender"), ("neutral", "disabled", "deaf", "blind", "old", "young"),
    ("leute", "frauen", "männer", "muslime", "christen", "juden", "ausländer", "flüchtlinge"), ("gens", "femmes", "hommes", "musulmans", "chrétiens", "juifs", "étrangers", "réfugiés"),
    ("gente", "mujeres", "hombres", "musulmanes", "cristianos", "judíos", "extranjeros", "refugiados"),
)
LISTS: dict[str, list[int]] = {}
for _at, _terms in enumerate(IDENTITY):
    for _term in _terms[1:]:
        LISTS.setdefault(_term, []).append(_at)
SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
NAMED = re.compile(r"\w+")


def features(words: Words, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, value) of all features that are not zero, by document."""
    data = LOWER[words.data]
    n = words.count
    owner = words.owner().astype(np.int64)
    top, size = np.uint64(64 - bits), FAMILIES << bits
    keys, weight = [owner * size + (mix(words.hashes(data) + GRAM[20]) >> top).astype(np.int64)], [None]
    for family, length in enumerate(HEADS, 1):
        long = words.end - words.start >= length
        start = words.start[long]
        head = (mix(spans(data, start, start + length) + GRAM[20 + family]) >> top).astype(np.int64)
        keys.append(owner[long] * size + (family << bits) + head)
        weight.append(SHARE)
    docs, buckets, values = [], [], []
    for key, share in zip(keys, weight, strict=True):
        each, count = np.unique(key, return_counts=True)
        doc = each // size
        docs.append(doc)
        buckets.append(each % size)
        values.append(np.ones(len(each)) if share is None else share * count / n[doc])
    doc = np.concatenate(docs)
    order = np.argsort(doc, kind="stable")
    return doc[order], np.concatenate(buckets)[order], np.concatenate(values)[order]


def vectors(texts: list[str], bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, values) of each text, the intercept last."""
    out = []
    for _, _, data, doc_off in slices(pa.array(texts, pa.string())):
        words = find_words(data, doc_off)
        doc, bucket, value = features(words, bits)
        cuts = np.searchsorted(doc, np.arange(len(doc_off)))
        out += [(np.append(bucket[a:b], FAMILIES << bits), np.append(value[a:b], 1.0)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return out


def swapped(sentence: str, turn: int) -> str | None:
    """The sentence with each identity term replaced by another one of its list; None where there is none."""
    found = False

    def other(match: re.Match) -> str:
        nonlocal found
        term = match[0].lower()
        if term not in LISTS:
            return match[0]
        found = True
        lists = LISTS[term]
        choices = [t for t in IDENTITY[lists[turn % len(lists)]] if t != term]
        return choices[turn % len(choices)]

    out = NAMED.sub(other, sentence)
    return out if found else None


def counterfactuals(text: str, turn: int, variants: int = VARIANTS) -> list[tuple[str, str]]:
    """Pairs of a sentence and its swapped form: all sentences that name a group, or else one with a mention put in."""
    sentences = [s.strip() for s in SENTENCE.findall(text) if s.strip()]
    pairs = [(s, made) for s in sentences for k in range(variants) if (made := swapped(s, turn * variants + k)) is not None]
    if pairs or not sentences:
        return pairs
    words = sentences[turn % len(sentences)].split()
    terms = IDENTITY[turn % len(IDENTITY)]
    at = turn % (len(words) + 1)
    named = [" ".join([*words[:at], t, *words[at:]]) for t in (terms[0], terms[1 + turn % (len(terms) - 1)])]
    return [(named[1], named[0])]


def gap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Features in which two texts differ."""
    ids = np.concatenate([a[0], b[0]])
    each, inverse = np.unique(ids, return_inverse=True)
    value = np.zeros(len(each))
    np.add.at(value, inverse, np.concatenate([a[1], -b[1]]))
    keep = np.abs(value) > 1e-12
    return each[keep], value[keep]


def fit(texts: list[str], labels: np.ndarray, penalty: float = PENALTY, bits: int = BITS, steps: int = STEPS, alpha: float = 1.0, beta: float = 1.0, l1: float = 2.0, l2: float = 0.0, seed: int = 5) -> np.ndarray:
    """Weights of all buckets and, last, the intercept."""
    size = (FAMILIES << bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    docs = vectors(texts, bits)
    pairs: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in texts]
    if penalty:
        made = [(i, a, b) for i, t in enumerate(texts) for a, b in counterfactuals(t, i)]
        both = vectors([s for _, a, b in made for s in (a, b)], bits)
        for k, (i, _, _) in enumerate(made):
            pairs[i].append(gap(both[2 * k], both[2 * k + 1]))

    def weights(ids: np.ndarray) -> np.ndarray:
        zi = z[ids]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[ids])) / alpha + l2))

    def step(ids: np.ndarray, w: np.ndarray, g: np.ndarray) -> None:
        z[ids] += g - (np.sqrt(n[ids] + g * g) - np.sqrt(n[ids])) / alpha * w
        n[ids] += g * g

    order = np.random.default_rng(seed)
    for _ in range(min(20, steps // max(1, len(docs)))):
        for i in order.permutation(len(docs)):
            ids, x = docs[i]
            w = weights(ids)
            step(ids, w, (1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30))) - labels[i]) * x)
            for ids, d in pairs[i]:
                w = weights(ids)
                step(ids, w, 2.0 * penalty / len(pairs[i]) * (d @ w) * d)
    return weights(np.arange(size)).astype(np.float32)


def score(column: pa.Array, weights: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Probability of label 1 of each text."""
    out = np.zeros(len(column))
    for low, high, data, doc_off in slices(column):
        doc, bucket, value = features(find_words(data, doc_off), bits)
        each = weights[bucket].astype(np.float64) * value
        logit = totals(each, np.searchsorted(doc, np.arange(high - low + 1))) + weights[-1]
        out[low:high] = 1.0 / (1.0 + np.exp(-np.clip(logit, -30, 30)))
    return out


def fit_task(batches: Iterator[pa.RecordBatch], **settings: float) -> Iterator[pa.RecordBatch]:
    rows = [r for b in batches for r in b.to_pylist()]
    rows.sort(key=lambda r: (r["turn"], r["doc_id"], r["text"]))
    labels = np.array([r["label"] for r in rows], dtype=np.float64)
    both = len(set(labels.tolist())) == 2
    weights = fit([r["text"] for r in rows], labels, **settings) if both else np.zeros((FAMILIES << BITS) + 1, np.float32)
    yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary())], names=["weights"])


def fit_model(docs: DataFrame, labels: DataFrame, label: str = "toxic", train: Column | None = None, rows: int = FIT_ROWS, penalty: float = PENALTY) -> np.ndarray:
    """Weights fitted on at most ``rows`` labelled documents for which ``train`` (of doc_id) holds, half of them of each label."""
    halves = [labelled_sample(docs, labels.where(F.col(label) == value), label, train, rows // 2) for value in (0, 1)]
    row = mapped(halves[0].unionByName(halves[1]).coalesce(1), fit_task, "weights binary", penalty=penalty).first()
    return np.frombuffer(row[0], dtype=np.float32) if row else np.zeros((FAMILIES << BITS) + 1, np.float32)


def toxic_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", train: Column | None = None, rows: int = FIT_ROWS, penalty: float = PENALTY, threshold: float = 0.5) -> DataFrame:
    """One row per document: doc_id, score, predicted."""
    weights = fit_model(docs, labels, label, train, rows, penalty)
    ready(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    @F.arrow_udf("double")
    def judge(texts: pa.Array) -> pa.Array:
        return pa.array(score(texts, sent.value))

    scored = docs.select(F.col("doc_id").cast("long"), judge(known()).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
