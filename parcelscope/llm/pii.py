"""Personal data: fixed patterns, and a linear-chain CRF over word-shape features.

Base findings are the leftmost, non-overlapping matches of each kind that pass its check.
The CRF labels the words of a line (outside, or first and further words of a kind). Its features
are shapes: the word's character classes with run lengths, without them, marks such as @ or a
leading +, and the shapes of the words beside it; texts of words are no feature. It is
trained by forward-backward gradients on a small table of labelled lines; by default lines of a bounded
sample of documents, labelled by the base patterns. Batches of lines are decoded by Viterbi, one step
for all lines at a time. Lines without digit or @ are outside as a whole: no shape in
them can begin personal data, and training gives such words no other label. Long lines
are trained on and decoded in runs of ``STEPS`` words that overlap by half; in decoding a word
takes the label of the run in which it is further from the end, in training no run begins
inside a finding.

CRF spans that touch no base finding and pass the kind's check are added.

Defined results: a null text is empty and has no findings; without labelled lines nothing is
added; repeated rows are searched each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .base import known, mapped, ready, text_sample
from .words import slices

# Fixed patterns.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
BUCKETS = 1 << 13
SLOTS = 8  # features of a word
STEPS = 64
FIT_LINES = 600
TRIM = ".,;:!?\"'"
_SHAPES: dict[str, tuple[int, ...]] = {}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def valid(kind: str, text: str) -> bool:
    digits = "".join(c for c in text if "0" <= c <= "9")
    if kind == "ip":
        parts = text.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in parts)
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return 8 <= len(digits) <= 15 if kind == "phone" else "@" in text


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_findings(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), by kind as listed and start."""
    found = [(s, e, "email") for s, e in emails(text)] if "@" in text else []
    for kind, pattern in (("ip", IP), ("card", CARD), ("phone", PHONE)):
        found += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if valid(kind, m.group())]
    return found


def classes(word: str) -> str:
    return "".join("d" if "0" <= c <= "9" else "A" if "A" <= c <= "Z" else "a" if "a" <= c <= "z" else c if ord(c) < 128 else "u" for c in word)


def bucket(name: str) -> int:
    return zlib.crc32(name.encode()) % BUCKETS


def own_features(word: str) -> tuple[int, ...]:
    """Buckets of a word's shape, its collapsed shape, and its marks; kept for words seen before."""
    got = _SHAPES.get(word)
    if got is None:
        full = classes(word)
        runs = "".join(f"{m.group(1)}{min(len(m.group()), 9)}" for m in re.finditer(r"(.)\1*", full, re.DOTALL))
        short = re.sub(r"(.)\1+", r"\1", full, flags=re.DOTALL)
        marks = f"{'@' in word}{word[0] == '+'}{word[0] == '('}{min(word.count('.'), 4)}{min(sum(c == 'd' for c in full), 20)}"
        got = bucket("r" + runs), bucket("s" + short), bucket("m" + marks), bucket("<" + short), bucket(">" + short)
        if len(_SHAPES) > 200_000:
            _SHAPES.clear()
        _SHAPES[word] = got
    return got


EDGE = (bucket("<edge"), bucket(">edge"))


def features(words: list[str]) -> np.ndarray:
    """Words x SLOTS buckets: own shapes, marks, shapes of the neighbours, a constant."""
    own = [own_features(w) for w in words]
    rows = []
    for i, (runs, short, marks, _, _) in enumerate(own):
        before = own[i - 1][3] if i else EDGE[0]
        after = own[i + 1][4] if i + 1 < len(own) else EDGE[1]
        rows.append((runs, short, marks, before, after, zlib.crc32(b"%d,%d" % (short, before)) % BUCKETS, zlib.crc32(b"%d;%d" % (short, after)) % BUCKETS, 0))
    return np.array(rows, dtype=np.int32).reshape(-1, SLOTS)


def allowed() -> np.ndarray:
    """0 where the second label may follow the first, else a large negative number."""
    ok = np.zeros((len(LABELS), len(LABELS)))
    for j, b in enumerate(LABELS):
        if b[0] == "I":
            ok[[i for i, a in enumerate(LABELS) if a[2:] != b[2:]], j] = -1e4
    return ok


START = np.array([-1e4 if b[0] == "I" else 0.0 for b in LABELS])


class Chain:
    """Emission weights (buckets x labels) and transition weights."""

    def __init__(self, emit: np.ndarray, move: np.ndarray, fitted: bool):
        self.emit, self.move, self.fitted = emit, move, fitted

    @classmethod
    def empty(cls) -> Chain:
        return cls(np.zeros((BUCKETS, len(LABELS))), np.zeros((len(LABELS), len(LABELS))), False)

    def train(self, lines: list[np.ndarray], tags: list[np.ndarray], epochs: int = 12, batch: int = 32, rate: float = 0.3, l2: float = 1e-4, seed: int = 13) -> None:
        """AdaGrad on the log-likelihood, with forward-backward over padded batches."""
        rng, bans = np.random.default_rng(seed), allowed()
        seen_e, seen_m = np.full_like(self.emit, 1e-6), np.full_like(self.move, 1e-6)
        for _ in range(epochs):
            order = rng.permutation(len(lines))
            for at in range(0, len(order), batch):
                part = order[at : at + batch]
                x, n = _padded([lines[i] for i in part])
                y = _padded([tags[i][:, None] for i in part])[0][:, :, 0]
                node, pair = self._marginals(x, n, bans)
                real = np.arange(x.shape[1])[None, :] < n[:, None]
                gold = np.eye(len(LABELS))[y]
                error = np.where(real[:, :, None], node - gold, 0.0) / len(part)
                g_emit = np.zeros_like(self.emit)
                np.add.at(g_emit, x.reshape(-1), np.repeat(error.reshape(-1, len(LABELS)), SLOTS, axis=0))
                links = real[:, 1:]
                g_move = (np.where(links[:, :, None, None], pair, 0.0).sum(axis=(0, 1)) - np.einsum("bti,btj->ij", gold[:, :-1] * links[:, :, None], gold[:, 1:])) / len(part)
                touched = np.unique(x)
                g_emit[touched] += l2 * self.emit[touched]
                seen_e[touched] += g_emit[touched] ** 2
                self.emit[touched] -= rate * g_emit[touched] / np.sqrt(seen_e[touched])
                seen_m += g_move**2
                self.move -= rate * g_move / np.sqrt(seen_m)
        self.fitted = True

    def _marginals(self, x: np.ndarray, n: np.ndarray, bans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        score, move = self.emit[x].sum(axis=2), self.move + bans
        b, t, k = score.shape
        alpha, beta = np.zeros((b, t, k)), np.zeros((b, t, k))
        alpha[:, 0] = score[:, 0] + START
        for i in range(1, t):
            step = _logsum(alpha[:, i - 1, :, None] + move[None], 1) + score[:, i]
            alpha[:, i] = np.where((i < n)[:, None], step, alpha[:, i - 1])
        for i in range(t - 2, -1, -1):
            step = _logsum(move[None] + (score[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
            beta[:, i] = np.where((i + 1 < n)[:, None], step, 0.0)
        whole = _logsum(alpha[:, -1], 1)[:, None, None]
        node = np.exp(np.minimum(alpha + beta - whole, 0.0))
        pair = np.exp(np.minimum(alpha[:, :-1, :, None] + move[None, None] + (score + beta)[:, 1:, None, :] - whole[..., None], 0.0))
        return node, pair

    def decode(self, lines: list[np.ndarray]) -> list[np.ndarray]:
        """Best labels of each line, a step for all lines at a time."""
        if not lines:
            return []
        x, n = _padded(lines)
        score, move = self.emit[x].sum(axis=2), self.move + allowed()
        best, back = score[:, 0] + START, np.zeros(score.shape, dtype=np.int8)
        for i in range(1, x.shape[1]):
            ways = best[:, :, None] + move[None]
            back[:, i] = ways.argmax(axis=1)
            best = np.where((i < n)[:, None], ways.max(axis=1) + score[:, i], best)
        tags = np.zeros(x.shape[:2], dtype=np.int64)
        last = best.argmax(axis=1)
        for i in range(x.shape[1] - 1, -1, -1):
            tags[:, i] = last
            if i:
                last = np.where(i < n, back[np.arange(len(lines)), i, last], last)
        return [tags[j, : n[j]] for j in range(len(lines))]

    def packed(self) -> bytes:
        return np.concatenate([[float(self.fitted)], self.emit.reshape(-1), self.move.reshape(-1)]).astype("<f4").tobytes()

    @classmethod
    def unpacked(cls, raw: bytes) -> Chain:
        flat, k = np.frombuffer(raw, "<f4").astype(np.float64), len(LABELS)
        return cls(flat[1 : 1 + BUCKETS * k].reshape(BUCKETS, k), flat[1 + BUCKETS * k :].reshape(k, k), flat[0] > 0)


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(r) for r in rows])
    out = np.zeros((len(rows), max(1, int(n.max())), rows[0].shape[1]), dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out, n


def tagged(words: list[tuple[int, int]], found: list[tuple[int, int, str]]) -> np.ndarray:
    """Label number of each word span: that of the finding it touches."""
    tags = np.zeros(len(words), dtype=np.int64)
    starts, ends = [a for a, _ in words], [b for _, b in words]
    for s, e, kind in found:
        for k, i in enumerate(range(bisect_right(ends, s), bisect_left(starts, e))):
            tags[i] = LABELS.index(("B-" if k == 0 else "I-") + kind)
    return tags


def lines_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled lines: with a base finding, and without one but with a digit."""
    for batch in batches:
        rows = []
        for text in batch.column(0).to_pylist():
            for line in text.split("\n"):
                if any(c.isdigit() or c == "@" for c in line):
                    words = [m.span() for m in WORD.finditer(line)]
                    tags = tagged(words, base_findings(line))
                    rows.append(([line[s:e] for s, e in words], tags.tolist()))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.list_(pa.string())), pa.array([r[1] for r in rows], pa.list_(pa.int32()))], names=["words", "tags"])


def labelled_lines(docs: DataFrame, rows: int = FIT_LINES) -> DataFrame:
    """(words, tags) of lines with a digit or @ of at most ``rows`` texts that have one."""
    return mapped(text_sample(docs, [F.col("text").rlike(r"[0-9@]")], rows), lines_task, "words array<string>, tags array<int>")


def training_runs(tags: list[int]) -> Iterator[tuple[int, int]]:
    """(first, past the last) word of the runs of a line, as in decoding; one that would begin inside a finding begins with it."""
    for first in range(0, max(1, len(tags) - STEPS // 2), STEPS // 2):
        start = first
        while start and LABELS[tags[start]][0] == "I":
            start -= 1
        yield start, min(len(tags), first + STEPS)


def run_features(words: list[str], start: int, end: int) -> np.ndarray:
    """Features of a run, with the line's own neighbours at its ends."""
    low = max(0, start - 1)
    return features(words[low : end + 1])[start - low : end - low]


def train_task(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    chain = Chain.empty()
    rows = sorted((r["words"], r["tags"]) for b in batches for r in b.to_pylist())
    runs = [(w, t, s, e) for w, t in rows for s, e in training_runs(t)]
    marked, plain = [r for r in runs if any(r[1][r[2] : r[3]])], [r for r in runs if not any(r[1][r[2] : r[3]])]
    kept = [r for group in (marked, plain) for r in group[:: max(1, -(-len(group) // most))]]
    if marked:
        chain.train([run_features(w, s, e) for w, _, s, e in kept], [np.array(t[s:e]) for _, t, s, e in kept])
    yield pa.RecordBatch.from_arrays([pa.array([chain.packed()], pa.binary())], names=["chain"])


def fit_chain(lines: DataFrame, most: int = 600) -> Chain:
    """A chain from labelled lines (words, tags), at most ``most`` runs of them with findings and as many without."""
    row = mapped(lines.coalesce(1), train_task, "chain binary", most=most).first()
    return Chain.unpacked(row[0]) if row else Chain.empty()


def _spans(words: list[tuple[int, int]], tags: np.ndarray, text: str) -> Iterator[tuple[int, int, str]]:
    i = 0
    while i < len(words):
        if tags[i]:
            kind, j = LABELS[tags[i]][2:], i + 1
            while j < len(words) and LABELS[tags[j]] == f"I-{kind}":
                j += 1
            start, end = words[i][0], words[j - 1][1]
            while end > start and text[end - 1] in TRIM:
                end -= 1
            while start < end and text[start] in TRIM:
                start += 1
            if end > start:
                yield start, end, kind
            i = j
        else:
            i += 1


def search(texts: pa.Array, chain: Chain) -> list[list[tuple[int, int, str]]]:
    """Findings of each text: base ones, and those that the chain adds."""
    out: list[list[tuple[int, int, str]]] = [[] for _ in range(len(texts))]
    runs: list[tuple[int, str, list[tuple[int, int]], int, int]] = []
    held: list[np.ndarray] = []

    def flush() -> None:
        marks: dict[tuple[int, int], np.ndarray] = {}
        for (i, _, words, at, key), tags in zip(runs, chain.decode(held), strict=True):
            whole = marks.setdefault((i, key), np.zeros(len(words), dtype=np.int64))
            skip = STEPS // 4 if at else 0
            whole[at + skip : at + len(tags)] = tags[skip:]
        for i, text, words, at, key in runs:
            if at == 0:
                for s, e, kind in _spans(words, marks[i, key], text):
                    if valid(kind, text[s:e]) and all(b <= s or a >= e for a, b, _ in out[i]):
                        out[i].append((s, e, kind))
        runs.clear()
        held.clear()

    for low, _, data, doc_off in slices(texts):
        hit = np.flatnonzero(((data >= 48) & (data <= 57)) | (data == 64))
        for i in np.unique(np.searchsorted(doc_off, hit, side="right") - 1).tolist():
            text = data[doc_off[i] : doc_off[i + 1]].tobytes().decode()
            out[low + i] = base_findings(text)
            at = 0
            for line in text.split("\n") if chain.fitted else ():
                if re.search(r"[0-9@]", line):
                    words = [(m.start() + at, m.end() + at) for m in WORD.finditer(line)]
                    rows = features([text[s:e] for s, e in words])
                    for first in range(0, max(1, len(words) - STEPS // 2), STEPS // 2):
                        runs.append((low + i, text, words, first, at))
                        held.append(rows[first : first + STEPS])
                at += len(line) + 1
            if len(held) > 2000:
                flush()
    flush()
    return [sorted(f, key=lambda f: (KINDS.index(f[2]), f[0])) for f in out]


def find_personal(docs: DataFrame, chain: Chain) -> DataFrame:
    """One row per document: doc_id, findings array<struct<kind, start, end, base>> by kind and start."""
    ready(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(chain.packed())

    @F.arrow_udf("array<struct<kind: string, start: int, end: int, base: boolean>>")
    def judge(texts: pa.Array) -> pa.Array:
        rows = []
        for text, found in zip(texts, search(texts, Chain.unpacked(sent.value)), strict=True):
            base = set(base_findings(text.as_py())) if found else ()
            rows.append([{"kind": k, "start": s, "end": e, "base": (s, e, k) in base} for s, e, k in found])
        return pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])))

    return docs.select(F.col("doc_id").cast("long"), judge(known()).alias("findings"))


def digests(found: DataFrame) -> DataFrame:
    """Findings as numbers and strings: doc_id, n_<kind> and base_sha256 of base findings, spans of all."""
    def text(rows: Column) -> Column:
        return F.array_join(F.transform(rows, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")

    base = F.filter("findings", lambda f: f["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("findings", lambda f: f["base"] & (f["kind"] == kind))).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("findings")).alias("spans"))
