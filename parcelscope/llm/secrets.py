"""Secret scans: fixed patterns, and a character convolutional network over further candidates.

Base findings are the leftmost, non-overlapping matches of each kind. A candidate is a run of at least ``LEAST``
token characters with a letter and a digit. The network reads the candidate and the
characters around it: embedded characters, one convolution, largest and mean activation,
a logistic output. A candidate of more than ``INSIDE`` characters is read whole, in windows of
that many that overlap by half, and counts as its window with the largest output, in training
too; the cost of either grows with its length. It is trained on labelled findings (value, place, label): by default
all those that the base patterns give on the documents, against all candidates that
they leave, with the tell-tale key word hidden in half of the cases so that the value counts. Distinct findings are
dealt into blocks of about ``BLOCK``; in each of ``ROUNDS`` rounds every block trains the same network on, blocks side by side,
and the parameters are averaged. A quarter of the findings, by hash, is kept for calibration (a Platt line) and for the threshold: the
highest with the wanted recall, wherever that is. Both come from the counts of all kept findings by label and output, which is
read in steps of 1 / ``STEPS`` wherever it is used. The network keeps the recall and precision that
it reached there (``recall``, ``precision``; not a number if it could not be trained).

Candidates beside base findings with a probability over the threshold are added as kind
``cnn``. Which texts hold a pattern or candidate at all is found in the bytes of a batch.

Defined results: a null text is empty and has no findings; without labelled findings of
both kinds nothing is added; repeated rows are scanned each; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from parcelscope.session import spread

from .base import known, mapped, ready, settle
from .words import slices

# Fixed patterns.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "cnn")
WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
LEAST = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % LEAST)
KEYED = re.compile(r"""[A-Za-z_]*["']?\x20*[:=]\x20*["']?$""")

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-:\"'@ \n"
CODE = {c: i + 2 for i, c in enumerate(ALPHABET)}  # 0: nothing there, 1: any other character
BEFORE, INSIDE, AFTER = 16, 40, 8
WIDTH, DIMS, FILTERS = 5, 8, 24
BLOCK, BLOCK_CHARS = 2_000, 4_000_000  # findings, and characters, that one task trains on between two averages
ROUNDS, EPOCHS = 6, 2
STEPS, FURTHEST = 1_024, 32  # outputs are read in these steps, and no further out
TOKEN = np.zeros(256, dtype=bool)
TOKEN[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-")] = True
DIGIT, LETTER, HEXED = (np.zeros(256, dtype=bool) for _ in range(3))
DIGIT[48:58] = LETTER[65:91] = LETTER[97:123] = HEXED[48:58] = HEXED[97:103] = True


def base_findings(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), by start and kind as listed."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda f: (f[0], KINDS.index(f[2])))


def candidates(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Runs with a letter and a digit that touch no finding."""
    out = []
    for m in CANDIDATE.finditer(text):
        run = m.group()
        if any(c.isdigit() for c in run) and any(c.isalpha() for c in run) and all(e <= m.start() or s >= m.end() for s, e, _ in taken):
            out.append(m.span())
    return out


def _runs(mask: np.ndarray, least: int, doc_off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of at least ``least`` within one document each."""
    limit = np.zeros(len(mask) + 1, dtype=bool)
    limit[doc_off] = True
    before, after = (np.concatenate(x) for x in (([False], mask[:-1]), (mask[1:], [False])))
    start = np.flatnonzero(mask & (~before | limit[:-1]))
    end = np.flatnonzero(mask & (~after | limit[1:])) + 1
    long = end - start >= least
    return start[long], end[long]


def suspects(data: np.ndarray, doc_off: np.ndarray) -> np.ndarray:
    """Documents of a batch that hold a pattern or candidate, or seem to (a key word may cross into the next text)."""
    start, end = _runs(TOKEN[data], LEAST, doc_off)
    digits, letters = (np.concatenate([[0], np.cumsum(t[data])]) for t in (DIGIT, LETTER))
    some = (digits[end] > digits[start]) & (letters[end] > letters[start])
    places = [start[some], _runs(HEXED[data], 32, doc_off)[0]]
    low = data.tobytes().lower()
    for word in (*WORDS, b"akia"):
        at, hits = low.find(word), []
        while at >= 0:
            hits.append(at)
            at = low.find(word, at + 1)
        places.append(np.array(hits, dtype=np.int64))
    return np.unique(np.searchsorted(doc_off, np.concatenate(places), side="right") - 1)


def window(text: str, start: int, end: int) -> list[int]:
    """Codes of a span of at most ``INSIDE`` characters and those around it."""
    head = text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0")
    body = text[start:end].ljust(INSIDE, "\0")
    return [0 if c == "\0" else CODE.get(c, 1) for c in head + body + text[end : end + AFTER].ljust(AFTER, "\0")]


def windows(text: str, start: int, end: int) -> np.ndarray:
    """Codes of a span of any length: windows of ``INSIDE`` characters, the last one up to its end."""
    if end - start <= INSIDE:
        return np.array([window(text, start, end)], dtype=np.uint8)
    around = text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0") + text[start:end] + text[end : end + AFTER].ljust(AFTER, "\0")
    codes = np.array([0 if c == "\0" else CODE.get(c, 1) for c in around], dtype=np.uint8)
    first = np.append(np.arange(0, end - start - INSIDE, INSIDE // 2), end - start - INSIDE)
    return np.lib.stride_tricks.sliding_window_view(codes, BEFORE + INSIDE + AFTER)[first]


class CharNet:
    """Embedding, convolution, pooling and a logistic output, with their gradients."""

    SHAPES = {"emb": (len(ALPHABET) + 2, DIMS), "conv": (WIDTH * DIMS, FILTERS), "bias": (FILTERS,), "out": (2 * FILTERS,), "top": (1,)}

    def __init__(self, parameters: dict[str, np.ndarray], slope: float = 1.0, shift: float = 0.0, threshold: float = 2.0, recall: float = np.nan, precision: float = np.nan):
        self.p, self.slope, self.shift, self.threshold = parameters, slope, shift, threshold
        self.recall, self.precision = recall, precision

    @classmethod
    def fresh(cls, seed: int) -> CharNet:
        rng = np.random.default_rng(seed)
        return cls({n: rng.normal(0, 0.0 if n in ("bias", "top") else 0.3 if n == "emb" else 1 / np.sqrt(s[0]), s) for n, s in cls.SHAPES.items()})

    def forward(self, codes: np.ndarray) -> tuple[np.ndarray, tuple]:
        e = self.p["emb"][codes]
        steps = codes.shape[1] - WIDTH + 1
        patches = np.concatenate([e[:, k : k + steps] for k in range(WIDTH)], axis=2)
        z = patches @ self.p["conv"] + self.p["bias"]
        a = np.maximum(z, 0)
        where = a.argmax(axis=1)
        pooled = np.concatenate([np.take_along_axis(a, where[:, None, :], 1)[:, 0], a.mean(axis=1)], axis=1)
        return pooled @ self.p["out"] + self.p["top"][0], (codes, patches, z, where, pooled)

    def pick(self, spans: list[tuple[str, int, int]], size: int = 2048) -> np.ndarray:
        """Codes of each (text, start, end): of its window with the largest output."""
        out, best = np.zeros((len(spans), BEFORE + INSIDE + AFTER), dtype=np.uint8), np.full(len(spans), -np.inf)
        held: list[tuple[int, np.ndarray]] = []

        def compare() -> None:
            codes, owner = np.concatenate([c for _, c in held]), np.repeat([i for i, _ in held], [len(c) for _, c in held])
            output = self.forward(codes)[0]
            order = np.lexsort((-output, owner))
            top = order[np.unique(owner[order], return_index=True)[1]]
            top = top[output[top] > best[owner[top]]]
            out[owner[top]], best[owner[top]] = codes[top], output[top]
            held.clear()

        for i, (text, start, end) in enumerate(spans):
            codes = windows(text, start, end)
            if len(codes) == 1:
                out[i] = codes[0]
                continue
            for at in range(0, len(codes), size):
                held.append((i, codes[at : at + size]))
                if sum(len(c) for _, c in held) >= size:
                    compare()
        if held:
            compare()
        return out

    def gradients(self, kept: tuple, error: np.ndarray) -> dict[str, np.ndarray]:
        codes, patches, z, where, pooled = kept
        d_pool = error[:, None] * self.p["out"][None, :]
        d_a = np.repeat(d_pool[:, None, FILTERS:] / z.shape[1], z.shape[1], axis=1)
        rows, cols = np.arange(len(codes))[:, None], np.arange(FILTERS)[None, :]
        d_a[rows, where, cols] += d_pool[:, :FILTERS]
        d_z = d_a * (z > 0)
        d_patch = d_z @ self.p["conv"].T
        d_emb = np.zeros_like(self.p["emb"])
        for k in range(WIDTH):
            np.add.at(d_emb, codes[:, k : k + z.shape[1]], d_patch[:, :, k * DIMS : (k + 1) * DIMS])
        flat = patches.reshape(-1, patches.shape[2])
        return {"emb": d_emb, "conv": flat.T @ d_z.reshape(-1, FILTERS), "bias": d_z.sum(axis=(0, 1)), "out": pooled.T @ error, "top": error.sum(keepdims=True)}

    def train(self, spans: list[tuple[str, int, int]], labels: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.01, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        first, second = ({n: np.zeros_like(v) for n, v in self.p.items()} for _ in range(2))
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(spans))
            for at in range(0, len(order), batch):
                part = order[at : at + batch]
                logit, kept = self.forward(self.pick([spans[i] for i in part.tolist()]))
                error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[part]) / len(part)
                step += 1
                for n, g in self.gradients(kept, error).items():
                    first[n] = 0.9 * first[n] + 0.1 * g
                    second[n] = 0.999 * second[n] + 0.001 * g * g
                    self.p[n] -= rate * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)

    def cells(self, codes: np.ndarray) -> np.ndarray:
        """Outputs as whole numbers of steps."""
        return np.floor(np.clip(self.forward(codes)[0], -FURTHEST, FURTHEST) * STEPS).astype(np.int64)

    def calibrate(self, codes: np.ndarray, labels: np.ndarray, recall: float) -> None:
        self.calibrate_counts(self.cells(codes), labels, np.ones(len(labels), dtype=np.int64), recall)

    def calibrate_counts(self, cells: np.ndarray, labels: np.ndarray, counts: np.ndarray, recall: float) -> None:
        """A Platt line by gradient steps on scaled logits, and the highest threshold with the wanted recall."""
        logit, hit, total = cells / STEPS, labels > 0.5, int(counts.sum())
        hits = int(counts[hit].sum())
        scale = max(1.0, float(np.abs(logit) @ counts) / total)
        x = np.stack([logit / scale, np.ones_like(logit)], axis=1)
        t = np.where(hit, (hits + 1) / (hits + 2), 1 / (total - hits + 2))
        w = np.array([1.0, 0.0])
        for _ in range(400):
            w -= x.T @ ((1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - t) * counts) / total
        self.slope, self.shift = float(w[0]) / scale, float(w[1])
        p = self._calibrated(cells)
        order = np.argsort(p[hit], kind="stable")
        upto = np.cumsum(counts[hit][order])
        self.threshold = float(p[hit][order][np.searchsorted(upto, int((1 - recall) * hits), side="right")])
        found = int(counts[hit & (p >= self.threshold)].sum())
        self.recall, self.precision = found / hits, found / int(counts[p >= self.threshold].sum())

    def _calibrated(self, cells: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (cells / STEPS) + self.shift, -30, 30)))

    def probability(self, codes: np.ndarray) -> np.ndarray:
        return self._calibrated(self.cells(codes))

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[n].reshape(-1) for n in self.SHAPES])

    @classmethod
    def of_flat(cls, flat: np.ndarray, *calibration: float) -> CharNet:
        at, p = 0, {}
        for n, s in cls.SHAPES.items():
            size = int(np.prod(s))
            p[n], at = flat[at : at + size].reshape(s).copy(), at + size
        return cls(p, *calibration)

    def packed(self) -> bytes:
        tail = np.array([self.slope, self.shift, self.threshold, self.recall, self.precision])
        return np.concatenate([self.flat(), tail]).astype("<f8").tobytes()

    @classmethod
    def unpacked(cls, raw: bytes) -> CharNet:
        flat = np.frombuffer(raw, "<f8")
        return cls.of_flat(flat[:-5], *flat[-5:].tolist())


def findings_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled findings of texts by the base patterns: the value of an assignment, keys, digests; other candidates are no secret."""
    for batch in batches:
        for _, _, data, doc_off in slices(batch.column(0)):
            rows: list[tuple[str, int, int, int]] = []
            for i in suspects(data, doc_off).tolist():
                text = data[doc_off[i] : doc_off[i + 1]].tobytes().decode()
                base = base_findings(text)
                spans = [(s, e, 1) for s, e, kind in base if kind != "assign"]
                spans += [(m.start(2), m.end(2), 1) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
                spans += [(s, e, 0) for s, e in candidates(text, base)]
                rows += [(text[max(0, s - 40) : e + 20], s - max(0, s - 40), e - max(0, s - 40), label) for s, e, label in spans]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.int32()))], names=["text", "start", "end", "label"])


def labelled_findings(docs: DataFrame) -> DataFrame:
    """(text, start, end, label) of every text."""
    return mapped(docs.select(known().alias("text")), findings_task, "text string, start int, end int, label int")


def _hidden(row: tuple[int, str, int, int], hide: bool) -> tuple[str, int, int]:
    _, text, start, end = row
    key = KEYED.search(text[:start]) if hide else None
    return (text[: key.start()] + " " + text[start:], key.start() + 1, key.start() + 1 + end - start) if key else (text, start, end)


def _examples(table: pa.Table | pa.RecordBatch) -> tuple[list[tuple[str, int, int]], np.ndarray]:
    """Spans and labels, in an order of their own."""
    rows = sorted(zip(*(table.column(n).to_pylist() for n in ("label", "text", "start", "end", "hide")), strict=True))
    return [_hidden(r[:4], r[4]) for r in rows], np.array([r[0] for r in rows], dtype=np.float64)


def train_block(table: pa.Table, net: bytes, seed: int) -> pa.Table:
    """The network after some epochs on one block."""
    own = CharNet.unpacked(net)
    own.train(*_examples(table), epochs=EPOCHS, seed=seed)
    return pa.table({"net": pa.array([own.flat().tolist()], pa.list_(pa.float64()))})


def outputs_task(batches: Iterator[pa.RecordBatch], net: bytes) -> Iterator[pa.RecordBatch]:
    """The output of each finding, in steps."""
    own = CharNet.unpacked(net)
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            spans, labels = _examples(batch.slice(at, 2048))
            yield pa.RecordBatch.from_arrays([pa.array(labels.astype(np.int32)), pa.array(own.cells(own.pick(spans)))], names=["label", "cell"])


def training_table(findings: DataFrame, seed: int = 19) -> DataFrame:
    """Each distinct finding once, with ``kept`` (for calibration), ``hide`` and ``turn``, all three by its hash."""
    turn = F.xxhash64("label", "text", "start", "end", F.lit(seed))
    rows = findings.select(*[F.col(c).cast("int") for c in ("label", "start", "end")], "text").distinct().withColumn("turn", turn)
    return rows.withColumns({"kept": F.pmod("turn", F.lit(4)) == 0, "hide": F.pmod(F.shiftright("turn", 2), F.lit(2)) == 0})


def train_round(rows: DataFrame, net: CharNet, blocks: int, seed: int) -> CharNet:
    """The mean of what the blocks make of the network; exact decimals are added, so that their order does not count."""
    ready(rows.sparkSession)
    packed = net.packed()

    def send(table: pa.Table) -> pa.Table:
        return train_block(table, packed, seed)

    dealt = spread(rows.withColumn("block", F.pmod(F.shiftright("turn", 3), F.lit(blocks))), "block").groupBy("block")
    each = dealt.applyInArrow(send, "net array<double>").select(F.posexplode("net").alias("at", "value"))
    mean = each.groupBy("at").agg(F.avg(F.col("value").cast("decimal(22,12)")).cast("double").alias("value"))
    return CharNet.of_flat(np.array([r.value for r in sorted(mean.collect(), key=lambda r: r.at)]))


def output_counts(rows: DataFrame, net: CharNet) -> DataFrame:
    """(label, cell, count): findings by label and output; a row for each label and step, at most."""
    return mapped(rows.select("label", "text", "start", "end", "hide"), outputs_task, "label int, cell long", net=net.packed()).groupBy("label", "cell").count()


def fit_net(findings: DataFrame, recall: float = 0.95, seed: int = 19, block: int = BLOCK) -> CharNet:
    """A network from all labelled findings (text, start, end, label), blocks of about ``block`` at a time."""
    net, rows = CharNet.fresh(seed), settle(training_table(findings, seed), "findings")
    found = rows.groupBy("label", "kept").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).collect()
    n = {(label, kept): sum(r.n for r in found if (r.label, r.kept) == (label, kept)) for label in (0, 1) for kept in (False, True)}
    if min(n[0, False] + n[0, True], n[1, False] + n[1, True]) < 10 or not (n[0, True] and n[1, True]):
        return net
    chars = sum(r.chars for r in found if not r.kept)
    blocks = max(1, round((n[0, False] + n[1, False]) / block), -(-chars // BLOCK_CHARS))
    for nth in range(ROUNDS):
        net = train_round(rows.where(~F.col("kept")), net, blocks, seed + nth)
    counts = output_counts(rows.where("kept"), net).orderBy("label", "cell").collect()
    net.calibrate_counts(*(np.array([r[i] for r in counts], dtype=np.int64) for i in (1, 0, 2)), recall)
    return net


def scan(texts: pa.Array, net: CharNet) -> list[list[tuple[int, int, str]]]:
    """Findings of each text: base ones and candidates that pass the network."""
    out: list[list[tuple[int, int, str]]] = [[] for _ in range(len(texts))]
    for low, _, data, doc_off in slices(texts):
        asked: list[tuple[int, str, int, int]] = []
        for i in suspects(data, doc_off).tolist():
            text = data[doc_off[i] : doc_off[i + 1]].tobytes().decode()
            out[low + i] = base_findings(text)
            if net.threshold <= 1:
                asked += [(low + i, text, start, end) for start, end in candidates(text, out[low + i])]
        for at in range(0, len(asked), 2048):
            p = net.probability(net.pick([a[1:] for a in asked[at : at + 2048]]))
            for k in np.flatnonzero(p >= net.threshold).tolist():
                i, _, start, end = asked[at + k]
                out[i].append((start, end, "cnn"))
    return [sorted(f, key=lambda f: (f[0], KINDS.index(f[2]))) for f in out]


def joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in found)


def find_secrets(docs: DataFrame, net: CharNet) -> DataFrame:
    """One row per document: doc_id, findings array<struct<kind, start, end>> (code points, end exclusive, base ones first by place)."""
    ready(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(net.packed())

    @F.arrow_udf("array<struct<kind: string, start: int, end: int>>")
    def judge(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        return pa.array([[{"kind": k, "start": s, "end": e} for s, e, k in f] for f in scan(texts, CharNet.unpacked(sent.value))], kind)

    return docs.select(F.col("doc_id").cast("long"), judge(known()).alias("findings"))


def digests(found: DataFrame, kinds: tuple[str, ...] = KINDS[:3]) -> DataFrame:
    """Findings as numbers and strings: doc_id, n_<kind>, base_sha256, spans."""
    def text(rows: Column) -> Column:
        return F.array_join(F.transform(rows, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")

    base = F.filter("findings", lambda f: f["kind"].isin(*kinds))

    def count(kind: str) -> Column:
        return F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in kinds]
    return found.select("doc_id", *counts, F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("findings")).alias("spans"))
