"""N-gram Jaccard join: MinHash banding and exact verification.

1. Documents with the same word shingles are one *class*; its representative stands for it.
2. The MinHash signature of a class has ``trees`` bands of k values, each folded into one
   hash, a *node*. k is fixed by formula before data is read: the longest, ``depth`` at
   most, at which the expected recall of a pair at the threshold, 1 - (1 - t^k)^trees,
   reaches ``recall``. Classes with an equal node are candidates. This is no LSH forest: no
   sorted tries are kept and no prefix is adapted to the data.
3. Nodes join classes to *clusters* (connected components by way of each node's smallest
   member, so no pairs are made). A cluster is cut into blocks; a task takes two blocks and
   verifies all pairs between them exactly on their shingle sets. It returns, for each
   class, the number of links and one linked root, never the pairs. So a very large group
   costs block pairs, spread over tasks, and rows in proportion to the blocks.
4. The roots join the verified links to groups.

Defined results: documents with fewer words than a shingle have one shingle of all their
words; documents without words (null, empty, blank) have no shingles and no links; repeated
rows are copies of each other; null identifiers come last; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .base import known, mapped, settle
from .graph import components
from .words import find_words, mix, shingles, slices, totals

BLOCK_CLASSES = 256
BLOCK_SHINGLES = 500_000
COLUMNS = 2048  # shingles multiplied at once
KEY_SCHEMA = "doc_id long, tie long, klass binary, n_shingles long, nodes array<long>"


def prefix_length(threshold: float, trees: int, depth: int, recall: float) -> int:
    """The longest prefix at which a pair at the threshold meets in some tree with the wanted probability."""
    for k in range(depth, 0, -1):
        if 1 - (1 - threshold**k) ** trees >= recall:
            return k
    raise ValueError("more trees are needed for this recall")


def _class_keys(sh: np.ndarray, off: np.ndarray) -> list[bytes]:
    """128 bits of the multiset of shingles of each document."""
    one = totals(mix(sh ^ np.uint64(0x1234567)), off)
    two = totals(mix(sh ^ np.uint64(0x7654321)), off)
    raw = np.stack([one, two], axis=1).astype(">u8").tobytes()
    return [raw[16 * i : 16 * i + 16] for i in range(len(one))]


def keys_task(batches: Iterator[pa.RecordBatch], size: int, trees: int, prefix: int, depth: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Class key and band hashes (nodes) of each document."""
    draw = np.random.default_rng(seed)
    masks = draw.integers(0, 2**63, size=(trees, depth), dtype=np.uint64)
    factors = draw.integers(0, 2**63, size=(trees, depth), dtype=np.uint64) | np.uint64(1)
    for batch in batches:
        for low, high, data, doc_off in slices(batch.column(2)):
            sh, off = shingles(find_words(data, doc_off), size)
            keys, n = _class_keys(sh, off), np.diff(off)
            full = np.flatnonzero(n)
            nodes = np.zeros((len(full), trees), dtype=np.uint64)
            if len(full):
                starts = off[full]
                for t in range(trees):
                    node = np.full(len(full), t + 1, dtype=np.uint64)
                    for k in range(prefix):
                        least = np.minimum.reduceat((sh ^ masks[t, k]) * factors[t, k], starts)
                        node = mix(node * np.uint64(0x9E3779B97F4A7C15) + least)
                    nodes[:, t] = node
            flat = nodes.view(np.int64).reshape(-1)
            ends = np.concatenate([[0], np.cumsum(np.where(n > 0, trees, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            out = [*(batch.column(c).slice(low, high - low) for c in (0, 1)), pa.array(keys, pa.binary()), pa.array(n, pa.int64()), lists]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "tie", "klass", "n_shingles", "nodes"])


def overlap(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set in a with each in b."""
    values, place = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    rows = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
    in_a = np.bincount(place[rows < len(a)], minlength=len(values)) > 0
    in_b = np.bincount(place[rows >= len(a)], minlength=len(values)) > 0
    shared = np.flatnonzero(in_a & in_b)  # no other shingle can be in an intersection
    at = np.full(len(values), -1)
    at[shared] = np.arange(len(shared))
    column = at[place]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    out = np.zeros((len(a), len(b)), dtype=np.float32)
    for low in range(0, len(shared), COLUMNS):
        s, e = np.searchsorted(column, [low, low + COLUMNS])
        cells = np.zeros((len(a) + len(b), COLUMNS), dtype=np.float32)
        cells[rows[s:e], column[s:e] - low] = 1
        out += cells[: len(a)] @ cells[len(a) :].T
    return out


def linked(sets: list[np.ndarray], first: int, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """For rows of the first block: which of the other sets they are linked with.

    The sets are those of one block (``first`` = their number) or of two; pairs are made within one block or
    between the two.
    """
    n = np.array([len(s) for s in sets], dtype=np.float64)
    other = list(range(first)) if first == len(sets) else list(range(first, len(sets)))
    both = overlap(sets[:first], [sets[j] for j in other]).astype(np.float64)
    union = n[:first, None] + n[other][None, :] - both
    yes = (both > 0) & (both >= threshold * union - 1e-9)
    for i in range(first):
        mates = np.array(other, dtype=np.int64)[yes[i]]
        yield i, mates[mates != i]


def _verified(keys: list[bytes], copies: np.ndarray, sets: list[np.ndarray], first: int, threshold: float) -> tuple[list, list, list, list]:
    root = list(range(len(keys)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    docs, classes = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    for i, mates in linked(sets, first, threshold):
        docs[i] += copies[mates].sum()
        classes[i] += len(mates)
        if first < len(sets):
            docs[mates] += copies[i]
            classes[mates] += 1
        for j in mates.tolist():
            x, y = find(i), find(j)
            if x != y:
                root[max(x, y)] = min(x, y)
    some = np.flatnonzero(classes).tolist()
    return [keys[i] for i in some], [keys[find(i)] for i in some], docs[some].tolist(), classes[some].tolist()


def verify_task(groups: pa.Table, size: int, threshold: float) -> pa.Table:
    """Members of two blocks of a cluster (or of one) in; per linked class its root and links out."""
    rows: dict[bytes, tuple[int, int, np.ndarray]] = {}
    base = 0
    klass, block, copies, pair = (groups.column(c).to_pylist() for c in ("klass", "block", "copies", "pair"))
    for low, high, data, doc_off in slices(groups.column("text")):
        sh, off = shingles(find_words(data, doc_off), size)
        for i, key in enumerate(_class_keys(sh, off)):
            if key == klass[base + low + i]:  # another row may have the representative's identifier
                rows[key] = block[base + low + i], copies[base + low + i], np.unique(sh[off[i] : off[i + 1]])
    lower = pair[0][0]
    ordered = sorted(rows, key=lambda k: (rows[k][0] != lower, k))
    if not ordered or (pair[0][0] == pair[0][1] and len(ordered) < 2):
        return pa.table({"klass": pa.array([], pa.binary()), "root": pa.array([], pa.binary()), "docs": pa.array([], pa.int64()), "classes": pa.array([], pa.int64())})
    first = sum(rows[k][0] == lower for k in ordered)
    sets = [rows[k][2] for k in ordered]
    if first == len(sets) and pair[0][0] != pair[0][1]:
        sets, ordered = [], []
    counts = np.array([rows[k][1] for k in ordered], dtype=np.int64)
    found = _verified(ordered, counts, sets, first, threshold) if sets else ([], [], [], [])
    kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64())
    return pa.table({n: pa.array(v, t) for n, v, t in zip(("klass", "root", "docs", "classes"), found, kinds, strict=True)})


def _judged(docs: DataFrame, size: int, threshold: float, trees: int, depth: int, recall: float, seed: int) -> DataFrame:
    """doc_id, tie (hash of the text), n_shingles and, with shingles: copy and first (the class's and the group's least row), copies, linked docs and classes."""
    prefix = prefix_length(threshold, trees, depth, recall)
    text = docs.select(F.col("doc_id").cast("long"), F.xxhash64(known()).alias("tie"), known().alias("text"))
    rows = settle(mapped(text, keys_task, KEY_SCHEMA, size=size, trees=trees, prefix=prefix, depth=depth, seed=seed), "jaccard-keys")
    row = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "tie")
    classes = rows.where("n_shingles > 0").groupBy("klass").agg(F.min(row).alias("copy"), F.count("*").alias("copies"), F.max("n_shingles").alias("n_shingles"), F.max("nodes").alias("nodes"))
    classes = settle(classes, "jaccard-classes")

    seats = classes.select("klass", F.explode("nodes").alias("node"))
    hubs = seats.groupBy("node").agg(F.min("klass").alias("hub"), F.count("*").alias("n")).where("n > 1").select("node", "hub")
    cluster_of = components(seats.join(hubs, "node").select("klass", "hub"), "klass", "hub")
    members = classes.join(cluster_of.select(F.col("node").alias("klass"), F.col("root").alias("cluster")), "klass").drop("nodes")
    members = settle(members, "jaccard-members")
    sizes = members.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BLOCK_CLASSES), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    members = members.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("klass"), F.col("blocks")).cast("int"))

    text = text.withColumnsRenamed({"doc_id": "_id", "tie": "_tie"})
    found = members.join(text, F.col("copy.doc_id").eqNullSafe(F.col("_id")) & (F.col("copy.tie") == F.col("_tie")))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = found.select("cluster", "klass", "copies", "block", "text", other.alias("_other"))
    pair = F.array(F.least("block", "_other"), F.greatest("block", "_other"))
    pairs = pairs.select("cluster", "klass", "copies", "block", "text", pair.alias("pair"))

    def verify(group: pa.Table) -> pa.Table:
        return verify_task(group, size, threshold)

    links = pairs.groupBy("cluster", "pair").applyInArrow(verify, "klass binary, root binary, docs long, classes long")
    links = settle(links, "jaccard-links")
    counts = links.groupBy("klass").agg(F.sum("docs").alias("linked_docs"), F.sum("classes").alias("linked_classes"))
    group_of = components(links, "klass", "root").withColumnRenamed("node", "klass")
    judged = classes.select("klass", "copy", "copies").join(counts, "klass", "left").join(group_of, "klass", "left").withColumn("root", F.coalesce("root", "klass"))
    firsts = judged.groupBy("root").agg(F.min("copy").alias("first"))
    judged = judged.join(firsts, "root").select("klass", "first", "copy", "copies", "linked_docs", "linked_classes")
    return rows.drop("nodes").withColumn("klass", F.when(F.col("n_shingles") > 0, F.col("klass"))).join(judged, "klass", "left")


def jaccard_links(
    docs: DataFrame, size: int = 5, threshold: float = 0.8, trees: int = 20, depth: int = 8, recall: float = 0.9999, seed: int = 5
) -> DataFrame:
    """One row per document: doc_id, class_id, copy_id, n_links, n_linked_texts.

    ``class_id``: smallest doc_id of the near-duplicate group (documents joined by links);
    ``copy_id``: smallest doc_id with the same shingles; ``n_links``: other documents with a
    Jaccard similarity of at least the threshold, copies counted; ``n_linked_texts``: the same in classes.
    A document without words is its own class.
    """
    rows = _judged(docs, size, threshold, trees, depth, recall, seed)
    worded = F.col("n_shingles") > 0
    return rows.select(
        "doc_id",
        F.when(worded, F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(worded, F.col("copy.doc_id")).otherwise(F.col("doc_id")).alias("copy_id"),
        F.when(worded, F.col("copies") - 1 + F.coalesce("linked_docs", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        F.coalesce("linked_classes", F.lit(0)).cast("long").alias("n_linked_texts"),
    )


def keep_one_near(docs: DataFrame, size: int = 5, threshold: float = 0.8, trees: int = 20, depth: int = 8, recall: float = 0.9999, seed: int = 5) -> DataFrame:
    """The documents with one of each near-duplicate group, the one with the smallest doc_id, all columns kept.

    Documents without words all stay. Of equal rows (same doc_id and text) in a group one stays.
    """
    rows = _judged(docs, size, threshold, trees, depth, recall, seed)
    bare = F.col("n_shingles") == 0
    first = (F.col("first.tie") == F.col("tie")) & F.col("first.doc_id").eqNullSafe(F.col("doc_id"))
    stays = rows.where(bare | first).groupBy("doc_id", "tie").agg(F.when(F.max(bare), F.lit(1)).otherwise(F.count("*")).alias("_near_times"))
    stays = stays.withColumnsRenamed({"doc_id": "_near_id", "tie": "_near_tie"})
    own = docs.select(F.struct("*").alias("_near_row"), F.col("doc_id").cast("long").alias("_near_own"), F.xxhash64(known()).alias("_near_key"))
    found = own.join(stays, F.col("_near_own").eqNullSafe(F.col("_near_id")) & (F.col("_near_key") == F.col("_near_tie")))
    once = found.where("_near_times = 1").select("_near_row.*")
    more = found.where("_near_times > 1").dropDuplicates(["_near_id", "_near_tie"]).select("_near_row.*")
    return once.unionByName(more)
