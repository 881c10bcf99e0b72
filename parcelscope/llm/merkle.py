"""Merkle manifest of a dataset: leaf coordinates by rank in bitmaps, levels by keyed slot arrays.

* **Coordinates.** Each batch of leaves gives a compressed bitmap of the ids in every block of ``BLOCK`` ids (an array of
  offsets, or bits where that is smaller). The bitmaps of a block are merged into one with a popcount directory;
  the counts of blocks are summed up in two steps. The place of a leaf is then a rank query: ids in the blocks
  before, the directory's count before its 64-bit word, and the bits below it. No table of leaves is sorted.
* **Levels.** ``SLOTS`` = 8^3 consecutive nodes are one record, an array by slot; three levels are hashed in it, and
  its top is a node of the next tier. So n leaves take log_512(n) shuffles, each of 1/512 of the rows before.
* **Proofs** go down again: a record gets the siblings above it and hands each slot its own.

Several rows with one id and equal content are one leaf with a count until their places are dealt out. Rows with one id and
different contents are ordered by leaf in the task of their block.

Defined results: a null language is a tree of its own and comes first; null ids come first in a tree and are not
tampered with; null values are ``-``; empty and very long texts are hashed whole; ties go by leaf hash; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .base import ascii_lower, mapped, ready, settle

FAN = 8
SLOTS = 512  # FAN ** 3
BLOCK_BITS = 12  # ids of a block: few enough that dense ids still make many blocks
BLOCK = 1 << BLOCK_BITS
NO_ID = -(1 << 62)  # block of null ids
COPIES = 1 << 16  # places dealt out at once to equal rows


def leaf_text(text: Column) -> Column:
    """What is hashed for a row: each value behind its byte count."""
    parts = [F.col("doc_id").cast("long").cast("string"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("long").cast("string"), text]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts])


def leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """(tree, doc_id, leaf, other, m): leaf digest, that of the tampered row (null if none), and equal rows."""
    digest = lambda text: F.unhex(F.sha2(leaf_text(text), 256))
    rows = docs.select(
        F.coalesce(F.concat(F.lit("+"), F.col("lang").cast("string")), F.lit("")).alias("tree"), F.col("doc_id").cast("long").alias("doc_id"),
        digest(F.col("text")).alias("leaf"), F.when(tampered, digest(ascii_lower(F.col("text")))).alias("other"),
    )
    rows = rows.groupBy("tree", "doc_id", "leaf", "other").agg(F.count("*").alias("m"))
    block = F.coalesce(F.shiftright("doc_id", BLOCK_BITS), F.lit(NO_ID).cast("long"))
    return rows.withColumn("block", block).withColumn("low", F.coalesce(F.col("doc_id").bitwiseAND(F.lit(BLOCK - 1)), F.lit(0)).cast("long"))


# -- bitmaps ------------------------------------------------------------------------------------------


def packed(counts: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Ids with a count as offsets or bits, whichever is smaller; ids with more than one; their further counts."""
    there = np.flatnonzero(counts)
    ids = there.astype("<u2").tobytes()
    if len(ids) >= BLOCK // 8:
        ids = np.packbits(counts > 0, bitorder="little").tobytes()
    many = np.flatnonzero(counts > 1)
    return ids, many.astype("<u2").tobytes(), (counts[many] - 1).astype("<i8").tobytes()


def unpacked(ids: bytes, many: bytes, more: bytes) -> np.ndarray:
    if len(ids) == BLOCK // 8:
        counts = np.unpackbits(np.frombuffer(ids, np.uint8), bitorder="little").astype(np.int64)
    else:
        counts = np.zeros(BLOCK, dtype=np.int64)
        counts[np.frombuffer(ids, "<u2")] = 1
    counts[np.frombuffer(many, "<u2")] += np.frombuffer(more, "<i8")
    return counts


def rank(low: np.ndarray, ids: bytes, many: bytes, more: bytes, directory: bytes) -> np.ndarray:
    """Number of rows below each offset."""
    if len(ids) == BLOCK // 8:
        words = np.frombuffer(ids, "<u8")
        below = (np.uint64(1) << (low & 63).astype(np.uint64)) - np.uint64(1)
        found = np.frombuffer(directory, "<u2")[low >> 6].astype(np.int64) + np.bitwise_count(words[low >> 6] & below)
    else:
        found = np.searchsorted(np.frombuffer(ids, "<u2"), low).astype(np.int64)
    repeats = np.concatenate([[0], np.cumsum(np.frombuffer(more, "<i8"))])
    return found + repeats[np.searchsorted(np.frombuffer(many, "<u2"), low)]


def bitmap_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["tree", "block", "ids", "many", "more"]
    for batch in batches:
        if not len(batch):
            continue
        trees = batch.column("tree").dictionary_encode()
        tree, block = trees.indices.to_numpy(), batch.column("block").to_numpy()
        low, m = batch.column("low").to_numpy(), batch.column("m").to_numpy()
        order = np.lexsort((block, tree))
        cuts = np.flatnonzero((np.diff(tree[order]) != 0) | (np.diff(block[order]) != 0)) + 1
        out: list[list] = [[] for _ in names]
        for part in np.split(order, cuts):
            counts = np.zeros(BLOCK, dtype=np.int64)
            np.add.at(counts, low[part], m[part])
            for column, value in zip(out, (trees.dictionary[int(tree[part[0]])].as_py(), int(block[part[0]]), *packed(counts)), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=names)


def merge_blocks(table: pa.Table) -> pa.Table:
    """One bitmap of the bitmaps of a block, with its directory of counts before each word."""
    columns = [table.column(c).to_pylist() for c in ("ids", "many", "more")]
    counts = np.zeros(BLOCK, dtype=np.int64)
    for ids, many, more in zip(*columns, strict=True):
        counts += unpacked(ids, many, more)
    made = packed(counts)
    before = np.concatenate([[0], np.cumsum((counts > 0).reshape(-1, 64).sum(axis=1))[:-1]]).astype("<u2").tobytes() if len(made[0]) == BLOCK // 8 else b""
    row = {"tree": table.column("tree")[0].as_py(), "block": table.column("block")[0].as_py(), "n": int(counts.sum()), "ids": made[0], "many": made[1], "more": made[2], "directory": before}
    kinds = {"tree": pa.string(), "block": pa.int64(), "n": pa.int64()}
    return pa.Table.from_pylist([row], schema=pa.schema([(c, kinds.get(c, pa.binary())) for c in row]))


def bitmap_index(rows: DataFrame) -> DataFrame:
    """(tree, block, ids, many, more, directory, before, total): merged bitmaps, rows of the tree before each block, and in all."""
    parts = mapped(rows.select("tree", "block", "low", "m"), bitmap_task, "tree string, block long, ids binary, many binary, more binary")
    schema = "tree string, block long, n long, ids binary, many binary, more binary, directory binary"
    merged = settle(parts.groupBy("tree", "block").applyInArrow(merge_blocks, schema), "bitmaps")
    merged = merged.withColumn("wide", F.shiftright("block", 10))
    wide = merged.groupBy("tree", "wide").agg(F.sum("n").alias("sum"))
    wide = wide.select("tree", "wide", (F.sum("sum").over(Window.partitionBy("tree").orderBy("wide")) - F.col("sum")).alias("outer"), F.sum("sum").over(Window.partitionBy("tree")).alias("total"))
    inner = F.sum("n").over(Window.partitionBy("tree", "wide").orderBy("block")) - F.col("n")
    return merged.withColumn("inner", inner).join(wide, ["tree", "wide"]).withColumn("before", F.col("inner") + F.col("outer")).drop("wide", "inner", "outer", "n")


def place_leaves(found: pa.Table, index: pa.Table) -> pa.Table:
    """Place of each leaf of a block in its tree."""
    if not len(found):
        return PLACED.empty_table()
    own = index.slice(0, 1).to_pylist()[0]
    low, m = found.column("low").to_numpy(), found.column("m").to_numpy()
    p = own["before"] + rank(low, own["ids"], own["many"], own["more"], own["directory"])
    at, counts = np.unique(low, return_counts=True)
    tied = np.flatnonzero(np.isin(low, at[counts > 1]))
    if len(tied):  # one id, several contents: by leaf
        pick = found.take(pa.array(tied))
        keys = list(zip(low[tied].tolist(), pick.column("leaf").to_pylist(), (x or b"" for x in pick.column("other").to_pylist()), strict=True))
        order = sorted(range(len(tied)), key=keys.__getitem__)
        past = 0
        for k, i in enumerate(order):
            past = past + int(m[tied[order[k - 1]]]) if k and keys[order[k - 1]][0] == keys[i][0] else 0
            p[tied[i]] += past
    n = np.full(len(found), own["total"], dtype=np.int64)
    columns = [found.column("tree"), pa.array(p), pa.array(n), found.column("leaf"), found.column("doc_id"), found.column("other"), found.column("m")]
    return pa.Table.from_arrays(columns, names=PLACED.names).cast(PLACED)


PLACED = pa.schema([("tree", pa.string()), ("p", pa.int64()), ("n", pa.int64()), ("node", pa.binary()), ("doc_id", pa.int64()), ("other", pa.binary()), ("m", pa.int64())])


def placed(rows: DataFrame) -> DataFrame:
    """(tree, p, n, node, doc_id, other): one row per leaf, its place among the n of its tree."""
    ready(rows.sparkSession)
    index = bitmap_index(rows)
    both = rows.groupBy("tree", "block").cogroup(index.groupBy("tree", "block"))
    found = both.applyInArrow(place_leaves, "tree string, p long, n long, node binary, doc_id long, other binary, m long")
    found = found.withColumn("part", F.explode(F.expr(f"sequence(0L, (m - 1) div {COPIES})")))
    first = F.col("p") + F.col("part") * COPIES
    last = F.least(F.col("p") + F.col("m"), first + COPIES) - 1
    return found.select("tree", F.explode(F.sequence(first, last)).alias("p"), "n", "node", "doc_id", "other")


# -- tiers ----------------------------------------------------------------------------------------------


def levels(nodes: list[str], lone: bool) -> list[list[str]]:
    """Nodes of a record level by level: three of them, or in a tree's only record until one node is left."""
    out = [nodes]
    while (len(out[-1]) > 1) if lone else (len(out) < 4):
        here = out[-1]
        out.append([sha256("".join(here[a : a + FAN]).encode()).hexdigest() for a in range(0, len(here), FAN)])
    return out


def records(nodes: DataFrame) -> DataFrame:
    """(tree, gid, n, slots): consecutive nodes as arrays by slot, at most ``SLOTS`` each."""
    cell = F.struct("p", *[c for c in nodes.columns if c not in ("tree", "p", "n")])
    packed_rows = nodes.groupBy("tree", F.expr(f"p div {SLOTS}").alias("gid")).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(cell)).alias("slots"))
    return settle(packed_rows, "slots")


def top_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(batch.column("nodes").to_pylist(), batch.column("n").to_pylist(), strict=True)
        tops = [bytes.fromhex(levels([x.hex() for x in nodes], n <= SLOTS)[-1][0]) for nodes, n in rows]
        yield pa.RecordBatch.from_arrays([batch.column("tree"), batch.column("gid"), batch.column("n"), pa.array(tops, pa.binary())], names=["tree", "gid", "n", "node"])


def climb(nodes: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """Records of all tiers, and (tree, node) of the tops of all trees; ``most`` is the largest number of leaves."""
    tiers, tops = [], []
    while True:
        tiers.append(records(nodes))
        slim = tiers[-1].select("tree", "gid", "n", F.col("slots.node").alias("nodes"))
        top = settle(mapped(slim, top_task, "tree string, gid long, n long, node binary"), "tops")
        tops.append(top.where(F.col("n") <= SLOTS).select("tree", "node"))
        if most <= SLOTS:
            return tiers, reduce(DataFrame.unionByName, tops)
        groups = F.expr(f"(n + {SLOTS - 1}) div {SLOTS}")
        nodes = top.where(F.col("n") > SLOTS).select("tree", F.col("gid").alias("p"), groups.alias("n"), "node")
        most = -(-most // SLOTS)


def sides(here: list[list[str]]) -> list[list[tuple[str, str]]]:
    """For each level but the last: what stands left and right of each node in its run."""
    out = []
    for nodes in here[:-1]:
        runs = [nodes[a : a + FAN] for a in range(0, len(nodes), FAN)]
        out.append([("".join(run[:i]), "".join(run[i + 1 :])) for run in runs for i in range(len(run))])
    return out


def way(i: int, around: list[list[tuple[str, str]]]) -> list[tuple[str, str]]:
    """Left and right siblings of a slot, level by level."""
    return [around[j][i // FAN**j] for j in range(len(around))]


def as_text(steps: list[tuple[str, str]]) -> str:
    return "".join(f"{left},{right};" for left, right in steps)


def as_steps(text: str) -> list[tuple[str, str]]:
    return [tuple(s.split(",")) for s in text.split(";")[:-1]]


def down_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Path of each slot: its siblings in the record and those above."""
    for batch in batches:
        for r in batch.to_pylist():
            around = sides(levels([x.hex() for x in r["nodes"]], r["n"] <= SLOTS))
            paths = [as_text(way(i, around)) + r["path"] for i in range(len(r["nodes"]))]
            k = len(paths)
            columns = [pa.array([r["tree"]] * k), pa.array(r["ps"], pa.int64()), pa.array([r["subroot"]] * k, pa.binary()), pa.array([r["root"]] * k, pa.string()), pa.array(paths)]
            yield pa.RecordBatch.from_arrays(columns, names=["tree", "gid", "subroot", "root", "path"])


def proof_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Proof and refolded root of each leaf of a record."""
    for batch in batches:
        for row in range(len(batch)):
            r = batch.slice(row, 1).to_pylist()[0]
            hexes = [s["node"].hex() for s in r["slots"]]
            around = sides(levels(hexes, r["n"] <= SLOTS))
            above = as_steps(r["path"])
            siblings_above = "".join(left + right for left, right in above)
            out: list[list] = [[], [], [], []]
            for i, s in enumerate(r["slots"]):
                inside = way(i, around)
                node = hexes[i] if s["other"] is None else s["other"].hex()
                proof = "".join(left + right for left, right in inside) + siblings_above
                for left, right in inside + above:
                    node = sha256((left + node + right).encode()).hexdigest()
                for column, value in zip(out, (s["doc_id"], hexes[i], sha256(proof.encode()).hexdigest(), node), strict=True):
                    column.append(value)
            k = len(hexes)
            columns = [pa.array(out[0], pa.int64()), pa.array(out[1]), pa.array([r["subroot"].hex()] * k), pa.array([r["root"]] * k), pa.array(out[2]), pa.array(out[3])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([f == r["root"] for f in out[3]])], names=[c.split()[0] for c in RESULT.split(", ")])


RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def descend(tiers: list[DataFrame], trees: DataFrame) -> DataFrame:
    """Records of the lowest tier with the siblings above them; ``trees`` is (tree, subroot, root, path) of each tree's top."""
    paths = None
    for tier in reversed(tiers):
        lone = tier.where(F.col("n") <= SLOTS).join(trees, "tree")
        here = lone if paths is None else lone.unionByName(tier.where(F.col("n") > SLOTS).join(paths, ["tree", "gid"]))
        if tier is tiers[0]:
            return here
        slim = here.select("tree", "n", "subroot", "root", "path", F.col("slots.node").alias("nodes"), F.col("slots.p").alias("ps"))
        paths = mapped(slim, down_task, "tree string, gid long, subroot binary, root string, path string")
    raise ValueError("a tree has one tier at least")


def numbered(df: DataFrame, order: str) -> DataFrame:
    """Adds p, the place in the order, and n, the number of rows: places in each range of a global sort, ranges summed up."""
    ordered = settle(df.orderBy(order).withColumn("at", F.monotonically_increasing_id()), "ordered").withColumn("part", F.shiftright("at", 33))
    parts = ordered.groupBy("part").agg(F.count("*").alias("k"))  # one row per range
    parts = parts.select("part", (F.sum("k").over(Window.orderBy("part")) - F.col("k")).alias("before"), F.sum("k").over(Window.partitionBy()).alias("n"))
    place = F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("before")
    return ordered.join(parts, "part").withColumn("p", place).drop("at", "part", "before")


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """One row per document: its leaf, the roots over it, its proof, and the root folded from the row as tampered with."""
    never = F.lit(False) if tampered is None else tampered
    nodes = settle(placed(settle(leaves(docs, never), "leaves")), "places")
    most = nodes.agg(F.max("n")).first()[0] or 0
    tiers, subroots = climb(nodes, most)
    ranked = numbered(subroots, "tree").select(F.lit("").alias("tree"), "p", "n", "node", F.col("tree").alias("name"))
    ranked = settle(ranked, "trees")
    upper, roots = climb(ranked, ranked.agg(F.max("n")).first()[0] or 0)
    whole = descend(upper, roots.select("tree", F.col("node").alias("subroot"), F.lower(F.hex("node")).alias("root"), F.lit("").alias("path")))
    trees = settle(mapped(whole.select("n", "root", "path", "slots"), tree_task, "tree string, subroot binary, root string, path string"), "paths")
    found = descend(tiers, trees).select("n", "subroot", "root", "path", "slots")
    return mapped(found, proof_task, RESULT)


def tree_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Subroot, root and siblings of each tree."""
    for batch in batches:
        for r in batch.to_pylist():
            around = sides(levels([s["node"].hex() for s in r["slots"]], r["n"] <= SLOTS))
            rows = [{"tree": s["name"], "subroot": s["node"], "root": r["root"], "path": as_text(way(i, around)) + r["path"]} for i, s in enumerate(r["slots"])]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("tree", pa.string()), ("subroot", pa.binary()), ("root", pa.string()), ("path", pa.string())]))


def tampering(share: int = 3) -> Column:
    """Whether a row is tampered with, by its id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % share == 0, F.lit(False))
