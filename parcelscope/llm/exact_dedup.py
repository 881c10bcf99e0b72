"""Exact duplicates by Patricia tries.

Rows meet in partitions by length and content hash. A task puts the full byte strings of
its partition into a compressed radix trie; the terminal node of a string holds the
identifier that stays and the number of rows. The same trie runs before the shuffle, over
each input partition, so a text that a third of all rows share arrives once per partition.

Memory is bounded by ``budget`` bytes of edges and spilled by subtree. Before the shuffle
any subtree may go: what it holds is a partial result. After it rows come sorted by length
and hash, keys begin with both, and the subtrees beside the current path are complete.

Defined results: a null text is empty; a null doc_id stays only if its group has no other;
a row that occurs several times is counted each time and kept once; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .base import ascii_lower, known, mapped

BUDGET = 64 << 20
NODE_BYTES = 250  # a node beside its edge
HEAD = struct.Struct(">QQ")  # length and content hash before the text itself


class Node:
    __slots__ = ("best", "edge", "kids", "n")

    def __init__(self, edge: bytes):
        self.edge, self.kids, self.best, self.n = edge, None, None, 0


class Patricia:
    """Byte strings with, for each, the identifier that stays and a count."""

    def __init__(self, largest: bool):
        self.root, self.largest, self.held = Node(b""), largest, 0

    def add(self, key: bytes, identifier: int | None, n: int) -> None:
        node, at = self.root, 0
        while at < len(key):
            kid = node.kids.get(key[at]) if node.kids else None
            if kid is None:
                kid = Node(key[at:])
                self.held += len(kid.edge) + NODE_BYTES
                node.kids = node.kids or {}
                node.kids[key[at]] = node = kid
                break
            if not key.startswith(kid.edge, at):
                same = self._common(kid.edge, key, at)
                fork = Node(kid.edge[:same])
                fork.kids = {kid.edge[same]: kid}
                kid.edge = kid.edge[same:]
                self.held += NODE_BYTES
                node.kids[key[at]] = kid = fork
            node, at = kid, at + len(kid.edge)
        if node.best is None or (identifier is not None and (identifier > node.best) == self.largest):
            node.best = identifier
        node.n += n

    @staticmethod
    def _common(edge: bytes, key: bytes, at: int) -> int:
        low, high = 0, min(len(edge), len(key) - at)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if edge[low:mid] == key[at + low : at + mid] else (low, mid - 1)
        return low

    def _take(self, top: Node, prefix: bytes) -> Iterator[tuple[bytes, int | None, int]]:
        """Terminals under a node that is no longer linked."""
        stack = [(top, prefix)]
        while stack:
            node, before = stack.pop()
            key = before + node.edge
            self.held -= len(node.edge) + NODE_BYTES
            if node.n:
                yield key, node.best, node.n
            for kid in (node.kids or {}).values():
                stack.append((kid, key))

    def spill(self, keep: bytes = b"", upto: int = 0) -> Iterator[tuple[bytes, int | None, int]]:
        """Unlink the subtrees that leave the path of ``keep[:upto]`` and give their terminals."""
        node, at = self.root, 0
        while True:
            ahead = keep[at] if at < upto else None
            for first in [k for k in node.kids or () if k != ahead]:
                yield from self._take(node.kids.pop(first), keep[:at])
            kid = (node.kids or {}).get(ahead)
            if kid is None or not keep.startswith(kid.edge, at) or at + len(kid.edge) >= upto:
                return
            node, at = kid, at + len(kid.edge)


def _rows(found: list[tuple[bytes, int | None, int]], names: list[str]) -> pa.RecordBatch:
    keys, best, n = zip(*found, strict=True)
    size, mark = zip(*(HEAD.unpack_from(k) for k in keys), strict=True)
    signed = [m - (1 << 64) if m >> 63 else m for m in mark]
    out = [pa.array(size, pa.int64()), pa.array(signed, pa.int64()), pa.array([k[HEAD.size :] for k in keys], pa.binary()), pa.array(best, pa.int64()), pa.array(n, pa.int64())]
    return pa.RecordBatch.from_arrays(out, names=names)


def owners_task(batches: Iterator[pa.RecordBatch], largest: bool, budget: int, ordered: bool) -> Iterator[pa.RecordBatch]:
    """(size, mark, body, best, n) rows into one for each text; ``ordered``: they come by size and mark."""
    trie, ready, weight, names = Patricia(largest), [], 0, ["size", "mark", "body", "best", "n"]
    for batch in batches:
        for size, mark, body, best, n in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            key = HEAD.pack(size, mark & (1 << 64) - 1) + body
            trie.add(key, best, n)
            if trie.held > budget:
                for found in trie.spill(key, HEAD.size if ordered else 0):
                    ready.append(found)
                    weight += len(found[0])
                    if weight > 4 << 20:
                        yield _rows(ready, names)
                        ready, weight = [], 0
    for found in trie.spill():
        ready.append(found)
        weight += len(found[0])
        if weight > 4 << 20:
            yield _rows(ready, names)
            ready, weight = [], 0
    if ready:
        yield _rows(ready, names)


def owners(rows: DataFrame, largest: bool = False, budget: int = BUDGET) -> DataFrame:
    """One row per distinct text of ``rows(doc_id, body binary)``: size, mark, body, best, n."""
    schema = "size long, mark long, body binary, best long, n long"
    dealt = rows.select(F.octet_length("body").cast("long").alias("size"), F.xxhash64("body").alias("mark"), "body", F.col("doc_id").cast("long").alias("best"), F.lit(1).cast("long").alias("n"))
    partial = mapped(dealt, owners_task, schema, largest=largest, budget=budget, ordered=False)
    met = partial.repartition("size", "mark").sortWithinPartitions("size", "mark")
    return mapped(met, owners_task, schema, largest=largest, budget=budget, ordered=True)


def normalised(text: str | Column = "text") -> Column:
    return ascii_lower(known(text))


def _judged(docs: DataFrame, largest: bool, budget: int) -> DataFrame:
    """doc_id, digest, times (equal rows), keep_id, group_size of each distinct row."""
    body = normalised().cast("binary")
    whole = owners(docs.select("doc_id", body.alias("body")), largest, budget)
    groups = whole.where("n > 1").select(F.unhex(F.sha2("body", 256)).alias("digest"), F.col("best").alias("keep_id"), F.col("n").alias("group_size"), F.lit(True).alias("shared"))
    rows = docs.select(F.col("doc_id").cast("long"), F.unhex(F.sha2(body, 256)).alias("digest"))
    rows = rows.groupBy("doc_id", "digest").agg(F.count("*").cast("int").alias("times"))  # repeated rows count, one is kept
    found = rows.join(groups, "digest", "left")
    keep = F.when(F.col("shared"), F.col("keep_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "digest", "times", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"))


def exact_groups(docs: DataFrame, largest: bool = False, budget: int = BUDGET) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    The smallest identifier of a group stays, or the largest one.
    """
    rows = _judged(docs, largest, budget).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return rows.select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame, largest: bool = False) -> DataFrame:
    """The documents without exact duplicates, one of each group, all columns kept."""
    mark, given, times = "_exact_digest", "_exact_id", "_exact_times"
    kept = _judged(docs, largest, BUDGET).where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    kept = kept.select(F.col("digest").alias(mark), F.col("doc_id").alias(given), F.col("times").alias(times))
    rows = docs.select(F.struct("*").alias("_exact_row"), F.unhex(F.sha2(normalised().cast("binary"), 256)).alias("_exact_own"), F.col("doc_id").cast("long").alias("_exact_doc"))
    found = rows.join(kept, (rows["_exact_own"] == kept[mark]) & rows["_exact_doc"].eqNullSafe(kept[given]))
    once = found.where(F.col(times) == 1).select("_exact_row.*")
    more = found.where(F.col(times) > 1).dropDuplicates([mark, given]).select("_exact_row.*")
    return once.unionByName(more)
