"""Token ids in bit planes.

The file format, one *chunk* per row of a Parquet table (Spark's own writer commits it, so
a lost executor leaves no half file, and any store that Spark reaches will do):

    magic ``BPL1`` | u32 ids in a block | u32 bits in a unit (1: bit planes, 8: byte planes)
    u64 documents | i64 document ids | u8 id is known | u64 ids of each document
    u64 blocks | chunk index: u32 planes of each block, u32 bytes of each plane
    the planes, each compressed with zstandard

All numbers are little-endian. A block holds a fixed number of ids (the last one of a
chunk may hold fewer); its ids are transposed so that plane b holds bit (byte) b of all of
them. Planes above the highest bit in use are not stored. Chunks hold whole documents.
Rows carry (shard, chunk) and the number of ids, so positions are found without reading a
payload. Shards are ranges of ascending document ids.

Defined results: a null or empty text is the end id alone; a null document id comes first;
repeated rows are all written; an empty table gives no chunks; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from parcelscope.session import shared_folder

from .base import known, mapped
from .tokens import piece_cache

MAGIC = b"BPL1"
CHUNK_SCHEMA = "shard int, chunk int, n_docs long, n_ids long, payload binary"
DOC_SCHEMA = "shard int, chunk int, nth long, doc_id long, chunk_start long, n_tokens long, ids_crc32 long"


def planes(ids: np.ndarray, unit: int) -> list[bytes]:
    """Planes of a block of 32-bit ids, lowest first, up to the highest in use."""
    top = int(ids.max()).bit_length() if len(ids) else 0
    octets = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if unit == 8:
        return [np.ascontiguousarray(octets[:, b]).tobytes() for b in range(-(-top // 8))]
    width = -(-top // 8)
    bits = np.unpackbits(octets[:, :width], axis=1, bitorder="little")[:, :top]
    return [row.tobytes() for row in np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")]


def from_planes(parts: list[bytes], n: int, unit: int) -> np.ndarray:
    octets = np.zeros((n, 4), dtype=np.uint8)
    if unit == 8:
        for b, raw in enumerate(parts):
            octets[:, b] = np.frombuffer(raw, np.uint8)
    elif parts:
        rows = np.frombuffer(b"".join(parts), np.uint8).reshape(len(parts), -1)
        bits = np.unpackbits(rows, axis=1, count=n, bitorder="little")
        packed = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
        octets[:, : packed.shape[1]] = packed
    return octets.reshape(-1).view("<u4")


def encode_chunk(doc_ids: list[int | None], ids: list[bytes], block: int, unit: int, level: int) -> bytes:
    flat = np.frombuffer(b"".join(ids), dtype="<u4")
    squeeze = zstandard.ZstdCompressor(level=level).compress
    head = [MAGIC, struct.pack("<IIQ", block, unit, len(ids))]
    head.append(np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes())
    head.append(bytes(d is not None for d in doc_ids))
    head.append(np.array([len(i) // 4 for i in ids], dtype="<u8").tobytes())
    blocks = [[squeeze(p) for p in planes(flat[at : at + block], unit)] for at in range(0, len(flat), block)]
    head.append(struct.pack("<Q", len(blocks)))
    head.append(np.array([len(b) for b in blocks], dtype="<u4").tobytes())
    head.append(np.array([len(p) for b in blocks for p in b], dtype="<u4").tobytes())
    return b"".join(head + [p for b in blocks for p in b])


def decode_chunk(payload: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, ids of each document, and all ids in order."""
    if payload[:4] != MAGIC:
        raise ValueError("not a chunk of token ids")
    block, unit, n_docs = struct.unpack_from("<IIQ", payload, 4)
    at = 20

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(payload, dtype=kind, count=n, offset=at)
        at += got.nbytes
        return got

    doc_ids, valid, lengths = take("<i8", n_docs), take("u1", n_docs), take("<u8", n_docs).astype(np.int64)
    n_blocks = int(take("<u8", 1)[0])
    per_block = take("<u4", n_blocks)
    sizes = take("<u4", int(per_block.sum()))
    ends = at + np.cumsum(sizes, dtype=np.int64)
    left, total, k, out = int(lengths.sum()), int(lengths.sum()), 0, []
    unsqueeze = zstandard.ZstdDecompressor().decompress
    for n_planes in per_block.tolist():
        n = min(block, left)
        parts = [unsqueeze(payload[ends[j] - sizes[j] : ends[j]]) for j in range(k, k + n_planes)]
        out.append(from_planes(parts, n, unit))
        left, k = left - n, k + n_planes
    flat = np.concatenate(out) if out else np.zeros(0, "<u4")
    if len(flat) != total:
        raise ValueError("the chunk is incomplete")
    return [int(d) if v else None for d, v in zip(doc_ids, valid, strict=True)], lengths, flat


def write_task(batches: Iterator[pa.RecordBatch], path: str, eos: int, chunk_ids: int, block: int, unit: int, level: int) -> Iterator[pa.RecordBatch]:
    cache, end, shard = piece_cache(path), eos.to_bytes(4, "little"), TaskContext.get().partitionId()
    number, held, size = 0, ([], []), 0

    def flush() -> pa.RecordBatch:
        nonlocal number, held, size
        payload = encode_chunk(*held, block, unit, level)
        row = [pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([len(held[0])], pa.int64()), pa.array([size], pa.int64()), pa.array([payload], pa.binary())]
        number, held, size = number + 1, ([], []), 0
        return pa.RecordBatch.from_arrays(row, names=["shard", "chunk", "n_docs", "n_ids", "payload"])

    for batch in batches:
        for doc_id, ids in zip(batch.column(0).to_pylist(), cache.encode_column(batch.column(1)), strict=True):
            held[0].append(doc_id)
            held[1].append(ids + end)
            size += len(ids) // 4 + 1
            if size >= chunk_ids:
                yield flush()
    if held[0]:
        yield flush()


def read_task(batches: Iterator[pa.RecordBatch], keep_ids: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, chunk, payload in zip(*(batch.column(i) for i in range(3)), strict=True):
            doc_ids, lengths, flat = decode_chunk(payload.as_py())
            raw, n = flat.tobytes(), len(doc_ids)
            ends = np.cumsum(lengths)
            texts = [raw[4 * (e - k) : 4 * e] for e, k in zip(ends.tolist(), lengths.tolist(), strict=True)]
            out = [
                pa.array([shard.as_py()] * n, pa.int32()), pa.array([chunk.as_py()] * n, pa.int32()), pa.array(range(n), pa.int64()), pa.array(doc_ids, pa.int64()),
                pa.array(ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array([zlib.crc32(t) for t in texts], pa.int64()),
            ] + ([pa.array(texts, pa.binary())] if keep_ids else [])
            yield pa.RecordBatch.from_arrays(out, names=[c.split()[0] for c in DOC_SCHEMA.split(", ")] + ["ids"] * keep_ids)


def write_ids(
    docs: DataFrame, tokenizer: str, folder: str | None = None, eos: int = 2, chunk_ids: int = 1 << 18, block: int = 1 << 16, unit: int = 1, level: int = 3
) -> str:
    """Write the ids of all documents in ascending order of doc_id; returns the folder.

    ``folder`` is a new one under the shared folder unless given. The ids of one row go to one
    range; equal document ids are spread by a hash of their text.
    """
    if unit not in (1, 8):
        raise ValueError("unit is 1 (bit planes) or 8 (byte planes)")
    folder = folder or shared_folder(docs.sparkSession, "ids")
    rows = docs.select(F.col("doc_id").cast("long"), known().alias("text")).withColumn("tie", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    chunks = mapped(rows.select("doc_id", "text"), write_task, CHUNK_SCHEMA, path=tokenizer, eos=eos, chunk_ids=chunk_ids, block=block, unit=unit, level=level)
    chunks.write.option("compression", "none").parquet(folder)
    return folder


def read_ids(spark: SparkSession, folder: str, keep_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids_crc32 [, ids as little-endian unsigned 32-bit bytes]."""
    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(folder)
    docs = mapped(chunks.select("shard", "chunk", "payload"), read_task, DOC_SCHEMA + ", ids binary" * keep_ids, keep_ids=keep_ids)
    past = (Window.unboundedPreceding, -1)
    shards = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    shards = shards.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(*past)), F.lit(0)).alias("shard_start"))
    within = Window.partitionBy("shard").orderBy("chunk").rowsBetween(*past)
    bases = chunks.select("shard", "chunk", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("base")).join(shards, "shard")
    bases = bases.select("shard", "chunk", (F.col("base") + F.col("shard_start")).alias("base"))
    out = docs.join(bases, ["shard", "chunk"]).withColumn("start", F.col("base") + F.col("chunk_start"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * keep_ids)
