"""Conversation structure repair: a rank-convergence parallel Viterbi over chunks of turns.

The rows of a conversation are read as one sequence that must end up with role initials
``(s?(ua)+)?``. Four states say what stands last (nothing, system, user, assistant); a cost vector holds
the cheapest way from each state to an accepted end.

* Rows are ordered by a range shuffle and cut into chunks of at most ``ROWS`` rows. A conversation
  whose chunk is whole is finished where it lies; the others (long ones, and at most two at the edges of
  a partition) go on as chunks, so a conversation of any length is spread over tasks.
* Every chunk starts from a speculative vector, that of the last chunk's end, and runs backward.
  Fix-up passes hand each chunk the start vector of the chunk after it and rerun those for which it differs by more than a
  constant, until none does. Rows that never converge (no role among s, u, a) are left after ``PASSES`` passes;
  their chunks are joined exactly by doubling min-plus products.
* The stitched vectors drive the trace: at each place the ASCII-least edit that keeps the cost.
  Where a chunk begins follows from the chunks before it, for all four states, by doubling.

One task hashes the repaired text of one conversation, as SHA-256 goes through it in order; it holds one chunk at a time.

Defined results: null role, text, and null parts of the damage key are one space; a null conv_id is a conversation;
rows of one turn go by role, then by the text's SHA-256, null turns first; a role that starts with neither s, u
nor a (an empty one too) is never kept; equal rows are duplicates; very long texts are rows like others;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .base import mapped, settle

ROWS = 256  # rows of a chunk
PASSES = 4  # fix-up passes before the rest is joined by products
INSERT, REROLE, DELETE, CUT = 2, 2, 3, 1
FAR = 1 << 20
AFTER = np.array([2, 2, 3, 2])  # state that a written user or assistant row leads to
NAMES = {2: "user", 3: "assistant"}
END = np.array([0, 4, 2, 0])  # cost of ending in each state
GONE = 8  # code of a row that must be deleted; else class (s, u, a, other) + 4 if truncated
KEEP_TO = np.zeros((9, 4), dtype=np.int64)
KEEP_COST = np.full((9, 4), FAR, dtype=np.int64)
for _code in range(8):
    for _state, _to in (((0, 1),), ((0, 2), (1, 2), (3, 2)), ((2, 3),), ())[_code % 4]:
        KEEP_TO[_code, _state], KEEP_COST[_code, _state] = _to, CUT * (_code // 4)
REROLE_COST = np.array([REROLE] * 4 + [REROLE + CUT] * 4 + [FAR])
LEGAL = {(0, 1), (1, 2), (2, 1)}
WORD_CHAR = r"[^\x20\x09-\x0D]"
DONE = "conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, sha string"
CHUNK = "key string, at long, open boolean, turns array<long>, roles array<string>, texts array<string>, marks array<string>, codes binary, " + DONE


def damaged(conversations: DataFrame, fault: str = "crc32(cast(concat(key, ':', coalesce(cast(turn AS string), ' ')) AS binary)) % 20") -> DataFrame:
    """(key, conv, turn, role, text, gone): rows as the fault number says; dropped rows stay, marked, so that no conversation is lost."""
    rows = conversations.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("key"), F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
    ).withColumn("fault", F.expr(fault))
    text = F.when(F.col("fault").isin(0, 1), "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    rows = rows.select("key", "conv", "turn", role.alias("role"), text.alias("text"), (F.col("fault") == 0).alias("gone"), copies)
    return rows.drop("col")


def in_order(rows: DataFrame) -> DataFrame:
    """Rows by conversation and place, each partition a range of them; the last key splits a run of equal rows."""
    initial = F.substring("role", 1, 1)
    cls = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    cut = F.when(F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), 0).otherwise(4)
    code = F.when(F.col("text").rlike(WORD_CHAR), cls + cut).otherwise(cls + 16).cast("byte")
    rows = rows.select("*", F.sha2("text", 256).alias("mark"), code.alias("code"), F.monotonically_increasing_id().alias("tie"))
    order = ["key", "gone", "turn", "role", "mark", "tie"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")


# -- vectors and traces of many chunks at once ------------------------------------------------------


def padded(codes: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of each chunk as one row of a table, and their number."""
    n = np.diff(off)
    table = np.full((len(n), int(n.max(initial=0))), GONE, dtype=np.int64)
    table[np.arange(table.shape[1]) < n[:, None]] = codes
    return table, n


def backward(table: np.ndarray, n: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Cost vector at each place of each chunk, from the vector at its end."""
    m, length = table.shape
    costs = np.empty((m, length + 1, 4), dtype=np.int64)
    costs[:, length] = v = ends
    for t in range(length - 1, -1, -1):
        code = table[:, t]
        kept = np.take_along_axis(v, KEEP_TO[code], axis=1) + KEEP_COST[code]
        new = np.minimum(np.minimum(v + DELETE, kept), v[:, AFTER] + REROLE_COST[code][:, None])
        for _ in range(2):
            new = np.minimum(new, new[:, AFTER] + INSERT)
        costs[:, t] = v = np.where((t < n)[:, None], new, v)
    return costs


def trace(table: np.ndarray, n: np.ndarray, costs: np.ndarray, state: np.ndarray, last: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Least audit of each chunk from the state before it, and the state after it."""
    m, length = table.shape
    ops = np.zeros((m, length + 1, 3), dtype=np.uint8)
    q, each = state.copy(), np.arange(m)
    for t in range(length):
        live, code, after = t < n, table[:, t], costs[:, t + 1]
        more = live.copy()
        for slot in range(2):
            here = costs[each, t, q]
            more &= (here != after[each, q] + DELETE) & (here == costs[each, t, AFTER[q]] + INSERT)
            ops[more, t, slot] = ord("I")
            q = np.where(more, AFTER[q], q)
        here = costs[each, t, q]
        drop = here == after[each, q] + DELETE
        keep = ~drop & (here == after[each, KEEP_TO[code, q]] + KEEP_COST[code, q])
        ops[live, t, 2] = np.where(drop, ord("D"), np.where(keep, ord("K"), ord("R")))[live]
        q = np.where(live & ~drop, np.where(keep, KEEP_TO[code, q], AFTER[q]), q)
    for slot in range(2):
        short = last & ((q == 1) | (q == 2))
        ops[short, length, slot] = ord("I")
        q = np.where(short, AFTER[q], q)
    flat = ops.reshape(m, -1)
    return [row[row > 0].tobytes() for row in flat], q


def rebuilt(audit: bytes, state: int, roles: list[str], texts: list[str]) -> list[str]:
    """Lines ``role:text`` that an audit makes of a chunk's rows."""
    lines, at = [], 0
    for op in audit.decode():
        if op == "I":
            state = int(AFTER[state])
            lines.append(f"{NAMES[state]}:")
            continue
        if op == "K":
            state = {"s": 1, "u": 2, "a": 3}[roles[at][0]]
            lines.append(f"{roles[at]}:{texts[at]}")
        elif op == "R":
            state = int(AFTER[state])
            lines.append(f"{NAMES[state]}:{texts[at]}")
        at += 1
    return lines


def sha(lines: list[str]) -> str:
    return hashlib.sha256("\n".join(lines).encode("utf-8", "surrogatepass")).hexdigest()


# -- chunks ---------------------------------------------------------------------------------------------


def runs(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, bounds of chunks, first chunk of its conversation here, last one): chunks end with a conversation or at ``rows`` rows.

    The conversation at the end of a batch waits for the next one, its full chunks but the last excepted.
    """
    rest: pa.Table | None = None
    fresh = True  # whether the first row waiting starts its conversation here
    feed = iter(batches)
    batch = next(feed, None)
    while batch is not None:
        following = next(feed, None)
        table = pa.Table.from_batches([batch])
        batch = following
        if rest is not None:
            table = pa.concat_tables([rest, table])
        table = table.combine_chunks()
        if not len(table):
            continue
        ids = table.column("key").combine_chunks()
        ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
        codes = ids.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1])
        stops = np.append(starts[1:], len(codes))
        bounds = np.concatenate([np.arange(a, b, rows) for a, b in zip(starts, stops, strict=True)])
        begins = np.isin(bounds, starts)
        begins[0] &= fresh
        ends = np.append(begins[1:], following is None)
        if following is not None:  # the last chunk may go on
            cut = int(bounds[-1])
            fresh, rest = bool(begins[-1]), table.slice(cut)
            table, begins, ends = table.slice(0, cut), begins[:-1], ends[:-1]
            if not len(bounds) - 1:
                continue
            bounds = bounds[:-1]
        yield table, np.append(bounds, len(table)), begins, ends


def chunk_task(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Whole conversations finished; chunks of the others as records of lists."""
    from pyspark import TaskContext

    at = TaskContext.get().partitionId() << 33
    first_key = None
    parts = runs(batches, rows)
    held = next(parts, None)
    names = [f.name for f in SCHEMA]
    while held is not None:
        following = next(parts, None)
        table, bounds, begins, ends = held
        held = following
        columns = {c: table.column(c).combine_chunks() for c in table.column_names}
        columns = {c: a.chunk(0) if isinstance(a, pa.ChunkedArray) else a for c, a in columns.items()}
        if first_key is None:
            first_key = columns["key"][0].as_py()
        last_key = columns["key"][len(table) - 1].as_py() if following is None else None
        keys = columns["key"].take(pa.array(bounds[:-1]))
        edge = np.array([k in (first_key, last_key) for k in keys.to_pylist()], dtype=bool)
        is_open = ~(begins & ends) | edge
        made = finished(columns, bounds, np.flatnonzero(~is_open))
        lists = {c: pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), columns[c]) for c in ("turn", "role", "text", "mark")}
        code = np.where(columns["gone"].to_numpy(zero_copy_only=False), 32, columns["code"].to_numpy()).astype(np.uint8)
        raw = code.tobytes()
        some = pa.array(np.where(is_open, np.arange(len(is_open)), -1))
        some = pc.if_else(pc.less(some, 0), None, some)
        out = {
            "key": keys, "at": pa.array(at + np.arange(len(is_open))), "open": pa.array(is_open),
            "turns": lists["turn"].take(some), "roles": lists["role"].take(some), "texts": lists["text"].take(some), "marks": lists["mark"].take(some),
            "codes": pa.array([raw[a:b] if o else None for a, b, o in zip(bounds[:-1], bounds[1:], is_open, strict=True)], pa.binary()),
            "conv": columns["conv"].take(pa.array(bounds[:-1])),
        } | made
        at += len(is_open)
        whole = pa.Table.from_arrays([out[c] for c in names], names=names).cast(SCHEMA)
        yield from whole.to_batches(max_chunksize=max(1, 1 << 12))


def finished(columns: dict[str, pa.Array], bounds: np.ndarray, chosen: np.ndarray) -> dict[str, pa.Array]:
    """Results of the chosen chunks, each a whole conversation; null for the others."""
    code, live = columns["code"].to_numpy().copy(), ~columns["gone"].to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    codes_of = lambda c: columns[c].dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    same = np.stack([owner, codes_of("role"), codes_of("mark")], axis=1)
    _, firsts = np.unique(same, axis=0, return_index=True)
    repeat = np.ones(len(code), dtype=bool)
    repeat[firsts] = False
    blank = live & (code >= 16)
    repeat &= live & ~blank
    cls = code % 4
    fixed = np.where(blank | repeat, GONE, code)
    truncated = live & ~blank & ~repeat & (code >= 4)
    turns = columns["turn"]
    known = live & turns.is_valid().to_numpy(zero_copy_only=False)
    turn = pc.fill_null(turns, 0).to_numpy()
    roles, texts = columns["role"].to_pylist(), columns["text"].to_pylist()
    rows = [np.flatnonzero(live[bounds[c] : bounds[c + 1]]) + bounds[c] for c in chosen]
    out: dict[str, list] = {c: [None] * (len(bounds) - 1) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "sha")}
    for low in range(0, len(chosen), 512):  # the table of vectors holds this many conversations
        some = rows[low : low + 512]
        table, n = padded(np.concatenate([fixed[r] for r in some]) if some else np.zeros(0, int), np.concatenate([[0], np.cumsum([len(r) for r in some])]))
        costs = backward(table, n, np.tile(END, (len(some), 1)))
        audits, _ = trace(table, n, costs, np.zeros(len(some), dtype=np.int64), np.ones(len(some), dtype=bool))
        for k, r in enumerate(some):
            c = int(chosen[low + k])
            spoken = turn[r[known[r]]]
            out["gaps"][c] = int(spoken[-1] - spoken[0] + 1 - 1 - np.count_nonzero(np.diff(spoken))) if len(spoken) else 0
            out["blank"][c], out["duplicate"][c], out["truncated"][c] = int(blank[r].sum()), int(repeat[r].sum()), int(truncated[r].sum())
            pairs = list(zip(cls[r[:-1]].tolist(), cls[r[1:]].tolist(), strict=True))
            out["illegal"][c] = sum(p not in LEGAL for p in pairs)
            out["cost"][c] = int(costs[k, 0, 0])
            out["audit"][c] = audits[k].decode()
            out["sha"][c] = sha(rebuilt(audits[k], 0, [roles[i] for i in r], [texts[i] for i in r]))
    return {c: pa.array(v, pa.string() if c in ("audit", "sha") else pa.int64()) for c, v in out.items()}


def arrow_schema() -> pa.Schema:
    strings = pa.list_(pa.string())
    kinds = {"key": pa.string(), "open": pa.bool_(), "turns": pa.list_(pa.int64()), "roles": strings, "texts": strings, "marks": strings, "codes": pa.binary(), "audit": pa.string(), "sha": pa.string()}
    return pa.schema([(f.split()[0], kinds.get(f.split()[0], pa.int64())) for f in CHUNK.split(", ")])


SCHEMA = arrow_schema()


# -- conversations over several chunks -----------------------------------------------------------------


def run_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to each chunk the vector at its start less its last part (``starts``, ``base``), and the state after it for each state before it."""
    for batch in batches:
        for low in range(0, len(batch), 512):
            part = batch.slice(low, 512)
            raw = [np.frombuffer(c, dtype=np.uint8) for c in part.column("codes").to_pylist()]
            table, n = padded(np.concatenate(raw), np.concatenate([[0], np.cumsum([len(c) for c in raw])]))
            ends = np.array(part.column("ends").to_pylist(), dtype=np.int64)
            costs = backward(table, n, ends)
            base = costs[:, 0, 3]
            last = part.column("last").to_numpy(zero_copy_only=False)
            goes = np.stack([trace(table, n, costs, np.full(len(part), q), last)[1] for q in range(4)], axis=1)
            keep = [c for c in part.schema.names if c not in ("starts", "base", "goes")]
            more = [pa.array((costs[:, 0] - base[:, None]).tolist(), pa.list_(pa.int64())), pa.array(base), pa.array(goes.tolist(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *more], names=[*keep, "starts", "base", "goes"])


RUN = "key string, idx long, at long, last boolean, codes binary, ends array<long>, starts array<long>, base long, goes array<long>"


def run_chunks(chunks: DataFrame) -> DataFrame:
    return mapped(chunks.select("key", "idx", "at", "last", "codes", "ends"), run_task, RUN)


def stitched(chunks: DataFrame, passes: int) -> DataFrame:
    """Chunks whose end vectors are right but for a constant."""
    found = settle(run_chunks(chunks.withColumn("ends", F.array(*[F.lit(int(v)).cast("long") for v in END]))), "vectors")
    for n in range(passes + 1):
        after = found.select("key", (F.col("idx") - 1).alias("idx"), F.col("starts").alias("wanted"))
        both = found.join(after, ["key", "idx"], "left").withColumn("wanted", F.coalesce("wanted", "ends"))
        stale = both.where("wanted <> ends")
        if stale.isEmpty():
            return found
        if n == passes:
            return run_chunks(joined_exactly(found))
        again = run_chunks(stale.withColumn("ends", F.col("wanted")))
        found = settle(both.where("wanted = ends").drop("wanted").unionByName(again), "vectors")
    return found


def matrix_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Min-plus matrix of each chunk: cost from each state before it to each one after it."""
    for batch in batches:
        for low in range(0, len(batch), 512):
            part = batch.slice(low, 512)
            raw = [np.frombuffer(c, dtype=np.uint8) for c in part.column("codes").to_pylist()]
            table, n = padded(np.concatenate(raw), np.concatenate([[0], np.cumsum([len(c) for c in raw])]))
            to = []
            for q in range(4):
                ends = np.full((len(part), 4), FAR, dtype=np.int64)
                ends[:, q] = 0
                to.append(backward(table, n, ends)[:, 0])
            product = np.stack(to, axis=2).reshape(len(part), 16)
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("idx"), pa.array(product.tolist(), pa.list_(pa.int64()))], names=["key", "idx", "m"])


def joined_exactly(found: DataFrame) -> DataFrame:
    """End vectors from the product of the matrices of all later chunks; each round doubles how many a product covers.

    An insert between two chunks is counted with the later one, and none is wanted after the last but to end.
    """
    reach = settle(mapped(found.select("key", "idx", "codes"), matrix_task, "key string, idx long, m array<long>"), "reach")
    most, step = found.agg(F.max("idx")).first()[0], 1
    while step <= most:
        later = reach.select("key", (F.col("idx") - step).alias("idx"), F.col("m").alias("b"))
        product = F.expr("transform(sequence(0, 15), i -> array_min(transform(sequence(0, 3), k -> m[(i div 4) * 4 + k] + b[k * 4 + i % 4])))")
        both = reach.join(later, ["key", "idx"], "left")
        reach = settle(both.select("key", "idx", F.when(F.col("b").isNull(), F.col("m")).otherwise(product).alias("m")), "reach")
        step *= 2
    final = ", ".join(str(int(v)) + "L" for v in END)
    vector = F.expr(f"transform(sequence(0, 3), q -> array_min(transform(sequence(0, 3), k -> m[q * 4 + k] + element_at(array({final}), k + 1))))")
    after = reach.select("key", (F.col("idx") - 1).alias("idx"), vector.alias("v"))
    after = after.select("key", "idx", F.expr("transform(v, x -> x - v[3])").alias("exact"))
    return found.join(after, ["key", "idx"], "left").withColumn("ends", F.coalesce("exact", "ends")).drop("exact")


def begun(found: DataFrame) -> DataFrame:
    """(key, idx, state): the state before each chunk, by composing ``goes`` of all chunks before, doubling."""
    moves = settle(found.select("key", "idx", "goes"), "moves")
    most, step = found.agg(F.max("idx")).first()[0] or 0, 1
    while step <= most:
        earlier = moves.select("key", (F.col("idx") + step).alias("idx"), F.col("goes").alias("before"))
        both = moves.join(earlier, ["key", "idx"], "left")
        moves = settle(both.select("key", "idx", F.when(F.col("before").isNull(), F.col("goes")).otherwise(F.expr("transform(before, s -> goes[int(s)])")).alias("goes")), "moves")
        step *= 2
    return moves.select("key", (F.col("idx") + 1).alias("idx"), F.expr("goes[0]").alias("state"))


def audit_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, len(batch), 512):
            part = batch.slice(low, 512)
            raw = [np.frombuffer(c, dtype=np.uint8) for c in part.column("codes").to_pylist()]
            table, n = padded(np.concatenate(raw), np.concatenate([[0], np.cumsum([len(c) for c in raw])]))
            costs = backward(table, n, np.array(part.column("ends").to_pylist(), dtype=np.int64))
            audits, _ = trace(table, n, costs, part.column("state").to_numpy(), part.column("last").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([part.column("at"), part.column("state"), pa.array(audits, pa.binary())], names=["at", "state", "audit"])


def text_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired text of each chunk, chunk by chunk."""
    for batch in batches:
        for row in range(len(batch)):
            r = batch.slice(row, 1).to_pylist()[0]
            kept = [i for i, c in enumerate(r["codes"]) if c != 32]
            lines = rebuilt(r["audit"], r["state"], [r["roles"][i] for i in kept], [r["texts"][i] for i in kept])
            piece = "\n".join(lines).encode("utf-8", "surrogatepass") if lines else None
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["key"]]), pa.array([r["at"]], pa.int64()), pa.array([r["audit"].decode()]), pa.array([piece], pa.binary())], names=["key", "at", "audit", "piece"]
            )


def hash_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and hash of each conversation from its sorted pieces."""
    key, audits, digest, begun_text = None, [], hashlib.sha256(), False

    def result() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key]), pa.array(["".join(audits)]), pa.array([digest.hexdigest()])], names=["key", "audit", "sha"])

    for batch in batches:
        for k, audit, piece in zip(*(batch.column(c).to_pylist() for c in ("key", "audit", "piece")), strict=True):
            if k != key:
                if key is not None:
                    yield result()
                key, audits, digest, begun_text = k, [], hashlib.sha256(), False
            audits.append(audit)
            if piece is not None:
                digest.update(b"\n" + piece if begun_text else piece)
                begun_text = True
    if key is not None:
        yield result()


def numbered_chunks(chunks: DataFrame) -> DataFrame:
    """Consecutive numbers of a conversation's chunks. In a partition they follow each other, so only partitions are summed up."""
    part = F.shiftright("at", 33)
    parts = chunks.groupBy("key", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    along = Window.partitionBy("key").orderBy("part")
    parts = parts.select("key", "part", "first", (F.sum("n").over(along) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy("key")).alias("total"))
    idx = F.col("before") + F.col("at") - F.col("first")
    return chunks.withColumn("part", part).join(parts, ["key", "part"]).withColumn("idx", idx).withColumn("last", idx == F.col("total") - 1).drop("part", "first", "before", "total")


def with_duplicates(chunks: DataFrame) -> DataFrame:
    """``firsts``: places of the rows that are the first of their role and text, for each chunk."""
    code = F.expr("transform(sequence(1, length(codes)), i -> cast(conv(hex(substring(codes, i, 1)), 16, 10) AS int))")
    each = chunks.withColumn("code", code).select("key", "at", F.posexplode(F.arrays_zip("roles", "marks", "code")).alias("pos", "row"))
    each = each.where("row.code < 16").groupBy("key", "row.roles", "row.marks").agg(F.min(F.struct("at", "pos")).alias("f"))
    firsts = each.groupBy(F.col("f.at").alias("at")).agg(F.collect_list("f.pos").alias("firsts"))
    return chunks.join(firsts, "at", "left")


def facts_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each chunk, what stands at its ends, and the codes of its rows with duplicates marked."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            code = np.frombuffer(r["codes"], dtype=np.uint8)
            live = code != 32
            first = np.zeros(len(code), dtype=bool)
            first[r["firsts"] or []] = True
            blank, repeat = (code >= 16) & live, (code < 16) & ~first
            here = np.flatnonzero(live)
            cls = (code[here] % 4).tolist()
            spoken = [r["turns"][i] for i in here if r["turns"][i] is not None]
            fixed = np.where(blank | repeat, GONE, code)[here].astype(np.uint8)
            out.append({
                "key": r["key"], "idx": r["idx"], "at": r["at"], "last": r["last"], "codes": fixed.tobytes(), "conv": r["conv"],
                "blank": int(blank.sum()), "duplicate": int(repeat.sum()), "truncated": int(((code >= 4) & live & ~blank & ~repeat).sum()),
                "illegal": sum(p not in LEGAL for p in zip(cls[:-1], cls[1:], strict=True)), "head": cls[0] if cls else None, "tail": cls[-1] if cls else None,
                "low": spoken[0] if spoken else None, "high": spoken[-1] if spoken else None, "turns": len(set(spoken)),
            })
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([
            (c.split()[0], {"string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}.get(c.split()[1], pa.int64())) for c in FACTS.split(", ")
        ]))


FACTS = "key string, idx long, at long, last boolean, codes binary, conv long, blank long, duplicate long, truncated long, illegal long, head long, tail long, low long, high long, turns long"


def over_chunks(chunks: DataFrame, passes: int = PASSES) -> DataFrame:
    """Results of the conversations that lie in several chunks, or at the edge of a partition."""
    numbered = numbered_chunks(chunks.select("key", "at", "conv", "turns", "roles", "marks", "codes"))
    facts = settle(mapped(with_duplicates(numbered).select("key", "idx", "at", "last", "codes", "conv", "turns", "firsts"), facts_task, FACTS), "facts")
    found = settle(stitched(facts.select("key", "idx", "at", "last", "codes"), passes), "stitched")
    states = begun(found)
    ready = found.join(states, ["key", "idx"], "left").withColumn("state", F.coalesce("state", F.lit(0).cast("long")))
    audits = mapped(ready.select("at", "codes", "ends", "last", "state"), audit_task, "at long, state long, audit binary")
    texts = chunks.select("key", "at", "roles", "texts", "codes").join(audits, "at")
    pieces = mapped(texts, text_task, "key string, at long, audit string, piece binary")
    hashed = mapped(pieces.repartition("key").sortWithinPartitions("key", "at"), hash_task, "key string, audit string, sha string")
    before = facts.select("key", (F.col("idx") + 1).alias("idx"), F.col("tail").alias("tail_before"), F.col("high").alias("high_before"))
    sides = facts.join(before, ["key", "idx"], "left").join(found.select("at", "base", F.expr("starts[0]").alias("start")), "at")
    legal = F.array(*[F.lit(10 * a + b) for a, b in sorted(LEGAL)])
    crossed = F.col("tail_before").isNotNull() & F.col("head").isNotNull() & ~F.array_contains(legal, (10 * F.col("tail_before") + F.col("head")).cast("int"))
    shared = F.coalesce((F.col("high_before") == F.col("low")).cast("long"), F.lit(0).cast("long"))
    totals = sides.groupBy("key").agg(
        F.max("conv").alias("conv"), F.coalesce(F.max("high") - F.min("low") + 1 - F.sum(F.col("turns") - shared), F.lit(0).cast("long")).alias("gaps"),
        F.sum("blank").alias("blank"), F.sum("duplicate").alias("duplicate"), F.sum("truncated").alias("truncated"),
        F.sum(F.col("illegal") + crossed.cast("long")).alias("illegal"), (F.sum("base") + F.max(F.when(F.col("idx") == 0, F.col("start")))).alias("cost"),
    )
    return totals.join(hashed, "key").drop("key")


def repair(conversations: DataFrame, rows: int = ROWS, passes: int = PASSES, damage: bool = True) -> DataFrame:
    """One row per conversation: its faults, the cheapest edits, and the hash of the repaired text."""
    lines = damaged(conversations) if damage else damaged(conversations, "-1")
    chunks = settle(mapped(in_order(lines), chunk_task, CHUNK, rows=rows), "chunks")
    whole = chunks.where("not open").select(*[c.split()[0] for c in DONE.split(", ")])
    split = chunks.where("open")
    found = whole if split.isEmpty() else whole.unionByName(over_chunks(split, passes))
    return found.select(F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha").alias("repaired_sha256"))
