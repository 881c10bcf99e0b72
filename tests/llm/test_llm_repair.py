"""Conversation repair against a plain forward search, and its parts on rows that never converge."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from parcelscope.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, key string, audit int, idx string"
COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def cheapest(rows):
    """(cost, audit, lines) of rows (role, text, fault) by a forward search that keeps the best way to each state."""
    after = {0: 2, 1: 2, 2: 3, 3: 2}
    name = {2: "user", 3: "assistant"}

    def with_inserts(ways):
        ways, more = dict(ways), True
        while more:
            more = False
            for q in list(ways):
                cost, audit, lines = ways[q]
                to, way = after[q], (cost + 2, audit + "I", (*lines, f"{name[after[q]]}:"))
                if to not in ways or way[:2] < ways[to][:2]:
                    ways[to], more = way, True
        return ways

    ways = with_inserts({0: (0, "", ())})
    for role, text, fault in rows:
        new = {}

        def put(q, way, new=new):
            if q not in new or way[:2] < new[q][:2]:
                new[q] = way

        for q, (cost, audit, lines) in ways.items():
            put(q, (cost + 3, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            cut = int(fault == "truncated")
            for initial, froms, to in (("s", (0,), 1), ("u", (0, 1, 3), 2), ("a", (2,), 3)):
                if role[:1] == initial and q in froms:
                    put(to, (cost + cut, audit + "K", (*lines, f"{role}:{text}")))
            put(after[q], (cost + 2 + cut, audit + "R", (*lines, f"{name[after[q]]}:{text}")))
        ways = with_inserts(new)
    return min((ways[q] for q in (0, 3) if q in ways), key=lambda w: w[:2])


def expected(conv, rows, damage=True):
    show = lambda x: " " if x is None else x
    live = []
    for turn, role, text in rows:
        fault = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20 if damage else 5
        role, text = show(role), show(text)
        if fault:
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            live += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    live.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in live:
        signs = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not signs else "duplicate" if (role, text) in seen else "truncated" if signs[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in live if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(live, live[1:], strict=False))
    cost, audit, lines = cheapest([(r, x, f) for (_, r, x), f in zip(live, faults, strict=True)])
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def check(spark, talks, damage=True, schema=SCHEMA, **settings):
    wide = [(*r, "k", 1, "x") for r in talks]
    found = repair.repair(spark.createDataFrame(wide, schema).repartition(3), damage=damage, **settings).collect()
    groups = defaultdict(list)
    for conv, *row in talks:
        groups[conv].append(row)
    assert {r.conv_id: tuple(r[c] for c in COLUMNS) for r in found} == {c: expected(c, g, damage) for c, g in groups.items()}
    assert len(found) == len(groups)


def random_rows(seed, conversations, roles, length):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "", " \n", "Why?", "A longer answer.  ", "mid. sentence", "Ünï!"]
    return [
        (rng.choice([c, c, None]) if c == 0 else c, rng.choice([t, t, t + 2, None]), rng.choice(roles), rng.choice([*texts, f"Text {t}.", f"Text {t}", None]))
        for c in range(conversations) for t in range(rng.randrange(1, length))
    ]


@pytest.mark.parametrize("size", [2, 256])
def test_random_conversations(spark, size):
    check(spark, random_rows(1, 60, ["system", "user", "assistant", "user", "assistant", "tool", "", None], 9), rows=size)


def test_long_conversation_over_many_chunks(spark):
    rng = random.Random(4)
    rows = [(7, t, ("user", "assistant")[t % 2] if rng.random() < 0.8 else "system", f"Turn {t}" + rng.choice([".", ""])) for t in range(300)]
    rows += [(7, 400 + t, "user", "Same.") for t in range(40)] + [(8, 1, "user", "Hello."), (8, 2, "assistant", "Hi.")]
    check(spark, rows, rows=16)


def test_rows_that_never_converge_are_joined_exactly(spark):
    """Without any known role every vector only changes places, so a fix-up pass moves on by one chunk."""
    rows = [(1, t, "tool", f"Step {t}.") for t in range(41)] + [(2, t, "tool", f"Step {t}.") for t in range(24)]
    check(spark, rows, damage=False, rows=4, passes=1)


def test_empty_table_and_conversation_without_rows(spark):
    assert repair.repair(spark.createDataFrame([], SCHEMA)).collect() == []
    gone = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    check(spark, [(5, gone, "user", "Only this.")])


def test_very_long_text_and_repeated_rows(spark):
    check(spark, [(1, 0, "user", "word " * 60_000 + "."), (1, 1, "assistant", "Yes.")] + [(2, 5, "user", "Same.")] * 50, rows=8)


def test_vectors_stay_within_inserts_of_each_other():
    """What fix-up passes rely on: differences are bounded, so there are few vectors but for a constant."""
    rng = np.random.default_rng(2)
    table = rng.integers(0, 9, size=(50, 40))
    costs = repair.backward(table, np.full(50, 40), np.tile(repair.END, (50, 1)))
    assert int((costs.max(axis=2) - costs.min(axis=2)).max()) <= 8
    assert (costs >= 0).all()
