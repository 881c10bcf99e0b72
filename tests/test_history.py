"""Lifecycle events against a sequential state machine, and the stated cases."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from parcelscope.operators import agents as A, history as H, hunts as U
from parcelscope.streaming import observe as O

OBS = """id string, observed_at timestamp, seq bigint, price_display string, price_from bigint, price_to bigint, status string,
    tag_text string, tag_class string, mode string, headline string, inspections array<struct<start:string,end:string>>"""
T0 = dt.datetime(2026, 6, 1)


def obs(spark, rows):
    return spark.createDataFrame(rows, OBS)


def row(id, hour, lo=1000000, hi=1100000, status="active", tag=None, seq=0, shown="guide", visits=(), headline=None):
    return (id, T0 + dt.timedelta(hours=hour), seq, shown, lo, hi, status, tag, "is-sold" if tag else None, "sale", headline, list(visits))


def kinds(df):
    return [(r.id, r.event_type) for r in df.orderBy("id", "observed_at", "ord").collect()]


def replay(rows, gone):
    """One listing at a time, one observation after the other."""
    out, state = [], {}
    steps = [(r[0], r[1], 0, r[2], r) for r in rows] + [(g[0], g[1], 1, 0, None) for g in gone]
    for id, at, kind, _, r in sorted(steps, key=lambda s: s[:4]):
        st = state.setdefault(id, {"row": None, "last": None, "times": ()})
        if kind == 1:
            if st["last"] != "withdrawn_or_stale":
                out.append((id, at, "withdrawn_or_stale"))
                st["last"] = "withdrawn_or_stale"
            continue
        off = r[7] is not None
        status = "sold" if off else r[6]
        now, prior, emitted = (r[3], r[4], r[5], status), st["last"], []
        moved = st["row"] is None or st["row"][0] != now
        if moved and off:
            if prior != "sold":
                emitted.append("sold")
        elif moved and st["row"] is not None:
            old = st["row"][0]
            a, b = (old[1] + old[2]) / 2, (now[1] + now[2]) / 2
            if (old[0], a) != (now[0], b):
                emitted.append("price_drop" if b < a else "price_rise" if b > a else "price_change")
            if old[3] != status:
                emitted.append("status_change")
        if prior == "withdrawn_or_stale" and not off:
            emitted.append("relisted")
        if st["row"] is not None:
            was, new = {tuple(x) for x in st["times"]}, {tuple(x) for x in r[11]}
            if was and new and was != new:
                emitted.append("inspection_change")
        out += [(id, at, e) for e in emitted]
        st["last"] = emitted[-1] if emitted else prior
        st["row"], st["times"] = (now,), r[11] or st["times"]  # a sighting without times erases none
    return sorted(out)


def random_case(seed):
    rng = random.Random(seed)
    rows, gone = [], []
    for i in range(12):
        t = 0
        for s in range(rng.randint(1, 25)):
            t += rng.choice([1, 5, 30])
            lo = rng.choice([900000, 950000, 1000000])
            visits = [("2026-06-06T%02d:00" % h, None) for h in rng.sample(range(9, 12), rng.randint(0, 2))]
            rows.append(row(f"L{i}", t, lo, lo + rng.choice([0, 100000]), rng.choice(["active", "auction"]),
                            "Sold by private treaty 12 Jun 2026" if rng.random() < 0.25 else None, s, rng.choice(["a", "b"]), visits))
            if rng.random() < 0.3:
                t += 1
                gone.append((f"L{i}", T0 + dt.timedelta(hours=t)))
    return rows, gone


@pytest.mark.parametrize("seed", [1, 2, 5])
def test_events_match_sequential_replay(spark, seed):
    rows, gone = random_case(seed)
    shuffled = rows[:]
    random.Random(seed).shuffle(shuffled)
    stale = spark.createDataFrame(gone, "id string, observed_at timestamp")
    for chunk in (None, F.date_trunc("hour", F.col("observed_at"))):
        got = H.lifecycle_events(obs(spark, shuffled), stale, chunk)
        assert sorted((r.id, r.observed_at, r.event_type) for r in got.collect()) == replay(rows, gone)


def test_price_drop_and_why_now(spark):
    df = obs(spark, [row("a", 0), row("a", 1, 950000, 1000000, shown="new guide")])
    events = H.lifecycle_events(df)
    r = events.collect()[0]
    assert (r.event_type, r.previous_value, r.current_value) == ("price_drop", "guide", "new guide")
    assert "price guide dropped" in H.why_now(events).collect()[0].why_now
    s = H.lifecycle_summary(df, events).collect()[0]
    assert (s.snapshot_count, s.changed, s.price_drops, s.status) == (2, True, 1, "active")


def test_relist_recorded_once(spark):
    stale = spark.createDataFrame([("a", T0 + dt.timedelta(hours=2))], "id string, observed_at timestamp")
    events = H.lifecycle_events(obs(spark, [row("a", 0), row("a", 3), row("a", 4)]), stale)
    assert kinds(events) == [("a", "withdrawn_or_stale"), ("a", "relisted")]
    assert H.why_now(events).collect()[0].why_now.startswith("Relisted")


def test_sold_after_vanishing_is_not_a_relist(spark):
    stale = spark.createDataFrame([("a", T0 + dt.timedelta(hours=2))], "id string, observed_at timestamp")
    rows = obs(spark, [row("a", 0), row("a", 3, tag="Sold by private treaty 12 Jun 2026", shown="sold")])
    events = H.lifecycle_events(rows, stale)
    assert kinds(events) == [("a", "withdrawn_or_stale"), ("a", "sold")]
    assert "private treaty" in events.where("event_type='sold'").collect()[0].summary
    state = H.state_fold(rows.drop("inspections")).collect()[0]
    assert (state.mode, state.status) == ("sold", "sold")


def test_null_price_overwrites_and_text_is_kept(spark):
    rows = obs(spark, [row("a", 0, headline="first"), row("a", 1, None, None, shown=None)])
    state = H.state_fold(rows.drop("inspections")).collect()[0]
    assert (state.price_from, state.price_display, state.headline) == (None, None, "first")
    assert kinds(H.lifecycle_events(rows)) == [("a", "price_change")]


def test_merge_is_the_fold_of_both(spark):
    rows, _ = random_case(4)
    df = obs(spark, rows).drop("inspections")
    cut = F.lit(T0 + dt.timedelta(hours=60))
    merged = H.merge_state(H.state_fold(df.where(F.col("observed_at") < cut)), H.state_fold(df.where(F.col("observed_at") >= cut)))
    whole = H.state_fold(df)
    assert sorted(map(tuple, merged.select(*whole.columns).collect())) == sorted(map(tuple, whole.collect()))


def test_added_columns(spark):
    old, new = spark.createDataFrame([("a",)], "id string"), spark.createDataFrame([("b", 1)], "id string, n int")
    assert sorted(map(tuple, H.add_columns(old, new).collect())) == [("a", None), ("b", 1)]
    assert H.raw_text(new).collect()[0].raw_json == '{"id":"b","n":1}'


def _runs(spark, spec, blocked=()):
    day = lambda n: T0 + dt.timedelta(days=n)
    members = [("h", day(n), i, False) for n, ids in enumerate(spec) for i in ids]
    runs = [("h", day(n), len(ids), n in blocked) for n, ids in enumerate(spec)]
    return (
        spark.createDataFrame(members, "hunt string, run_at timestamp, id string, off_market boolean"),
        spark.createDataFrame(runs, "hunt string, run_at timestamp, total_results long, blocked boolean"),
    )


def test_hunt_diff(spark):
    members, runs = _runs(spark, ["ab", "bc", "bcd"])
    events = spark.createDataFrame([("b", T0 + dt.timedelta(days=1, hours=1)), ("c", T0)], "id string, observed_at timestamp")
    got = {(r.id, r.section) for r in U.latest_diff(members, runs, events).collect()}
    assert got == {("a", "stale"), ("d", "new"), ("b", "changed")}
    assert [(r.id, r.run_at.day) for r in U.vanished(members, runs).collect()] == [("a", 2)]


def test_blocked_run_marks_nothing(spark):
    members, runs = _runs(spark, ["ab", ""], blocked={1})
    assert U.vanished(members, runs).count() == 0
    r = U.hunt_report(members, runs).collect()[0]
    assert (r.stale_count, r.new_count, r.changed_count, r.blocked) == (0, 0, 0, True)


def test_blocked_runs_record_what_they_saw(spark):
    """b is first seen in a blocked run, c in that run only."""
    members, runs = _runs(spark, ["a", "bc", "ab"], blocked={1})
    new = {(r.id, r.run_at.day) for r in U.new_listings(members, runs).collect()}
    assert new == {("a", 1), ("b", 2), ("c", 2)}
    assert {(r.id, r.section) for r in U.latest_diff(members, runs).collect()} == {("c", "stale")}
    assert [(r.id, r.run_at.day) for r in U.vanished(members, runs).collect()] == [("c", 3)]
    assert U.returned(members, runs).count() == 0
    members, runs = _runs(spark, ["a", "ab"], blocked={1})
    assert {(r.id, r.section) for r in U.latest_diff(members, runs).collect()} == {("b", "new")}


def test_times_are_remembered(spark):
    first, other = [("2026-06-06T10:00", None)], [("2026-06-06T11:00", None)]
    rows = [row("a", 0, visits=first), row("a", 30), row("a", 60, visits=other)]
    assert kinds(H.inspection_events(obs(spark, rows))) == [("a", "inspection_change")]


def test_times_changed_while_off_market_hide_a_relist(spark):
    tag = "Sold by private treaty 12 Jun 2026"
    visits = [[("2026-06-06T%d:00" % h, None)] for h in (10, 11)]
    rows = [row("a", 0, tag=tag, visits=visits[0]), row("a", 3, tag=tag, visits=visits[1]), row("a", 4)]
    stale = spark.createDataFrame([("a", T0 + dt.timedelta(hours=2))], "id string, observed_at timestamp")
    events = H.lifecycle_events(obs(spark, rows), stale)
    assert "relisted" not in [k for _, k in kinds(events)] and "inspection_change" in [k for _, k in kinds(events)]


def test_returned_after_gap(spark):
    members, runs = _runs(spark, ["a", "", "b", "a"])
    assert [(r.id, r.run_at.day) for r in U.returned(members, runs).collect()] == [("a", 4)]
    assert sorted((r.id, r.run_at.day) for r in U.vanished(members, runs).collect()) == [("a", 2), ("b", 4)]


def test_supply_trend(spark):
    rows = [("h", T0, 120), ("h", T0 + dt.timedelta(days=1), 95), ("none", T0, None), ("one", T0, 5)]
    runs = spark.createDataFrame(rows, "hunt string, run_at timestamp, total_results long")
    got = {r.hunt: r for r in U.supply_trend(runs).collect()}
    h = got["h"]
    assert (h.current, h.previous, h.delta, h.direction, h.n_runs, h.avg_recent, h.pct_change) == (95, 120, -25, "falling", 2, 108, -20.8)
    assert (got["none"].direction, got["one"].direction) == ("no-data", "first-reading")


def test_agent_metrics(spark):
    rows = [row("a", 0, 900000, 1000000), row("a", 1, 850000, 900000, shown="less")]
    drops = H.lifecycle_events(obs(spark, rows))
    listings = spark.createDataFrame([("a", 1100000, 850000, 900000)], "id string, sold_price long, price_from long, price_to long")
    links = spark.createDataFrame([("a", 1)], "id string, agent_id long")
    m = A.agent_metrics(listings, links, drops).collect()[0]
    assert (m.listings_seen, m.listings_sold, m.price_drops_observed, m.underquote_signals, m.avg_guide_vs_sold) == (1, 1, 1, 1, 0.2571)


SHOWN = ["id", "observed_at", "seq", "event_type", "previous_value", "current_value", "summary"]


def shown(events):
    return sorted(map(str, events.select(*SHOWN).collect()))


def test_stream_equals_batch_over_five_files_with_restarts(spark, tmp_path):
    """Every call of ``drain`` is a new query that goes on from the checkpoint, so state outlives restarts."""
    rows, _ = random_case(7)
    rows.sort(key=lambda r: (r[1], r[0], r[2]))
    source, root = str(tmp_path / "in"), str(tmp_path / "log")
    for n in range(5):
        part = rows[n * len(rows) // 5 : (n + 1) * len(rows) // 5]
        obs(spark, part + part[:3]).coalesce(1).write.mode("append").parquet(source)  # some are delivered twice
        stream = spark.readStream.schema(OBS).option("maxFilesPerTrigger", 1).parquet(source)
        log = O.drain(spark, O.change_log(stream, "30 days"), "test-log", root)
    assert shown(O.logged_events(log)) == shown(H.lifecycle_events(obs(spark, rows)))
    snaps = ["id", "observed_at", "seq"]
    assert sorted(map(tuple, O.logged_snapshots(log).select(*snaps).collect())) == sorted(map(tuple, H.snapshots(obs(spark, rows)).select(*snaps).collect()))
    assert log.where("late").count() == 15


def test_stream_with_runs_equals_batch(spark, tmp_path):
    """Disappearances and returns by timers; a blocked run arms none."""
    rng = random.Random(3)
    day = dt.timedelta(days=1)
    runs = [(h, T0 + day * (n + 1), 5, h == "b" and n in (2, 5)) for h in ("a", "b") for n in range(9)]
    runs = spark.createDataFrame(runs, "hunt string, run_at timestamp, total_results long, blocked boolean")
    days = [[row(f"x{i}", 24 * n + rng.randrange(24), 1000000 + 50000 * rng.randrange(3), seq=10 * n + i, tag="Sold by auction 1 Jun 2026" if rng.random() < 0.1 else None) for i in range(8) if rng.random() < 0.6] for n in range(9)]
    seen = OBS + ", hunt string, run_at timestamp"
    source, root = str(tmp_path / "in"), str(tmp_path / "log")
    wide = []
    for n, part in enumerate(days):
        found = [(*r, rng.choice("ab"), T0 + day * (n + 1)) for r in part]
        wide += found
        spark.createDataFrame(found, seen).coalesce(1).write.mode("append").parquet(source)
        if n in (3, 8):
            stream = spark.readStream.schema(seen).option("maxFilesPerTrigger", 1).parquet(source)
            log = O.drain(spark, O.change_log(stream, "0 seconds", U.calendar(runs), "run_at"), "test-log", root)
    every = spark.createDataFrame(wide, seen)
    members = every.select("hunt", "run_at", "id", F.lit(False).alias("off_market"))
    gone = U.vanished(members, runs).select("id", F.col("run_at").alias("observed_at")).distinct()
    batch = H.lifecycle_events(every.drop("hunt", "run_at"), gone)
    assert shown(O.logged_events(log)) == shown(batch)
    assert {"relisted", "withdrawn_or_stale", "sold"} <= {r.event_type for r in batch.collect()}
