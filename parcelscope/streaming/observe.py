"""Streaming forms of the change detector, the disappearance timer and the supply count.

Sources, sinks and checkpoints live in folders the caller names (or in the shared
folder), so a restarted query goes on where it stopped.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from parcelscope.functions import numbers as N
from parcelscope.operators import history as H
from parcelscope.session import shared_folder, workers_import


def observation_stream(
    stream: DataFrame, lateness: str = "1 day", time: str = "observed_at", key: tuple[str, ...] = ("id", "observed_at", "seq")
) -> DataFrame:
    """Watermarked observations without repeated deliveries. Later ones are dropped."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark(list(key))


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TOKEN = "id string, kind int, at bigint, seq bigint, price_display string, price_from bigint, price_to bigint, status string, mid double, off string, times string, hunt string, due bigint"
STEP = (
    "id string, kind int, at bigint, seq bigint, price_display string, price_from bigint, price_to bigint, status string, off string, times string, "
    "known boolean, was_display string, was_from bigint, was_to bigint, was_status string, was_times string, left boolean, back boolean, late boolean, prior string"
)
TIP = "at bigint, seq bigint, price_display string, price_from bigint, price_to bigint, status string, mid double, times string, last_event string, away boolean, waiting string"


KINDS = {"string": StringType(), "int": IntegerType(), "bigint": LongType(), "double": DoubleType(), "boolean": BooleanType()}


def _struct(fields: str) -> StructType:
    """A type from its text, also where there is no session."""
    return StructType([StructField(name, KINDS[kind]) for name, kind in (f.split() for f in fields.split(", "))])


class ListingLog(StatefulProcessor):
    """What is known of one listing, in Spark's own keyed state: its last sighting, latest event type and due runs.

    A sighting (kind 0) comes out with the sighting and the event type before it. A membership (kind 2) says that a
    search saw the listing and when its next run that is not blocked is due; if nothing renews it, the listing
    disappears at that run (kind 1): as soon as something later is heard of it, or else by an event-time timer.
    Sightings not newer than the last one come out marked late and change nothing, so a repeated delivery adds nothing.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tip = handle.getValueState("tip", _struct(TIP))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        tip = self._read()
        waiting = dict(tip["waiting"])
        for r in sorted(rows, key=lambda r: (r.at, r.kind, r.seq or 0)):
            yield from self._overdue(key[0], tip, waiting, r.at)
            if r.kind == 2:
                if r.at >= waiting.get(r.hunt, (r.at, None))[0]:
                    waiting[r.hunt] = (r.at, r.due)
            elif tip["at"] is not None and (r.at, r.seq) <= (tip["at"], tip["seq"]):
                yield self._step(r.id, 0, r, tip, late=True)
            else:
                yield self._sighting(r, tip)
        self._write(tip, waiting)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        tip = self._read()
        waiting = dict(tip["waiting"])
        yield from self._overdue(key[0], tip, waiting, expiredTimerInfo.getExpiryTimeInMs() * 1000 + 1000)
        self._write(tip, waiting)

    def close(self) -> None:
        pass

    def _read(self) -> dict:
        names = [f.split()[0] for f in TIP.split(", ")]
        tip = dict(zip(names, self.tip.get(), strict=True)) if self.tip.exists() else dict.fromkeys(names)
        return tip | {"waiting": json.loads(tip["waiting"] or "{}"), "away": bool(tip["away"])}

    def _write(self, tip: dict, waiting: dict) -> None:
        waiting = {h: w for h, w in waiting.items() if w[1] is not None}
        self.tip.update(tuple(json.dumps(waiting, sort_keys=True) if f == "waiting" else tip[f] for f in (f.split()[0] for f in TIP.split(", "))))
        due = {w[1] // 1000 for w in waiting.values()}
        for old in list(self.handle.listTimers()):
            if old not in due:
                self.handle.deleteTimer(old)
        for at in due:
            self.handle.registerTimer(at)

    def _overdue(self, id: str, tip: dict, waiting: dict, now: int) -> Iterator[Row]:
        for due in sorted({w[1] for w in waiting.values() if w[1] is not None and w[1] < now}):
            yield Row(**dict.fromkeys(f.split()[0] for f in STEP.split(", ")) | {"id": id, "kind": 1, "at": due, "late": False, "prior": tip["last_event"]})
            tip["last_event"], tip["away"] = "withdrawn_or_stale", True
            for hunt in [h for h, w in waiting.items() if w[1] == due]:
                del waiting[hunt]

    def _step(self, id: str, kind: int, r: Row, tip: dict, **more: object) -> Row:
        base = {"id": id, "kind": kind, **{c: getattr(r, c) for c in ("at", "seq", "price_display", "price_from", "price_to", "status", "off", "times")}}
        base |= {"known": tip["at"] is not None, "was_display": tip["price_display"], "was_from": tip["price_from"], "was_to": tip["price_to"]}
        base |= {"was_status": tip["status"], "was_times": tip["times"], "left": False, "back": False, "late": False, "prior": tip["last_event"]}
        return Row(**base | more)

    def _sighting(self, r: Row, tip: dict) -> Row:
        known, live = tip["at"] is not None, r.off is None
        moved = not known or any(tip[c] != getattr(r, c) for c in ("price_display", "price_from", "price_to", "status"))
        visits = known and r.times is not None and tip["times"] is not None and r.times != tip["times"]
        back, left = live and tip["away"], not live and moved
        out = self._step(r.id, 0, r, tip, left=left, back=back)
        kinds = ["sold"] * left
        if live and known and (tip["price_display"] != r.price_display or tip["mid"] != r.mid):
            old, new = tip["mid"], r.mid
            kinds.append("price_change" if old is None or new is None or old == new else "price_drop" if new < old else "price_rise")
        if live and known and (tip["status"] or "") != (r.status or ""):
            kinds.append("status_change")
        kinds += ["relisted"] * back + ["inspection_change"] * visits
        if kinds:
            tip["last_event"] = kinds[-1]
        if live or left or visits:
            tip["away"] = False
        tip |= {c: getattr(r, c) for c in ("at", "seq", "price_display", "price_from", "price_to", "status", "mid")}
        tip["times"] = tip["times"] if r.times is None else r.times
        return out


def change_log(stream: DataFrame, lateness: str = "1 day", runs: DataFrame | None = None, time: str = "observed_at") -> DataFrame:
    """Every sighting with what came before it, and every disappearance, as an append-mode stream.

    ``runs``: the calendar of search runs (``hunts.calendar``), read anew with every batch; then sightings carry ``hunt`` and
    ``run_at``, the search that saw them and its run. ``time`` is the column that the watermark follows.
    Partial state of hot listings cannot be split, as each sighting depends on the one before; it is one row a listing.
    """
    rows = H.effective(stream.withWatermark(time, lateness))
    times = H.shown_times(F.col("inspections")) if "inspections" in rows.columns else F.lit(None).cast("string")
    rows = rows.withColumn("times", times).withColumn("off", F.to_json("off")).withColumn("mid", N.midpoint(F.col("price_from"), F.col("price_to")))
    if runs is None:
        rows = rows.withColumns({"kind": F.lit(0), "hunt": F.lit(None).cast("string"), "due": F.lit(None).cast("bigint"), "at": F.unix_micros("observed_at")})
    else:
        days = runs.alias("n").join(runs.select("hunt", F.col("run_no").alias("next_open"), F.col("run_at").alias("due_at")), ["hunt", "next_open"], "left")
        rows = rows.join(days.select("hunt", "run_at", F.unix_micros("due_at").alias("due")), ["hunt", "run_at"], "left")
        rows = rows.withColumn("kind", F.explode(F.array(F.lit(0), F.lit(2))))
        rows = rows.withColumn("at", F.when(F.col("kind") == 0, F.unix_micros("observed_at")).otherwise(F.unix_micros("run_at")))
    tokens = rows.select(time, *[F.col(c.split()[0]).cast(c.split()[1]) for c in TOKEN.split(", ")])
    steps = tokens.groupBy("id").transformWithState(ListingLog(), _struct(STEP), "Append", "EventTime")
    was = F.struct(*[F.col(f"was_{w}").alias(c) for w, c in zip(("display", "from", "to", "status"), H.TRACKED, strict=True)])
    off = F.from_json("off", "struct<status:string,sale_method:string,sold_date:date,tag_text:string>")
    visits = "array<struct<start:string,end:string>>"
    return steps.withColumns({
        "observed_at": F.timestamp_micros("at"), "off": off, "prev": F.when(F.col("known"), was),
        "times": F.from_json("times", visits), "prev_times": F.when(F.col("times").isNotNull(), F.from_json("was_times", visits)),
    }).drop("known", *[f"was_{w}" for w in ("display", "from", "to", "status", "times")])


def logged_events(log: DataFrame) -> DataFrame:
    return H.events_of(log.where("not late"))


def logged_snapshots(log: DataFrame) -> DataFrame:
    """First sightings and sightings where price or status moved."""
    changed = F.lit(False)
    for c in H.TRACKED:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"prev.{c}"))
    return log.where((F.col("kind") == 0) & ~F.col("late") & (F.col("prev").isNull() | changed)).select("id", *H.ORDER, *H.TRACKED)


def vanished(stream: DataFrame, gap: str, lateness: str = "1 day") -> DataFrame:
    """Listings not sighted for ``gap``: one row per closed session, at its end.

    A session window merges within each partition before the shuffle, so a listing
    sighted very often costs little more than a quiet one.
    """
    return (
        stream.withWatermark("observed_at", lateness)
        .groupBy(F.session_window("observed_at", gap).alias("w"), "id")
        .agg(F.count("*").alias("sightings"))
        .select("id", F.col("w.start").alias("first_seen"), F.col("w.end").alias("vanished_at"), "sightings")
    )


def supply(stream: DataFrame, every: str = "1 day", lateness: str = "1 day") -> DataFrame:
    """Distinct listings per hunt and time window, once the window is closed."""
    per_listing = (
        stream.withWatermark("observed_at", lateness)
        .groupBy(F.window("observed_at", every), "hunt", "id")
        .agg(F.count("*").alias("_n"))
    )
    return (
        per_listing.groupBy("window", "hunt")
        .agg(F.count("*").alias("total_results"))
        .select("hunt", F.col("window.end").alias("run_at"), "total_results")
    )


def drain(spark: SparkSession, stream: DataFrame, purpose: str, root: str | None = None) -> DataFrame:
    """Run an append-mode stream over what is there now; read its output table. With ``root`` a later call goes on there."""
    root = root or shared_folder(spark, purpose)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    workers_import(spark)
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{root}/out")
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def file_stream(spark: SparkSession, folder: str, name: str, schema, columns: list | None = None, **options) -> DataFrame:
    """Stream of one parquet table (file name or glob) inside a folder."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    for k, v in options.items():
        reader = reader.option(k, v)
    rows = reader.parquet(folder)
    return rows.select(*columns) if columns else rows


