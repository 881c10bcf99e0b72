"""Current state, change trail and lifecycle events of listings.

Input is the observations table: ``id, observed_at, seq`` plus the observed fields.
``(observed_at, seq)`` is a total order within a listing. Everything is derived from the
whole history with windows and combinable aggregates, so a replay gives the same result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from parcelscope import vocab
from parcelscope.functions import numbers as N
from parcelscope.functions.tags import off_market
from parcelscope.operators.skew import first_k, newest, newest_known, with_previous

ORDER = ("observed_at", "seq")
TRACKED = ("price_display", "price_from", "price_to", "status")
REPLACED = ("mode", "listing_type", "status", "price_display", "price_from", "price_to", "raw_json")
EVENT_COLUMNS = (
    "id", "observed_at", "seq", "ord", "event_type", "previous_value", "current_value", "summary",
)


def day(column: str = "observed_at") -> Column:
    return F.date_trunc("day", F.col(column))


def effective(observations: DataFrame) -> DataFrame:
    """Off-market tags override status, and mode when sold or leased."""
    if "tag_text" not in observations.columns:
        return observations.withColumn("off", off_market(F.lit(None).cast("string"), F.lit(None).cast("string")))
    rows = observations.withColumn("off", off_market(F.col("tag_text"), F.col("tag_class")))
    rows = rows.withColumn("status", F.coalesce("off.status", "status"))
    if "mode" in rows.columns:
        rows = rows.withColumn(
            "mode", F.when(F.col("off.status").isin("sold", "leased"), F.col("off.status")).otherwise(F.col("mode"))
        )
    return rows


def state_fold(observations: DataFrame, known: Sequence[str] = ()) -> DataFrame:
    """One row per listing: price, status, mode and raw text from the latest sighting
    (NULL included), every other field from its latest non-NULL one."""
    rows = effective(observations)
    fixed = {"id", *ORDER, "off", "tag_text", "tag_class"}
    fields = list(known) or [c for c in rows.columns if c not in fixed]
    return rows.groupBy("id").agg(
        *[(newest(c, ORDER) if c in REPLACED else newest_known(c, ORDER)).alias(c) for c in fields],
        F.min("observed_at").alias("first_seen"),
        F.max("observed_at").alias("last_seen"),
    )


def merge_state(current: DataFrame, update: DataFrame) -> DataFrame:
    """Keyed merge of a folded update into the stored state (same rule as the fold)."""
    a, b = current.alias("a"), update.alias("b")
    extra = [c for c in update.columns if c not in current.columns]
    columns = [c for c in [*current.columns, *extra] if c not in ("id", "first_seen", "last_seen")]

    def field(c: str) -> Column:
        if c in extra:
            return F.col(f"b.{c}")
        if c not in update.columns:
            return F.col(f"a.{c}")
        if c in REPLACED:
            return F.when(F.col("b.id").isNotNull(), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))
        return F.coalesce(f"b.{c}", f"a.{c}")

    return a.join(b, F.col("a.id") == F.col("b.id"), "full_outer").select(
        F.coalesce("a.id", "b.id").alias("id"),
        *[field(c).alias(c) for c in columns],
        F.coalesce("a.first_seen", "b.first_seen").alias("first_seen"),
        F.coalesce("b.last_seen", "a.last_seen").alias("last_seen"),
    )


def with_last_sighting(observations: DataFrame, chunk: Column | None = None) -> DataFrame:
    """Effective observations with ``prev``: the tracked fields of the sighting before.

    With inspections also ``times``, those with a start (NULL for none), and ``prev_times``, the last known ones
    (on sightings with times): a sighting without times does not erase them.
    """
    rows, known = effective(observations), []
    if "inspections" in rows.columns:
        times = _intervals(F.col("inspections"))
        rows, known = rows.withColumn("times", F.when(F.size(times) > 0, times)), ["times"]
    rows = with_previous(rows, ["id"], ORDER, TRACKED, day() if chunk is None else chunk, known=known)
    changed = F.lit(False)
    for c in TRACKED:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"prev.{c}"))
    return rows.withColumn("moved", F.col("prev").isNull() | changed)


def snapshots(observations: DataFrame, chunk: Column | None = None) -> DataFrame:
    """First sightings and sightings where price or status moved."""
    return with_last_sighting(observations.drop("inspections"), chunk).where("moved").select("id", *ORDER, *TRACKED)


def _event(ord_: int, kind: Column, before: Column, after: Column, summary: Column) -> Column:
    return F.struct(
        F.lit(ord_).alias("ord"),
        kind.alias("event_type"),
        before.alias("previous_value"),
        after.alias("current_value"),
        summary.alias("summary"),
    )


def _guide(display: Column, mid: Column) -> Column:
    return F.coalesce(F.nullif(display, F.lit("")), F.concat(F.lit("$"), F.format_number(mid, 0)))


def _price_event() -> Column:
    old = N.midpoint(F.col("prev.price_from"), F.col("prev.price_to"))
    new = N.midpoint(F.col("price_from"), F.col("price_to"))
    word = F.when(new < old, "dropped").when(new > old, "rose").otherwise("changed")
    kind = F.when(new < old, "price_drop").when(new > old, "price_rise").otherwise("price_change")
    before, after = _guide(F.col("prev.price_display"), old), _guide(F.col("price_display"), new)
    unknown = F.lit("unknown")
    text = F.concat(
        F.lit("Price guide "), word, F.lit(": "), F.coalesce(before, unknown), F.lit(" -> "), F.coalesce(after, unknown)
    )
    differs = ~F.col("price_display").eqNullSafe(F.col("prev.price_display")) | ~new.eqNullSafe(old)
    empty = F.lit("")
    return F.when(differs, _event(1, kind, F.coalesce(before, empty), F.coalesce(after, empty), text))


def _status_event() -> Column:
    empty = F.lit("")
    old, new = F.coalesce("prev.status", empty), F.coalesce("status", empty)
    text = F.concat(
        F.lit("Status changed: "),
        F.coalesce(F.nullif(old, empty), F.lit("unknown")),
        F.lit(" -> "),
        F.coalesce(F.nullif(new, empty), F.lit("unknown")),
    )
    return F.when(old != new, _event(2, F.lit("status_change"), old, new, text))


def _intervals(inspections: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(inspections, lambda i: i["start"].isNotNull())))


def shown_times(inspections: Column) -> Column:
    """Known inspection times as text, NULL for none; equal texts are equal times."""
    times = _intervals(inspections)
    return F.when(F.size(times) > 0, F.to_json(times))


def _interval_text(intervals: Column) -> Column:
    return F.array_join(
        F.transform(intervals, lambda i: F.concat_ws(" - ", i["start"], F.coalesce(i["end"], F.lit("")))), "; "
    )


def _inspection_event() -> Column:
    old, new = F.col("prev_times"), F.col("times")
    return F.when(
        old.isNotNull() & new.isNotNull() & ~old.eqNullSafe(new),
        _event(4, F.lit("inspection_change"), _interval_text(old), _interval_text(new), F.lit("Inspection times changed.")),
    )


EVENT_TYPE = "struct<ord:int,event_type:string,previous_value:string,current_value:string,summary:string>"


def _relist_event() -> Column:
    return F.when(
        F.col("back"),
        _event(3, F.lit("relisted"), F.lit("withdrawn/stale"), F.coalesce("status", F.lit("active")), F.lit(vocab.RELIST_TEXT)),
    )


def _sold_event(prior: Column) -> Column:
    """A sighting that leaves the market, unless the event before says so already."""
    detail = F.coalesce(F.nullif(F.col("off.tag_text"), F.lit("")), F.col("off.status"))
    text = F.concat(
        F.lit("Listing left the market: "), detail,
        F.coalesce(F.concat(F.lit(" ("), F.col("off.sale_method"), F.lit(")")), F.lit("")),
        F.coalesce(F.concat(F.lit(" on "), F.col("off.sold_date").cast("string")), F.lit("")),
        F.lit(". Not a live opportunity."),
    )
    return F.when(
        F.coalesce("left", F.lit(False)) & ~prior.eqNullSafe(F.lit("sold")),
        _event(1, F.lit("sold"), F.coalesce(prior, F.lit("active")), F.col("off.status"), text),
    )


def _stale_event(prior: Column) -> Column:
    """A disappearance; a second one without anything in between adds nothing."""
    return F.when(
        (F.col("kind") == 1) & ~prior.eqNullSafe(F.lit("withdrawn_or_stale")),
        _event(0, F.lit("withdrawn_or_stale"), F.lit("seen in previous run"), F.lit("missing from latest run"), F.lit(vocab.STALE_TEXT)),
    )


def events_of(rows: DataFrame) -> DataFrame:
    """Events of rows that already know what came before them.

    ``kind`` 0 is a sighting with ``prev``, ``times``, ``prev_times``, ``off``, ``left`` and ``back``, 1 a disappearance;
    ``prior`` is the type of the event before (null for none).
    """
    live, known = F.col("off").isNull(), F.col("prev").isNotNull()
    sighting = [F.when(live & known, _price_event()), F.when(live & known, _status_event()), _relist_event(), F.when(known, _inspection_event())]
    of_sighting = [F.when(F.col("kind") == 0, e) for e in sighting]
    every = F.array_compact(F.array(_stale_event(F.col("prior")), _sold_event(F.col("prior")), *of_sighting))
    return rows.select("id", *ORDER, F.explode(every).alias("e")).select("id", *ORDER, "e.*")


def price_events(observations: DataFrame, chunk: Column | None = None) -> DataFrame:
    """Drops, rises and changes between consecutive sightings (status and tags aside)."""
    rows = with_last_sighting(observations.drop("inspections"), chunk).where(F.col("prev").isNotNull())
    return rows.select("id", *ORDER, _price_event().alias("e")).where("e is not null").select("id", *ORDER, "e.*")


def status_events(observations: DataFrame, chunk: Column | None = None) -> DataFrame:
    rows = with_last_sighting(observations.drop("inspections"), chunk).where(F.col("prev").isNotNull())
    return rows.select("id", *ORDER, _status_event().alias("e")).where("e is not null").select("id", *ORDER, "e.*")


def inspection_events(observations: DataFrame, chunk: Column | None = None) -> DataFrame:
    rows = with_last_sighting(observations, chunk).where(F.col("prev").isNotNull())
    return rows.select("id", *ORDER, _inspection_event().alias("e")).where("e is not null").select("id", *ORDER, "e.*")


def lifecycle_events(
    observations: DataFrame, stale: DataFrame | None = None, chunk: Column | None = None
) -> DataFrame:
    """The full event log.

    ``stale``: disappearances (``id, observed_at``) from the search-run comparison.
    An off-market sighting replaces price and status events by one ``sold``, unless the
    latest event already is ``sold``. A live sighting right after a disappearance adds
    ``relisted``.
    """
    seen = with_last_sighting(observations, chunk)
    live = F.col("off").isNull()
    known = F.col("prev").isNotNull()
    changes = [F.when(live & known, _price_event()), F.when(live & known, _status_event())]
    late = [F.when(known, _inspection_event())] if "inspections" in seen.columns else []
    rows = seen.select(
        "id", *ORDER, "off", "status",
        F.lit(0).alias("kind"),
        (F.col("off").isNotNull() & F.col("moved")).alias("left"),
        F.array_compact(F.array(*changes)).alias("changes"),
        F.array_compact(F.array(*(late or [F.when(F.lit(False), _status_event())]))).alias("late"),
    )
    relist = F.lit(None).cast(EVENT_TYPE)
    order = ["observed_at", "kind", "seq"]
    grain = F.date_trunc("day", F.col("observed_at")) if chunk is None else chunk
    if stale is not None:
        gone = stale.select(
            "id", "observed_at", F.lit(1).alias("kind"),
            F.lit(None).cast(seen.schema["seq"].dataType).alias("seq"),
        )
        # tokens: disappearances, and sightings that can end one or add an event after it
        vocal = (F.col("kind") == 1) | F.col("off").isNull() | F.col("left") | (F.size("late") > 0)
        rows = rows.unionByName(gone, allowMissingColumns=True).withColumn("token", F.when(vocal, F.col("kind")))
        rows = with_previous(rows, ["id"], order, ["kind"], grain, "before", known=["token"])
        rows = rows.withColumn(
            "back", (F.col("kind") == 0) & F.col("off").isNull() & F.coalesce(F.col("before_token") == 1, F.lit(False))
        ).drop("before", "token", "before_token")
        relist = _relist_event()
    no_events = F.array().cast(rows.schema["changes"].dataType)
    rows = rows.withColumn(
        "events", F.concat(F.coalesce("changes", no_events), F.array_compact(F.array(relist)), F.coalesce("late", no_events))
    )
    rows = rows.where((F.col("kind") == 1) | F.coalesce("left", F.lit(False)) | (F.size("events") > 0)).withColumn(
        "closing",
        F.when(F.col("kind") == 1, "withdrawn_or_stale")
        .when(F.size("events") > 0, F.element_at("events", -1)["event_type"])
        .otherwise("sold"),
    )
    rows = with_previous(rows, ["id"], order, ["closing"], grain, "prior")
    prior = F.col("prior.closing")
    every = F.concat(F.array_compact(F.array(_stale_event(prior), _sold_event(prior))), F.coalesce("events", no_events))
    return rows.select("id", *ORDER, F.explode(every).alias("e")).select("id", *ORDER, "e.*")


def latest_event(events: DataFrame) -> DataFrame:
    """Latest event per listing, as one combinable aggregate."""
    newest_row = F.max_by(F.struct("observed_at", "event_type"), F.struct("observed_at", "seq", "ord"))
    return events.groupBy("id").agg(newest_row.alias("e")).select("id", "e.*")


def latest_changes(events: DataFrame, limit: int | None = 5, since: Column | None = None) -> DataFrame:
    """The latest events of each listing, ranked; None for all of them, without a rank."""
    rows = events if since is None else events.where(F.col("observed_at") > since)
    if limit is None:
        return rows
    order = [F.desc("observed_at"), F.desc_nulls_first("seq"), F.desc("ord")]
    return first_k(rows, ["id"], order, limit)


def why_now(events: DataFrame, since: Column | None = None) -> DataFrame:
    """One line per listing from its latest three events: sold, relisted, drop, all."""
    top = latest_changes(events, 3, since)
    ordered = F.sort_array(F.collect_list(F.struct("rank", "event_type", "summary")))  # three at most

    def first(kind: str) -> Column:
        return F.try_element_at(F.filter("top", lambda e: e["event_type"] == kind), F.lit(1))["summary"]

    drop = F.lower(first("price_drop"))
    every = F.array_join(F.transform("top", lambda e: F.lower(e["summary"])), "; ")
    text = (
        F.when(first("sold").isNotNull(), first("sold"))
        .when(
            first("relisted").isNotNull(),
            F.concat(
                F.lit("Relisted after dropping off the market"),
                F.coalesce(F.concat(F.lit("; "), drop), F.lit("")),
                F.lit("."),
            ),
        )
        .when(drop.isNotNull(), F.concat(F.lit("Resurfaced because "), drop, F.lit(".")))
        .otherwise(F.concat(F.lit("Resurfaced because "), every, F.lit(".")))
    )
    return top.groupBy("id").agg(ordered.alias("top")).select("id", text.alias("why_now"))


def lifecycle_summary(observations: DataFrame, events: DataFrame, since: Column | None = None, latest: int | None = 5) -> DataFrame:
    """Per listing: first/last seen, status, snapshots, latest changes and why now.

    ``price_drops`` counts within the ``latest`` events only (None: all).
    """
    state = state_fold(observations, ["status"])
    snaps = snapshots(observations).groupBy("id").agg(F.count("*").alias("snapshot_count"))
    changes = (
        latest_changes(events, latest, since)
        .groupBy("id")
        .agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "price_drop").alias("drops"))
    )
    return (
        state.join(snaps, "id", "left")
        .join(changes, "id", "left")
        .join(why_now(events, since), "id", "left")
        .select(
            "id", "first_seen", "last_seen", "status",
            F.coalesce("snapshot_count", F.lit(0)).alias("snapshot_count"),
            (F.coalesce("n", F.lit(0)) > 0).alias("changed"),
            F.coalesce("drops", F.lit(0)).alias("price_drops"),
            F.coalesce("why_now", F.lit(vocab.WHY_NOW_DEFAULT)).alias("why_now"),
        )
    )


# ---- child tables -----------------------------------------------------------------


def media_table(observations: DataFrame) -> DataFrame:
    """(listing, url) -> latest known type and position."""
    rows = observations.select("id", *ORDER, F.posexplode("images").alias("pos", "i")).where(
        F.coalesce(F.col("i.url"), F.lit("")) != ""
    )
    rows = rows.select(
        "id", *ORDER, "i.url",
        F.coalesce("i.type", F.lit("photo")).alias("media_type"),
        F.coalesce("i.position", "pos").alias("position"),
    )
    return rows.groupBy("id", "url").agg(
        newest_known("media_type", ORDER).alias("media_type"),
        newest_known("position", ORDER).alias("position"),
    )


def inspection_table(observations: DataFrame) -> DataFrame:
    """(listing, start) -> end of the first sighting that carried it."""
    rows = observations.select("id", *ORDER, F.explode("inspections").alias("i")).where("i.start is not null")
    return rows.groupBy("id", F.col("i.start").alias("start")).agg(
        F.min_by(F.col("i.end"), F.struct(*ORDER)).alias("end")
    )


def single_inspection(inspections: Column, open_time: Column, close_time: Column) -> Column:
    """Interval list, or the card's one open/close pair when the list is missing."""
    one = F.array(F.struct(open_time.alias("start"), close_time.alias("end")))
    return F.when(F.coalesce(F.size(inspections), F.lit(0)) > 0, inspections).otherwise(one)


def add_columns(stored: DataFrame, update: DataFrame) -> DataFrame:
    """Append rows of a newer, wider schema to a stored table."""
    return stored.unionByName(update, allowMissingColumns=True)


def raw_text(df: DataFrame) -> DataFrame:
    """Keep the whole row as JSON text next to it."""
    return df.withColumn("raw_json", F.to_json(F.struct(*df.columns)))
