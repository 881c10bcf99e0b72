"""Independent value signals per subject, their reconciliation, and the ask position.

Signals are an array of structs on the subject's row. Comparable statistics come from the
profile table, so building, weighing and reconciling the signals is a projection.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from parcelscope import vocab
from parcelscope.functions import labels as L, numbers as N, text as X
from parcelscope.functions.payload import area_source
from parcelscope.functions.phrases import found
from parcelscope.operators import comps as C
from parcelscope.session import once

SIGNAL = "struct<method:string,point:double,low:double,high:double,confidence:string,n:int,provider:string,source:string>"


def signal(
    when: Column, method: Column | str, point: Column, low: Column, high: Column, confidence: Column,
    n: Column, provider: Column | str = "internal", source: Column | str = "",
) -> Column:
    text = lambda v: F.lit(v) if isinstance(v, str) else v
    body = F.struct(
        text(method).alias("method"), point.cast("double").alias("point"), low.cast("double").alias("low"),
        high.cast("double").alias("high"), confidence.alias("confidence"), n.cast("int").alias("n"),
        text(provider).alias("provider"), text(source).alias("source"),
    )
    return F.when(F.coalesce(when, F.lit(False)), body).cast(SIGNAL)


def sold_evidence(per_profile: DataFrame) -> DataFrame:
    """Per profile: the price basis (same-bedroom comparables if there are two, else all),
    and the per-bed and per-sqm rates."""
    all_prices = F.transform("comps", lambda c: c["price"])
    same = F.transform(
        F.filter("comps", lambda c: N.bed_match(F.col("beds"), c["beds"])), lambda c: c["price"]
    )
    use_same = F.size(same) >= 2
    rows = per_profile.withColumn("basis", F.when(use_same, same).otherwise(all_prices))
    per_bed = F.filter(F.transform("comps", lambda c: c["per_bed"]), lambda v: N.present(v).isNotNull())
    per_sqm = F.transform(F.filter("comps", lambda c: c["sqm"] > 0), lambda c: c["price"] / c["sqm"])
    rows = rows.withColumn("per_bed", per_bed).withColumn("per_sqm", per_sqm)
    return rows.select(
        *C.PROFILE,
        "subjects",
        F.size("basis").alias("basis_n"),
        use_same.alias("same_bed"),
        N.array_median(F.col("basis")).alias("basis_median"),
        F.array_min("basis").alias("basis_low"),
        F.array_max("basis").alias("basis_high"),
        *_rates("per_bed"),
        *_rates("per_sqm"),
    )


def _rates(name: str) -> list[Column]:
    return [
        F.size(name).alias(f"{name}_n"),
        N.array_median(F.col(name)).alias(f"{name}_median"),
        (F.array_max(name) - F.array_min(name)).alias(f"{name}_range"),
    ]


def rent_evidence(per_profile: DataFrame) -> DataFrame:
    rents = F.transform("comps", lambda c: c["price"])
    return per_profile.select(*C.PROFILE, "subjects", F.size(rents).alias("rents_n"), N.array_median(rents).alias("rents_median"))


def comparable_signal() -> Column:
    n = F.col("basis_n")
    return signal(
        F.col("basis_median").isNotNull(), "comparable_median", F.bround("basis_median"), F.bround("basis_low"),
        F.bround("basis_high"), L.evidence_confidence(n), n, source="sold comparables",
    )


def _rate_signal(method: str, size: Column, high: int, medium: int, source: str) -> Column:
    n, median = F.col(f"{method}_n"), F.col(f"{method}_median")
    point = median * size
    spread = F.when(n > 1, F.col(f"{method}_range") / 2.0 * size).otherwise(point * 0.05)
    return signal(
        (size > 0) & (n > 0), method, F.bround(point), F.bround(point - spread), F.bround(point + spread),
        L.evidence_confidence(n, high, medium), n, source=source,
    )


def per_bed_signal() -> Column:
    return _rate_signal("per_bed", F.col("beds").cast("double"), 8, 4, "$/bedroom of comparables")


def per_sqm_signal(area: Column) -> Column:
    return _rate_signal("per_sqm", area, 6, 3, "$/internal sqm of comparables")


def hedonic_adjustment(text: Column, terms=vocab.HEDONIC, cap: float = vocab.HEDONIC_CAP) -> Column:
    total = F.lit(0.0)
    for pattern, weight, _ in terms:
        total = total + F.when(found(text, pattern), weight).otherwise(0.0)
    return F.greatest(F.lit(-cap), F.least(F.lit(cap), total))


def hedonic_reasons(text: Column, terms=vocab.HEDONIC) -> Column:
    return F.array_compact(F.array(*[F.when(found(text, p), label) for p, _, label in terms]))


def hedonic_text() -> Column:
    return X.blob(F.col("description"), X.joined(F.col("features")), F.col("headline"))


def hedonic_signal(adjustment: Column) -> Column:
    median = F.col("basis_median")
    conf = F.when(L.evidence_confidence(F.col("basis_n")).isin("high", "medium"), "medium").otherwise("low")
    zero = F.lit(0.0)
    return signal(
        median.isNotNull() & (F.abs(adjustment) >= vocab.HEDONIC_FLOOR), "hedonic", F.bround(median * (1 + adjustment)),
        F.bround(median * (1 + F.least(adjustment, zero))), F.bround(median * (1 + F.greatest(adjustment, zero))),
        conf, F.col("basis_n"), source="hedonic adjustment of comps",
    )


def yield_signal(band: Column) -> Column:
    annual = F.col("rents_median") * 52
    high, low = annual / band["low"], annual / band["high"]
    n = F.col("rents_n")
    return signal(
        n > 0, "yield_implied", F.bround((high + low) / 2.0), F.bround(low), F.bround(high),
        F.when(n < 4, "low").otherwise("medium"), n, source="rental yield cross-check",
    )


ESTIMATE = ("provider", "method", "point", "low", "high", "confidence")


def latest_estimates(captures: DataFrame, order: Sequence[str] = ("captured_at",)) -> DataFrame:
    """The estimate cache: of all captures of a key the last by ``order``; ties by the record itself."""
    record = F.struct(*[F.col(c) for c in ESTIMATE])
    by = [F.col(c) for c in order if c in captures.columns]
    last = captures.groupBy("key").agg(F.max_by(record, F.struct(*by, record)).alias("rec"))
    return last.select("key", *[F.col(f"rec.{c}") for c in ESTIMATE])


def captured_estimates(subjects: DataFrame, cache: DataFrame) -> DataFrame:
    """(id, avm): the captured estimate found by id, else by address; the last one of each key."""
    records = latest_estimates(cache).select("key", F.struct(*[F.col(c) for c in ESTIMATE]).alias("rec"))
    by_id = records.select(F.col("key").alias("id"), F.col("rec").alias("by_id"))
    by_address = records.select(F.col("key").alias("_address"), F.col("rec").alias("by_address"))
    rows = (
        subjects.select("id", F.nullif(X.normal_address(F.col("address_display")), F.lit("")).alias("_address"))
        .join(by_id, "id", "left")
        .join(by_address, "_address", "left")
        .withColumn("rec", F.coalesce("by_id", "by_address"))
    )
    known = [F.lit(m) for m in vocab.METHOD_WEIGHT]
    method = F.when(F.col("rec.method").isin(*known), F.col("rec.method")).otherwise("avm")
    return rows.select(
        "id",
        signal(
            F.coalesce("rec.point", "rec.low", "rec.high").isNotNull(), method, F.col("rec.point"), F.col("rec.low"),
            F.col("rec.high"), F.coalesce("rec.confidence", F.lit("medium")), F.lit(1),
            F.coalesce("rec.provider", F.lit("propertyvalue")), "captured estimate",
        ).alias("avm"),
    )


def signals(
    listings: DataFrame,
    subjects: DataFrame,
    neighbours: DataFrame,
    cache: DataFrame | None = None,
    extra: Sequence = (),
) -> DataFrame:
    """Subjects with their comparable evidence and ``signals``."""
    sold = C.profile_comps(listings, subjects, neighbours, C.SOLD)
    rent = C.profile_comps(listings, subjects, neighbours, C.RENT)
    rows = C.attach(C.profiled(subjects), sold_evidence(sold))
    rows = C.attach(rows, rent_evidence(rent))
    return with_signals(rows, subjects, cache, extra)


def with_signals(
    rows: DataFrame, subjects: DataFrame, cache: DataFrame | None = None, extra: Sequence = ()
) -> DataFrame:
    """Add ``signals``, heaviest first, to subject rows that carry the evidence columns.

    ``extra``: value providers, functions from the subjects to (id, signal struct).
    """
    band = F.col("yield_band") if "yield_band" in rows.columns else F.lit(None).cast("array<double>")
    two = F.when(F.size(band) == 2, band)
    rows = once(rows, own_area=area_source(rows)[1], _text=hedonic_text())
    rows = once(rows, adjustment=hedonic_adjustment(F.col("_text"))).drop("_text")
    rows = rows.withColumn("band", L.yield_band(F.get(two, F.lit(0)), F.get(two, F.lit(1))))
    parts = [
        comparable_signal(),
        per_bed_signal(),
        per_sqm_signal(F.col("own_area")),
        hedonic_signal(F.col("adjustment")),
        yield_signal(F.col("band")),
    ]
    providers = [*([lambda s: captured_estimates(s, cache)] if cache is not None else []), *extra]
    for i, provider in enumerate(providers):
        est = provider(subjects)
        value = next(c for c in est.columns if c != "id")
        rows = rows.join(est.select("id", F.col(value).alias(f"_p{i}")), "id", "left")
        parts.append(F.col(f"_p{i}").cast(SIGNAL))
    fields = ("method", "point", "low", "high", "confidence", "n", "provider", "source")
    weighed = F.transform(
        F.array_compact(F.array(*parts)),
        lambda s, i: F.struct(
            (-L.signal_weight(s["method"], s["confidence"])).alias("order"),
            i.alias("position"),
            L.signal_weight(s["method"], s["confidence"]).alias("weight"),
            *[s[f].alias(f) for f in fields],
        ),
    )
    return rows.withColumn("signals", F.sort_array(weighed))


def reconcile(rows: DataFrame) -> DataFrame:
    """Add ``estimate`` (point, low, high, confidence, signal_count, agreement)."""
    usable = F.filter(
        "signals", lambda s: (s["weight"] > 0) & N.present(N.best_point(s["point"], s["low"], s["high"])).isNotNull()
    )
    # added up in the order the signals were built, not by weight
    best = F.transform(
        usable,
        lambda s: F.struct(
            s["position"].alias("position"),
            s["weight"].alias("w"),
            N.best_point(s["point"], s["low"], s["high"]).alias("p"),
            F.coalesce(
                N.half_spread(s["low"], s["high"]), N.best_point(s["point"], s["low"], s["high"]) * 0.04
            ).alias("h"),
        ),
    )

    parts = {"w": lambda s: s["w"], "p": lambda s: s["p"], "pw": lambda s: s["p"] * s["w"], "hw": lambda s: s["h"] * s["w"]}
    none = F.struct(*[F.lit(0.0).alias(c) for c in parts])
    rows = rows.withColumn("_u", F.sort_array(best)).withColumn(
        "_sum", F.aggregate("_u", none, lambda acc, s: F.struct(*[(acc[c] + of(s)).alias(c) for c, of in parts.items()]))
    )
    n, weight = F.size("_u"), F.col("_sum.w")
    rows = rows.withColumn("_mean", F.col("_sum.p") / n)
    squares = F.aggregate("_u", F.lit(0.0), lambda acc, s: acc + (s["p"] - F.col("_mean")) * (s["p"] - F.col("_mean")))
    rows = (
        rows.withColumn("_point", F.when(weight > 0, F.col("_sum.pw") / weight))
        .withColumn("_sd", F.when(n > 1, F.sqrt(squares / n)).otherwise(0.0))
        .withColumn("_half", F.when(weight > 0, F.col("_sum.hw") / weight) + F.col("_sd") * 0.5)
    )
    cov = F.coalesce(F.col("_sd") / N.present(F.col("_point")), F.lit(0.0))
    confidence = F.when((n >= 3) & (cov < 0.06), "high").when((n >= 2) & (cov < 0.12), "medium").otherwise("low")
    estimate = F.struct(
        N.whole(F.col("_point")).alias("point"),
        N.whole(F.col("_point") - F.col("_half")).alias("low"),
        N.whole(F.col("_point") + F.col("_half")).alias("high"),
        confidence.alias("confidence"),
        n.alias("signal_count"),
        N.rounded(1 - cov, 3).alias("agreement"),
    )
    return rows.withColumn("estimate", F.when(n > 0, estimate)).drop("_u", "_sum", "_mean", "_point", "_sd", "_half")


def ask_position(ask: Column, estimate: Column) -> Column:
    """struct(asking, position, verdict, negotiation_headroom, posture), NULL without an ask."""
    point = estimate["point"]
    gap = (point - ask) / N.present(point)
    below, within = ask < estimate["low"], ask <= estimate["high"]

    def pick(a: str, b: str, c: str) -> Column:
        return F.when(below, a).when(within, b).otherwise(c)

    verdict = F.when(below & (gap >= 0.07), "under-quoted opportunity").otherwise(
        pick("keenly priced", "fairly guided", "over-quoted")
    )
    read = F.struct(
        N.whole(ask).alias("asking"),
        pick("below independent range", "within independent range", "above independent range").alias("position"),
        verdict.alias("verdict"),
        N.whole(point - ask).alias("negotiation_headroom"),
        L.lookup(pick("below", "within", "above"), vocab.ASK_POSTURE).alias("posture"),
    )
    return F.when(N.present(ask).isNotNull() & estimate.isNotNull(), read)


def valuation_case(listings: DataFrame, subjects: DataFrame, neighbours: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """Reconciled estimate and ask position per subject."""
    rows = reconcile(signals(listings, subjects, neighbours, cache))
    ask = N.ask_price(F.col("price_exact"), F.col("price_from"), F.col("price_to"))
    return rows.withColumn("ask", ask).withColumn("asking", ask_position(F.col("ask"), F.col("estimate")))


def signal_rows(rows: DataFrame) -> DataFrame:
    """Long form: one row per subject and signal, heaviest first."""
    return rows.select("id", F.posexplode("signals").alias("p", "s")).select(
        "id", (F.col("p") + 1).alias("rank"), "s.method", "s.point", "s.low", "s.high", "s.confidence", "s.weight", "s.n",
        "s.provider",
    )
