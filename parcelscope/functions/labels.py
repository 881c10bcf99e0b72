"""Labels, bands and short texts derived from numbers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from parcelscope import vocab
from parcelscope.functions.numbers import present, rounded


def fairness(ask: Column, median: Column, low: Column, high: Column) -> Column:
    known = present(ask).isNotNull() & present(median).isNotNull() & low.isNotNull()
    cheap, good, fair, stretched, over, unknown = vocab.FAIRNESS
    return (
        F.when(~known, unknown)
        .when(ask < low * 0.95, cheap)
        .when(ask <= median * 0.97, good)
        .when(ask <= median * 1.05, fair)
        .when(ask <= high * 1.05, stretched)
        .otherwise(over)
    )


def evidence_confidence(n: Column, high: int = 8, medium: int = 4) -> Column:
    return F.when(n >= high, "high").when(n >= medium, "medium").when(n >= 1, "low").otherwise("none")


def underquote(ask: Column, median: Column, n: Column, confidence: Column) -> Column:
    """struct(severity, gap_pct, implied_price) when the guide sits well under the evidence."""
    gap = (median - present(ask)) / present(median)
    read = F.struct(
        F.when(gap >= 0.20, "high").otherwise("moderate").alias("severity"),
        rounded(gap * 100, 1).alias("gap_pct"),
        F.bround(median).cast("bigint").alias("implied_price"),
    )
    return F.when((n >= 4) & confidence.isin("medium", "high") & (gap >= 0.12), read)


def lookup(label: Column, table: dict[str, str]) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.element_at(F.create_map(*pairs), label)


def posture(label: Column) -> Column:
    return lookup(label, vocab.POSTURE)


def rent_posture(label: Column) -> Column:
    return lookup(label, vocab.RENT_POSTURE)


def rent_budget_read(ask: Column, budget: Column) -> Column:
    a, b = present(ask), present(budget)
    return F.when(a.isNull() | b.isNull(), "unknown").when(a <= b, "within budget").otherwise("over budget")


def rent_urgency(label: Column, confidence: Column) -> Column:
    cheap, good, fair = vocab.FAIRNESS[:3]
    return (
        F.when(label.isin(cheap, good) & confidence.isin("medium", "high"), "high")
        .when(label == fair, "medium")
        .otherwise("low")
    )


def score_band(score: Column) -> Column:
    band = None
    for floor, name in vocab.SCORE_BANDS:
        band = F.when(score >= floor, name) if band is None else band.when(score >= floor, name)
    return band.otherwise(vocab.LOWEST_BAND)


def yield_band(low: Column, high: Column) -> Column:
    """struct(low, high): the brief's band if it is a valid one, else the default."""
    ok = F.coalesce((low > 0) & (low < high) & (high < 1), F.lit(False))
    dlo, dhi = vocab.DEFAULT_YIELD_BAND
    return F.struct(
        F.when(ok, low).otherwise(F.lit(dlo)).alias("low"),
        F.when(ok, high).otherwise(F.lit(dhi)).alias("high"),
    )


def guide_read(delta: Column) -> Column:
    pct = F.format_string("%.1f", rounded(F.abs(delta) * 100, 1))
    signed = F.format_string("%.1f", rounded(delta * 100, 1))
    return (
        F.when(delta.isNull(), "No sold-guide evidence yet")
        .when(delta >= 0.10, F.concat(F.lit("Sold results average "), signed, F.lit("% above guide midpoint")))
        .when(delta <= -0.05, F.concat(F.lit("Sold results average "), pct, F.lit("% below guide midpoint")))
        .otherwise(F.concat(F.lit("Sold results average "), signed, F.lit("% from guide midpoint")))
    )


def visit_priority(action: Column, fit: Column) -> Column:
    return (
        F.when(action == "pass", "skip")
        .when(fit >= 8, "must inspect")
        .when(fit >= 7, "strong backup")
        .otherwise("optional")
    )


def recommendation_confidence(explicit: Column, score: Column) -> Column:
    return (
        F.when(explicit.isin("high", "medium", "low"), explicit)
        .when(explicit == "none", "low")
        .when(score >= 8.5, "high")
        .when(score >= 7.0, "medium")
        .otherwise("low")
    )


def signal_weight(method: Column, confidence: Column) -> Column:
    pairs = [F.lit(x) for kv in vocab.METHOD_WEIGHT.items() for x in kv]
    by_method = F.coalesce(F.try_element_at(F.create_map(*pairs), method), F.lit(vocab.OTHER_METHOD_WEIGHT))
    pairs = [F.lit(x) for kv in vocab.CONFIDENCE_WEIGHT.items() for x in kv]
    return by_method * F.coalesce(F.try_element_at(F.create_map(*pairs), confidence), F.lit(0.0))
