"""Viability score of a listing for a brief."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parcelscope import vocab
from parcelscope.functions import labels as L, numbers as N, text as X
from parcelscope.functions.phrases import Phrases
from parcelscope.session import apart


def score_text(df: DataFrame) -> Column:
    parts = [F.col("description"), F.col("headline"), X.joined(F.col("features"), "  ")]
    if "structured_features" in df.columns:
        parts.append(X.joined(X.names(F.col("structured_features")), "  "))
    return X.blob(*parts, sep="  ")


PHRASES = Phrases({n: p for n, p, _, _ in vocab.PREFERENCES} | {f"breaks_{n}": p for n, p in vocab.BREAKERS.items()})


def with_phrases(rows: DataFrame, text: str, likes: str = "_likes", breaks: str = "_breaks") -> DataFrame:
    """Add a struct of preferences and one of deal-breakers that the text names."""
    liked = F.struct(*[PHRASES.met(n, F.col(text)).alias(n) for n, *_ in vocab.PREFERENCES])
    broken = F.struct(*[PHRASES.met(f"breaks_{n}", F.col(text)).alias(n) for n in vocab.BREAKERS])
    return apart(rows, **{likes: liked, breaks: broken})


def _weighted(flags: str, weights: list[float]) -> Column:
    got = F.lit(0.0)
    for (name, *_), w in zip(vocab.PREFERENCES, weights, strict=True):
        got = got + F.when(F.col(f"{flags}.{name}"), w).otherwise(0.0)
    return got / sum(weights)


def _explained(ratio: Column, investor: Column, bare: Column) -> tuple[Column, Column]:
    """What speaks against the brief (``violations``), and what else there is to know (``signals``), in words."""

    def lacks(value: str, bound: str, what: str) -> Column:
        have, want = F.coalesce(F.col(value), F.lit(0.0)), F.col(bound)
        words = F.concat(have.cast("int").cast("string"), F.lit(f" {what}, "), want.cast("int").cast("string"), F.lit(" or more asked"))
        return F.when(N.present(want).isNotNull() & (have < want), words)

    def percent(value: Column) -> Column:
        return N.whole(value * 100).cast("string")

    road, floor = F.col("_breaks.main_road"), F.col("_breaks.ground_floor")
    top = F.coalesce("_risk", F.lit("unresolved risk"))
    against = F.array(
        lacks("beds", "beds_min", "beds"), lacks("baths", "baths_min", "baths"), lacks("cars", "cars_min", "car spaces"),
        F.when(ratio > 1.08, F.concat(percent(ratio - 1), F.lit("% over the buy ceiling"))),
        F.when(F.col("_breaks.overlay"), "The text names a flood or fire overlay; check it"),
        F.when(floor & road, "Ground floor on a main road"),
        F.when(bare & N.present(F.col("cars_min")).isNotNull(), "The brief asks for parking and none is in sight"),
        F.when(F.col("_dealbreaker"), F.concat(F.lit("Deal-breaker: "), top)),
    )
    rent = F.format_number(N.present(F.col("weekly_rent")), 0)
    known = F.array(
        F.when(ratio <= 0.85, F.concat(percent(1 - ratio), F.lit("% under the buy ceiling")))
        .when(ratio <= 1.0, "In the upper part of the budget")
        .when(ratio <= 1.08, "Just over the budget at the middle of the guide"),
        F.when(road & ~floor, "A main road may be near; listen for noise"),
        F.when(
            investor,
            F.when(
                F.col("_gross").isNotNull(),
                F.concat(F.lit("Gross yield "), F.format_string("%.1f", N.rounded(F.col("_gross"), 1)), F.lit("% at a rent of $"), rent, F.lit(" a week")),
            ).otherwise("No rents are known to read a yield from"),
        ),
    )
    return F.array_compact(against), F.array_compact(known)


def with_viability(df: DataFrame) -> DataFrame:
    """Add ``viability``; needs brief columns, ``risks`` and ``weekly_rent`` (may be NULL).

    Hard criteria, budget fit, deal-breaker penalty and preference match are blended with
    weights that depend on the brief's lens; investors also weigh the gross yield.
    """
    text = score_text(df)
    ask = N.ask_price(F.col("price_exact"), F.col("price_from"), F.col("price_to"))
    # read here, beside the risks, so that none are listed for a score
    rows = df.withColumns({
        "_dealbreaker": F.col("risks.has_dealbreaker"),
        "_load": F.coalesce(F.col("risks.penalty"), F.lit(0.0)),
        "_risk": F.try_element_at(F.col("risks.top"), F.lit(1))["label"],
    })
    rows = apart(rows, _text=text, _ask=ask)
    rows = with_phrases(rows, "_text")
    investor = F.lower(F.coalesce(F.nullif("buyer_type", F.lit("")), F.lit("owner_occupier"))) == "investor"

    def short(value: str, bound: str, cost: float) -> Column:
        miss = N.present(F.col(bound)).isNotNull() & (F.coalesce(F.col(value), F.lit(0.0)) < F.col(bound))
        return F.when(miss, cost).otherwise(0.0)

    hard = F.greatest(
        F.lit(0.0),
        1.0 - short("beds", "beds_min", 0.5) - short("baths", "baths_min", 0.2) - short("cars", "cars_min", 0.3),
    )
    ratio = N.present(F.col("_ask")) / N.present(F.col("buy_max"))
    budget = (
        F.when(ratio.isNull(), 0.6).when(ratio <= 0.85, 1.0).when(ratio <= 1.0, 0.8).when(ratio <= 1.08, 0.45).otherwise(0.15)
    )
    on_road = F.col("_breaks.main_road")
    bare = (F.coalesce("cars", F.lit(0.0)) == 0) & ~F.col("_likes.secure_parking")
    risk = F.when(F.col("_dealbreaker"), 0.7).otherwise(F.least(F.lit(0.25), F.col("_load") * 0.5))
    penalty = (
        F.when(F.col("_breaks.overlay"), 0.6).otherwise(0.0)
        + F.when(F.col("_breaks.ground_floor") & on_road, 0.5).when(on_road, 0.2).otherwise(0.0)
        + F.when(bare & N.present(F.col("cars_min")).isNotNull(), 0.4).otherwise(0.0)
        + risk
    )
    owner_w, investor_w = [w for *_, w, _ in vocab.PREFERENCES], [w for *_, w in vocab.PREFERENCES]
    liked = F.when(investor, _weighted("_likes", investor_w)).otherwise(_weighted("_likes", owner_w))
    gross = N.rounded(N.present(F.col("weekly_rent")) * 52 / N.present(F.col("_ask")) * 100, 2)
    rows = (
        rows.withColumn("_hard", hard)
        .withColumn("_budget", budget)
        .withColumn("_penalty", penalty)
        .withColumn("_liked", liked)
        .withColumn("_gross", F.when(investor, gross))
    )
    worth = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("_gross") - 3.0) / 2.0))
    lens = F.when(F.col("_gross").isNotNull(), 0.55 * worth + 0.45 * F.col("_liked")).otherwise(F.col("_liked"))
    rows = rows.withColumn("_lens", lens)

    def blend(a: float, b: float, c: float) -> Column:
        return a * F.col("_hard") + b * F.col("_budget") + c * F.col("_lens")

    mixed = F.when(investor, blend(0.28, 0.22, 0.50)).otherwise(blend(0.30, 0.25, 0.45))
    mixed = F.greatest(F.lit(0.0), mixed - F.col("_penalty")) * 10
    # columns of their own, so that whoever reads only numbers needs no words
    rows = apart(
        rows, _score=N.rounded(mixed, 1),
        **{f"_{n}_2": N.rounded(F.col(f"_{n}"), 2) for n in ("hard", "budget", "lens", "liked", "penalty")},
        _as=F.when(investor, "investor").otherwise(F.lower(F.coalesce(F.nullif("buyer_type", F.lit("")), F.lit("owner_occupier")))),
    )
    rows = apart(rows, _band=L.score_band(F.col("_score")))
    likes = [
        F.when(F.col(f"_likes.{n}"), n.replace("_", " ")) for n, *_ in vocab.PREFERENCES
    ]
    misses = [F.when(~F.col(f"_likes.{n}"), n.replace("_", " ")) for n, *_ in vocab.PREFERENCES]
    violations, signals = _explained(ratio, investor, bare)
    return rows.withColumn(
        "viability",
        F.struct(
            F.col("_score").alias("score"),
            F.col("_band").alias("band"),
            F.col("_as").alias("lens"),
            F.col("_hard_2").alias("hard_criteria"),
            F.col("_budget_2").alias("budget_fit"),
            F.col("_lens_2").alias("yield_or_lifestyle"),
            F.col("_liked_2").alias("preference_match"),
            F.col("_penalty_2").alias("dealbreaker_penalty"),
            F.col("_ask").alias("price_used"),
            F.col("_gross").alias("gross_yield_pct"),
            F.array_compact(F.array(*likes)).alias("matched"),
            F.array_compact(F.array(*misses)).alias("missing"),
            violations.alias("violations"),
            signals.alias("signals"),
        ),
    ).drop(*[c for c in rows.columns if c not in df.columns])


def live_candidates(listings: DataFrame, beds_max: float | None = 2) -> DataFrame:
    """Active sale listings: not sold or withdrawn, no projects, small enough (None: of any size)."""
    gone = F.lower(F.coalesce("status", F.lit(""))).isin("sold", "withdrawn")
    project = F.lower(F.coalesce("listing_type", F.lit(""))) == "project"
    fits = F.lit(True) if beds_max is None else F.col("beds").isNull() | (F.col("beds") <= beds_max)
    return listings.where((F.col("mode") == "sale") & ~gone & ~project & fits)
