"""The full decision row: every read of a listing for a brief, in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from parcelscope.functions import labels as L, numbers as N
from parcelscope.operators import checks, comps as C, scoring, signals as S
from parcelscope.operators.briefs import with_brief
from parcelscope.session import spread


def decide(
    subjects: DataFrame, listings: DataFrame, briefs: DataFrame, neighbours: DataFrame, cache: DataFrame | None = None, deal: bool = True
) -> DataFrame:
    """One row per (brief, listing): risks, diligence, price read, estimate, score, actions.

    ``subjects`` are paired with the briefs naming their area. Both comparable profile
    tables are built once and written out; every read after that is a projection or an
    equi join against one row per profile. ``deal``: subjects are dealt over tasks by id, unless they are already.
    """
    paired = with_brief(spread(subjects, "id") if deal else subjects, briefs)
    sold = C.profile_comps(listings, subjects, neighbours, C.SOLD)
    rent = C.profile_comps(listings, subjects, neighbours, C.RENT)
    rows = C.attach(C.profiled(paired), S.sold_evidence(sold))
    rows = C.attach(rows, S.rent_evidence(rent))
    prefix = lambda df, p: df.select(*C.PROFILE, "subjects", *[F.col(c).alias(f"{p}_{c}") for c in READ])
    rows = C.attach(rows, prefix(C.comp_stats(sold), "sold"))
    rows = C.attach(rows, prefix(C.comp_stats(rent), "rent"))

    renting = F.coalesce(F.col("mode") == "rent", F.lit(False)) | F.coalesce(F.lower("objective").isin("rent", "renter"), F.lit(False))
    ask = N.ask_price(F.col("price_exact"), F.col("price_from"), F.col("price_to"))
    side = lambda c: F.when(renting, F.col(f"rent_{c}")).otherwise(F.col(f"sold_{c}"))
    rows = rows.withColumn("ask", ask).withColumn("side", F.when(renting, "rent").otherwise("buy"))
    rows = (
        rows.withColumn("n", F.coalesce(side("n"), F.lit(0)))
        .withColumn("median", side("median"))
        .withColumn("confidence", F.coalesce(side("confidence"), F.lit("none")))
        .withColumn("fairness", L.fairness(F.col("ask"), side("median"), side("low"), side("high")))
    )
    rows = rows.withColumn("posture", F.when(F.col("side") == "rent", L.rent_posture(F.col("fairness"))).otherwise(L.posture(F.col("fairness"))))
    rows = rows.withColumn(
        "underquote",
        F.when(F.col("side") == "buy", L.underquote(F.col("ask"), F.col("median"), F.col("n"), F.col("confidence"))),
    )
    rows = S.with_signals(rows, subjects, cache)
    rows = S.reconcile(rows)
    buying = F.col("side") == "buy"
    rows = rows.withColumn("estimate", F.when(buying, F.col("estimate")))
    rows = rows.withColumn("asking", S.ask_position(F.col("ask"), F.col("estimate")))

    rents = C.weekly_rent(listings, subjects).select(
        F.col("area").alias("_a"), F.col("beds").alias("_b"), "weekly_rent"
    )
    rows = rows.join(rents, F.col("area").eqNullSafe(F.col("_a")) & F.col("beds").eqNullSafe(F.col("_b")), "left").drop("_a", "_b")
    rows = checks.with_risks(rows)
    rows = checks.with_diligence(rows)
    rows = scoring.with_viability(rows)
    return checks.with_actions(rows)


READ = ("n", "low", "high", "median", "median_per_bed", "confidence")


def summary(decisions: DataFrame) -> DataFrame:
    """The short form of a decision used by digests."""
    return decisions.select(
        "brief_id", "id",
        F.col("viability.score").alias("viability_score"),
        F.col("viability.band").alias("viability_band"),
        F.col("fairness").alias("price_fairness"),
        F.col("confidence").alias("valuation_confidence"),
        F.col("estimate.point").alias("independent_estimate"),
        F.col("estimate.low").alias("independent_low"),
        F.col("estimate.high").alias("independent_high"),
        F.col("estimate.confidence").alias("independent_confidence"),
        F.col("asking.verdict").alias("asking_vs_estimate"),
        F.col("risks.summary").alias("top_risk"),
        F.col("diligence.summary").alias("due_diligence"),
        F.col("best_action.label").alias("next_action"),
        F.col("best_action.deadline").alias("next_action_deadline"),
    )
