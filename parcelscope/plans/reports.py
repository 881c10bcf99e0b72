"""Ranked outputs over decision rows: shortlist, recommendation, digest, folio, daily."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parcelscope.functions import labels as L
from parcelscope.functions.tags import first_of, grouped_media
from parcelscope.operators import scoring
from parcelscope.operators.skew import first_k

SERIOUS = ("dealbreaker", "major")


def fit(df: DataFrame) -> Column:
    """Viability score, else an authored fit score, else 0."""
    own = F.col("fit_score").cast("double") if "fit_score" in df.columns else F.lit(None).cast("double")
    return F.coalesce("viability.score", own, F.lit(0.0))


def ranked(decisions: DataFrame, limit: int) -> DataFrame:
    """Best listings per brief."""
    rows = decisions.withColumn("fit", fit(decisions))
    return first_k(rows, ["brief_id"], [F.desc("fit"), F.col("id")], limit)


def shortlist(decisions: DataFrame, limit: int | None = 8, beds_max: float | None = 2) -> DataFrame:
    """Active sale listings over all briefs, best first; None for all of them, or for homes of any size."""
    rows = scoring.live_candidates(decisions, beds_max)
    rows = (
        rows.select(
            "brief_id", "id", F.col("viability.score").alias("score"), F.col("viability.band").alias("band"), "suburb",
            F.col("price_display").alias("price"), "beds", "baths", "cars", "fairness", "confidence",
            F.col("n").alias("comp_count"), F.try_element_at(F.col("risks.top"), F.lit(1))["label"].alias("top_risk"),
            "url", F.col("address_display").alias("address"),
        )
        .orderBy(F.desc("score"), "id", "brief_id")
    )
    return rows if limit is None else rows.limit(limit)


def doubts(
    confidence: Column, n: Column, critical: Column, top: Column, action: Column, overall: Column, most: int | None = 3,
    priced: Column | None = None, scanned: Column | None = None,
) -> Column:
    """Notes on why a recommendation might be wrong, ``most`` at most. ``priced``, ``scanned``: whether there is a price read, a risk scan."""
    yes = F.lit(True)
    thin = confidence.isNull() | confidence.isin("none", "low") | (n < 4)
    notes = F.array_compact(
        F.array(
            F.when(~(yes if priced is None else priced), "There is no price read.").when(thin, "The comparables are thin; the price read may change."),
            F.when(critical > 0, "Critical checks are still open."),
            F.when(
                top["severity"].isin(*SERIOUS),
                F.concat(F.lit("One risk may outweigh the rest: "), top["label"], F.lit(".")),
            ).when(~(yes if scanned is None else scanned), "There is no risk scan."),
            F.when(action == "pass", "The advice is to pass unless new facts turn up."),
        )
    )
    fallback = F.when(
        overall != "high", F.array(F.lit("The pick is sound but not certain."))
    ).otherwise(F.array().cast("array<string>"))
    return first_of(F.when(F.size(notes) > 0, notes).otherwise(fallback), most)


def recommendation(decisions: DataFrame, notes: int | None = 3, actions: int | None = 4) -> DataFrame:
    """One row per brief: the standout, why, what to watch, what to do next, and doubts.

    At most ``notes`` reasons and as many doubts are given, and ``actions`` next steps (None: all).
    """
    top = F.try_element_at(F.col("risks.top"), F.lit(1))
    serious = top["severity"].isin(*SERIOUS)
    overall = L.recommendation_confidence(F.col("confidence"), F.col("fit"))
    authored = lambda c: F.col(c) if c in decisions.columns else F.lit(None).cast("string")
    step = F.concat_ws(" · ", F.col("best_action.label"), F.col("best_action.deadline"), F.col("best_action.detail"))
    priced, scanned = F.col("confidence").isNotNull() | F.col("n").isNotNull(), F.col("risks").isNotNull()
    named = F.coalesce(F.nullif("address_display", F.lit("")), F.nullif("headline", F.lit("")))
    best = ranked(decisions, 3).select(
        "brief_id", "rank",
        F.struct(
            F.col("rank"), F.col("id"), F.col("address_display").alias("address"), named.alias("named"), F.col("fit"), overall.alias("confidence"),
            first_of(
                F.array_compact(
                    F.array(
                        authored("verdict"),
                        F.concat(F.lit("Price read: "), F.col("fairness"), F.lit(".")),
                        F.concat(F.lit("Risk read: "), F.col("risks.summary"), F.lit(".")),
                    )
                ), notes,
            ).alias("reasons"),
            F.array_compact(
                F.array(authored("caveat"), F.when(serious, F.concat_ws(": ", top["severity"], top["label"])))
            ).alias("watch"),
            step.alias("step"),
            doubts(F.col("confidence"), F.col("n"), F.col("diligence.critical_count"), top, F.col("best_action.type"), overall, notes, priced, scanned).alias("why_wrong"),
        ).alias("p"),
    )
    picks = best.groupBy("brief_id").agg(F.sort_array(F.collect_list("p")).alias("p"))  # three at most
    first = F.element_at("p", 1)
    warm = F.transform(
        F.filter(F.slice("p", 2, 2), lambda x: F.coalesce(x["address"], F.lit("")) != ""),
        lambda x: F.concat(F.lit("Keep warm: "), x["address"], F.lit(" in case the first choice falls through.")),
    )
    lead = F.concat(
        F.lit("Lead with "), F.coalesce(first["named"], F.lit("the standout property")),
        F.lit(". Its fit is the best at "), F.format_string("%.1f", first["fit"]), F.lit("/10."),
    )
    return picks.select(
        "brief_id", first["id"].alias("standout"), lead.alias("summary"), first["confidence"].alias("confidence"),
        first["reasons"].alias("reasons"), first["watch"].alias("watch"),
        first_of(F.concat(F.array(first["step"]), warm), actions).alias("next_actions"), first["why_wrong"].alias("why_wrong"),
    )


def digest(diff: DataFrame, scores: DataFrame | None = None, reasons: DataFrame | None = None, top: int = 3) -> DataFrame:
    """First rows of each section over all hunts: new by score, changed and stale by id.

    ``diff``: hunt, id, section. ``scores``: id, viability_score. ``reasons``: id, why_now.
    """
    rows = diff.select("hunt", "id", "section")
    if scores is None:
        rows = rows.withColumn("score", F.lit(0.0))
    else:
        best = scores.groupBy("id").agg(F.max("viability_score").alias("score"))
        rows = rows.join(best, "id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    order = [F.desc(F.when(F.col("section") == "new", F.col("score")).otherwise(0.0)), F.col("hunt"), F.col("id")]
    rows = first_k(rows, ["section"], order, top)
    if reasons is not None:
        rows = rows.join(reasons.select("id", "why_now"), "id", "left")
    return rows


def folio(decisions: DataFrame, agents: DataFrame | None = None, stored_visits: DataFrame | None = None, limit: int = 20, gallery: int | None = 8) -> DataFrame:
    """Report frame: the shortlist of each brief with media, people, times and scorecard.

    ``gallery`` photos are listed behind the first one (None: all), ``n_photos`` counts them all.

    ``agents``: id, name, mobile, landline, email of stored links, used when the listing
    itself names nobody reachable. ``stored_visits``: id, start, end, used when the
    listing carries no times.
    """
    rows = ranked(decisions, limit)
    media = grouped_media(F.col("images"))
    rows = rows.withColumn("_media", media)
    person = F.transform("agents", lambda a: F.struct(a["name"].alias("name"), F.coalesce(a["mobile"], a["landline"]).alias("mobile"), a["email"].alias("email")))
    rows = rows.withColumn("people", person)
    if agents is not None:
        known = agents.withColumn("mobile", F.coalesce("mobile", "landline"))
        known = known.join(rows.select("id").distinct(), "id", "left_semi")
        reachable = F.col("mobile").isNotNull() | F.col("email").isNotNull()
        # one entry per name, a reachable one first
        named = known.groupBy("id", "name").agg(
            F.max_by(F.struct("name", "mobile", "email"), F.struct(reachable.cast("int"), F.coalesce("mobile", F.lit("")))).alias("a")
        )
        merged = named.groupBy("id").agg(F.sort_array(F.collect_list("a")).alias("stored"))  # agents of one listing
        rows = rows.join(merged, "id", "left")
        direct = F.exists("people", lambda p: p["mobile"].isNotNull() | p["email"].isNotNull())
        rows = rows.withColumn(
            "people", F.when(F.coalesce(direct, F.lit(False)) | F.col("stored").isNull(), F.col("people")).otherwise(F.col("stored"))
        ).drop("stored")
    times = F.transform("inspections", lambda i: F.struct(i["start"].alias("start"), i["end"].alias("end")))
    rows = rows.withColumn("times", times)
    if stored_visits is not None:
        wanted = stored_visits.join(rows.select("id").distinct(), "id", "left_semi")
        kept = wanted.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("stored"))  # times of one listing
        rows = rows.join(kept, "id", "left")
        rows = rows.withColumn(
            "times", F.when((F.size("times") > 0) | F.col("stored").isNull(), F.col("times")).otherwise(F.col("stored"))
        ).drop("stored")
    amount = lambda c, t: F.when(F.col(c).isNotNull(), F.concat(F.col(c).cast("int").cast("string"), F.lit(t)))
    config = F.concat_ws(" · ", amount("beds", " bed"), amount("baths", " bath"), amount("cars", " car"), "property_type")
    return rows.select(
        "brief_id", F.col("rank").alias("position"), "id",
        F.coalesce(F.nullif("headline", F.lit("")), "address_display").alias("headline"),
        F.col("address_display").alias("address"), "suburb", F.col("price_display").alias("price"), config.alias("config"),
        F.get("_media.photos", F.lit(0)).alias("hero"),
        first_of(F.col("_media.photos"), gallery, 2).alias("gallery"), F.size("_media.photos").alias("n_photos"),
        F.get("_media.floorplans", F.lit(0)).alias("floorplan"),
        "people", "times", F.col("fit").alias("fit"),
        F.col("viability.hard_criteria").alias("brief_match"),
        F.col("viability.budget_fit").alias("budget_fit"),
        F.col("viability.yield_or_lifestyle").alias("lens_fit"),
        F.col("viability.preference_match").alias("preference_match"),
        F.col("viability.dealbreaker_penalty").alias("penalty"),
        "fairness", "confidence", F.col("risks.summary").alias("top_risk"),
        F.col("best_action.label").alias("next_action"),
    )


def daily(cards: DataFrame, details: DataFrame, max_items: int = 12, enrich_max: int = 10) -> DataFrame:
    """Capped search results with the first ones enriched.

    ``cards``: source_url, position, id and listing fields; ``details``: id and listing
    fields. A detail replaces its card; a card without one stays as it is.
    """
    first = first_k(cards, ["source_url"], [F.col("position"), F.col("id")], max_items, "item")
    d = details.select("id", F.struct(*[c for c in details.columns if c != "id"]).alias("_d"))
    rows = first.join(d, "id", "left")
    rich = (F.col("item") <= enrich_max) & F.col("_d").isNotNull()
    shared = [c for c in details.columns if c in cards.columns and c != "id"]
    only = [c for c in details.columns if c not in cards.columns]
    keep = [c for c in cards.columns if c not in shared]
    return rows.select(
        *keep, "item", rich.alias("enriched"),
        *[F.when(rich, F.col(f"_d.{c}")).otherwise(F.col(c)).alias(c) for c in shared],
        *[F.when(rich, F.col(f"_d.{c}")).alias(c) for c in only],
    )


def cards(listings: DataFrame) -> DataFrame:
    """Card summary with address and url fallbacks."""
    parts = [F.nullif(c, F.lit("")) for c in ("street", "suburb", "state") if c in listings.columns]
    return listings.select(
        "id", F.col("price_display").alias("price"),
        F.coalesce(F.nullif("address_display", F.lit("")), F.concat_ws(", ", *parts)).alias("address"),
        "beds", "baths", "cars",
        F.coalesce(F.nullif("url", F.lit("")), F.concat(F.lit("https://listings.example/"), F.col("id"))).alias("url"),
    )
