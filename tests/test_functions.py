"""Expressions against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from parcelscope import vocab
from parcelscope.functions import labels as L, numbers as N, tags as G, text as X
from parcelscope.functions.payload import internal_area


def column(spark, values, kind, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


def test_rounding_is_pythons(spark):
    rng = random.Random(1)
    values = [rng.randint(-99999, 99999) / d for d in (8, 16, 200, 2000) for _ in range(200)] + [0.325, 2.675, 7.35, 0.125, 2.5, -0.325]
    for digits in (1, 2, 3):
        assert column(spark, values, "double", lambda c: N.rounded(c, digits)) == [round(v, digits) for v in values]
    assert column(spark, values, "double", N.whole) == [round(v) for v in values]


@pytest.mark.parametrize(
    ("text", "price"),
    [
        ("$950,000 - $1,045,000", 997500.0), ("FROM $910,000", 910000.0), ("$1.2m", 1200000.0), ("$850k", 850000.0), ("$850 per week", None),
        ("Contact agent", None), ("", None), (None, None), ("$ 1,0 $500 or $2,000", 2000.0),
    ],
)
def test_display_price(spark, text, price):
    assert column(spark, [text], "string", N.display_price) == [price]


def test_first_amount(spark):
    texts = ["$1,050,000", "Price Withheld", "$1.2m", "sold 9,999", "10,000", None]
    assert column(spark, texts, "string", N.first_amount) == [1050000, None, None, None, 10000, None]


def test_ask_price_counts_zero_as_missing(spark):
    df = spark.createDataFrame([(None, 900, 1000), (5, 900, 1000), (0, 0, 800), (None, 700, None), (None, 0, 0)], "e long, a long, b long")
    got = [r.x for r in df.select(N.ask_price(F.col("e"), F.col("a"), F.col("b")).alias("x")).collect()]
    assert got == [950.0, 5.0, 800.0, 700.0, None]


def test_transfer_duty_bands(spark):
    prices = [0.0, 16000.0, 16001.0, 35000.0, 93000.0, 351000.0, 800000.0, 1168000.0, 2000000.0, None]

    def expected(p):
        if not p or p <= 0:
            return None
        for low, high, base, rate in vocab.TAX_BANDS:
            if high is None or p <= high:
                return float(round(base + (p - low) * rate))

    assert column(spark, prices, "double", N.transfer_duty) == [expected(p) for p in prices]


def test_affordability_ramp(spark):
    got = column(spark, [80.0, 100.0, 130.0, 200.0, 0.0, None], "double", lambda c: N.affordability(c, F.lit(100.0)))
    assert got[0] == 1.0 and math.isclose(got[1], 0.6) and got[2:] == [0.0, 0.0, None, None]
    assert column(spark, [80.0], "double", lambda c: N.affordability(c, F.lit(None).cast("double"))) == [None]


def test_fairness_labels(spark):
    asks = [920000.0, 980000.0, 1100000.0, 820000.0, 1020000.0, None]
    got = column(spark, asks, "double", lambda c: L.fairness(c, F.lit(950000.0), F.lit(900000.0), F.lit(1000000.0)))
    assert got == ["good value", "fair", "overpriced", "cheap or underquoted", "stretched", "unknown"]


def test_type_match(spark):
    pairs = [("Apartment / Unit / Flat", "APARTMENT_UNIT_FLAT", True), ("Apartment", "apartment_unit_flat", True), ("House", "Unit", False), ("Townhouse", "House", True)]
    df = spark.createDataFrame(pairs, "a string, b string, ok boolean")
    rows = df.select("ok", X.type_match(X.type_canon(F.col("a")), X.type_canon(F.col("b"))).alias("x")).collect()
    assert all(r.ok == r.x for r in rows)


def test_localities(spark):
    assert column(spark, ["Zetland NSW 2017", " St. Leonards, NSW", "zetland-nsw-2017"], "string", X.locality_slug) == ["zetland-nsw-2017", "st-leonards-nsw", "zetland-nsw-2017"]
    rows = column(spark, ["zetland-nsw-2017", "surry-hills", "2017", "nsw"], "string", X.slug_locality)
    assert [tuple(r) for r in rows] == [("Zetland", "NSW"), ("Surry Hills", None), ("2017", None), ("nsw", "NSW")]
    urls = ["https://x.example/sale/zetland-nsw-2017/?price=1", "https://x.example/sale/?suburb=bondi-nsw-2026,other", "https://x.example/123"]
    assert [tuple(r) for r in column(spark, urls, "string", X.url_locality)] == [("Zetland", "NSW"), ("Bondi", "NSW"), ("Sydney", "NSW")]
    assert column(spark, ["Zetland NSW 2017", "Carlton VIC", "Bondi, x"], "string", X.bare_suburb) == ["Zetland", "Carlton", "Bondi"]


def test_times(spark):
    texts = ["2026-06-06T10:00:00", "2026-06-06T10:00:00Z", "2026-06-06T10:00:00+10:00", "5 June 2026", "5 Jun 2026", "2026-06-06 10:00", "06/06/2026 10:00", "Sat 6 Jun 10:00", "soon", None]
    got = column(spark, texts, "string", lambda c: F.date_format(X.parse_time(c), "yyyy-MM-dd HH:mm"))
    assert got == ["2026-06-06 10:00", "2026-06-06 10:00", "2026-06-06 00:00", "2026-06-05 00:00", "2026-06-05 00:00", "2026-06-06 10:00", "2026-06-06 10:00", "1900-06-06 10:00", None, None]


def test_off_market_tags(spark):
    rows = [
        ("Sold by private treaty 12 Jun 2026", "is-sold", ("sold", "private treaty", "2026-06-12")),
        ("Sold at auction 3 July 2026", None, ("sold", "auction", "2026-07-03")),
        ("Leased", None, ("leased", None, None)), ("Under offer", None, ("off_market", None, None)),
        ("", "is-undercontract", ("off_market", None, None)), ("New", "is-new", None), (None, None, None),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(rows)], "i int, a string, b string")
    got = [r.x for r in df.select("i", G.off_market(F.col("a"), F.col("b")).alias("x")).orderBy("i").collect()]
    assert [(x.status, x.sale_method, str(x.sold_date) if x.sold_date else None) if x else None for x in got] == [r[2] for r in rows]


def test_internal_area(spark):
    raws = ['{"listing":{"building_area":"85 sqm"}}', '{"building_area":{"value":72}}', '{"internalArea":60.5}', '{"building_area":0,"internal_area":"1,050.5"}', "{}", "oops", None]
    assert column(spark, raws, "string", internal_area) == [85.0, 72.0, 60.5, 1050.5, None, None, None]


def test_patterns_know_accents(spark):
    pattern = dict((n, p) for n, p, _, _ in vocab.PREFERENCES)["cafes_lifestyle"]
    assert column(spark, ["near a café.", "near a cafe", "cafés", "écafe"], "string", lambda c: X.has(c, pattern)) == [True, True, False, False]
