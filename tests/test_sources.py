"""Captured pages, definitions, facts."""

import json

from pyspark.sql import functions as F

from parcelscope import vocab
from parcelscope.operators import facts as FX
from parcelscope.sources import pages as P, providers


def card(i, **model):
    base = {
        "url": f"/x-{i}", "price": "$1.2m", "features": {"beds": 2, "parking": 0, "cars": 1, "propertyType": "Apartment"},
        "address": {"suburb": "Zetland"}, "branding": {"agents": [{"agentName": "A"}]}, "images": list("abcdefg"),
        "tags": {"tagText": "Sold by private treaty 12 Jun 2026", "tagClassName": "is-sold"},
        "inspection": {"openTime": "2026-06-06T10:00:00", "closeTime": "2026-06-06T10:30:00"},
    }
    return {"id": i, "listingType": "listing", "listingModel": {**base, **model}}


def page(component, extra=""):
    data = json.dumps({"props": {"pageProps": {"componentProps": component}}})
    return f'<html><script id="__NEXT_DATA__" type="application/json">{data}</script>{extra}</html>'


def pages(spark, *rows):
    return spark.createDataFrame([(f"u{i}", h) for i, h in enumerate(rows)], "url string, html string")


def test_page_class(spark):
    texts = [
        "x" * 300 + " sec-if-cpt-container", "Access Denied " + "x" * 300, "tiny", "<script>digitalData</script>" + "x" * 300,
        "x" * 300, "x" * 20000, None, "Are you human? digitalData " + "x" * 300,
    ]
    rows = P.classified(pages(spark, *texts)).orderBy("url").collect()
    assert [r.page_class for r in rows] == ["akamai_challenge", "access_denied", "browser_down", "empty_shell", "akamai_challenge", "ok", "browser_down", "access_denied"]
    assert [r.denied for r in rows] == [True, True, True, False, True, False, True, False]


def test_search_page(spark):
    component = {"listingsMap": {"12345": card(12345), "99999": card(99999)}, "listingSearchResultIds": [99999, 12345, 77777, 12], "totalListings": 42}
    digital = '<script>var digitalData = {"page":{"pageInfo":{"search":{"resultsRecords":"12345, 55555","searchResultCount":7}}}};</script>'
    events = '<script type="application/ld+json">[{"@type":"Event","name":"Open","location":{"address":"x"}},{"@type":"Thing"}]</script>'
    df = pages(spark, page(component, digital + events), page(component), page({}), "<b>access denied</b>")
    rows = P.search_pages(df).orderBy("url").collect()
    assert rows[0].listing_ids == ["12345", "55555", "99999", "77777"] and rows[0].search_result_count == 7
    assert rows[1].listing_ids == ["99999", "12345", "77777"] and rows[1].search_result_count == 42
    assert [r.blocked_markers for r in rows] == [[], [], ["blocked"], ["access_denied"]]
    assert [r.type for r in P.page_events(P.search_pages(df)).collect()] == ["Open"]
    cards = providers.search("captured_search_pages", df.where("url = 'u0'")).orderBy("position").collect()
    first = cards[0]
    assert [c.id for c in cards] == ["12345", "99999"]
    assert (first.cars, first.url, len(first.images), first.agents[0].name) == (1.0, "https://listings.example/x-12345", 5, "A")
    assert first.sources[0].url == "u0" and first.inspections[0].start.startswith("2026")
    assert [r.status for r in P.availability(df).orderBy("url").collect()] == ["ok", "ok", "blocked", "blocked"]
    assert P.search_pages(df, limit=1).orderBy("url").first().listing_ids == ["12345"]


def test_short_page_keeps_its_linked_data(spark):
    event = '<script type="application/ld+json">[{"@type":"Event","name":"Open"}]</script>'
    df = pages(spark, event + "x" * 300, event + "access denied" + "x" * 300, "x" * 300)
    rows = P.search_pages(df).orderBy("url").collect()
    assert [(r.source_url, r.type) for r in P.page_events(P.search_pages(df)).collect()] == [("u0", "Open")]
    assert [r.blocked_markers for r in rows] == [["akamai_challenge"], ["access_denied"], ["akamai_challenge"]]
    rows = P.classified(df, short=None).orderBy("url").collect()
    assert [(r.page_class, r.denied) for r in rows] == [("ok", False), ("access_denied", True), ("ok", False)]
    assert [r.denied_as for r in P.embedded(df, short=None).orderBy("url").collect()] == [None, "access_denied", None]


def test_detail_page(spark):
    detail = {
        "listingId": 12345, "status": "live", "priceDetails": {"rawValues": {"from": 900000, "to": 950000}}, "bedrooms": 3,
        "propertyTypes": ["APARTMENT"], "largeMedia": [], "mediumMedia": [{"url": "m", "type": "FLOORPLAN"}, {"type": "photo"}],
        "soldDetails": {"soldPrice": {"rawValues": {"exactPrice": 1}}, "soldDate": {"isoDate": "2026-06-01T00:00:00"}},
        "inspectionDetails": {"inspections": [{"openingDateTime": {"isoDate": "2026-06-06T09:00:00"}}]},
    }
    rich = page({"listingId": 12345, "listingsMap": {"12345": card(12345)}, "rootGraphQuery": {"listingByIdV2": detail}})
    only_cards = page({"listingsMap": {"12345": card(12345), "99999": card(99999)}})
    df = pages(spark, rich, only_cards, page({"x": 1})).withColumn("wanted", F.lit("99999"))
    rows = P.detail_pages(df, "wanted").orderBy("source_url").collect()
    assert len(rows) == 2
    r = rows[0]
    assert (r.beds, r.cars, r.price_display, r.price_from, r.suburb) == (3.0, 1.0, "$1.2m", 900000, "Zetland")
    assert [(m.url, m.type) for m in r.images] == [("m", "floorplan")] and r.sold_price == 1 and str(r.sold_date) == "2026-06-01"
    assert r.inspections[0].start == "2026-06-06T09:00:00"
    assert rows[1].id == "99999" and rows[1].inspections[0].start == "2026-06-06T10:00:00"


def test_hunt_definitions(spark, tmp_path):
    spec = {"hunts": [{"name": "a", "filters": {"mode": "sale", "suburbs": ["X"], "beds_min": 1}}, {"name": "b", "enabled": False, "filters": {}}]}
    (tmp_path / "h.json").write_text(json.dumps(spec, indent=1))
    rows = providers.hunts(spark, str(tmp_path / "h.json")).collect()
    assert [(r.name, r.suburbs, r.beds_min, r.enrich) for r in rows] == [("a", ["X"], 1, False)]


FACT = "key string, label string, value string, source_name string, observed_at string, published_at string, freshness_days int"


def test_freshness(spark):
    rows = [
        ("rba", "Cash rate", "4.35%", "RBA", "2026-06-01T00:00:00+00:00", None, 21), ("old", "F", "1", "RBA", "2026-01-01", None, 21),
        ("pub", "F", "1", "RBA", "2026-06-01", "1 Jan 2026", None), ("none", "F", None, "RBA", "2026-06-01", None, None), ("undated", "F", "1", "RBA", "?", None, None),
    ]
    facts = FX.assessed(spark.createDataFrame(rows, FACT), "2026-06-05")
    assert {r.key: r.status for r in facts.collect()} == {"rba": "fresh", "old": "stale", "pub": "stale", "none": "unknown", "undated": "unknown"}
    r = FX.source_status(facts).collect()[0]
    assert r.status == "needs_review" and "stale" in r.warnings[0]
    assert FX.source_status(facts.where("false")).collect()[0].warnings == [vocab.NO_SOURCES]
    assert FX.cited(facts).where("key='rba'").first().citation == "Cash rate 4.35% — RBA · 2026-06-01T00:00:00+00:00"


def test_facts_from_text(spark):
    got = FX.facts_from_text(pages(spark, "CPI rose\n 3.1 % this year", "nothing"), [{"key": "cpi", "label": "CPI", "pattern": r"rose\s+([0-9.]+\s*%)"}])
    rows = got.orderBy("url").collect()
    assert (rows[0].value, rows[0].notes, rows[1].value, rows[1].notes) == ("3.1 %", None, None, vocab.FACT_NOT_FOUND)


def test_no_filter_repeats_the_parsing_of_a_page(spark):
    pages = spark.createDataFrame([("u", "<html></html>")], "url string, html string")
    for rows in (P.search_cards(pages), P.detail_pages(pages)):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        filters = [line for line in plan.splitlines() if "Filter" in line]
        assert filters and not [line for line in filters if "from_json" in line or "regexp_extract" in line or "html" in line]
        assert plan.count("regexp_extract(html") == 2
