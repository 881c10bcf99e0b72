"""Captured search and detail pages -> normalized listings.

Input is a table of captured pages: ``url`` and ``html``. Everything is a projection over
the page: the embedded JSON is cut out with one pattern per block and parsed once with an
explicit schema.

A page without structured data and with fewer than ``short`` characters counts as denied; with
``short=None`` length denies no page. The class is reported beside what was parsed: a page is left
unparsed for a block marker alone, never for its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parcelscope import schema, vocab
from parcelscope.functions.tags import first_of
from parcelscope.session import once

BASE_URL = "https://listings.example"
_NEXT = r"(?is)<script[^>]*\bid=[\"']__NEXT_DATA__[\"'][^>]*>(.*?)</script>"
_LD = r"(?is)<script[^>]*\btype=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"
_DIGITAL = r"(?s)var\s+digitalData\s*=\s*(\{.*?\});"


# ---- page state -------------------------------------------------------------------


def _any(low: Column, markers) -> Column:
    hit = F.lit(False)
    for m in markers:
        hit = hit | low.contains(m)
    return hit


def lowered(html: Column) -> Column:
    return F.lower(F.coalesce(html, F.lit("")))


def structured(html: Column) -> Column:
    return _any(lowered(html), vocab.STRUCTURED_MARKERS)


def marked(html: Column) -> Column:
    return _any(lowered(html), vocab.BLOCK_MARKERS)


def _shorter(html: Column, short: int | None) -> Column:
    return F.lit(False) if short is None else F.length(F.coalesce(html, F.lit(""))) < short


def page_class(html: Column, short: int | None = vocab.SHORT_PAGE_CHARS) -> Column:
    """Why a page is unusable, or ok."""
    low = F.lower(F.coalesce(html, F.lit("")))
    size = F.length(low)
    return (
        F.when(_any(low, vocab.CHALLENGE_MARKERS), "akamai_challenge")
        .when(_any(low, (vocab.DENIED_MARKER, *vocab.BLOCK_MARKERS)), "access_denied")
        .when(size < vocab.EMPTY_PAGE_CHARS, "browser_down")
        .when(structured(html), "empty_shell")
        .when(_shorter(html, short), "akamai_challenge")
        .otherwise("ok")
    )


def hard_denied(html: Column, short: int | None = vocab.SHORT_PAGE_CHARS) -> Column:
    """No structured data, and marked as blocked or too short to be a page."""
    return ~structured(html) & (marked(html) | _shorter(html, short))


def classified(pages: DataFrame, short: int | None = vocab.SHORT_PAGE_CHARS) -> DataFrame:
    html = F.col("html")
    return pages.select(
        "*",
        F.sha2("url", 256).alias("page_key"),
        structured(html).alias("structured"),
        marked(html).alias("marked"),
        hard_denied(html, short).alias("denied"),
        page_class(html, short).alias("page_class"),
    )


def page_title(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


# ---- embedded data ----------------------------------------------------------------


def embedded(pages: DataFrame, short: int | None = vocab.SHORT_PAGE_CHARS) -> DataFrame:
    """Add ``component``, ``digital``, ``ld`` of pages that are not marked as blocked, and ``denied_as``."""
    rows = once(pages, _low=lowered(F.col("html")))
    html, low = F.col("html"), F.col("_low")
    data, block = _any(low, vocab.STRUCTURED_MARKERS), _any(low, vocab.BLOCK_MARKERS)
    rows = once(rows, _data=data, marked=block)
    data, block = F.col("_data"), F.col("marked")
    usable = data | ~block
    denied = ~data & (block | _shorter(html, short))
    rows = once(rows, denied_as=F.when(denied, page_class(html, short))).drop("_low")
    cut = lambda p: F.when(usable, F.regexp_extract(html, p, 1))
    rows = once(rows, _next=cut(_NEXT), _inline=cut(_DIGITAL))
    rows = once(rows, next=F.from_json(_set(F.col("_next")), schema.NEXT), inline=F.from_json(_set(F.col("_inline")), schema.DIGITAL))
    ld = F.flatten(
        F.transform(
            F.when(usable, F.regexp_extract_all("html", F.lit(_LD), F.lit(1))),
            lambda t: F.coalesce(F.from_json(t, schema.LD_ITEM), F.array().cast(schema.LD_ITEM)),
        )
    )
    layout = F.col("next.props.pageProps.layoutProps.digitalData")
    component = F.col("next.props.pageProps.componentProps")
    return (
        rows.withColumn("ld", ld)
        .withColumn("component", component)
        .withColumn("digital", F.coalesce("inline", component["digitalData"], layout))
        .drop("html", "next", "inline", "_next", "_inline", "_data")
    )


def listing_ids(digital: Column, component: Column) -> Column:
    """Distinct ids (four digits up) in first-seen order."""
    search = digital["page"]["pageInfo"]["search"]
    none = F.array().cast("array<string>")
    lists = F.transform(
        F.map_entries(F.map_filter(search, lambda k, v: k.startswith("resultsRecords") & v.isNotNull())),
        lambda e: F.split(e["value"], ","),
    )
    recorded = F.transform(F.flatten(lists), lambda x: F.trim(x))
    every = F.concat(F.coalesce(recorded, none), F.coalesce(component["listingSearchResultIds"], none))
    return F.array_distinct(F.filter(every, lambda x: F.coalesce(x.rlike(r"^\d{4,}$"), F.lit(False))))


def result_count(digital: Column, component: Column) -> Column:
    counted = F.try_element_at(digital["page"]["pageInfo"]["search"], F.lit("searchResultCount"))
    return F.coalesce(counted.try_cast("bigint"), component["totalListings"])


def search_pages(pages: DataFrame, limit: int | None = None, short: int | None = vocab.SHORT_PAGE_CHARS) -> DataFrame:
    """One row per search page: ids, counts, blocked markers, and the raw listing map."""
    rows = embedded(pages, short)
    ids = listing_ids(F.col("digital"), F.col("component"))
    rows = once(rows, listing_ids=F.slice(ids, 1, limit) if limit else ids)
    rows = rows.withColumn("search_result_count", result_count(F.col("digital"), F.col("component")))
    rows = rows.withColumn("listings_map", F.col("component.listingsMap"))
    shell = (
        (F.size("listing_ids") == 0)
        & (F.coalesce(F.size("listings_map"), F.lit(0)) <= 0)
        & (F.coalesce("search_result_count", F.lit(0)) == 0)
    )
    markers = (
        F.when(F.col("denied_as").isNotNull(), F.array("denied_as"))
        .when(F.col("marked") | shell, F.array(F.lit("blocked")))
        .otherwise(F.array().cast("array<string>"))
    )
    return rows.withColumn("blocked_markers", markers).withColumn("count", F.size("listing_ids")).drop("digital")


def page_events(rows: DataFrame) -> DataFrame:
    """Event items of the pages' linked data."""
    return rows.select("url", F.explode("ld").alias("e")).where(F.col("e.`@type`") == "Event").select(
        F.col("url").alias("source_url"), F.col("e.name").alias("type"), F.col("e.description").alias("description"),
        F.col("e.url").alias("url"), F.col("e.startDate").alias("start_date"), F.col("e.location.address").alias("address"),
        F.col("e.location.geo").alias("geo"), F.col("e.image").alias("image"),
    )


# ---- normalization ----------------------------------------------------------------


def absolute_url(url: Column, base: str = BASE_URL) -> Column:
    return (
        F.when(F.coalesce(url, F.lit("")) == "", F.lit(None).cast("string"))
        .when(url.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), url)
        .when(url.startswith("//"), F.concat(F.lit("https:"), url))
        .when(url.startswith("/"), F.concat(F.lit(base), url))
        .otherwise(F.concat(F.lit(base + "/"), url))
    )


def _set(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def with_card(rows: DataFrame, listing_id: Column, raw: Column, out: str = "c", images: int | None = 5) -> DataFrame:
    """Add the normalized search card; its model may sit under ``listingModel`` or at the top. ``images``: how many it keeps (None: all).

    Each of the two texts is parsed once.
    """
    rows = once(rows, _outer=F.from_json(raw, schema.CARD))
    rows = once(rows, _model=F.from_json(F.coalesce("_outer.listingModel", raw), schema.CARD_MODEL))
    return rows.withColumn(out, F.when(raw.isNotNull(), _card(listing_id, raw, F.col("_outer"), F.col("_model"), images))).drop("_outer", "_model")


def _card(listing_id: Column, raw: Column, outer: Column, inner: Column, images: int | None) -> Column:
    f, b = inner["features"], inner["branding"]
    people = F.transform(
        b["agents"],
        lambda a: F.struct(
            F.coalesce(_set(a["agentName"]), a["name"]).alias("name"), F.lit(None).cast("string").alias("email"),
            F.lit(None).cast("string").alias("mobile"), F.lit(None).cast("string").alias("landline"),
            F.lit(None).cast("string").alias("profile_url"), a["agentPhoto"].alias("photo"),
            F.lit(None).cast("string").alias("agent_id"),
        ),
    )
    pictures = F.transform(
        F.filter(first_of(F.coalesce(inner["images"], F.array().cast("array<string>")), images), lambda u: F.coalesce(u, F.lit("")) != ""),
        lambda u, i: F.struct(
            u.alias("url"), F.lit("photo").alias("type"), F.lit(None).cast("string").alias("category"), i.alias("position")
        ),
    )
    visit = inner["inspection"]
    return F.struct(
        F.coalesce(_set(outer["id"]), listing_id).alias("id"),
        F.coalesce(_set(outer["listingType"]), inner["listingType"]).alias("listing_type"),
        absolute_url(inner["url"]).alias("url"),
        F.coalesce(_set(inner["price"]), _set(inner["displayPrice"]), inner["displaySearchPriceRange"]).alias("price_display"),
        inner["address"]["displayAddress"].alias("address_display"),
        inner["address"]["street"].alias("street"),
        inner["address"]["suburb"].alias("suburb"),
        inner["address"]["state"].alias("state"),
        inner["address"]["postcode"].alias("postcode"),
        inner["address"]["lat"].alias("lat"),
        inner["address"]["lng"].alias("lng"),
        f["beds"].alias("beds"),
        f["baths"].alias("baths"),
        F.coalesce(F.nullif(f["parking"], F.lit(0.0)), f["cars"]).alias("cars"),
        F.coalesce(_set(f["propertyTypeFormatted"]), f["propertyType"]).alias("property_type"),
        f["landSize"].alias("land_size"),
        f["landUnit"].alias("land_unit"),
        F.coalesce(people, F.array().cast(f"array<{schema.AGENT}>")).alias("agents"),
        b["agencyId"].alias("agency_id"),
        inner["promoType"].alias("promo_type"),
        inner["auction"].alias("auction"),
        inner["tags"]["tagText"].alias("tag_text"),
        inner["tags"]["tagClassName"].alias("tag_class"),
        pictures.cast(f"array<{schema.IMAGE}>").alias("images"),
        F.when(
            _set(visit["openTime"]).isNotNull(),
            F.array(F.struct(visit["openTime"].alias("start"), visit["closeTime"].alias("end"))),
        ).otherwise(F.array().cast(f"array<{schema.INTERVAL}>")).alias("inspections"),
        raw.alias("raw_json"),
    )


def search_cards(pages: DataFrame, limit: int | None = None) -> DataFrame:
    """One normalized row per listing on each search page, in page order."""
    rows = search_pages(pages, limit)
    # looked up before the rows are multiplied, as each would carry the whole map
    card = lambda x, i: F.struct(i.alias("position"), x.alias("_id"), F.try_element_at("listings_map", x).alias("_raw"))
    rows = once(rows, _cards=F.filter(F.transform("listing_ids", card), lambda c: c["_raw"].startswith("{")))
    rows = rows.select("url", F.explode("_cards").alias("_c")).select("url", "_c.*")
    found = with_card(rows, F.col("_id"), F.col("_raw"))
    return found.select(F.col("url").alias("source_url"), "position", "c.*")


def media(detail: Column) -> Column:
    """Images of the first resolution tier that has any, typed and numbered."""
    tiers = [F.when(F.size(detail[t]) > 0, detail[t]) for t in ("largeMedia", "mediumMedia", "smallMedia", "thumbnailMedia")]
    numbered = F.transform(
        F.coalesce(*tiers),
        lambda m, i: F.struct(
            m["url"].alias("url"), F.lower(F.coalesce(_set(m["type"]), F.lit("photo"))).alias("type"),
            m["mediaCategory"].alias("category"), i.alias("position"),
        ),
    )
    return F.filter(numbered, lambda m: F.coalesce(m["url"], F.lit("")) != "")


def _filled_in(raw: Column) -> Column:
    return F.coalesce(~raw.isin("", "{}", "[]", "null", "false"), F.lit(False))


def detail_listing(listing_id: Column, detail: Column, fallback: Column, bare: Column) -> Column:
    """Normalized detail block; a field it lacks comes from the card (may be NULL).

    ``bare``: there is no detail block at all, only the card.
    """
    d, c = detail, fallback
    address, price = d["displayableAddress"], d["priceDetails"]
    sold = d["soldDetails"]
    people = F.transform(
        d["agents"],
        lambda a: F.struct(
            a["fullName"].alias("name"), a["email"].alias("email"), a["mobileNumber"].alias("mobile"),
            a["landlineNumber"].alias("landline"), a["profileUrl"].alias("profile_url"), a["photo"]["url"].alias("photo"),
            a["agentId"].alias("agent_id"),
        ),
    )
    times = F.transform(
        d["inspectionDetails"]["inspections"],
        lambda i: F.struct(i["openingDateTime"]["isoDate"].alias("start"), i["closingDateTime"]["isoDate"].alias("end")),
    )
    none = F.array().cast("array<string>")

    def place(own: str, other: str) -> Column:
        return F.when(address.isNotNull(), address[own]).otherwise(c[other]).alias(other)

    def filled(own: Column, other: Column) -> Column:
        return F.when(F.size(own) > 0, own).otherwise(other)

    return F.struct(
        F.coalesce(_set(d["listingId"]), listing_id).alias("id"),
        F.coalesce(_set(d["listingType"]), c["listing_type"]).alias("listing_type"),
        d["status"].alias("status"),
        F.coalesce(_set(d["seoUrl"]), c["url"]).alias("url"),
        d["headline"].alias("headline"),
        d["description"].alias("description"),
        F.coalesce(_set(price["displayPrice"]), c["price_display"]).alias("price_display"),
        price["rawValues"]["from"].alias("price_from"),
        price["rawValues"]["to"].alias("price_to"),
        price["rawValues"]["exactPriceV2"].alias("price_exact"),
        place("displayAddress", "address_display"),
        place("street", "street"),
        place("suburbName", "suburb"),
        place("state", "state"),
        place("postcode", "postcode"),
        F.when(address.isNotNull(), address["geolocation"]["latitude"]).otherwise(c["lat"]).alias("lat"),
        F.when(address.isNotNull(), address["geolocation"]["longitude"]).otherwise(c["lng"]).alias("lng"),
        address["unitNumber"].alias("unit"),
        address["streetNumber"].alias("street_number"),
        F.coalesce(d["bedrooms"], c["beds"]).alias("beds"),
        F.coalesce(d["bathrooms"], c["baths"]).alias("baths"),
        F.coalesce(d["carspaces"], c["cars"]).alias("cars"),
        F.coalesce(_set(F.array_join(d["propertyTypes"], " ")), c["property_type"]).alias("property_type"),
        d["propertyTypes"].alias("property_types"),
        d["landAreaSqm"].alias("land_area_sqm"),
        d["buildingArea"].alias("building_area"),
        d["energyEfficiencyRating"].alias("energy_rating"),
        F.coalesce(d["features"], none).alias("features"),
        F.coalesce(d["structuredFeatures"], F.array().cast("array<struct<category:string,name:string>>")).alias("structured_features"),
        filled(people, c["agents"]).alias("agents"),
        d["agency"]["name"].alias("agency_name"),
        d["agency"]["branding"]["logo"]["url"].alias("agency_logo"),
        # a bare card has one open time of its own; a detail block never borrows it
        F.coalesce(F.when(bare, c["inspections"]), times, F.array().cast(f"array<{schema.INTERVAL}>")).alias("inspections"),
        _filled_in(F.when(bare, c["auction"]).otherwise(d["auctionDetails"])).alias("auction"),
        sold["soldPrice"]["rawValues"]["exactPrice"].alias("sold_price"),
        F.to_date(F.substring(sold["soldDate"]["isoDate"], 1, 10)).alias("sold_date"),
        sold["saleMethod"].alias("sale_method"),
        sold["priceSource"].alias("sold_source"),
        d["dateListedV2"]["isoDate"].alias("date_listed"),
        d["dateUpdated"]["isoDate"].alias("date_updated"),
        d["virtualTourUrl"].alias("virtual_tour_url"),
        filled(media(d).cast(f"array<{schema.IMAGE}>"), c["images"]).alias("images"),
        c["tag_text"].alias("tag_text"),
        c["tag_class"].alias("tag_class"),
    )


def detail_pages(pages: DataFrame, wanted: str | None = None, short: int | None = vocab.SHORT_PAGE_CHARS) -> DataFrame:
    """One normalized listing per detail page.

    The canonical detail block comes first. Without one, the embedded card of the wanted
    id (column ``wanted``), else the first card on the page.
    """
    rows = embedded(pages, short)
    cmap = F.col("component.listingsMap")
    own = F.col("component.listingId")
    asked = F.col(wanted) if wanted else F.lit(None).cast("string")
    detail_text = F.when(own.isNotNull(), F.col("component.rootGraphQuery.listingByIdV2"))
    entries = F.filter(F.map_entries(cmap), lambda e: F.get_json_object(e["value"], "$.listingModel").isNotNull())
    by_id = F.filter(
        entries, lambda e: F.coalesce(F.get_json_object(e["value"], "$.id"), F.lit("")) == F.coalesce(asked, F.lit("-"))
    )
    chosen = F.coalesce(F.get(by_id, F.lit(0)), F.get(entries, F.lit(0)))["value"]
    rows = once(
        rows,
        d=F.from_json(detail_text, schema.DETAIL),
        _raw=F.when(detail_text.isNotNull(), F.try_element_at(cmap, own)).otherwise(chosen),
    ).select(
        F.col("url").alias("source_url"), (F.col("denied_as").isNotNull() | F.col("marked")).alias("blocked"),
        "d", F.coalesce(asked, own, F.lit("")).alias("_id"), "_raw",
    )
    rows = with_card(rows, F.col("_id"), F.col("_raw"))
    bare = F.col("d").isNull()
    own_id = F.when(bare, F.col("c.id")).otherwise(F.col("_id"))
    found = F.when(~bare | F.col("c").isNotNull(), detail_listing(own_id, F.col("d"), F.col("c"), bare))
    rows = once(rows.drop("_raw"), l=found).where(F.col("l").isNotNull())
    return rows.select("source_url", "blocked", "l.*")


# ---- page checks ------------------------------------------------------------------


def availability(pages: DataFrame, sample: int = 5) -> DataFrame:
    """Check record per captured search page: ok or blocked, counts of all ids, and the first ``sample`` of them."""
    rows = search_pages(pages)
    status = F.when(F.size("blocked_markers") > 0, "blocked").otherwise("ok")
    return rows.select(
        "url", status.alias("status"), "blocked_markers", "search_result_count", F.col("count").alias("returned"),
        F.slice("listing_ids", 1, sample).alias("sample_listing_ids"),
    )
