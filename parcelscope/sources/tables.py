"""Views of the given tables in the listing-market schema.

orders x customer x nation x region become listings, events become observations and
search runs, lineitem becomes the price history and the agent bridge, documents the
listing texts. Every derived column is a fixed function of the row, so that the same view
can be written in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from parcelscope.functions.numbers import whole
from parcelscope.session import settle, spread

# Short listing phrases; a listing takes a few of them by its key.
PHRASES = (
    "North-facing with harbour view",
    "Light-filled living with balcony",
    "Ground floor position",
    "Set on a busy road",
    "Renovated kitchen with stone bench",
    "Walk-up block, no lift",
    "Lift and secure parking",
    "Walk to station and cafe village",
    "Art deco character",
    "Storage cage and internal laundry",
    "Flood zone mapping applies",
    "Studio layout",
    "Strata managed, 85 sqm",
    "Needs work, original condition",
    "Shared driveway with easement",
    "Air conditioning and heating",
    "No pets",
    "Pet friendly, available now",
    "Street parking only",
    "Short lease",
    "Pool, gym and rooftop",
    "Low maintenance courtyard",
    "Double garage and study",
    "Limited natural light",
)
KINDS = {
    "AUTOMOBILE": "Apartment / Unit / Flat",
    "BUILDING": "House",
    "FURNITURE": "Studio",
    "HOUSEHOLD": "Townhouse",
    "MACHINERY": "Apartment",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def phrase(position: Column) -> Column:
    return F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (position % len(PHRASES) + 1).cast("int"))


def nation_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        "n_nationkey", "n_regionkey", "n_name", "r_name"
    )


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listing_columns(_order_rows(spark, sf_dir))


def dealt_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All listings, dealt over tasks by id while their rows are still short."""
    return _listing_columns(spread(_order_rows(spark, sf_dir), "id"))


def _order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that a listing is made of."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation_areas(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.withColumn("id", F.col("o_orderkey").cast("string"))


def _listing_columns(rows: DataFrame) -> DataFrame:
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    mode = F.when(F.col("o_orderstatus") == "F", "sold").when(F.col("o_orderstatus") == "O", "sale").otherwise("rent")
    kind = F.lit(None).cast("string")
    for segment, name in KINDS.items():
        kind = F.when(F.col("c_mktsegment") == segment, name).otherwise(kind)
    rows = rows.withColumn("mode", mode).withColumn("guide", price * (F.lit(0.80) + F.lit(0.05) * (key % 9)))

    def by_mode(sale: Column, sold: Column, rent: Column) -> Column:
        return F.when(F.col("mode") == "sale", sale).when(F.col("mode") == "sold", sold).otherwise(rent)

    unpriced = key % 17 == 0
    rent = whole(price / 100)
    low = by_mode(whole(price * 0.95), whole(F.col("guide") * 0.95), rent)
    high = by_mode(whole(price * 1.05), whole(F.col("guide") * 1.05), rent)
    sold = F.when((F.col("mode") == "sold") & (key % 13 != 0), whole(price))
    dollars = F.concat(F.lit("$"), F.format_number(whole(price), 0))
    display = by_mode(
        F.when(key % 5 == 0, F.concat(F.lit("Auction guide "), dollars)).otherwise(
            F.concat(F.lit("$"), F.format_number(whole(price * 0.95), 0), F.lit(" - $"), F.format_number(whole(price * 1.05), 0))
        ),
        dollars,
        F.concat(F.lit("$"), F.format_number(rent, 0), F.lit(" per week")),
    )
    seen = F.col("o_orderdate")
    return rows.select(
        "id",
        key.alias("listing_key"),
        "mode",
        F.when(key % 19 == 0, "project").otherwise("property").alias("listing_type"),
        F.when(F.col("mode") == "sold", "sold").when(key % 7 == 0, "under offer").otherwise("active").alias("status"),
        F.concat(F.lit("https://listings.example/"), key.cast("string")).alias("url"),
        phrase(key).alias("headline"),
        F.concat_ws(". ", *["text"] * ("text" in rows.columns), phrase(key * 5 + 11), phrase(key * 7 + 2)).alias("description"),
        F.when(key % 11 == 0, F.lit(None)).otherwise(display).alias("price_display"),
        F.when(~unpriced, low).alias("price_from"),
        F.when(~unpriced, high).alias("price_to"),
        F.lit(None).cast("bigint").alias("price_exact"),
        sold.alias("sold_price"),
        F.when((F.col("mode") == "sold") & (key % 29 != 0), F.to_date(seen)).alias("sold_date"),
        F.when(F.col("mode") == "sold", F.when(key % 2 == 0, "auction").otherwise("private treaty")).alias("sale_method"),
        F.substring("o_orderpriority", 1, 1).cast("double").alias("beds"),
        (F.lit(1.0) + key % 2).alias("baths"),
        (key % 3).cast("double").alias("cars"),
        kind.alias("property_type"),
        F.concat(F.col("c_name"), F.lit(", "), F.col("n_name")).alias("address_display"),
        F.col("n_name").alias("suburb"),
        F.col("r_name").alias("state"),
        F.col("r_name").alias("region"),
        (F.lit(2000) + F.col("n_regionkey")).cast("string").alias("postcode"),
        F.to_date(seen).alias("last_seen"),
        # a lambda keeps this long projection out of whole-stage code: as one method it would be too large for the JVM to compile
        F.transform(F.array(key * 7 + 3, key * 5 + 1), phrase).alias("features"),
        F.array(F.struct(F.lit("Feature").alias("category"), phrase(key * 11 + 1).alias("name"))).alias("structured_features"),
        F.when(key % 3 == 0, F.array(_media("photo", 0), _media("floorplan", 1))).otherwise(F.array(_media("photo", 0))).alias("images"),
        F.when(key % 4 == 0, F.array().cast("array<struct<name:string,mobile:string,email:string,landline:string>>"))
        .otherwise(F.array(_agent(key))).alias("agents"),
        F.when(
            key % 5 < 3,
            F.array(F.struct(
                F.concat(F.date_format(seen, "yyyy-MM-dd"), F.lit("T10:00:00")).alias("start"),
                F.concat(F.date_format(seen, "yyyy-MM-dd"), F.lit("T10:30:00")).alias("end"),
            )),
        ).otherwise(F.array().cast("array<struct<start:string,end:string>>")).alias("inspections"),
        F.lit(False).alias("auction"),
        _raw_area(key).alias("raw_json"),
    )


def _media(kind: str, position: int) -> Column:
    return F.struct(
        F.lit(f"{kind}.jpg").alias("url"), F.lit(kind).alias("type"), F.lit(position).alias("position")
    )


def _agent(key: Column) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        F.concat(F.lit("Agent "), (key % 50).cast("string")).alias("name"),
        F.when(key % 4 < 3, F.lit("0400000000")).alias("mobile"),
        none.alias("email"),
        none.alias("landline"),
    )


def _raw_area(key: Column) -> Column:
    """Raw payload text holding the internal area in one of several shapes."""
    area = (key % 160 + 40).cast("string")
    return (
        F.when(key % 5 == 0, F.lit("{}"))
        .when(key % 5 == 1, F.concat(F.lit('{"listing":{"building_area":"'), area, F.lit(' sqm"}}')))
        .when(key % 5 == 2, F.concat(F.lit('{"building_area":{"value":'), area, F.lit("}}")))
        .when(key % 5 == 3, F.concat(F.lit('{"internalArea":'), area, F.lit(".5}")))
        .otherwise(F.concat(F.lit('{"internal_area":"'), area, F.lit('"}')))
    )


def text_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All listings, dealt as ``dealt_listings``; where a document has the listing's number, its whole text leads the description."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    rows = spread(_order_rows(spark, sf_dir), "id").join(docs, "id", "left")
    return _listing_columns(rows)


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """area -> neighbour: areas of one region (a fixed 25-row table)."""
    a = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("area"), "n_regionkey")
    b = a.select(F.col("area").alias("neighbour"), "n_regionkey")
    return a.join(b, "n_regionkey").where("area <> neighbour").select("area", "neighbour")


def briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One brief per area, with alternating objective, lens and budgets."""
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        F.concat(F.lit("brief-"), k.cast("string")).alias("brief_id"),
        F.array("n_name").alias("suburbs"),
        F.when(k % 3 == 0, "buy").when(k % 3 == 1, "both").otherwise("rent").alias("objective"),
        F.when(k % 2 == 0, "owner_occupier").otherwise("investor").alias("buyer_type"),
        F.lit(2).alias("beds_min"),
        F.lit(4).alias("beds_max"),
        (k % 2 + 1).cast("int").alias("baths_min"),
        (k % 3).cast("int").alias("cars_min"),
        F.lit(0).cast("bigint").alias("buy_min"),
        (F.lit(150000) + k * 10000).cast("bigint").alias("buy_max"),
        F.lit(None).cast("bigint").alias("rent_min"),
        (F.lit(1500) + k * 100).cast("bigint").alias("rent_max"),
        F.when(k % 4 == 0, F.array(F.lit(0.03), F.lit(0.05))).alias("yield_band"),
        F.array().cast("array<string>").alias("property_types"),
        F.lit(None).cast("string").alias("region"),
        (k % 2 == 0).alias("exclude_under_offer"),
        F.lit("dateupdated-desc").alias("sort"),
        (k % 5 == 0).alias("track_sold"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as sightings of a listing (the user) with a price and a status."""
    return table(spark, sf_dir, "events").select(*observation_columns())


def observation_columns() -> list[Column]:
    cents = whole(F.col("value") * 100)
    sold = F.col("event_type") == "purchase"
    return [
        F.col("user_id").cast("string").alias("id"),
        F.col("ts").cast("timestamp").alias("observed_at"),
        F.col("event_id").alias("seq"),
        F.concat(F.lit("$"), cents.cast("string")).alias("price_display"),
        cents.alias("price_from"),
        cents.alias("price_to"),
        F.col("event_type").alias("status"),
        F.when(sold, F.concat(F.lit("Sold by private treaty "), F.date_format("ts", "d MMM yyyy"))).alias("tag_text"),
        F.when(sold, F.lit("is-sold")).alias("tag_class"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Unit "), F.col("user_id").cast("string"))).alias("headline"),
        F.lit("sale").alias("mode"),
        F.when(
            F.col("event_id") % 2 == 0,
            F.array(F.struct(
                F.date_format("ts", "yyyy-MM-dd'T'HH:00:00").alias("start"),
                F.date_format("ts", "yyyy-MM-dd'T'HH:30:00").alias("end"),
            )),
        ).otherwise(F.array().cast("array<struct<start:string,end:string>>")).alias("inspections"),
    ]


def seen_by_columns() -> list[Column]:
    """The search (event type) and daily run that saw an event."""
    run_at = F.date_trunc("day", F.col("ts").cast("timestamp")) + F.expr("INTERVAL 1 DAY")
    return [F.col("event_type").alias("hunt"), run_at.alias("run_at")]


def price_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as the price history of the listings; ``seq`` is a stable row order."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("id"),
        F.col("l_shipdate").cast("timestamp").alias("observed_at"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("seq"),
        F.lit(None).cast("string").alias("price_display"),
        whole(F.col("l_extendedprice")).alias("price_from"),
        whole(F.col("l_extendedprice")).alias("price_to"),
        F.col("l_linestatus").alias("status"),
    )


def agent_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """listing <-> agent pairs (agents are the suppliers)."""
    return (
        table(spark, sf_dir, "lineitem")
        .select(F.col("l_orderkey").cast("string").alias("id"), F.col("l_suppkey").alias("agent_id"))
        .distinct()
    )


def agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    areas = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return table(spark, sf_dir, "supplier").join(areas, "s_nationkey").select(
        F.col("s_suppkey").alias("agent_id"), F.col("s_name").alias("name"), F.col("n_name").alias("agency")
    )


def run_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per search (event type), daily run and listing seen in it."""
    ev = table(spark, sf_dir, "events")
    return ev.groupBy(
        F.col("event_type").alias("hunt"),
        (F.date_trunc("day", F.col("ts").cast("timestamp")) + F.expr("INTERVAL 1 DAY")).alias("run_at"),
        F.col("user_id").cast("string").alias("id"),
    ).agg((F.max("value") > 100).alias("off_market"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run records; a run whose count ends in 0 plays the blocked one."""
    return (
        run_listings(spark, sf_dir)
        .groupBy("hunt", "run_at")
        .agg(F.count("*").alias("total_results"))
        .withColumn("blocked", F.col("total_results") % 10 == 0)
    )


def shipment_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as quarterly runs of searches (the supplier's key, modulo 5) that saw the order; the latest run sees new ones."""
    quarter = F.date_trunc("quarter", F.col("l_shipdate").cast("timestamp")) + F.expr("INTERVAL 3 MONTHS")
    return table(spark, sf_dir, "lineitem").groupBy(
        F.concat(F.lit("search-"), (F.col("l_suppkey") % 5).cast("string")).alias("hunt"), quarter.alias("run_at"), F.col("l_orderkey").cast("string").alias("id")
    ).agg((F.max("l_quantity") > 48).alias("off_market"))


def runs_of(members: DataFrame) -> DataFrame:
    """Run records of memberships; none of them blocked."""
    return members.groupBy("hunt", "run_at").agg(F.count("*").alias("total_results")).withColumn("blocked", F.lit(False))


def reachable_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored agents of each listing, some with a mobile or a landline."""
    key = F.col("agent_id")
    rows = agent_links(spark, sf_dir).join(agents(spark, sf_dir), "agent_id")
    return rows.select(
        "id", "name", F.when(key % 3 == 0, F.concat(F.lit("04"), key.cast("string"))).alias("mobile"),
        F.when(key % 3 == 1, F.concat(F.lit("02"), key.cast("string"))).alias("landline"), F.lit(None).cast("string").alias("email"),
    )


def avm_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured estimates keyed by listing id (from lineitem) or by address (from customer)."""
    by_id = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").cast("string").alias("key"))
        .agg(F.count("*").alias("n"), F.max("l_extendedprice").alias("top"))
        .where("n % 2 = 0")
        .select(
            "key",
            F.lit("captured").alias("provider"),
            F.when(F.col("n") % 4 == 0, "avm").alias("method"),
            whole(F.col("top") * 3).cast("double").alias("point"),
            whole(F.col("top") * 2.8).cast("double").alias("low"),
            whole(F.col("top") * 3.2).cast("double").alias("high"),
            F.when(F.col("n") >= 6, "high").alias("confidence"),
        )
    )
    areas = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    by_address = (
        table(spark, sf_dir, "customer")
        .join(areas, "c_nationkey")
        .where("c_acctbal > 0")
        .select(
            F.lower(F.concat("c_name", F.lit(", "), "n_name")).alias("key"),
            F.lit(None).cast("string").alias("provider"),
            F.lit(None).cast("string").alias("method"),
            whole(F.col("c_acctbal") * 40).cast("double").alias("point"),
            F.lit(None).cast("double").alias("low"),
            F.lit(None).cast("double").alias("high"),
            F.lit(None).cast("string").alias("confidence"),
        )
    )
    return by_id.unionByName(by_address)


def estimate_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every lineitem as a captured estimate of its listing; several a key."""
    price = F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("key"),
        F.col("l_shipdate").alias("captured_at"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", price).alias("seq"),
        F.col("l_returnflag").alias("provider"),
        F.lit("avm").alias("method"),
        whole(price).cast("double").alias("point"),
        whole(price * 0.5).cast("double").alias("low"),
        whole(price * 2).cast("double").alias("high"),
        F.when(F.col("l_linestatus") == "F", "high").alias("confidence"),
    )


def open_briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Briefs that name no suburb: each names a region, and every fifth no locality at all."""
    k = F.regexp_extract("brief_id", r"(\d+)$", 1).cast("int")
    names = table(spark, sf_dir, "region").select(F.col("r_regionkey"), F.upper("r_name").alias("r_name"))
    rows = briefs(spark, sf_dir).withColumn("suburbs", F.array().cast("array<string>")).withColumn("_r", k % 5).drop("region")
    return rows.join(names, F.col("_r") == F.col("r_regionkey")).withColumn("region", F.when(F.col("_r") != 0, F.col("r_name"))).drop("_r", "r_regionkey", "r_name")


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as inspection appointments of a person (the event type)."""
    areas = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("_k"), "n_name")
    ev = table(spark, sf_dir, "events")
    return ev.join(areas, F.col("user_id") % 25 == F.col("_k")).select(
        F.col("event_type").alias("brief_id"),
        F.col("event_id").cast("string").alias("id"),
        F.col("n_name").alias("suburb"),
        F.concat(F.col("user_id").cast("string"), F.lit(" Example St")).alias("address"),
        F.col("ts").cast("timestamp").alias("start"),
        F.when(
            F.col("event_id") % 10 != 0, F.timestamp_seconds(F.unix_timestamp(F.col("ts").cast("timestamp")) + F.floor("value").cast("bigint") * 60)
        ).alias("end"),
        F.col("value").alias("fit_score"),
        F.when(F.col("event_id") % 8 == 0, "pass").otherwise("inspect").alias("action"),
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated source facts: one per customer, sighted at every order."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("key"),
        F.concat(F.lit("Segment "), F.col("o_orderstatus")).alias("label"),
        F.when(F.col("o_orderkey") % 10 != 0, whole(F.col("o_totalprice")).cast("string")).alias("value"),
        F.lit("orders").alias("source_name"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("observed_at"),
        F.when(F.col("o_orderkey") % 3 == 0, F.date_format(F.date_sub("o_orderdate", 10), "d MMM yyyy")).alias("published_at"),
        F.when(F.col("o_orderkey") % 4 == 0, F.lit(365)).alias("freshness_days"),
        F.col("o_orderkey").alias("seq"),
    )


# ---- listings as captured pages ---------------------------------------------------

PAGE_SIZE = 20


def _script(kind: str, body: Column) -> Column:
    return F.concat(F.lit(f"<script {kind}>"), body, F.lit("</script>"))


def _card_json() -> Column:
    tag = F.when(F.col("mode") == "sold", F.struct(
        F.concat(F.lit("Sold at auction "), F.date_format("last_seen", "d MMM yyyy")).alias("tagText"),
        F.lit("is-sold").alias("tagClassName"),
    ))
    model = F.struct(
        F.concat(F.lit("/"), F.col("id")).alias("url"),
        F.when(F.col("listing_key") % 2 == 0, F.col("price_display")).alias("price"),
        F.col("price_display").alias("displayPrice"),
        F.struct(F.col("address_display").alias("displayAddress"), "suburb", "state", "postcode").alias("address"),
        F.struct(
            "beds", "baths", F.col("cars").alias("parking"), F.lit(1.0).alias("cars"),
            F.col("property_type").alias("propertyTypeFormatted"),
        ).alias("features"),
        F.struct(F.transform("agents", lambda a: F.struct(a["name"].alias("agentName"))).alias("agents")).alias("branding"),
        F.transform("images", lambda i: i["url"]).alias("images"),
        tag.alias("tags"),
    )
    return F.to_json(F.struct(F.col("id"), F.lit("listing").alias("listingType"), model.alias("listingModel")))


def page_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings with portal ids (five digits up), as they appear on captured pages."""
    rows = listings(spark, sf_dir)
    return rows.withColumn("id", (F.col("listing_key") + 10000).cast("string"))


def captured_search_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search result pages of ``PAGE_SIZE`` listings with their embedded data."""
    paged = page_listings(spark, sf_dir).withColumn("page_no", F.floor(F.col("listing_key") / PAGE_SIZE))
    rows = spread(paged, "page_no").select("page_no", F.struct("listing_key", "id", _card_json().alias("card")).alias("c"))
    pages = rows.groupBy("page_no").agg(F.sort_array(F.collect_list("c")).alias("cards"))  # PAGE_SIZE at most
    ids = F.transform("cards", lambda c: c["id"])
    # the map's values are JSON texts already, so the object is put together as text
    cards = F.concat(
        F.lit("{"),
        F.array_join(F.transform("cards", lambda c: F.concat(F.lit('"'), c["id"], F.lit('":'), c["card"])), ","),
        F.lit("}"),
    )
    nexts = F.concat(
        F.lit('{"props":{"pageProps":{"componentProps":{"listingSearchResultIds":['), F.array_join(ids, ","),
        F.lit('],"totalListings":'), (F.col("page_no") * 3 + 40).cast("string"), F.lit(',"listingsMap":'), cards, F.lit("}}}}"),
    )
    digital = F.concat(
        F.lit('var digitalData = {"page":{"pageInfo":{"search":{"resultsRecords":"'), F.array_join(F.reverse(ids), ", "),
        F.lit('"}}}};'),
    )
    event = F.concat(
        F.lit('{"@type":"Event","name":"Open home","startDate":"2026-06-06","location":{"address":"'),
        F.element_at("cards", 1)["id"], F.lit(' Example St"}}'),
    )
    html = F.concat(
        F.lit("<html><head>"), F.when(F.col("page_no") % 3 == 0, _script("", digital)).otherwise(""),
        _script('type="application/ld+json"', event), F.lit("</head><body>"),
        _script('id="__NEXT_DATA__" type="application/json"', nexts), F.lit("</body></html>"),
    )
    url = F.concat(F.lit("https://listings.example/sale/page-"), F.col("page_no").cast("string"))
    return settle(pages.select(url.alias("url"), html.alias("html")), "search-pages")


def captured_detail_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One detail page per listing, carrying the detail block and the search card."""
    day = lambda c: F.struct(F.col(c).cast("string").alias("isoDate"))
    detail = F.struct(
        F.col("id").alias("listingId"), F.col("status").alias("status"), F.col("headline"), F.col("description"),
        F.struct(
            F.col("price_display").alias("displayPrice"),
            F.struct(F.col("price_from").alias("from"), F.col("price_to").alias("to")).alias("rawValues"),
        ).alias("priceDetails"),
        F.when(F.col("listing_key") % 4 != 0, F.col("beds")).alias("bedrooms"),
        F.array("property_type").alias("propertyTypes"), F.col("features"),
        F.col("structured_features").alias("structuredFeatures"),
        F.transform("agents", lambda a: F.struct(a["name"].alias("fullName"), a["mobile"].alias("mobileNumber"))).alias("agents"),
        F.struct(F.transform("inspections", lambda i: F.struct(
            F.struct(i["start"].alias("isoDate")).alias("openingDateTime"),
            F.struct(i["end"].alias("isoDate")).alias("closingDateTime"),
        )).alias("inspections")).alias("inspectionDetails"),
        F.when(F.col("sold_price").isNotNull(), F.struct(
            F.struct(F.struct(F.col("sold_price").alias("exactPrice")).alias("rawValues")).alias("soldPrice"),
            day("sold_date").alias("soldDate"), F.col("sale_method").alias("saleMethod"),
        )).alias("soldDetails"),
        F.transform("images", lambda i: F.struct(i["url"].alias("url"), i["type"].alias("type"))).alias("largeMedia"),
    )
    nexts = F.concat(
        F.lit('{"props":{"pageProps":{"componentProps":{"listingId":"'), F.col("id"), F.lit('","listingsMap":{"'), F.col("id"),
        F.lit('":'), _card_json(), F.lit('},"rootGraphQuery":{"listingByIdV2":'), F.to_json(detail), F.lit("}}}}}"),
    )
    html = F.concat(F.lit("<html><body>"), _script('id="__NEXT_DATA__" type="application/json"', nexts), F.lit("</body></html>"))
    url = F.concat(F.lit("https://listings.example/"), F.col("id"))
    return settle(spread(page_listings(spark, sf_dir), "listing_key").select(url.alias("url"), html.alias("html")), "detail-pages")
