"""Off-market reading of a card's tag, and media / source array expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parcelscope import vocab


def off_market(tag_text: Column, tag_class: Column) -> Column:
    """struct(status, sale_method, sold_date, tag_text) of an off-market tag, else NULL."""
    text = F.trim(F.coalesce(tag_text, F.lit("")))
    low, cls = F.lower(text), F.lower(F.coalesce(tag_class, F.lit("")))
    sold = cls.contains(vocab.SOLD_CLASS) | low.startswith("sold")
    leased = cls.contains(vocab.LEASED_CLASS) | low.startswith("leased")
    offer = F.lit(False)
    for c in vocab.OFFER_CLASSES:
        offer = offer | cls.contains(c)
    for p in vocab.OFFER_PREFIXES:
        offer = offer | low.startswith(p)
    method = None
    for words, name in vocab.SALE_METHODS:
        method = F.when(low.contains(words), name) if method is None else method.when(low.contains(words), name)
    day = r"(\d{1,2})\s+([A-Za-z]{3})[A-Za-z]*\s+(\d{4})"
    date = F.try_to_timestamp(
        F.concat_ws(
            " ",
            F.regexp_extract(text, day, 1),
            F.initcap(F.regexp_extract(text, day, 2)),
            F.regexp_extract(text, day, 3),
        ),
        F.lit("d MMM yyyy"),
    )
    status = F.when(sold, "sold").when(leased, "leased").otherwise("off_market")
    return F.when(
        sold | leased | offer,
        F.struct(
            status.alias("status"),
            method.alias("sale_method"),
            F.to_date(date).alias("sold_date"),
            text.alias("tag_text"),
        ),
    )


def first_of(values: Column, count: int | None, start: int = 1) -> Column:
    """At most ``count`` entries from ``start`` on; None for all that are left."""
    return F.slice(values, start, (1 << 31) - 1 if count is None else count)


def has_media(df: DataFrame, *kinds: str, column: str = "images") -> Column:
    """Whether an image of these kinds is there. An image's kind is its type, or its category where the type is missing or empty."""
    fields = df.schema[column].dataType.elementType.names

    def kind(image: Column) -> Column:
        named = [F.nullif(image[c], F.lit("")) for c in ("type", "category") if c in fields]
        return F.lower(F.coalesce(*named, F.lit("")))

    return F.coalesce(F.exists(column, lambda i: kind(i).isin(*kinds)), F.lit(False))


def grouped_media(images: Column) -> Column:
    """struct(photos, floorplans, other): urls by type, in position order."""
    ordered = F.sort_array(
        F.transform(
            F.filter(images, lambda i: i["url"].isNotNull()),
            lambda i: F.struct(
                i["position"].alias("position"),
                F.lower(F.coalesce(i["type"], F.lit("photo"))).alias("type"),
                i["url"].alias("url"),
            ),
        )
    )

    def urls(test) -> Column:
        return F.transform(F.filter(ordered, test), lambda i: i["url"])

    return F.struct(
        urls(lambda i: i["type"] == "photo").alias("photos"),
        urls(lambda i: i["type"] == "floorplan").alias("floorplans"),
        urls(lambda i: ~i["type"].isin("photo", "floorplan")).alias("other"),
    )


def with_source(sources: Column, provider: Column, url: Column) -> Column:
    """Append struct(provider, url) unless it is there already."""
    empty = F.array().cast("array<struct<provider:string,url:string>>")
    return F.array_union(
        F.coalesce(sources, empty), F.array(F.struct(provider.alias("provider"), url.alias("url")))
    )


def contact(agents: Column) -> Column:
    """True when any agent entry carries a phone number or an address."""

    def reachable(a: Column) -> Column:
        return F.coalesce(a["mobile"], a["email"], a["landline"], F.lit("")) != ""

    return F.coalesce(F.exists(agents, reachable), F.lit(False))
