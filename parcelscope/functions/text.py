"""Text, locality and timestamp expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from parcelscope import vocab


def truthy(value: Column) -> Column:
    """Empty text counts as missing."""
    return F.nullif(value, F.lit(""))


def type_text(property_type: Column) -> Column:
    return F.lower(F.coalesce(property_type, F.lit("")))


def type_canon(property_type: Column) -> Column:
    """Alphanumerics only, lower case; NULL when no type is given."""
    return F.when(
        truthy(property_type).isNotNull(),
        F.regexp_replace(F.lower(property_type), "[^a-z0-9]", ""),
    )


def type_match(a: Column, b: Column) -> Column:
    """Containment either way of two canonical types, both non-empty."""
    both = (F.length(a) > 0) & (F.length(b) > 0)
    return F.coalesce(both & (F.contains(a, b) | F.contains(b, a)), F.lit(False))


def locality_slug(name: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-"))


def slug_locality(slug: Column) -> Column:
    """Slug -> struct(suburb, state); a trailing postcode is dropped."""
    tokens = F.filter(F.split(F.lower(F.trim(slug)), "-"), lambda t: t != "")
    last = F.try_element_at(tokens, F.lit(-1))
    no_code = F.when(last.rlike(r"^\d{3,4}$"), F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0)))).otherwise(tokens)
    tail = F.try_element_at(no_code, F.lit(-1))
    is_state = F.coalesce(tail.isin(*vocab.STATE_CODES), F.lit(False))
    words = F.when(is_state, F.slice(no_code, 1, F.greatest(F.size(no_code) - 1, F.lit(0)))).otherwise(no_code)
    suburb = F.array_join(F.transform(words, F.initcap), " ")
    return F.struct(
        F.coalesce(truthy(suburb), slug).alias("suburb"),
        F.when(is_state, F.upper(tail)).alias("state"),
    )


def url_locality(url: Column) -> Column:
    """Locality a search URL asks for: ``suburb=`` first, else the path."""
    asked = truthy(F.split_part(F.parse_url(url, F.lit("QUERY"), F.lit("suburb")), F.lit(","), F.lit(1)))
    path = F.filter(F.split(F.parse_url(url, F.lit("PATH")), "/"), lambda s: s != "")
    in_path = F.when(
        F.try_element_at(path, F.lit(1)).isin(*vocab.SEARCH_PATHS),
        F.try_element_at(path, F.lit(2)),
    )
    slug = F.coalesce(asked, in_path)
    suburb, state = vocab.DEFAULT_LOCALITY
    fallback = F.struct(F.lit(suburb).alias("suburb"), F.lit(state).alias("state"))
    return F.when(slug.isNull(), fallback).otherwise(slug_locality(slug))


def bare_suburb(name: Column) -> Column:
    """'Name NSW 2000' or 'Name, ...' -> 'Name'."""
    cut = name
    for mark in (" NSW", " VIC", ","):
        cut = F.split_part(cut, F.lit(mark), F.lit(1))
    return F.trim(cut)


def blob(*parts: Column, sep: str = " ") -> Column:
    """Lower-case concatenation; missing parts contribute nothing but their separator."""
    return F.lower(F.concat_ws(sep, *[F.coalesce(p, F.lit("")) for p in parts]))


def names(structured: Column) -> Column:
    return F.transform(structured, lambda s: F.coalesce(s["name"], F.lit("")))


def joined(values: Column, sep: str = " ") -> Column:
    return F.array_join(F.coalesce(values, F.array().cast("array<string>")), sep)


def has(text: Column, pattern: str) -> Column:
    """Pattern test on lower-case text, with Unicode word characters."""
    return F.coalesce(text.rlike("(?U)" + pattern), F.lit(False))


def evidence(text: Column, pattern: str) -> Column:
    """The matched words of a lower-case text, or NULL."""
    return truthy(F.regexp_extract(text, "(?U)" + pattern, 0))


def parse_time(text: Column) -> Column:
    """ISO text, or one of the long and short day formats; naive means UTC."""
    t = F.trim(text)
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$"), t.try_cast("timestamp"))
    other = [
        F.try_to_timestamp(t, F.lit(f))
        for f in ("d MMMM yyyy", "d MMM yyyy", "yyyy-MM-dd HH:mm", "d/M/yyyy HH:mm")
    ]
    # "Sat 6 Jun 10:00" names no year; such times are placed in 1900.
    dayless = F.regexp_replace(t, r"^[A-Za-z]{3} ", "")
    yearless = F.try_to_timestamp(F.concat(F.lit("1900 "), dayless), F.lit("yyyy d MMM HH:mm"))
    return F.coalesce(iso, *other, yearless)


def normal_address(display: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(display, F.lit("")), r"\s+", " ")))


def citation(label: Column, key: Column, value: Column, source: Column, date: Column) -> Column:
    head = F.concat_ws(" ", F.coalesce(truthy(label), truthy(key)), truthy(value))
    tail = F.concat_ws(" · ", truthy(source), truthy(date))
    return F.concat_ws(" — ", truthy(head), truthy(tail))
