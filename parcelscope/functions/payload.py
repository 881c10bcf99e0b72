"""Values read out of raw listing payload text (JSON)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parcelscope import vocab
from parcelscope.functions.numbers import let

NUMBER = r"[\d,]+(?:\.\d+)?"


FIELDS = "map<string,string>"


def number_in(text: Column) -> Column:
    """A number, or the first number run inside a text."""

    def read(t: Column) -> Column:
        run = F.regexp_replace(F.regexp_extract(t, NUMBER, 0), ",", "").try_cast("double")
        return F.coalesce(t.try_cast("double"), run)

    return let(text, read)


def internal_area(raw: Column) -> Column:
    """First positive internal area in a payload; a ``listing`` wrapper is optional.

    Each key holds a number, a text with a number, or an object with the number under one
    of its value keys.
    """

    def inner(value: Column) -> Column:
        keyed = F.from_json(F.when(value.startswith("{"), value), FIELDS)
        own = let(keyed, lambda m: F.coalesce(*[F.try_element_at(m, F.lit(k)) for k in vocab.AREA_VALUE_KEYS]))
        return number_in(F.when(value.startswith("{"), own).otherwise(value))

    def first(fields: Column) -> Column:
        wanted = F.array(*[F.try_element_at(fields, F.lit(k)) for k in vocab.AREA_KEYS])
        return F.get(F.filter(F.transform(F.array_compact(wanted), inner), lambda v: v > 0), F.lit(0))

    def unwrapped(doc: Column) -> Column:
        return F.coalesce(F.from_json(F.try_element_at(doc, F.lit("listing")), FIELDS), doc)

    return let(let(F.from_json(raw, FIELDS), unwrapped), first)


def area_source(df: DataFrame) -> tuple[str, Column]:
    """Column to carry along, and the internal area read from it.

    Listings normalized at ingest hold ``internal_area``; others only the raw text.
    """
    if "internal_area" in df.columns:
        return "internal_area", F.col("internal_area").cast("double")
    return "raw_json", internal_area(F.col("raw_json"))
