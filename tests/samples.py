"""Synthetic listings in the normalized shape."""

from __future__ import annotations

import datetime as dt

SCHEMA = """id string, mode string, listing_type string, status string, url string, headline string, description string,
    price_display string, price_from bigint, price_to bigint, price_exact bigint, sold_price bigint, sold_date date,
    sale_method string, beds double, baths double, cars double, property_type string, address_display string, suburb string,
    state string, region string, postcode string, last_seen date, features array<string>,
    structured_features array<struct<category:string,name:string>>,
    images array<struct<url:string,type:string,position:int>>,
    agents array<struct<name:string,mobile:string,email:string,landline:string>>,
    inspections array<struct<start:string,end:string>>, auction boolean, raw_json string"""

BASE = dict(
    id="x1", mode="sale", listing_type="property", status="active", url=None, headline=None,
    description="Light-filled apartment with balcony, secure parking, gym, lift and transport nearby.",
    price_display="$950,000 - $1,050,000", price_from=950000, price_to=1050000, price_exact=None, sold_price=None,
    sold_date=None, sale_method=None, beds=2.0, baths=2.0, cars=1.0, property_type="Apartment",
    address_display="1 Test Street, Zetland NSW 2017", suburb="Zetland", state="NSW", region=None, postcode="2017",
    last_seen=dt.date(2026, 6, 1), features=["Air Conditioning", "Secure Parking", "Balcony"], structured_features=[],
    images=[("photo.jpg", "photo", 0), ("floorplan.jpg", "floorplan", 1)], agents=[("Agent One", "0400000000", None, None)],
    inspections=[("2026-06-06T10:00:00", "2026-06-06T10:30:00")], auction=False, raw_json="{}",
)


def listing(**changes):
    return {**BASE, **changes}


def sold(id, price, day, **changes):
    return listing(id=id, mode="sold", price_from=price, price_to=price, sold_price=price, sold_date=dt.date.fromisoformat(day), **changes)


def rent(id, weekly, **changes):
    return listing(
        id=id, mode="rent", price_display=f"${weekly} per week", price_from=weekly, price_to=weekly,
        description="Available now. Pet friendly apartment with air conditioning, heating, balcony and secure parking.", **changes,
    )


def frame(spark, *rows):
    names = list(BASE)
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], SCHEMA)


def brief(spark, **changes):
    row = dict(
        brief_id="b", suburbs=["Zetland"], objective="buy", buyer_type="owner_occupier", beds_min=1, beds_max=None, baths_min=1,
        cars_min=1, buy_min=None, buy_max=1100000, rent_min=None, rent_max=None, yield_band=None, property_types=[], region=None,
        exclude_under_offer=False, sort=None, track_sold=False,
    )
    row.update(changes)
    schema = """brief_id string, suburbs array<string>, objective string, buyer_type string, beds_min int, beds_max int, baths_min int,
        cars_min int, buy_min bigint, buy_max bigint, rent_min bigint, rent_max bigint, yield_band array<double>,
        property_types array<string>, region string, exclude_under_offer boolean, sort string, track_sold boolean"""
    return spark.createDataFrame([tuple(row.values())], schema)
