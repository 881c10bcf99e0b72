"""Pages of searches with different orders, against sorting each search in plain Python."""

import random
from datetime import date, timedelta

from parcelscope.operators import market as M

SORTS = ("price-asc", "price-desc", "dateupdated-desc", "solddate-desc", "id", "unheard-of", None)
SCHEMA = "q_name string, q_sort string, q_page int, q_size int, id string, price_from double, last_seen date, sold_date date"


def in_order(rows, sort):
    rows = sorted(rows, key=lambda r: r[4])
    field = {"price-asc": 5, "price-desc": 5, "dateupdated-desc": 6, "solddate-desc": 7}.get(sort)
    if field is None:
        return rows
    known = sorted((r for r in rows if r[field] is not None), key=lambda r: r[field], reverse=False)
    if sort != "price-asc":
        known = [r for v in sorted({r[field] for r in known}, reverse=True) for r in known if r[field] == v]
    return known + [r for r in rows if r[field] is None]


def test_each_search_has_its_own_order_and_page(spark):
    pick, day = random.Random(3), date(2024, 1, 1)
    rows = []
    for n, sort in enumerate(SORTS * 3):
        page, size = (None, None) if n % 5 == 0 else (n % 4, 1 + n % 7)
        for i in range(400 if n == 2 else n * 3):  # one search holds most matches
            some = [pick.choice((None, 5.0, 7.5, float(i))), pick.choice((None, day + timedelta(i % 9))), pick.choice((None, day + timedelta(i % 4)))]
            rows.append((f"s{n}", sort, page, size, f"h{pick.random():.9f}", *some))
    want = []
    for name in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == name]
        page, size = mine[0][2] or 2, mine[0][3] or 6
        ranked = list(enumerate(in_order(mine, mine[0][1]), 1))[(page - 1) * size : page * size]
        want += [(name, p, r[4]) for p, r in ranked]
    df = spark.createDataFrame(rows, SCHEMA)
    got = M.search_own_pages(df, page=2, size=6, parts=4).select("q_name", "position", "id").collect()
    assert sorted(tuple(r) for r in got) == sorted(want) and len(want) > 40


def test_without_own_columns_and_empty(spark):
    df = spark.createDataFrame([("s", str(i), float(-i), None, None) for i in range(5)], "q_name string, id string, price_from double, last_seen date, sold_date date")
    assert [r.id for r in M.search_own_pages(df, size=2).orderBy("position").collect()] == ["0", "1"]
    assert M.search_own_pages(df.limit(0)).count() == 0
