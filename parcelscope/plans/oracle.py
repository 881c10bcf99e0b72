"""SQL counterparts of the catalogue queries, for DuckDB over the same tables.

Written from the query definitions, independently of the DataFrame code: plain joins,
windows and aggregates over whole tables. Numeric literals carry ``e0`` so that the
arithmetic is double precision on both sides.
"""

from __future__ import annotations

from parcelscope import vocab
from parcelscope.plans.catalog import PAGE_PATTERNS
from parcelscope.sources.tables import KINDS, PHRASES

ORACLE: dict[str, str] = {}


# ---- text pieces ------------------------------------------------------------------


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def case(pairs, other: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {other} END"


def whole(x: str) -> str:
    return f"CAST(round_even({x}, 0) AS BIGINT)"


def rounded(x: str, digits: int) -> str:
    """Half-even of the exact binary value; ``x`` should be a column name."""
    s = f"{10**digits}e0"
    y = f"({x}*{s})"
    hi = f"({x}*134217729e0-({x}*134217729e0-{x}))"
    err = f"(({hi}*{s}-{y})+({x}-{hi})*{s})"
    tie = f"{y}-floor({y})=0.5e0"
    return f"(CASE WHEN {tie} AND {err}>0 THEN floor({y})+1 WHEN {tie} AND {err}<0 THEN floor({y}) ELSE round_even({y},0) END/{s})"


def phrase(pos: str) -> str:
    return "list_extract([" + ", ".join(q(p) for p in PHRASES) + f"], CAST(({pos}) % {len(PHRASES)} + 1 AS BIGINT))"


def words(pattern: str) -> str:
    """The pattern for RE2, with word boundaries that know accented letters."""
    out, i = "", 0
    while i < len(pattern):
        if pattern[i : i + 2] == r"\b":
            nxt = pattern[i + 2 : i + 3]
            out += r"(?:^|[^\p{L}\p{N}_])" if nxt and (nxt.isalnum() or nxt in "(\\") else r"(?:[^\p{L}\p{N}_]|$)"
            i += 2
        elif pattern[i : i + 2] == r"\w":
            out += r"[\p{L}\p{N}_]"
            i += 2
        else:
            out += pattern[i]
            i += 1
    return out


def has(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {q(words(pattern))})"


def found(text: str, pattern: str) -> str:
    """The matched words (the boundaries are outside the group)."""
    start = r"(?:^|[^\p{L}\p{N}_])"
    end = r"(?:[^\p{L}\p{N}_]|$)"
    p = words(pattern)
    head, p = (start, p[len(start):]) if p.startswith(start) else ("", p)
    tail, p = (end, p[: -len(end)]) if p.endswith(end) else ("", p)
    return f"nullif(regexp_extract({text}, {q(head + '(' + p + ')' + tail)}, 1), '')"


def amounts(text: str) -> str:
    """Dollar amounts of a text, from 1000 up, as a list."""
    pat = q(r"\$\s*([\d,]+(?:\.\d+)?)\s*([mMkK])?")
    n = f"regexp_extract_all({text}, {pat}, 1)"
    u = f"regexp_extract_all({text}, {pat}, 2)"
    one = (
        f"list_transform(list_zip({n}, {u}), lambda x: TRY_CAST(replace(x[1], ',', '') AS DOUBLE) * "
        "CASE lower(x[2]) WHEN 'm' THEN 1e6 WHEN 'k' THEN 1e3 ELSE 1e0 END)"
    )
    return f"list_filter({one}, lambda v: v >= 1000)"


def shown(text: str) -> str:
    return f"list_sum({amounts(text)}) / nullif(len({amounts(text)}), 0)"


def best_ask(lo: str = "price_from", hi: str = "price_to") -> str:
    a, b = f"nullif({lo}, 0)", f"nullif({hi}, 0)"
    return f"coalesce((CAST({a} AS DOUBLE) + CAST({b} AS DOUBLE)) / 2e0, CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))"


# ---- shared views -----------------------------------------------------------------

_KIND = case([(f"c_mktsegment = {q(k)}", q(v)) for k, v in KINDS.items()])
_RAW = f"""CASE WHEN k % 5 = 0 THEN NULL WHEN k % 5 = 3 THEN k % 160 + 40 + 0.5e0 ELSE CAST(k % 160 + 40 AS DOUBLE) END"""

LISTINGS = f"""
base0 AS (
  SELECT o_orderkey AS k, o_totalprice AS p, o_orderdate AS d, CASE o_orderstatus WHEN 'F' THEN 'sold' WHEN 'O' THEN 'sale' ELSE 'rent' END AS mode,
    n_name AS suburb, r_name AS state, CAST(2000 + n_regionkey AS VARCHAR) AS postcode, {_KIND} AS property_type,
    c_name || ', ' || n_name AS address_display, CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS beds
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
base1 AS (SELECT *, p * (0.80e0 + 0.05e0 * (k % 9)) AS guide, {whole('p / 100')} AS rent, {whole('p')} AS pw FROM base0),
base2 AS (SELECT *,
    CASE mode WHEN 'sale' THEN {whole('p * 0.95e0')} WHEN 'sold' THEN {whole('guide * 0.95e0')} ELSE rent END AS lo,
    CASE mode WHEN 'sale' THEN {whole('p * 1.05e0')} WHEN 'sold' THEN {whole('guide * 1.05e0')} ELSE rent END AS hi,
    CASE mode WHEN 'sale' THEN CASE WHEN k % 5 = 0 THEN 'Auction guide ' || format('${{:,}}', pw)
        ELSE format('${{:,}}', {whole('p * 0.95e0')}) || ' - ' || format('${{:,}}', {whole('p * 1.05e0')}) END
      WHEN 'sold' THEN format('${{:,}}', pw) ELSE format('${{:,}}', rent) || ' per week' END AS disp FROM base1),
listings AS (
  SELECT k, CAST(k AS VARCHAR) AS id, mode, CASE WHEN k % 19 = 0 THEN 'project' ELSE 'property' END AS listing_type,
    CASE WHEN mode = 'sold' THEN 'sold' WHEN k % 7 = 0 THEN 'under offer' ELSE 'active' END AS status,
    'https://listings.example/' || CAST(k AS VARCHAR) AS url, {phrase('k')} AS headline,
    {phrase('k * 5 + 11')} || '. ' || {phrase('k * 7 + 2')} AS description,
    CASE WHEN k % 11 = 0 THEN NULL ELSE disp END AS price_display,
    CASE WHEN k % 17 <> 0 THEN lo END AS price_from, CASE WHEN k % 17 <> 0 THEN hi END AS price_to,
    CASE WHEN mode = 'sold' AND k % 13 <> 0 THEN pw END AS sold_price,
    CASE WHEN mode = 'sold' AND k % 29 <> 0 THEN CAST(d AS DATE) END AS sold_date,
    CASE WHEN mode = 'sold' THEN CASE WHEN k % 2 = 0 THEN 'auction' ELSE 'private treaty' END END AS sale_method,
    beds, CAST(1 + k % 2 AS DOUBLE) AS baths, CAST(k % 3 AS DOUBLE) AS cars, property_type, address_display, suburb, state, postcode,
    CAST(d AS DATE) AS last_seen, {phrase('k * 7 + 3')} AS f1, {phrase('k * 5 + 1')} AS f2, {phrase('k * 11 + 1')} AS sf,
    k % 3 = 0 AS floorplan, k % 4 <> 0 AS has_agent, k % 4 IN (1, 2) AS has_contact, k % 5 < 3 AS has_visit, {_RAW} AS sqm
  FROM base2)"""

NEIGHBOURS = """
neighbours AS (SELECT lower(a.n_name) AS area, lower(b.n_name) AS neighbour FROM nation a JOIN nation b
  ON a.n_regionkey = b.n_regionkey AND a.n_name <> b.n_name)"""

BRIEFS = """
briefs AS (SELECT n_nationkey AS bk, 'brief-' || CAST(n_nationkey AS VARCHAR) AS brief_id, n_name AS brief_area,
    CASE n_nationkey % 3 WHEN 0 THEN 'buy' WHEN 1 THEN 'both' ELSE 'rent' END AS objective,
    CASE WHEN n_nationkey % 2 = 0 THEN 'owner_occupier' ELSE 'investor' END AS buyer_type, 2 AS beds_min, 4 AS beds_max,
    n_nationkey % 2 + 1 AS baths_min, n_nationkey % 3 AS cars_min, 150000 + n_nationkey * 10000 AS buy_max,
    1500 + n_nationkey * 100 AS rent_max, n_nationkey % 2 = 0 AS exclude_offer, n_nationkey % 5 = 0 AS track_sold FROM nation)"""

OBSERVATIONS = f"""
obs0 AS (SELECT CAST(user_id AS VARCHAR) AS id, ts, event_id AS seq, event_type, event_id,
    {whole('value * 100')} AS cents, event_type = 'purchase' AS off FROM events),
obs AS (SELECT id, ts, seq, '$' || CAST(cents AS VARCHAR) AS disp, cents AS lo, cents AS hi,
    CASE WHEN off THEN 'sold' ELSE event_type END AS status, CASE WHEN off THEN 'sold' ELSE 'sale' END AS mode, off,
    CASE WHEN off THEN 'Sold by private treaty ' || strftime(ts, '%-d %b %Y') END AS tag, CAST(CAST(ts AS DATE) AS VARCHAR) AS day,
    CASE WHEN event_id % 3 = 0 THEN 'Unit ' || id END AS headline,
    CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%dT%H:00:00') END AS open_at,
    CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%dT%H:30:00') END AS close_at FROM obs0),
seen AS (SELECT *, lag(disp) OVER w AS pdisp, lag(lo) OVER w AS plo, lag(hi) OVER w AS phi, lag(status) OVER w AS pstatus,
    last_value(open_at IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS popen,
    last_value(close_at IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pclose, row_number() OVER w = 1 AS is_first FROM obs WINDOW w AS (PARTITION BY id ORDER BY ts, seq)),
moves AS (SELECT *, is_first OR disp IS DISTINCT FROM pdisp OR lo IS DISTINCT FROM plo OR hi IS DISTINCT FROM phi OR status IS DISTINCT FROM pstatus AS moved FROM seen)"""

PRICE_EVENTS = """
price_ev AS (SELECT id, ts, seq, 1 AS ord, CASE WHEN lo < plo THEN 'price_drop' WHEN lo > plo THEN 'price_rise' ELSE 'price_change' END AS event_type,
    pdisp AS previous_value, disp AS current_value,
    'Price guide ' || CASE WHEN lo < plo THEN 'dropped' WHEN lo > plo THEN 'rose' ELSE 'changed' END || ': ' || pdisp || ' -> ' || disp AS summary
  FROM moves WHERE NOT is_first AND (disp IS DISTINCT FROM pdisp OR lo IS DISTINCT FROM plo))"""

STATUS_EVENTS = """
status_ev AS (SELECT id, ts, seq, 2 AS ord, 'status_change' AS event_type, pstatus AS previous_value, status AS current_value,
    'Status changed: ' || pstatus || ' -> ' || status AS summary FROM moves WHERE NOT is_first AND pstatus <> status)"""

INSPECTION_EVENTS = """
insp_ev AS (SELECT id, ts, seq, 4 AS ord, 'inspection_change' AS event_type, popen || ' - ' || pclose AS previous_value,
    open_at || ' - ' || close_at AS current_value, 'Inspection times changed.' AS summary
  FROM moves WHERE popen IS NOT NULL AND open_at IS NOT NULL AND popen <> open_at)"""

RUNS = """
members AS (SELECT event_type AS hunt, date_trunc('day', ts) + INTERVAL 1 DAY AS run_at, CAST(user_id AS VARCHAR) AS id, max(value) > 100 AS off
  FROM events GROUP BY ALL),
runs AS (SELECT hunt, run_at, count(*) AS total_results, count(*) % 10 = 0 AS blocked FROM members GROUP BY ALL),
cal0 AS (SELECT hunt, run_at, blocked, row_number() OVER (PARTITION BY hunt ORDER BY run_at) AS no FROM runs),
cal AS (SELECT *, (SELECT min(y.no) FROM cal0 y WHERE y.hunt = c.hunt AND y.no > c.no AND NOT y.blocked) AS next_open FROM cal0 c),
pres AS (SELECT m.*, c.no FROM members m JOIN cal c USING (hunt, run_at))"""

# after each sighting the next run that is not blocked, if none up to it saw the listing
GONE = """
gone AS (SELECT g.hunt, g.run_at, p.id, g.no FROM pres p JOIN cal c ON c.hunt = p.hunt AND c.no = p.no JOIN cal g ON g.hunt = c.hunt AND g.no = c.next_open
  WHERE NOT EXISTS (SELECT 1 FROM pres x WHERE x.hunt = p.hunt AND x.id = p.id AND x.no > p.no AND x.no <= g.no))"""

STALE_TEXT, RELIST_TEXT = q(vocab.STALE_TEXT), q(vocab.RELIST_TEXT)

LIFECYCLE = f"""
tokens AS (
  SELECT id, ts, 0 AS kind, seq, off, moved, status FROM moves m WHERE NOT off OR moved OR EXISTS (SELECT 1 FROM insp_ev i WHERE i.id = m.id AND i.seq = m.seq)
  UNION ALL SELECT DISTINCT id, run_at, 1, NULL, NULL, NULL, NULL FROM gone),
tok2 AS (SELECT *, lag(kind) OVER (PARTITION BY id ORDER BY ts, kind, seq) AS before FROM tokens),
relist_ev AS (SELECT id, ts, seq, 3 AS ord, 'relisted' AS event_type, 'withdrawn/stale' AS previous_value, status AS current_value, {RELIST_TEXT} AS summary
  FROM tok2 WHERE kind = 0 AND NOT off AND before = 1),
live_ev AS (
  SELECT p.* FROM price_ev p JOIN obs o USING (id, ts, seq) WHERE NOT o.off
  UNION ALL SELECT s.* FROM status_ev s JOIN obs o USING (id, ts, seq) WHERE NOT o.off
  UNION ALL SELECT * FROM insp_ev UNION ALL SELECT * FROM relist_ev),
steps AS (
  SELECT id, ts, 0 AS kind, seq, arg_max(event_type, ord) AS closing FROM (
    SELECT id, ts, seq, ord, event_type FROM live_ev
    UNION ALL SELECT id, ts, seq, 1, 'sold' FROM moves WHERE off AND moved) GROUP BY id, ts, seq
  UNION ALL SELECT DISTINCT id, run_at, 1, NULL, 'withdrawn_or_stale' FROM gone),
steps2 AS (SELECT *, lag(closing) OVER (PARTITION BY id ORDER BY ts, kind, seq) AS prior FROM steps),
sold_ev AS (SELECT m.id, m.ts, m.seq, 1 AS ord, 'sold' AS event_type, coalesce(s.prior, 'active') AS previous_value, 'sold' AS current_value,
    'Listing left the market: ' || m.tag || ' (private treaty) on ' || m.day || '. Not a live opportunity.' AS summary
  FROM moves m JOIN steps2 s ON s.id = m.id AND s.ts = m.ts AND s.kind = 0 AND s.seq = m.seq
  WHERE m.off AND m.moved AND s.prior IS DISTINCT FROM 'sold'),
stale_ev AS (SELECT id, ts, CAST(NULL AS BIGINT) AS seq, 0 AS ord, 'withdrawn_or_stale' AS event_type, 'seen in previous run' AS previous_value,
    'missing from latest run' AS current_value, {STALE_TEXT} AS summary FROM steps2 WHERE kind = 1 AND prior IS DISTINCT FROM 'withdrawn_or_stale'),
ev AS (SELECT * FROM live_ev UNION ALL SELECT * FROM sold_ev UNION ALL SELECT * FROM stale_ev)"""

ALL_EVENTS = ",".join([OBSERVATIONS, PRICE_EVENTS, STATUS_EVENTS, INSPECTION_EVENTS, RUNS, GONE, LIFECYCLE])
TOP = "row_number() OVER (PARTITION BY id ORDER BY ts DESC, seq DESC NULLS FIRST, ord DESC)"
WHY = f"""
top3 AS (SELECT *, {TOP} AS r FROM ev QUALIFY r <= 3),
why AS (SELECT id,
    min_by(summary, r) FILTER (event_type = 'sold') AS s, min_by(summary, r) FILTER (event_type = 'relisted') AS l,
    lower(min_by(summary, r) FILTER (event_type = 'price_drop')) AS d, string_agg(lower(summary), '; ' ORDER BY r) AS every FROM top3 GROUP BY id),
why_now AS (SELECT id, CASE WHEN s IS NOT NULL THEN s
    WHEN l IS NOT NULL THEN 'Relisted after dropping off the market' || coalesce('; ' || d, '') || '.'
    WHEN d IS NOT NULL THEN 'Resurfaced because ' || d || '.' ELSE 'Resurfaced because ' || every || '.' END AS why_now FROM why)"""
EVENT_OUT = "SELECT id, epoch_us(ts) AS at_us, CAST(seq AS BIGINT) AS seq, CAST(ord AS BIGINT) AS ord, event_type, previous_value, current_value, summary FROM "


def add(name: str, sql: str, *views: str) -> None:
    head = f"WITH {','.join(views)}\n" if views else ""
    ORACLE[name] = head + sql


# ---- market -----------------------------------------------------------------------

_SALES = """SELECT suburb, count(*) AS sold_count, {median} AS median_price, {lo} AS min_price, {hi} AS max_price, {per} AS price_per_bed,
  CAST(min(sold_date) AS VARCHAR) AS first_sold, CAST(max(sold_date) AS VARCHAR) AS last_sold
  FROM (SELECT *, coalesce(CAST(nullif(sold_price, 0) AS DOUBLE), {shown}) AS sp FROM listings WHERE mode = 'sold' {extra}) WHERE sp IS NOT NULL GROUP BY suburb"""


def _sales(extra: str) -> str:
    return _SALES.format(
        median=whole("median(sp)"), lo=whole("min(sp)"), hi=whole("max(sp)"), per=whole("median(sp) / median(beds)"),
        shown=shown("price_display"), extra=extra,
    )


add("sales_summary", _sales(""), LISTINGS)
add("sales_window", _sales("AND sold_date >= DATE '2001-08-02' - 365 AND beds >= 2"), LISTINGS)
add("recent_sales", f"""SELECT id, suburb, address_display AS address, {whole('sp')} AS sold_price, CAST(sold_date AS VARCHAR) AS sold_date, sale_method, beds, property_type
  FROM (SELECT *, coalesce(CAST(sold_price AS DOUBLE), {shown('price_display')}) AS sp FROM listings)
  WHERE mode = 'sold' AND sold_date >= DATE '2001-08-02' - 900 AND lower(suburb) IN (SELECT neighbour FROM neighbours WHERE area IN ('nation_1', 'nation_7'))
  ORDER BY sold_date DESC, sp DESC NULLS LAST, id LIMIT 50""", LISTINGS, NEIGHBOURS)
add("area_stats", f"""SELECT suburb, state, postcode, n, min_price, max_price, {rounded('a', 2)} AS avg_price, {rounded('b', 4)} AS avg_beds FROM (
  SELECT suburb, state, postcode, count(*) AS n, avg(coalesce(sold_price, (price_from + price_to) // 2, price_from, price_to)) AS a,
    min(coalesce(sold_price, price_from, price_to)) AS min_price, max(coalesce(sold_price, price_to, price_from)) AS max_price, avg(beds) AS b
  FROM listings WHERE mode = 'sold' GROUP BY ALL HAVING count(*) >= 3)""", LISTINGS)


def _rank(mode: str, floor: str, budget: bool, least: int) -> str:
    score = "CASE WHEN af IS NOT NULL THEN af * (0.4e0 + 0.6e0 * act) ELSE act END" if budget else "act"
    ratio = "(mp / 200000e0)"
    af = f"CASE WHEN {ratio} <= 0.8e0 THEN 1e0 WHEN {ratio} >= 1.3e0 THEN 0e0 ELSE greatest(0e0, least(1e0, 1e0 - ({ratio} - 0.8e0) / 0.5e0)) END"
    cols = f", {rounded('af', 3)} AS affordability" if budget else ""
    return f"""SELECT suburb, state, postcode, n AS count, {whole('mp')} AS median_price, {whole('lo')} AS min_price, {whole('hi')} AS max_price,
  {rounded('mb', 1)} AS avg_beds, {whole('mp / mb')} AS price_per_bed, {rounded('act', 3)} AS activity, {rounded('score', 4)} AS score{cols}
  FROM (SELECT *, {score} AS score FROM (SELECT *, {af} AS af, CAST(n AS DOUBLE) / max(n) OVER () AS act FROM (
    SELECT suburb, state, postcode, count(*) AS n, median(e) AS mp, min(e) AS lo, max(e) AS hi, median(nullif(beds, 0)) AS mb
    FROM (SELECT *, coalesce(CAST(nullif(sold_price, 0) AS DOUBLE), {best_ask()}, {shown('price_display')}) AS e FROM listings WHERE mode = '{mode}')
    WHERE e IS NOT NULL {floor} GROUP BY ALL))) WHERE n >= {least}"""


add("area_rank", _rank("sold", "AND e >= 20000", True, 5), LISTINGS)
add("area_activity", _rank("rent", "", False, 1), LISTINGS)
add("area_candidates", """SELECT suburb, state, postcode, count(*) AS n FROM listings WHERE mode = 'sale'
  AND postcode IN (SELECT postcode FROM listings WHERE suburb IN ('NATION_1', 'NATION_7')) GROUP BY ALL ORDER BY n DESC, suburb, state, postcode LIMIT 25""", LISTINGS)
add("mode_rollup", "SELECT coalesce(mode, 'all') AS mode, count(*) AS n FROM listings GROUP BY ROLLUP (mode)", LISTINGS)

SEARCHES = """
searches AS (
  SELECT brief_id, 'buy-' || replace(lower(brief_area), '_', '-') AS name, 'sale' AS mode, brief_area, 0 AS pmin, buy_max AS pmax, beds_min, beds_max, baths_min, cars_min, exclude_offer AS ex, 'dateupdated-desc' AS sort FROM briefs WHERE objective IN ('buy', 'both')
  UNION ALL SELECT brief_id, 'rent-' || replace(lower(brief_area), '_', '-'), 'rent', brief_area, NULL, rent_max, beds_min, beds_max, baths_min, cars_min, exclude_offer, 'dateupdated-desc' FROM briefs WHERE objective IN ('rent', 'both')
  UNION ALL SELECT brief_id, 'sold-' || replace(lower(brief_area), '_', '-'), 'sold', brief_area, NULL, NULL, beds_min, beds_max, baths_min, cars_min, false, 'solddate-desc' FROM briefs WHERE track_sold),
matches AS (
  SELECT s.name AS q_name, l.* FROM searches s JOIN listings l ON l.suburb = s.brief_area AND l.mode = s.mode
  WHERE beds >= beds_min AND beds <= beds_max AND baths >= baths_min AND cars >= cars_min
    AND (pmin IS NULL OR e >= pmin) AND (pmax IS NULL OR e <= pmax) AND NOT (ex AND status = 'under offer'))"""
_EFF = f"listings AS (SELECT *, coalesce(CAST(nullif(sold_price, 0) AS DOUBLE), {best_ask()}, {shown('price_display')}) AS e FROM listings0)"
LISTINGS_E = LISTINGS.replace("\nlistings AS (", "\nlistings0 AS (") + ",\n" + _EFF
add("brief_searches", """SELECT brief_id, name, list_aggregate(list_sort(list_filter([ 'mode=' || mode, 'suburbs=' || brief_area, 'price_min=' || pmin, 'price_max=' || pmax,
  'beds_min=' || beds_min, 'beds_max=' || beds_max, 'baths_min=' || baths_min, 'cars_min=' || cars_min, 'exclude_under_offer=' || CAST(ex AS VARCHAR), 'sort=' || sort ], lambda x: x IS NOT NULL)), 'string_agg', '|') AS filters
  FROM searches""", BRIEFS, SEARCHES.split("\nmatches AS")[0].rstrip().rstrip(","))
add("search_matches", "SELECT q_name, id, mode, suburb, beds FROM matches", LISTINGS_E, BRIEFS, SEARCHES)
OPEN = SEARCHES.replace("FROM briefs", "FROM ob").replace("replace(lower(brief_area), '_', '-')", "regexp_replace(lower(brief_area), '[^a-z0-9]+', '-', 'g')").replace("s.name AS q_name", "s.brief_id || '/' || s.name AS q_name").replace(
    "l.suburb = s.brief_area", "(s.brief_area = 'multi' OR lower(l.state) = lower(s.brief_area))")
OPEN = "\nob AS (SELECT b.* REPLACE (CASE WHEN bk % 5 <> 0 THEN upper(r_name) ELSE 'multi' END AS brief_area) FROM briefs b JOIN region ON r_regionkey = bk % 5)," + OPEN
add("search_unbounded", "SELECT q_name, count(*) AS n, min(id) AS first_id, count(DISTINCT suburb) AS suburbs FROM matches GROUP BY q_name", LISTINGS_E, BRIEFS, OPEN)
add("cache_latest", f"""SELECT CAST(l_orderkey AS VARCHAR) AS key, l_returnflag AS provider, 'avm' AS method, CAST({whole('l_extendedprice')} AS DOUBLE) AS point,
  CAST({whole('l_extendedprice * 0.5e0')} AS DOUBLE) AS low, CAST({whole('l_extendedprice * 2e0')} AS DOUBLE) AS high, CASE WHEN l_linestatus = 'F' THEN 'high' END AS confidence
  FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_returnflag DESC, confidence DESC NULLS LAST) = 1""")
add("search_results", """SELECT q_name, position, id, price_from FROM (SELECT *, row_number() OVER (PARTITION BY q_name ORDER BY price_from NULLS LAST, id) AS position FROM matches)
  WHERE position BETWEEN 6 AND 10""", LISTINGS_E, BRIEFS, SEARCHES)
_OWN = SEARCHES.replace("s.name AS q_name", """s.brief_id || '/' || s.name AS q_name, CAST(regexp_extract(s.brief_id, '\\d+') AS INT) AS nth,
  CASE WHEN s.mode = 'sold' THEN s.sort ELSE ['price-asc', 'price-desc', 'dateupdated-desc', 'id'][CAST(regexp_extract(s.brief_id, '\\d+') AS INT) % 4 + 1] END AS q_sort""")
add("search_own_pages", """SELECT q_name, q_sort, position, id, price_from FROM (SELECT *, row_number() OVER (PARTITION BY q_name ORDER BY CASE WHEN q_sort = 'price-asc' THEN price_from END NULLS LAST,
  CASE WHEN q_sort = 'price-desc' THEN price_from END DESC NULLS LAST, CASE q_sort WHEN 'dateupdated-desc' THEN last_seen WHEN 'solddate-desc' THEN sold_date END DESC NULLS LAST, id) AS position FROM matches)
  WHERE position > (nth % 2) * (2 + nth % 3) AND position <= (1 + nth % 2) * (2 + nth % 3)""", LISTINGS_E, BRIEFS, _OWN)

# ---- expressions ------------------------------------------------------------------

_TEXT = f"""CASE k % 6 WHEN 0 THEN format('${{:,}}', {whole('p')}) || ' - ' || format('${{:,}}', {whole('p * 1.1e0')})
  WHEN 1 THEN 'From $' || {whole('p / 1000')} || 'k' WHEN 2 THEN '$' || {whole('p / 1e5')} || '.5m to $9m' WHEN 3 THEN 'Contact agent'
  WHEN 4 THEN format('${{:,}}', {whole('p / 500')}) || ' per week' ELSE 'Guide ' || format('{{:,}}', {whole('p')}) END"""
_FIRST = r"TRY_CAST(replace(regexp_extract(t, '\d[\d,]*'), ',', '') AS BIGINT)"
add("price_text_parse", f"""SELECT k AS id, {shown('t')} AS shown, CASE WHEN {_FIRST} >= 10000 THEN {_FIRST} END AS amount
  FROM (SELECT *, {_TEXT} AS t FROM (SELECT o_orderkey AS k, o_totalprice AS p FROM orders))""")
add("ask_prices", f"""SELECT id, {best_ask()} AS ask, e AS effective, round_even({best_ask()} / beds, 0) AS per_bed,
  coalesce(CAST(sold_price AS DOUBLE), {shown('price_display')}) AS sold, CASE WHEN beds <= 3 THEN CAST(beds AS BIGINT) END AS beds_int FROM listings""", LISTINGS_E)


def _duty(p: str) -> str:
    pairs = []
    for low, high, base, rate in vocab.TAX_BANDS:
        test = f"{p} > 0" if high is None else f"{p} <= {high}"
        pairs.append((test, f"{base}e0 + ({p} - {low}e0) * {rate}e0"))
    return f"round_even({case(pairs)}, 0)"


add("tax_bands", f"""SELECT duty, cash, count(*) AS n FROM (SELECT {_duty('x')} AS duty, round_even(x * 0.10e0, 0) + {_duty('x')} AS cash
  FROM (SELECT l_extendedprice * 20 AS x FROM lineitem)) GROUP BY ALL""")
add("localities", r"""SELECT c_custkey AS id, trim(regexp_replace(lower(c_name || ' NSW ' || (c_custkey % 900 + 2000)), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
  'Customer ' || substr(c_name, 10) AS suburb, 'NSW' AS state FROM customer""")
add("url_localities", """SELECT page_id, 'Sydney' AS suburb, 'NSW' AS state FROM pages""")
add("payload_areas", "SELECT id, sqm AS area FROM listings", LISTINGS)
add("tag_reads", """SELECT k AS id, status, CASE WHEN status IS NULL THEN NULL WHEN k % 6 = 0 THEN 'private treaty' WHEN k % 6 = 1 THEN 'auction' WHEN k % 6 = 4 THEN 'prior to auction' END AS method,
  CASE WHEN status IS NOT NULL AND k % 6 IN (0, 1, 2, 4) THEN strftime(d, '%Y-%m-%d') END AS sold_date
  FROM (SELECT o_orderkey AS k, o_orderdate AS d, CASE WHEN o_orderkey % 6 IN (0, 1, 4) THEN 'sold' WHEN o_orderkey % 6 = 2 THEN 'leased'
    WHEN o_orderkey % 6 = 3 OR o_orderkey % 10 = 0 THEN 'off_market' END AS status FROM orders)""")
TEXTS = """
texts AS (SELECT l.* REPLACE (coalesce(doc.text || '. ', '') || l.description AS description) FROM listings l LEFT JOIN documents doc ON doc.doc_id = l.k),
blobs AS (SELECT *, lower(description || '  ' || headline || '  ' || f1 || '  ' || f2 || '  ' || sf) AS vblob,
  lower(headline || ' ' || description || ' ' || coalesce(price_display, '') || ' ' || status || ' ' || f1 || ' ' || f2 || ' Feature ' || sf || ' ') AS rblob,
  lower(description || ' ' || headline || ' ' || f1 || ' ' || f2) AS dblob, lower(description || ' ' || f1 || ' ' || f2 || ' ' || headline) AS hblob FROM texts)"""
add("preference_flags", "SELECT id, " + ", ".join(f"CAST({has('vblob', p)} AS BIGINT) AS {n}" for n, p, _, _ in vocab.PREFERENCES) + " FROM blobs", LISTINGS, TEXTS)
add("media_groups", "SELECT id, 'photo.jpg' AS photos, CASE WHEN floorplan THEN 'floorplan.jpg' ELSE '' END AS floorplans, '' AS other FROM listings", LISTINGS)

# ---- history ----------------------------------------------------------------------

add("snapshot_diff", "SELECT id, epoch_us(ts) AS at_us, seq, disp AS price_display, lo AS price_from, hi AS price_to, status FROM moves WHERE moved", OBSERVATIONS)
ORACLE["stream_snapshots"] = ORACLE["snapshot_diff"]
add("price_events", EVENT_OUT + "price_ev", OBSERVATIONS, PRICE_EVENTS)
add("status_events", EVENT_OUT + "status_ev", OBSERVATIONS, STATUS_EVENTS)
add("inspection_changes", EVENT_OUT + "insp_ev", OBSERVATIONS, INSPECTION_EVENTS)
add("lifecycle", EVENT_OUT + "ev", ALL_EVENTS)
NO_GONE = ",".join([OBSERVATIONS, PRICE_EVENTS, STATUS_EVENTS, INSPECTION_EVENTS, "gone AS (SELECT id, ts AS run_at FROM obs WHERE false)", LIFECYCLE])
add("stream_events", EVENT_OUT + "ev", NO_GONE)
ORACLE["stream_lifecycle"] = ORACLE["lifecycle"]
HISTORY = f"""
hist AS (SELECT CAST(l_orderkey AS VARCHAR) AS id, {whole('l_extendedprice')} AS v,
  lag({whole('l_extendedprice')}) OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pv FROM lineitem),
hist_ev AS (SELECT id, CASE WHEN v < pv THEN 'price_drop' ELSE 'price_rise' END AS event_type FROM hist WHERE v <> pv)"""
add("price_history_events", "SELECT id, event_type, count(*) AS n FROM hist_ev GROUP BY ALL", HISTORY)
add("latest_event", "SELECT id, epoch_us(ts) AS at_us, event_type FROM price_ev QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC, seq DESC) = 1", OBSERVATIONS, PRICE_EVENTS)
add("latest_changes", f"SELECT id, {TOP} AS rank, epoch_us(ts) AS at_us, event_type FROM price_ev QUALIFY rank <= 5", OBSERVATIONS, PRICE_EVENTS)
add("state_fold", """SELECT id, arg_max(mode, (ts, seq)) AS mode, arg_max(status, (ts, seq)) AS status, arg_max(headline, (ts, seq)) FILTER (headline IS NOT NULL) AS headline,
  arg_max(disp, (ts, seq)) AS price_display, arg_max(lo, (ts, seq)) AS price_from, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM obs GROUP BY id""", OBSERVATIONS)
ORACLE["state_merge"] = ORACLE["state_stored"] = ORACLE["state_fold"]
add("why_now", "SELECT * FROM why_now", ALL_EVENTS, WHY)
add("lifecycle_summary", f"""SELECT id, first_us, last_us, status, snapshot_count, coalesce(drops, 0) AS price_drops, CAST(e.id IS NOT NULL AS BIGINT) AS changed FROM (
    SELECT id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, arg_max(status, (ts, seq)) AS status, count(*) FILTER (moved) AS snapshot_count FROM moves GROUP BY id) s
  LEFT JOIN (SELECT id, count(*) FILTER (event_type = 'price_drop') AS drops FROM (SELECT *, {TOP} AS r FROM ev QUALIFY r <= 5) GROUP BY id) e USING (id)""", ALL_EVENTS)
add("inspection_table", "SELECT id, open_at AS start, min(close_at) AS \"end\" FROM obs WHERE open_at IS NOT NULL GROUP BY ALL", OBSERVATIONS)
add("media_table", """SELECT id, 'photo.jpg' AS url, 'photo' AS media_type, 0 AS position FROM listings
  UNION ALL SELECT id, 'floorplan.jpg', 'floorplan', 1 FROM listings WHERE floorplan""", LISTINGS)

# ---- hunts ------------------------------------------------------------------------

add("new_listings", """SELECT hunt, epoch_us(run_at) AS run_us, id FROM pres p WHERE NOT off AND NOT EXISTS (
  SELECT 1 FROM pres x WHERE x.hunt = p.hunt AND x.id = p.id AND x.no < p.no)""", RUNS)
add("stale_listings", "SELECT hunt, epoch_us(run_at) AS run_us, id FROM gone", RUNS, GONE)
add("relisted", """SELECT hunt, epoch_us(run_at) AS run_us, id FROM pres p WHERE NOT off AND EXISTS (SELECT 1 FROM gone g WHERE g.hunt = p.hunt AND g.id = p.id AND g.no < p.no
  AND NOT EXISTS (SELECT 1 FROM pres x WHERE x.hunt = p.hunt AND x.id = p.id AND x.no > g.no AND x.no < p.no))""", RUNS, GONE)
DIFF = """
lastrun AS (SELECT hunt, run_at, blocked, total_results, lag(run_at) OVER w AS prev_at, row_number() OVER (PARTITION BY hunt ORDER BY run_at DESC) AS r FROM runs
  WINDOW w AS (PARTITION BY hunt ORDER BY run_at) QUALIFY r = 1),
spans AS (SELECT hunt, id, min(run_at) AS f, max(run_at) AS l, arg_max(off, run_at) AS off FROM pres GROUP BY ALL),
diff AS (SELECT hunt, run_at, id, CASE WHEN l < run_at AND NOT blocked THEN 'stale' WHEN f = run_at AND NOT off THEN 'new'
    WHEN NOT blocked AND l = run_at AND f < run_at AND NOT off AND EXISTS (SELECT 1 FROM {events} e WHERE e.id = spans.id AND e.ts > prev_at) THEN 'changed' END AS section
  FROM spans JOIN lastrun USING (hunt))"""
D1 = DIFF.format(events="price_ev")
add("hunt_diff", "SELECT hunt, epoch_us(run_at) AS run_us, id, section FROM diff WHERE section IS NOT NULL", OBSERVATIONS, PRICE_EVENTS, RUNS, D1)
add("changed_since", "SELECT hunt, epoch_us(run_at) AS run_us, id FROM diff WHERE section = 'changed'", OBSERVATIONS, PRICE_EVENTS, RUNS, D1)
COUNTS = """
counts AS (SELECT r.hunt, r.run_at, r.blocked, r.total_results, count(*) FILTER (section = 'new') AS new_count, count(*) FILTER (section = 'changed') AS changed_count,
  count(*) FILTER (section = 'stale') AS stale_count FROM lastrun r LEFT JOIN diff d ON d.hunt = r.hunt GROUP BY ALL),
level AS (SELECT hunt, total_results - lag(total_results) OVER (PARTITION BY hunt ORDER BY run_at) AS delta, row_number() OVER (PARTITION BY hunt ORDER BY run_at DESC) AS r FROM runs)"""
_DIR = "CASE WHEN delta IS NULL THEN 'first-reading' WHEN delta > 0 THEN 'rising' WHEN delta < 0 THEN 'falling' ELSE 'flat' END"
add("hunt_report", f"""SELECT hunt, epoch_us(run_at) AS run_us, CAST(blocked AS BIGINT) AS blocked, total_results, new_count, changed_count, stale_count, delta, {_DIR} AS direction
  FROM counts JOIN (SELECT * FROM level WHERE r = 1) USING (hunt)""", OBSERVATIONS, PRICE_EVENTS, RUNS, D1, COUNTS)
add("run_totals", "SELECT count(*) AS hunts, sum(new_count)::BIGINT AS total_new, sum(changed_count)::BIGINT AS total_changed, sum(stale_count)::BIGINT AS total_stale FROM counts", OBSERVATIONS, PRICE_EVENTS, RUNS, D1, COUNTS)
add("stale_preview", "SELECT hunt, row_number() OVER (PARTITION BY hunt ORDER BY id) AS rank, id FROM diff WHERE section = 'stale' QUALIFY rank <= 10", OBSERVATIONS, PRICE_EVENTS, RUNS, D1)
add("run_membership", """SELECT hunt, epoch_us(run_at) AS run_us, id, CAST(id NOT IN (SELECT x.id FROM members x WHERE x.hunt = m.hunt AND x.run_at = f) AS BIGINT) AS is_new
  FROM members m JOIN (SELECT hunt, min(run_at) AS f FROM members GROUP BY hunt) USING (hunt) WHERE run_at > f""", RUNS)
add("hunts_stored", """SELECT hunt, arg_max(total_results, run_at) AS total_results, CAST(arg_max(blocked, run_at) AS BIGINT) AS blocked, epoch_us(min(run_at)) AS first_us,
  epoch_us(max(run_at)) AS last_us FROM runs GROUP BY hunt""", RUNS)
add("seen_stored", """SELECT m.hunt, epoch_us(m.run_at) AS run_us, m.id, CAST(min(x.run_at) >= TIMESTAMP '2024-01-21' AS BIGINT) AS is_new, epoch_us(min(x.run_at)) AS first_us,
  epoch_us(max(x.run_at)) AS last_us FROM members m JOIN members x ON x.hunt = m.hunt AND x.id = m.id WHERE m.run_at >= TIMESTAMP '2024-01-21' GROUP BY m.hunt, m.run_at, m.id""", RUNS)
add("supply_trend", f"""SELECT hunt, current, previous, delta, {whole('a')} AS avg_recent, n_runs, {rounded('pct', 1)} AS pct_change, {_DIR} AS direction, history FROM (
  SELECT *, current - previous AS delta, (current - previous) / previous * 100e0 AS pct FROM (
  SELECT hunt, max(total_results) FILTER (r = 1) AS current, max(total_results) FILTER (r = 2) AS previous, avg(total_results) AS a, count(*) AS n_runs,
    string_agg(CAST(total_results AS VARCHAR), '|' ORDER BY run_at) AS history
  FROM (SELECT *, row_number() OVER (PARTITION BY hunt ORDER BY run_at DESC) AS r FROM runs) WHERE r <= 12 GROUP BY hunt))""", RUNS)

# ---- agents -----------------------------------------------------------------------

METRICS = f"""
links AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS id, l_suppkey AS agent_id FROM lineitem),
per AS (SELECT id, sold_price IS NOT NULL AND sold_price <> 0 AS sold, (sold_price - {best_ask()}) / {best_ask()} AS delta FROM listings),
drops AS (SELECT id, count(*) AS n FROM hist_ev WHERE event_type = 'price_drop' GROUP BY id),
metrics0 AS (SELECT agent_id, count(*) AS listings_seen, count(*) FILTER (sold) AS listings_sold, avg(delta) AS a, CAST(coalesce(sum(n), 0) AS BIGINT) AS price_drops_observed,
  count(*) FILTER (delta >= 0.10e0) AS underquote_signals FROM links JOIN per USING (id) LEFT JOIN drops USING (id) GROUP BY agent_id),
metrics AS (SELECT * EXCLUDE a, {rounded('a', 4)} AS avg_guide_vs_sold FROM metrics0)"""
add("agent_metrics", "SELECT * FROM metrics", LISTINGS, HISTORY, METRICS)
add("agent_rank", f"""SELECT agent_id, s_name AS name, n_name AS agency, listings_seen, price_drops_observed, underquote_signals, CASE WHEN v IS NULL THEN 'No sold-guide evidence yet'
  WHEN v >= 0.10e0 THEN 'Sold results average ' || printf('%.1f', {rounded('pct', 1)}) || '% above guide midpoint' WHEN v <= -0.05e0 THEN 'Sold results average ' || printf('%.1f', abs({rounded('pct', 1)})) || '% below guide midpoint'
  ELSE 'Sold results average ' || printf('%.1f', {rounded('pct', 1)}) || '% from guide midpoint' END AS guide_read
  FROM (SELECT *, avg_guide_vs_sold AS v, avg_guide_vs_sold * 100e0 AS pct FROM metrics WHERE listings_seen >= 5) JOIN supplier ON s_suppkey = agent_id JOIN nation ON n_nationkey = s_nationkey
  ORDER BY underquote_signals DESC, price_drops_observed DESC, listings_seen DESC, s_name, agent_id LIMIT 20""", LISTINGS, HISTORY, METRICS)
add("agent_directory", """SELECT 'Agent ' || (k % 50) AS name, suburb AS agency, max(CASE WHEN has_contact THEN '0400000000' END) AS mobile, CAST(NULL AS VARCHAR) AS email FROM listings WHERE has_agent GROUP BY ALL""", LISTINGS)
add("agent_listings", "SELECT 'Agent ' || (k % 50) AS name, suburb AS agency, count(*) AS n FROM listings WHERE has_agent GROUP BY ALL", LISTINGS)

# ---- comparables ------------------------------------------------------------------


def _comps(mode: str, pool: int, pre: str) -> str:
    """``{pre}`` = ranked comparables per (area, kind, beds); 13 kept so that one can be left out."""
    sold = mode == "sold"
    low = "nullif(price_from, 0), nullif(price_to, 0)"
    price = f"coalesce(nullif(sold_price, 0), {low}, {shown('price_display')})" if sold else f"coalesce({low}, {shown('price_display')})"
    rec = "coalesce(sold_date, last_seen)" if sold else "last_seen"
    dated = "sold_date" if sold else "last_seen"
    cap = "" if sold else "AND price <= 5000"
    near = f"{pre}_near"
    match = "(contains(p.kind, c.kind) OR contains(c.kind, p.kind))"
    return f"""
{near} AS (SELECT * FROM (SELECT a.area, lower(l.suburb) AS candidate, l.id, l.beds, l.sqm, regexp_replace(lower(l.property_type), '[^a-z0-9]', '', 'g') AS kind,
    CAST({price} AS DOUBLE) AS price, {dated} AS dated, row_number() OVER (PARTITION BY a.area ORDER BY {rec} DESC NULLS LAST, l.id) AS pos
  FROM (SELECT DISTINCT lower(n_name) AS area FROM nation) a JOIN listings l ON l.mode = '{mode}' AND (lower(l.suburb) = a.area
    OR lower(l.suburb) IN (SELECT neighbour FROM neighbours n WHERE n.area = a.area))) WHERE pos <= {pool}),
{pre}_prof AS (SELECT DISTINCT lower(suburb) AS area, regexp_replace(lower(property_type), '[^a-z0-9]', '', 'g') AS kind, beds FROM listings),
{pre} AS (SELECT *, row_number() OVER (PARTITION BY area, kind, beds ORDER BY score DESC, dated DESC NULLS LAST, pos) AS rank FROM (
  SELECT p.area, p.kind, p.beds, c.id AS comp_id, c.price, c.dated, c.pos, c.sqm, c.beds AS comp_beds, round_even(c.price / c.beds, 0) AS per_bed,
    CASE WHEN abs(c.beds - p.beds) <= 0.5 THEN 3 WHEN abs(c.beds - p.beds) <= 1 THEN 1 ELSE 0 END + 2 + CASE WHEN p.area = c.candidate THEN 3 ELSE 1 END AS score
  FROM {pre}_prof p JOIN {near} c ON c.area = p.area WHERE c.price IS NOT NULL AND c.price <> 0 {cap} AND {match}) WHERE score >= 3 QUALIFY rank <= 13)"""


SOLD, RENT = _comps("sold", 80, "sc"), _comps("rent", 100, "rc")
SUBJ = "(SELECT *, lower(suburb) AS area, regexp_replace(lower(property_type), '[^a-z0-9]', '', 'g') AS kind FROM listings WHERE mode = '{mode}') s"
_ROWS = "SELECT s.id AS subject_id, {rank} AS rank, comp_id, CAST(score AS BIGINT) AS score, price, per_bed FROM {subj} JOIN {comps} c USING (area, kind, beds)"
add("sold_comps", _ROWS.format(rank="rank", subj=SUBJ.format(mode="sale"), comps="sc") + " WHERE rank <= 12", LISTINGS, NEIGHBOURS, SOLD)
add("rental_comps", _ROWS.format(rank="rank", subj=SUBJ.format(mode="rent"), comps="rc") + " WHERE rank <= 12", LISTINGS, NEIGHBOURS, RENT)
add("sold_comps_others", "SELECT subject_id, row_number() OVER (PARTITION BY subject_id ORDER BY rank) AS rank, comp_id, score, price, per_bed FROM (" + _ROWS.format(rank="rank", subj=SUBJ.format(mode="sold"), comps="sc") + " WHERE comp_id <> s.id) t QUALIFY rank <= 12".replace("QUALIFY rank", "QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY t.rank)"), LISTINGS, NEIGHBOURS, SOLD)


def _stats(pre: str) -> str:
    conf = "CASE WHEN count(*) >= 8 THEN 'high' WHEN count(*) >= 4 THEN 'medium' ELSE 'low' END"
    return f"""
{pre}_stats AS (SELECT area, kind, beds, count(*) AS n, min(price) AS low, max(price) AS high, median(price) AS median, median(per_bed) AS mpb, {conf} AS confidence,
  string_agg(comp_id, '|' ORDER BY rank) FILTER (rank <= 6) AS comps FROM {pre} WHERE rank <= 12 GROUP BY area, kind, beds)"""


_FAIR = """CASE WHEN ask IS NULL OR median IS NULL THEN 'unknown' WHEN ask < low * 0.95e0 THEN 'cheap or underquoted' WHEN ask <= median * 0.97e0 THEN 'good value'
  WHEN ask <= median * 1.05e0 THEN 'fair' WHEN ask <= high * 1.05e0 THEN 'stretched' ELSE 'overpriced' END"""


def _reads(mode: str, pre: str, name: str) -> str:
    return f"""
{name}0 AS (SELECT s.*, {best_ask()} AS ask, coalesce(n, 0) AS n, low, high, median, mpb, coalesce(confidence, 'none') AS confidence, comps
  FROM {SUBJ.format(mode=mode)} LEFT JOIN {pre}_stats USING (area, kind, beds)),
{name} AS (SELECT *, {_FAIR} AS fairness FROM {name}0)"""


SALE_READ = ",".join([LISTINGS, NEIGHBOURS, SOLD, _stats("sc"), _reads("sale", "sc", "reads")])
RENT_READ = ",".join([LISTINGS, NEIGHBOURS, RENT, _stats("rc"), _reads("rent", "rc", "rreads")])
_POST = case([(f"fairness = {q(k)}", q(v)) for k, v in vocab.POSTURE.items()])
add("comp_valuation", f"""SELECT id, ask, n, low, high, median, mpb AS median_per_bed, round_even(ask / beds, 0) AS price_per_bed, fairness, confidence, {_POST} AS posture, comps FROM reads""", SALE_READ)
add("rent_valuation", """SELECT id, ask, n, low, high, median, round_even(ask / beds, 0) AS rent_per_bed, fairness, confidence,
  CASE WHEN ask IS NULL THEN 'unknown' WHEN ask <= 2500 THEN 'within budget' ELSE 'over budget' END AS affordability, ask * 52 AS annual_burden,
  CASE WHEN fairness IN ('cheap or underquoted', 'good value') AND confidence IN ('medium', 'high') THEN 'high' WHEN fairness = 'fair' THEN 'medium' ELSE 'low' END AS urgency FROM rreads""", RENT_READ)
add("underquote", f"""SELECT id, CASE WHEN gap >= 0.20e0 THEN 'high' ELSE 'moderate' END AS severity, {rounded('pct', 1)} AS gap_pct, {whole('median')} AS implied_price FROM (
  SELECT *, gap * 100e0 AS pct FROM (SELECT *, (median - ask) / median AS gap FROM reads WHERE n >= 4 AND confidence IN ('medium', 'high')) WHERE gap >= 0.12e0)""", SALE_READ)
RENTS = f"""
arents AS (SELECT lower(suburb) AS area, beds, coalesce(nullif(price_from, 0), nullif(price_to, 0), {shown('price_display')}) AS rent FROM listings WHERE mode = 'rent'),
weekly AS (SELECT w.area, w.beds, round_even(median(CAST(rent AS DOUBLE)), 0) AS weekly_rent, count(*) AS rent_n FROM (SELECT DISTINCT lower(suburb) AS area, beds FROM listings) w
  JOIN arents r ON r.area = w.area AND abs(r.beds - w.beds) <= 1 WHERE rent BETWEEN 100 AND 5000 GROUP BY ALL)"""
add("area_weekly_rent", "SELECT area, beds, weekly_rent, rent_n FROM weekly", LISTINGS, RENTS)

# ---- signals ----------------------------------------------------------------------


def _conf(n: str, hi: int = 8, med: int = 4) -> str:
    return f"CASE WHEN {n} >= {hi} THEN 'high' WHEN {n} >= {med} THEN 'medium' ELSE 'low' END"


def _adjust(blob: str) -> str:
    total = "0e0" + "".join(f" + CASE WHEN {has(blob, p)} THEN {w}e0 ELSE 0e0 END" for p, w, _ in vocab.HEDONIC)
    return f"greatest(-0.12e0, least(0.12e0, {total}))"


_METHOD = case([(f"method = {q(m)}", f"{w}e0") for m, w in vocab.METHOD_WEIGHT.items()], "0.5e0")
_CONFW = case([(f"confidence = {q(c)}", f"{w}e0") for c, w in vocab.CONFIDENCE_WEIGHT.items()], "0e0")


def _signal_views(subjects: str, band: str = "0.035e0 AS ylo, 0.045e0 AS yhi") -> str:
    pt = "coalesce(point, (low + high) / 2e0, low, high)"
    return f"""
subj AS (SELECT s.*, {best_ask()} AS ask, lower(description || ' ' || f1 || ' ' || f2 || ' ' || headline) AS htext, {band} FROM {subjects}),
basis AS (SELECT area, kind, beds, count(*) FILTER (comp_beds = beds) AS same_n FROM sc WHERE rank <= 12 GROUP BY ALL),
based AS (SELECT area, kind, beds, count(*) AS n, median(price) AS m, min(price) AS lo, max(price) AS hi FROM sc JOIN basis USING (area, kind, beds)
  WHERE rank <= 12 AND (same_n < 2 OR comp_beds = beds) GROUP BY ALL),
rates AS (SELECT area, kind, beds, count(per_bed) AS nb, median(per_bed) AS mb, max(per_bed) - min(per_bed) AS rb, count(price / sqm) AS nq, median(price / sqm) AS mq,
  max(price / sqm) - min(price / sqm) AS rq FROM sc WHERE rank <= 12 GROUP BY ALL),
rentm AS (SELECT area, kind, beds, count(*) AS n, median(price) * 52 AS annual FROM rc WHERE rank <= 12 GROUP BY ALL),
hed AS (SELECT s.id, b.m, b.n, {_adjust('htext')} AS adj FROM subj s JOIN based b USING (area, kind, beds)),
cap0 AS (SELECT l_orderkey AS ck, count(*) AS n, max(l_extendedprice) AS top FROM lineitem GROUP BY l_orderkey HAVING count(*) % 2 = 0),
cap AS (SELECT s.id, coalesce({whole('top * 3')}, {whole('c_acctbal * 40')})::DOUBLE AS point, {whole('top * 2.8e0')}::DOUBLE AS low, {whole('top * 3.2e0')}::DOUBLE AS high,
    CASE WHEN n >= 6 THEN 'high' ELSE 'medium' END AS confidence FROM subj s LEFT JOIN cap0 ON ck = s.k
    LEFT JOIN (SELECT c_name || ', ' || n_name AS addr, c_acctbal FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 0) a ON a.addr = s.address_display),
sig0 AS (
  SELECT s.id, 0 AS pos, 'comparable_median' AS method, round_even(m, 0) AS point, round_even(lo, 0) AS low, round_even(hi, 0) AS high, {_conf('n')} AS confidence, n FROM subj s JOIN based USING (area, kind, beds)
  UNION ALL SELECT s.id, 1, 'per_bed', round_even(mb * s.beds, 0), round_even(mb * s.beds - sp, 0), round_even(mb * s.beds + sp, 0), {_conf('nb')}, nb FROM (
    SELECT s.*, mb, nb, CASE WHEN nb > 1 THEN rb / 2e0 * s.beds ELSE mb * s.beds * 0.05e0 END AS sp FROM subj s JOIN rates USING (area, kind, beds)) s WHERE nb > 0
  UNION ALL SELECT s.id, 2, 'per_sqm', round_even(mq * s.sqm, 0), round_even(mq * s.sqm - sp, 0), round_even(mq * s.sqm + sp, 0), {_conf('nq', 6, 3)}, nq FROM (
    SELECT s.*, mq, nq, CASE WHEN nq > 1 THEN rq / 2e0 * s.sqm ELSE mq * s.sqm * 0.05e0 END AS sp FROM subj s JOIN rates USING (area, kind, beds)) s WHERE nq > 0 AND s.sqm > 0
  UNION ALL SELECT id, 3, 'hedonic', round_even(m * (1 + adj), 0), round_even(m * (1 + least(adj, 0e0)), 0), round_even(m * (1 + greatest(adj, 0e0)), 0), CASE WHEN n >= 4 THEN 'medium' ELSE 'low' END, n FROM hed WHERE abs(adj) >= 0.005e0
  UNION ALL SELECT s.id, 4, 'yield_implied', round_even((annual / ylo + annual / yhi) / 2e0, 0), round_even(annual / yhi, 0), round_even(annual / ylo, 0), CASE WHEN n < 4 THEN 'low' ELSE 'medium' END, n FROM subj s JOIN rentm USING (area, kind, beds)
  UNION ALL SELECT id, 5, 'avm', point, low, high, confidence, 1 FROM cap WHERE point IS NOT NULL),
sig AS (SELECT *, {_METHOD} * {_CONFW} AS weight FROM sig0),
recl AS (SELECT id, count(*) AS c, list({{'w': weight, 'p': p, 'h': coalesce((high - low) / 2e0, p * 0.04e0)}} ORDER BY pos) AS l
  FROM (SELECT *, {pt} AS p FROM sig) WHERE weight > 0 AND p <> 0 GROUP BY id),
recm AS (SELECT *, list_sum(list_transform(l, lambda x: x.w)) AS tw, list_sum(list_transform(l, lambda x: x.p)) / c AS mean FROM recl),
recd AS (SELECT *, list_transform(l, lambda x: x.p - mean) AS devs FROM recm),
rec0 AS (SELECT id, c, list_sum(list_transform(l, lambda x: x.p * x.w)) / tw AS point, list_sum(list_transform(l, lambda x: x.h * x.w)) / tw AS half,
  CASE WHEN c > 1 THEN sqrt(list_sum(list_transform(devs, lambda d: d * d)) / c) ELSE 0e0 END AS sd FROM recd),
rec AS (SELECT id, {whole('point')} AS point, {whole('point - (half + sd * 0.5e0)')} AS low, {whole('point + (half + sd * 0.5e0)')} AS high, c AS signal_count, 1 - sd / point AS agr,
  CASE WHEN c >= 3 AND sd / point < 0.06e0 THEN 'high' WHEN c >= 2 AND sd / point < 0.12e0 THEN 'medium' ELSE 'low' END AS confidence FROM rec0),
asks AS (SELECT s.id, s.ask, r.*, CASE WHEN s.ask < low THEN 'below' WHEN s.ask <= high THEN 'within' ELSE 'above' END AS side FROM subj s JOIN rec r USING (id) WHERE s.ask IS NOT NULL)"""


_VERDICT = "CASE WHEN side = 'below' AND (point - ask) / point >= 0.07e0 THEN 'under-quoted opportunity' WHEN side = 'below' THEN 'keenly priced' WHEN side = 'within' THEN 'fairly guided' ELSE 'over-quoted' END"
CASES = ",".join([LISTINGS, NEIGHBOURS, SOLD, RENT, _signal_views(SUBJ.format(mode="sale"))])
for _name, _method in (("signal_median", "comparable_median"), ("signal_per_bed", "per_bed"), ("signal_per_sqm", "per_sqm"), ("signal_yield", "yield_implied"), ("signal_captured", "avm"), ("signal_hedonic", "hedonic")):
    add(_name, f"SELECT id, point, low, high, confidence, CAST(n AS BIGINT) AS n FROM sig WHERE method = '{_method}'", CASES)
add("signal_provided", f"""SELECT s.id, {whole('top * 3')}::DOUBLE AS point, ({whole('top * 3')} - 1000)::DOUBLE AS low, ({whole('top * 3')} + 1000)::DOUBLE AS high, 'medium' AS confidence, n
  FROM listings s JOIN (SELECT l_orderkey AS lk, count(*) AS n, max(l_extendedprice) AS top FROM lineitem GROUP BY l_orderkey) ON lk = s.k WHERE s.mode = 'sale' AND n > 3""", LISTINGS)
add("signal_order", f"SELECT id, row_number() OVER (PARTITION BY id ORDER BY weight DESC, pos) AS rank, method, {rounded('weight', 4)} AS weight FROM sig", CASES)
add("reconcile", f"SELECT id, point, low, high, signal_count, confidence, {rounded('agr', 3)} AS agreement FROM rec", CASES)
add("ask_position", f"""SELECT id, {whole('ask')} AS asking, {whole('point - ask')} AS negotiation_headroom, side || ' independent range' AS position, {_VERDICT} AS verdict FROM asks""", CASES)
_REASONS = ", ".join(f"CASE WHEN {has('hblob', p)} THEN {q(label)} END" for p, _, label in vocab.HEDONIC)
add("hedonic_texts", f"SELECT id, {rounded('a', 4)} AS adjustment, coalesce(list_aggregate(list_filter([{_REASONS}], lambda x: x IS NOT NULL), 'string_agg', '|'), '') AS reasons FROM (SELECT *, {_adjust('hblob')} AS a FROM blobs)", LISTINGS, TEXTS)

# ---- rules ------------------------------------------------------------------------


def _risk_rules() -> list[tuple[str, str, str, str, str, str]]:
    """(condition, severity, category, label, evidence, known) in rule order."""
    ev = lambda k: f"ev_{k}"
    hit = lambda k: f"ev_{k} IS NOT NULL"
    areas = ", ".join(q(a) for a in vocab.HIGH_DENSITY_AREAS)
    cars = "CAST(cars AS VARCHAR)"
    none = "''"
    return [
        ("short_cars", "dealbreaker", "brief", "Parking shortfall", cars, "1"),
        (hit("overlay"), "dealbreaker", "overlay", "Potential property overlay", ev("overlay"), "1"),
        (hit("road"), "major", "location", "Noise or road exposure", ev("road"), "1"),
        (hit("ground"), "minor", "apartment", "Ground-floor exposure", ev("ground"), "1"),
        (hit("light"), "major", "apartment", "Light/aspect concern", ev("light"), "1"),
        (f"small AND {hit('no_lift')}", "minor", "apartment", "No-lift building", ev("no_lift"), "1"),
        (f"small AND {hit('compact')}", "watch", "apartment", "Compact floorplan", ev("compact"), "1"),
        ("small AND ev_compact IS NULL AND ev_sized IS NULL", "watch", "missing_data", "Internal area unclear", none, "0"),
        (f"small AND lower(suburb) IN ({areas})", "watch", "market", "High-density suburb", none, "1"),
        (hit("condition"), "major", "condition", "Condition risk", ev("condition"), "1"),
        (f"house AND {hit('title')}", "major", "title", "Easement/access issue", ev("title"), "1"),
        ("unit AND NOT floorplan", "watch", "missing_data", "No floorplan found", none, "0"),
        ("unit AND NOT contains(rblob, 'strata')", "watch", "missing_data", "Strata costs unknown", none, "0"),
        ("NOT has_visit", "watch", "missing_data", "No inspection time found", none, "0"),
        ("has_agent AND NOT has_contact", "watch", "missing_data", "Agent contact incomplete", none, "0"),
        ("NOT has_agent", "watch", "missing_data", "Agent details missing", none, "0"),
        ("rental AND ev_climate IS NULL", "watch", "renter", "Heating/cooling unconfirmed", none, "0"),
        (f"rental AND {hit('pets')}", "major", "renter", "Pet restriction", ev("pets"), "1"),
        (f"rental AND {hit('laundry')}", "minor", "renter", "Shared laundry", ev("laundry"), "1"),
        (f"rental AND {hit('lease')}", "major", "renter", "Short lease risk", ev("lease"), "1"),
        (f"rental AND {hit('no_parking')}", "minor", "renter", "Parking/storage shortfall", ev("no_parking"), "1"),
        ("rental AND ev_no_parking IS NULL AND cars = 0 AND cars_min = 0", "watch", "renter", "No allocated parking", none, "0"),
        ("rental AND ev_available IS NULL", "watch", "renter", "Availability unclear", none, "0"),
    ]


def _risk_views(source: str) -> str:
    evs = ", ".join(f"{found('rblob', p)} AS ev_{k}" for k, p in vocab.RISK_PATTERNS.items())
    items = ", ".join(
        f"CASE WHEN {c} THEN {{'w': {vocab.SEVERITY_WEIGHT[s]}e0, 'i': {i}, 'severity': {q(s)}, 'category': {q(cat)}, 'label': {q(lab)}, 'evidence': {e}, 'known': {k}}} END"
        for i, (c, s, cat, lab, e, k) in enumerate(_risk_rules())
    )
    return f"""
paired AS (SELECT t.*, b.* FROM {source} t JOIN briefs b ON b.brief_area = t.suburb),
facts0 AS (SELECT *, lower(property_type) AS pt, cars_min > 0 AND cars < cars_min AS short_cars, objective IN ('rent', 'both') OR mode = 'rent' AS rental, {evs} FROM paired),
facts1 AS (SELECT *, contains(pt, 'apartment') OR contains(pt, 'unit') AS unit, contains(pt, 'apartment') OR contains(pt, 'unit') OR contains(pt, 'studio') AS small,
  contains(pt, 'house') OR contains(pt, 'terrace') OR contains(pt, 'villa') AS house FROM facts0),
risks0 AS (SELECT *, list_filter([{items}], lambda x: x IS NOT NULL) AS items FROM facts1),
risks1 AS (SELECT *, list_sort(list_transform(items, lambda x: {{'o': -x.w, 'i': x.i, 'x': x}})) AS sorted FROM risks0),
risks2 AS (SELECT *, least(1e0, coalesce(list_sum(list_transform(sorted, lambda s: s.x.w)), 0e0) / 4e0) AS load,
  len(list_filter(items, lambda x: x.severity = 'dealbreaker')) > 0 AS breaker, sorted[1].x.severity AS top_severity,
  coalesce(sorted[1].x.label, {q(vocab.NO_RISK_SUMMARY)}) AS top_risk FROM risks1),
risks AS (SELECT *, {rounded('load', 2)} AS penalty FROM risks2)"""


BLOBS = ",".join([LISTINGS, TEXTS, BRIEFS])
RISKS = BLOBS + "," + _risk_views("blobs")
add("risk_flags", """SELECT brief_id, id, CAST(len(items) AS BIGINT) AS n, penalty, CAST(breaker AS BIGINT) AS has_dealbreaker, top_risk,
  coalesce(list_aggregate(list_transform(sorted[1:3], lambda s: s.x.label), 'string_agg', '|'), '') AS top,
  CAST(len(list_filter(items, lambda x: x.severity = 'major')) AS BIGINT) AS majors, CAST(len(list_filter(items, lambda x: x.known = 0)) AS BIGINT) AS unknowns FROM risks""", RISKS)
add("risk_items", """SELECT brief_id, id, CAST(rank AS BIGINT) AS rank, s.x.severity AS severity, s.x.category AS category, s.x.label AS label, s.x.evidence AS evidence, CAST(s.x.known AS BIGINT) AS known
  FROM (SELECT brief_id, id, unnest(sorted) AS s, generate_subscripts(sorted, 1) AS rank FROM risks)""", RISKS)


def _diligence_views(source: str) -> str:
    cool = " OR ".join(f"contains(dblob, {q(w)})" for w in vocab.CLIMATE_WORDS)
    rules = [
        ("buying", "legal", "required", "critical"), ("buying AND small", "strata", "required", "critical"),
        ("buying AND NOT small AND house2", "building_pest", "required", "critical"), ("buying AND auction", "auction", "required", "critical"),
        ("buying AND NOT auction", "cooling_off", "check", "major"), ("buying AND ask > buy_max", "finance", "estimate", "major"),
        ("buying AND ask <= buy_max", "finance", "estimate", "watch"), ("buying AND ask IS NULL", "finance", "unknown", "major"),
        ("rental AND ask IS NOT NULL", "upfront_cash", "estimate", "major"), ("rental AND ask IS NULL", "upfront_cash", "unknown", "major"),
        ("rental", "lease", "check", "major"), ("rental AND NOT contains(dblob, 'pet')", "pets", "unknown", "major"),
        (f"rental AND NOT ({cool})", "climate", "unknown", "major"), ("rental AND short_cars", "parking_storage", "unknown", "major"),
        ("rental", "application", "required", "major"), ("NOT floorplan", "layout", "unknown", "watch"), ("NOT has_visit", "inspection", "unknown", "major"),
        ("price_display IS NULL", "price", "unknown", "major"), ("NOT has_agent", "agent", "unknown", "watch"),
    ]
    items = ", ".join(
        f"CASE WHEN {c} THEN {{'o': {vocab.DILIGENCE_ORDER.index(s)}, 'i': {i}, 'category': {q(cat)}, 'status': {q(st)}, 'severity': {q(s)}}} END"
        for i, (c, cat, st, s) in enumerate(rules)
    )
    return f"""
dil0 AS (SELECT *, {best_ask()} AS ask0, objective IN ('buy', 'both') AND mode <> 'rent' AS buying, contains(coalesce(lower(price_display), ''), 'auction') AS auction,
  contains(pt, 'house') OR contains(pt, 'villa') OR contains(pt, 'duplex') AS house2 FROM {source}),
dil1 AS (SELECT *, list_sort(list_filter([{items.replace('ask ', 'ask0 ')}], lambda x: x IS NOT NULL)) AS ditems FROM dil0),
dil AS (SELECT *, len(list_filter(ditems, lambda x: x.severity = 'critical')) AS critical_count, len(list_filter(ditems, lambda x: x.status = 'unknown')) AS unknown_count FROM dil1)"""


add("diligence", """SELECT brief_id, id, CAST(critical_count AS BIGINT) AS critical_count, CAST(unknown_count AS BIGINT) AS unknown_count, critical_count || ' critical checks, ' || unknown_count || ' unknowns' AS summary,
  list_aggregate(list_transform(ditems, lambda x: x.category || ':' || x.status || ':' || x.severity), 'string_agg', '|') AS items FROM dil""", RISKS, _diligence_views("risks"))


def _score_views(source: str) -> str:
    likes = ", ".join(f"{has('vblob', p)} AS like_{n}" for n, p, _, _ in vocab.PREFERENCES)
    breaks = ", ".join(f"{has('vblob', p)} AS break_{n}" for n, p in vocab.BREAKERS.items())

    def share(i: int) -> str:
        got = "0e0" + "".join(f" + CASE WHEN like_{r[0]} THEN {r[i]}e0 ELSE 0e0 END" for r in vocab.PREFERENCES)
        return f"({got}) / CAST({sum(r[i] for r in vocab.PREFERENCES)!r} AS DOUBLE)"

    bands = case([(f"score >= {f}", q(n)) for f, n in vocab.SCORE_BANDS], q(vocab.LOWEST_BAND))
    return f"""
v0 AS (SELECT x.*, {likes}, {breaks}, {best_ask()} AS vask, weekly.weekly_rent FROM {source} x LEFT JOIN weekly ON weekly.area = lower(x.suburb) AND weekly.beds = x.beds),
v1 AS (SELECT *, vask / buy_max AS ratio, greatest(0e0, 1e0 - CASE WHEN beds < beds_min THEN 0.5e0 ELSE 0e0 END - CASE WHEN baths < baths_min THEN 0.2e0 ELSE 0e0 END
    - CASE WHEN cars_min > 0 AND cars < cars_min THEN 0.3e0 ELSE 0e0 END) AS hard, CASE WHEN buyer_type = 'investor' THEN {share(3)} ELSE {share(2)} END AS liked,
  CASE WHEN break_overlay THEN 0.6e0 ELSE 0e0 END + CASE WHEN break_ground_floor AND break_main_road THEN 0.5e0 WHEN break_main_road THEN 0.2e0 ELSE 0e0 END
    + CASE WHEN cars = 0 AND NOT like_secure_parking AND cars_min > 0 THEN 0.4e0 ELSE 0e0 END + CASE WHEN breaker THEN 0.7e0 ELSE least(0.25e0, penalty * 0.5e0) END AS pen,
  weekly_rent * 52 / vask * 100e0 AS g0 FROM v0),
v2 AS (SELECT *, CASE WHEN ratio IS NULL THEN 0.6e0 WHEN ratio <= 0.85e0 THEN 1e0 WHEN ratio <= 1e0 THEN 0.8e0 WHEN ratio <= 1.08e0 THEN 0.45e0 ELSE 0.15e0 END AS budget,
  CASE WHEN buyer_type = 'investor' THEN {rounded('g0', 2)} END AS gross FROM v1),
v3 AS (SELECT *, CASE WHEN gross IS NOT NULL THEN 0.55e0 * greatest(0e0, least(1e0, (gross - 3e0) / 2e0)) + 0.45e0 * liked ELSE liked END AS lens FROM v2),
v4 AS (SELECT *, greatest(0e0, CASE WHEN buyer_type = 'investor' THEN 0.28e0 * hard + 0.22e0 * budget + 0.50e0 * lens ELSE 0.30e0 * hard + 0.25e0 * budget + 0.45e0 * lens END - pen) * 10 AS mixed FROM v3),
v5 AS (SELECT *, {rounded('mixed', 1)} AS score FROM v4),
scored AS (SELECT *, {bands} AS band FROM v5)"""


SCORES = ",".join([RISKS, RENTS, _score_views("risks")])
add("viability", f"""SELECT brief_id, id, score, band, buyer_type AS lens, {rounded('hard', 2)} AS hard_criteria, {rounded('budget', 2)} AS budget_fit, {rounded('lens', 2)} AS yield_or_lifestyle,
  {rounded('liked', 2)} AS preference_match, {rounded('pen', 2)} AS dealbreaker_penalty, gross AS gross_yield_pct FROM scored""", SCORES)



def _noted(*cases: str) -> str:
    return f"coalesce(list_aggregate(list_filter([{', '.join(f'CASE {c} END' for c in cases)}], lambda x: x IS NOT NULL), 'string_agg', '|'), '')"


def _lacks(have: str, bound: str, what: str) -> str:
    return f"WHEN {bound} > 0 AND coalesce({have}, 0) < {bound} THEN CAST(coalesce({have}, 0) AS INT) || ' {what}, ' || CAST({bound} AS INT) || ' or more asked'"


_AGAINST = _noted(
    _lacks("beds", "beds_min", "beds"), _lacks("baths", "baths_min", "baths"), _lacks("cars", "cars_min", "car spaces"),
    f"WHEN ratio > 1.08e0 THEN {whole('(ratio - 1) * 100')} || '% over the buy ceiling'", "WHEN break_overlay THEN 'The text names a flood or fire overlay; check it'",
    "WHEN break_ground_floor AND break_main_road THEN 'Ground floor on a main road'",
    "WHEN cars = 0 AND NOT like_secure_parking AND cars_min > 0 THEN 'The brief asks for parking and none is in sight'", "WHEN breaker THEN 'Deal-breaker: ' || top_risk",
)
_KNOWN = _noted(
    f"WHEN ratio <= 0.85e0 THEN {whole('(1 - ratio) * 100')} || '% under the buy ceiling' WHEN ratio <= 1e0 THEN 'In the upper part of the budget' WHEN ratio <= 1.08e0 THEN 'Just over the budget at the middle of the guide'",
    "WHEN break_main_road AND NOT break_ground_floor THEN 'A main road may be near; listen for noise'",
    f"WHEN buyer_type <> 'investor' THEN NULL WHEN gross IS NOT NULL THEN 'Gross yield ' || printf('%.1f', {rounded('gross', 1)}) || '% at a rent of $' || format('{{:,}}', CAST(weekly_rent AS BIGINT)) || ' a week' ELSE 'No rents are known to read a yield from'",
)
_LIKES = [(f"like_{n}", n.replace("_", " ")) for n, *_ in vocab.PREFERENCES]
add("viability_notes", f"""SELECT brief_id, id, {_AGAINST} AS violations, {_KNOWN} AS signals, {_noted(*[f"WHEN {c} THEN '{t}'" for c, t in _LIKES])} AS matched,
  {_noted(*[f"WHEN NOT {c} THEN '{t}'" for c, t in _LIKES])} AS missing FROM scored""", SCORES)

# ---- decisions --------------------------------------------------------------------


def _decision_views(source: str) -> str:
    """All reads of ``source`` (texts with blobs) joined on (brief, listing)."""
    band = "CASE WHEN bk % 4 = 0 THEN 0.03e0 ELSE 0.035e0 END AS ylo, CASE WHEN bk % 4 = 0 THEN 0.05e0 ELSE 0.045e0 END AS yhi"
    subj = f"(SELECT x.*, b.bk, lower(x.suburb) AS area, regexp_replace(lower(property_type), '[^a-z0-9]', '', 'g') AS kind FROM {source} x JOIN briefs b ON b.brief_area = x.suburb) s"
    side = "CASE WHEN d.mode = 'rent' OR d.objective = 'rent' THEN r.{c} ELSE s.{c} END AS {c}"
    cols = ", ".join(side.format(c=c) for c in ("n", "low", "high", "median", "confidence"))
    return ",".join([
        NEIGHBOURS, SOLD, RENT, _stats("sc"), _stats("rc"), _risk_views(source), _diligence_views("risks"), RENTS, _score_views("dil"), _signal_views(subj, band),
        f"""
dec0 AS (SELECT d.* EXCLUDE (ask0), d.ask0 AS ask, d.mode = 'rent' OR d.objective = 'rent' AS renting, {cols} FROM scored d
  LEFT JOIN sc_stats s ON s.area = lower(d.suburb) AND s.kind = regexp_replace(d.pt, '[^a-z0-9]', '', 'g') AND s.beds = d.beds
  LEFT JOIN rc_stats r ON r.area = lower(d.suburb) AND r.kind = regexp_replace(d.pt, '[^a-z0-9]', '', 'g') AND r.beds = d.beds),
dec1 AS (SELECT *, coalesce(confidence, 'none') AS conf, coalesce(n, 0) AS nn, {_FAIR} AS fairness FROM dec0),
dec AS (SELECT d.*, CASE WHEN NOT renting THEN r.point END AS ipoint, CASE WHEN NOT renting THEN r.low END AS ilow, CASE WHEN NOT renting THEN r.high END AS ihigh,
  CASE WHEN NOT renting THEN r.confidence END AS iconf, CASE WHEN NOT renting THEN {_VERDICT.replace('side', 'a.side').replace('point - ask', 'a.point - a.ask').replace('/ point', '/ a.point')} END AS verdict0, a.id IS NOT NULL AS asked,
  CASE WHEN breaker THEN 'Pass unless the deal-breaker is disproved' WHEN has_visit THEN 'Inspect in person' ELSE 'Ask for inspection access' END AS action,
  CASE WHEN breaker THEN 'now' WHEN has_visit THEN 'next open' ELSE 'today' END AS deadline
  FROM dec1 d LEFT JOIN rec r ON r.id = d.id LEFT JOIN asks a ON a.id = d.id)""",
    ])


PLAIN = """
blobs AS (SELECT *, lower(description || '  ' || headline || '  ' || f1 || '  ' || f2 || '  ' || sf) AS vblob,
  lower(headline || ' ' || description || ' ' || coalesce(price_display, '') || ' ' || status || ' ' || f1 || ' ' || f2 || ' Feature ' || sf || ' ') AS rblob,
  lower(description || ' ' || headline || ' ' || f1 || ' ' || f2) AS dblob FROM listings)"""
DECISIONS = ",".join([LISTINGS, PLAIN, BRIEFS, _decision_views("blobs")])
TEXT_DECISIONS = ",".join([LISTINGS, TEXTS, BRIEFS, _decision_views("blobs")])
add("decision", """SELECT brief_id, id, score AS viability_score, band AS viability_band, fairness AS price_fairness, conf AS valuation_confidence, ipoint AS independent_estimate,
  ilow AS independent_low, ihigh AS independent_high, iconf AS independent_confidence, CASE WHEN asked THEN verdict0 END AS asking_vs_estimate, top_risk,
  critical_count || ' critical checks, ' || unknown_count || ' unknowns' AS due_diligence, action AS next_action, deadline AS next_action_deadline FROM dec""", DECISIONS)
add("shortlist", """SELECT brief_id, id, score, band, suburb, fairness, conf AS confidence, CASE WHEN len(items) > 0 THEN top_risk END AS top_risk FROM dec
  WHERE mode = 'sale' AND listing_type <> 'project' AND beds <= 2 ORDER BY score DESC, id, brief_id LIMIT 20""", DECISIONS)
add("raw_shortlist", """SELECT brief_id, id, score, band, suburb, fairness, conf AS confidence, CASE WHEN len(items) > 0 THEN top_risk END AS top_risk FROM dec
  WHERE mode = 'sale' AND listing_type <> 'project'""", DECISIONS)
add("raw_models", f"""SELECT id, CASE CAST(id AS BIGINT) % 3 WHEN 0 THEN 0 WHEN 1 THEN 4 ELSE 3 END AS depth, {whole('price_from')} AS price_from, {whole('beds')} AS beds, suburb,
  1 + CAST(floorplan AS BIGINT) AS n_images FROM listings""", LISTINGS)
RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY brief_id ORDER BY score DESC, id) AS pos FROM dec QUALIFY pos <= 10)"
add("ranked_properties", "SELECT brief_id, pos AS rank, id, score AS fit FROM ranked WHERE pos <= 5", DECISIONS, RANKED)
add("folio", f"""SELECT brief_id, pos AS position, id, headline, address_display AS address, price_display AS price,
  CAST(beds AS INT) || ' bed · ' || CAST(baths AS INT) || ' bath · ' || CAST(cars AS INT) || ' car · ' || property_type AS config, 'photo.jpg' AS hero,
  CASE WHEN floorplan THEN 'floorplan.jpg' END AS floorplan, score AS fit, {rounded('hard', 2)} AS brief_match, {rounded('budget', 2)} AS budget_fit, {rounded('lens', 2)} AS lens_fit,
  {rounded('liked', 2)} AS preference_match, {rounded('pen', 2)} AS penalty, fairness, conf AS confidence, top_risk, action AS next_action FROM ranked""", DECISIONS, RANKED)
FOLIO_PEOPLE = """
stored AS (SELECT id, list_aggregate(list_sort(list(name || coalesce(':' || tel, ''))), 'string_agg', '|') AS names, bool_or(TRUE) AS any_stored FROM (
  SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS id, s_name AS name, CASE s_suppkey % 3 WHEN 0 THEN '04' || s_suppkey WHEN 1 THEN '02' || s_suppkey END AS tel
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey) GROUP BY id),
stored_times AS (SELECT CAST(user_id AS VARCHAR) AS id, count(DISTINCT strftime(ts, '%Y-%m-%dT%H:00:00')) AS n, min(strftime(ts, '%Y-%m-%dT%H:00:00')) AS first FROM events WHERE event_id % 2 = 0 GROUP BY 1)"""
add("folio_people", """SELECT brief_id, pos AS position, r.id, CASE WHEN has_agent AND has_contact THEN 'Agent ' || (k % 50) || ':0400000000' WHEN s.id IS NOT NULL THEN names
    WHEN has_agent THEN 'Agent ' || (k % 50) ELSE '' END AS people, 1::BIGINT AS n_photos, CASE WHEN has_visit THEN 1 ELSE coalesce(t.n, 0) END AS n_times,
  CASE WHEN has_visit THEN last_seen || 'T10:00:00' ELSE t.first END AS first_time FROM ranked r LEFT JOIN stored s ON s.id = r.id LEFT JOIN stored_times t ON t.id = r.id""", DECISIONS, RANKED, FOLIO_PEOPLE)
_SERIOUS = "top_severity IN ('dealbreaker', 'major')"
RECOMMEND = f"""
notes AS (SELECT *, CASE WHEN conf = 'none' THEN 'low' ELSE conf END AS overall, list_filter([
    CASE WHEN conf IN ('none', 'low') OR nn < 4 THEN 'The comparables are thin; the price read may change.' END,
    CASE WHEN critical_count > 0 THEN 'Critical checks are still open.' END,
    CASE WHEN {_SERIOUS} THEN 'One risk may outweigh the rest: ' || top_risk || '.' END,
    CASE WHEN breaker THEN 'The advice is to pass unless new facts turn up.' END], lambda x: x IS NOT NULL) AS why,
  CASE WHEN breaker THEN action || ' · ' || deadline || ' · ' || CASE top_risk WHEN 'Parking shortfall' THEN 'The brief asks for ' || cars_min || ' or more car spaces.' ELSE 'The text names a planning overlay; check it with the council.' END
    WHEN has_visit THEN action || ' · next open · Judge light, noise, state and layout on the spot.'
    ELSE action || ' · today · There is no open time to go to.' END AS step FROM ranked)"""
add("recommendation", f"""SELECT a.brief_id, a.id AS standout, 'Lead with ' || a.address_display || '. Its fit is the best at ' || printf('%.1f', a.score) || '/10.' AS summary, a.overall AS confidence,
  'Price read: ' || a.fairness || '.|Risk read: ' || a.top_risk || '.' AS reasons, CASE WHEN a.{_SERIOUS} THEN a.top_severity || ': ' || a.top_risk ELSE '' END AS watch,
  a.step || '|Keep warm: ' || b.address_display || ' in case the first choice falls through.|Keep warm: ' || c.address_display || ' in case the first choice falls through.' AS next_actions,
  CASE WHEN len(a.why) > 0 THEN list_aggregate(a.why[1:3], 'string_agg', '|') WHEN a.overall <> 'high' THEN 'The pick is sound but not certain.' ELSE '' END AS why_wrong
  FROM notes a JOIN notes b ON b.brief_id = a.brief_id AND b.pos = 2 JOIN notes c ON c.brief_id = a.brief_id AND c.pos = 3 WHERE a.pos = 1""", DECISIONS, RANKED, RECOMMEND)
add("actions", """SELECT brief_id, id, list_aggregate(list_filter([CASE WHEN breaker THEN 'pass' END, CASE WHEN has_visit THEN 'inspect' ELSE 'contact_agent' END,
  CASE WHEN renting THEN 'prepare_application' END, CASE WHEN renting THEN 'ask_property_manager' END, CASE WHEN NOT renting AND buying THEN 'request_contract' END,
  CASE WHEN NOT renting AND buying AND small THEN 'request_strata' END, CASE WHEN renting THEN NULL WHEN conf IN ('none', 'low') THEN 'run_comps' WHEN fairness IN ('stretched', 'overpriced') THEN 'price_discipline' END],
  lambda x: x IS NOT NULL), 'string_agg', '|') AS actions, action AS best FROM dec""", TEXT_DECISIONS)
add("digest", """SELECT section, row_number() OVER (PARTITION BY section ORDER BY hunt, id) AS rank, hunt, id, coalesce(why_now, '') AS why_now FROM diff LEFT JOIN why_now USING (id)
  WHERE section IS NOT NULL QUALIFY rank <= 3""", ALL_EVENTS, DIFF.format(events="ev"), WHY)
SHIPMENTS = """
smembers AS (SELECT 'search-' || (l_suppkey % 5) AS hunt, date_trunc('quarter', l_shipdate) + INTERVAL 3 MONTH AS run_at, CAST(l_orderkey AS VARCHAR) AS id, max(l_quantity) > 48 AS off
  FROM lineitem GROUP BY ALL),
slast AS (SELECT hunt, run_at, prev_at FROM (SELECT hunt, run_at, lag(run_at) OVER w AS prev_at, row_number() OVER (PARTITION BY hunt ORDER BY run_at DESC) AS r
  FROM (SELECT DISTINCT hunt, run_at FROM smembers) WINDOW w AS (PARTITION BY hunt ORDER BY run_at)) WHERE r = 1),
smoved AS (SELECT id, max(ts) AS moved_at FROM (SELECT CAST(l_orderkey AS VARCHAR) AS id, l_shipdate AS ts, round_even(l_extendedprice, 0) AS v,
  lag(round_even(l_extendedprice, 0)) OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pv FROM lineitem) WHERE v <> pv GROUP BY id),
sspans AS (SELECT hunt, id, min(run_at) AS f, max(run_at) AS l, arg_max(off, run_at) AS off FROM smembers GROUP BY ALL),
sdiff AS (SELECT hunt, id, CASE WHEN l < run_at THEN 'stale' WHEN f = run_at AND NOT off THEN 'new' WHEN f < run_at AND NOT off AND moved_at > prev_at THEN 'changed' END AS section
  FROM sspans JOIN slast USING (hunt) LEFT JOIN smoved USING (id))"""
add("digest_scored", """SELECT section, row_number() OVER (PARTITION BY section ORDER BY CASE WHEN section = 'new' THEN score ELSE 0 END DESC, hunt, id) AS rank, hunt, id, score FROM (
  SELECT section, hunt, d.id, CASE WHEN section = 'new' THEN coalesce(b.score, 0e0) ELSE coalesce(n.score, 0e0) END AS score FROM sdiff d LEFT JOIN (SELECT id, max(score) AS score FROM dec GROUP BY id) b ON b.id = d.id
  LEFT JOIN (SELECT id, max(score) AS score FROM dec WHERE id IN (SELECT id FROM sdiff WHERE section = 'new') GROUP BY id) n ON n.id = d.id WHERE section IS NOT NULL)
  QUALIFY rank <= 20""", DECISIONS, SHIPMENTS)
add("card_summaries", "SELECT id, price_display AS price, address_display AS address, beds, baths, cars, url FROM listings", LISTINGS)

# ---- inspections and facts --------------------------------------------------------

VISITS = """
visits AS (SELECT event_type AS brief_id, CAST(event_id AS VARCHAR) AS id, n_name AS suburb, user_id || ' Example St' AS address, ts AS start, CAST(ts AS DATE) AS day,
  CASE WHEN event_id % 10 <> 0 THEN date_trunc('second', ts) + to_minutes(CAST(floor(value) AS BIGINT)) END AS fin, value AS fit, event_id % 8 = 0 AS pass
  FROM events JOIN nation ON n_nationkey = user_id % 25),
days AS (SELECT brief_id, day, count(*) AS n, row_number() OVER (PARTITION BY brief_id ORDER BY dayofweek(day) = 6 DESC, count(*) DESC, day) AS r FROM visits GROUP BY brief_id, day QUALIFY r = 1)"""
add("inspection_days", "SELECT brief_id, CAST(day AS VARCHAR) AS day, n FROM days", VISITS)
add("inspection_run", """SELECT brief_id, CAST(day AS VARCHAR) AS day, id, epoch_us(start) AS start_us, epoch_us(fin) AS end_us, CAST(coalesce(start < pfree, false) AS BIGINT) AS clash,
  CASE WHEN psub IS NULL THEN 'Start here.' WHEN psub = suburb THEN 'Stay in ' || suburb || '.' ELSE 'Move from ' || psub || ' to ' || suburb || '; confirm travel time.' END AS travel_note,
  CASE WHEN pass THEN 'skip' WHEN fit >= 8 THEN 'must inspect' WHEN fit >= 7 THEN 'strong backup' ELSE 'optional' END AS priority
  FROM (SELECT v.*, lag(coalesce(fin, start)) OVER w AS pfree, lag(suburb) OVER w AS psub FROM visits v JOIN days USING (brief_id, day) WINDOW w AS (PARTITION BY v.brief_id ORDER BY start, suburb, address, id))""", VISITS)
add("inspection_summary", """SELECT suburb AS brief_id, CAST(day AS VARCHAR) AS day, n AS stops, n - 1 AS clashes, unscheduled, n || ' scheduled inspections' || CASE WHEN n > 1 THEN ' · ' || (n - 1) || ' clash(es)' ELSE '' END
    || CASE WHEN unscheduled > 0 THEN ' · ' || unscheduled || ' need agent follow-up' ELSE '' END AS summary
  FROM (SELECT suburb, last_seen AS day, count(*) AS n, row_number() OVER (PARTITION BY suburb ORDER BY dayofweek(last_seen) = 6 DESC, count(*) DESC, last_seen) AS r FROM listings WHERE has_visit GROUP BY suburb, last_seen QUALIFY r = 1)
  JOIN (SELECT suburb, count(*) FILTER (NOT has_visit) AS unscheduled FROM listings GROUP BY suburb) USING (suburb)""", LISTINGS)
FACTS = f"""
facts AS (SELECT CAST(o_custkey AS VARCHAR) AS key, 'Segment ' || o_orderstatus AS label, CASE WHEN o_orderkey % 10 <> 0 THEN CAST({whole('o_totalprice')} AS VARCHAR) END AS value,
  strftime(o_orderdate, '%Y-%m-%d') AS observed_at, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate - INTERVAL 10 DAY, '%-d %b %Y') END AS published_at,
  CASE WHEN o_orderkey % 4 = 0 THEN 365 END AS freshness_days, CAST(o_orderdate AS DATE) - CASE WHEN o_orderkey % 3 = 0 THEN 10 ELSE 0 END AS anchor
  FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
judged AS (SELECT *, CASE WHEN value IS NULL THEN 'unknown' WHEN DATE '2001-08-02' - anchor > coalesce(freshness_days, 45) THEN 'stale' ELSE 'fresh' END AS status FROM facts)"""
add("fact_latest", "SELECT key, label, value, observed_at, published_at, CAST(freshness_days AS BIGINT) AS freshness_days FROM facts", FACTS)
add("fact_freshness", "SELECT key, status FROM judged", FACTS)
add("fact_citations", "SELECT key, label || coalesce(' ' || value, '') || ' — orders · ' || coalesce(published_at, observed_at) AS citation FROM facts", FACTS)
add("source_status", """SELECT label, facts, stale, unknown, CASE WHEN stale + unknown > 0 THEN 'needs_review' ELSE 'fresh' END AS status,
  concat_ws('|', CASE WHEN stale > 0 THEN stale || ' market source(s) are stale.' END, CASE WHEN unknown > 0 THEN unknown || ' market source(s) could not be freshness-checked.' END) AS warnings
  FROM (SELECT label, count(*) AS facts, count(*) FILTER (status = 'stale') AS stale, count(*) FILTER (status = 'unknown') AS unknown FROM judged GROUP BY label)""", FACTS)
add("page_facts", " UNION ALL ".join(
    f"SELECT page_id, {q(p['key'])} AS key, nullif(trim(regexp_extract(html, {q('(?is)' + p['pattern'])}, 1)), '') AS value, CASE WHEN nullif(trim(regexp_extract(html, {q('(?is)' + p['pattern'])}, 1)), '') IS NULL THEN {q(vocab.FACT_NOT_FOUND)} END AS notes FROM pages"
    for p in PAGE_PATTERNS))

# ---- pages ------------------------------------------------------------------------

_any = lambda ms: "(" + " OR ".join(f"contains(h, {q(m)})" for m in ms) + ")"
add("page_class", f"""SELECT page_id, sha256(url) AS page_key, CAST(st AS BIGINT) AS structured, CAST(mk AS BIGINT) AS marked, CAST(NOT st AND (mk OR length(h) < 20000) AS BIGINT) AS denied,
  CASE WHEN {_any(vocab.CHALLENGE_MARKERS)} THEN 'akamai_challenge' WHEN mk THEN 'access_denied' WHEN length(h) < 200 THEN 'browser_down' WHEN st THEN 'empty_shell' WHEN length(h) < 20000 THEN 'akamai_challenge' ELSE 'ok' END AS page_class
  FROM (SELECT *, {_any(vocab.STRUCTURED_MARKERS)} AS st, {_any(vocab.BLOCK_MARKERS)} AS mk FROM (SELECT page_id, url, lower(html) AS h FROM pages))""")
add("page_titles", r"SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title FROM pages")
add("page_status", f"""SELECT 'https://listings.example/sale/page-' || no AS url, 'ok' AS status, '' AS markers, no * 3 + 40 AS search_result_count, n AS returned,
  list_aggregate(CASE WHEN no % 3 = 0 THEN list_reverse_sort(ids)[1:5] ELSE list_sort(ids)[1:5] END, 'string_agg', '|') AS sample
  FROM (SELECT o_orderkey // 20 AS no, count(*) AS n, list(CAST(o_orderkey + 10000 AS VARCHAR)) AS ids FROM orders GROUP BY ALL)
  UNION ALL SELECT url, CASE WHEN st = '' THEN 'blocked' ELSE 'blocked' END, CASE WHEN length(h) < 20000 OR {_any(vocab.BLOCK_MARKERS)} THEN {case([(_any(vocab.CHALLENGE_MARKERS), q('akamai_challenge')), (_any(vocab.BLOCK_MARKERS), q('access_denied')), ('length(h) < 200', q('browser_down'))], q('akamai_challenge'))} ELSE 'blocked' END, NULL, 0, ''
  FROM (SELECT url, '' AS st, lower(html) AS h FROM pages)""")
add("page_cards", """SELECT 'https://listings.example/sale/page-' || (k // 20) AS source_url,
  CASE WHEN (k // 20) % 3 = 0 THEN count(*) OVER (PARTITION BY k // 20) - row_number() OVER w ELSE row_number() OVER w - 1 END AS position,
  CAST(k + 10000 AS VARCHAR) AS id, 'listing' AS listing_type, 'https://listings.example/' || (k + 10000) AS url, price_display, suburb, postcode, beds, CASE WHEN cars = 0 THEN 1e0 ELSE cars END AS cars, property_type,
  CASE WHEN floorplan THEN 2 ELSE 1 END AS images, CAST(has_agent AS BIGINT) AS agents, CASE WHEN mode = 'sold' THEN CAST(last_seen AS VARCHAR) END AS off_date, 'captured_search_pages' AS source_provider, 1 AS sources
  FROM listings WINDOW w AS (PARTITION BY k // 20 ORDER BY k)""", LISTINGS)
add("source_cards", """SELECT 'https://listings.example/sale/page-' || (k // 20) AS source_url,
  CASE WHEN (k // 20) % 3 = 0 THEN count(*) OVER (PARTITION BY k // 20) - row_number() OVER w ELSE row_number() OVER w - 1 END AS position,
  CAST(k + 10000 AS VARCHAR) AS id, 'listing' AS listing_type, 'https://listings.example/' || (k + 10000) AS url, price_display, suburb, beds, 'captured_search_pages' AS source_provider
  FROM listings WINDOW w AS (PARTITION BY k // 20 ORDER BY k)""", LISTINGS)
add("source_searches", """SELECT 'search-' || c_custkey AS name, n_name AS suburb, CAST(c_custkey % 50 AS BIGINT) AS max_items, CAST(c_custkey % 4 AS BIGINT) AS beds_min,
  CAST(coalesce(sum(s.c), 0) AS BIGINT) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey
  LEFT JOIN (SELECT suburb, beds, count(*) AS c FROM listings WHERE mode = 'sale' GROUP BY suburb, beds) s ON s.suburb = n_name AND s.beds >= c_custkey % 4
  WHERE c_custkey % 5 <> 0 GROUP BY c_custkey, n_name""", LISTINGS)
add("stored_versions", """SELECT id, suburb, price_from, CAST(beds AS DOUBLE) AS beds, CASE WHEN k % 3 = 0 THEN 'listing' WHEN k % 5 > 0 THEN listing_type END AS listing_type,
  CASE WHEN k % 3 < 2 THEN 'unknown' WHEN k % 5 > 0 THEN status END AS status, CAST(k % 3 + 1 AS BIGINT) AS version FROM listings""", LISTINGS)
add("page_details", """SELECT CAST(k + 10000 AS VARCHAR) AS id, status, 'https://listings.example/' || (k + 10000) AS url, headline, price_display, price_from, price_to, suburb, beds,
  CASE WHEN cars = 0 THEN 1e0 ELSE cars END AS cars, property_type, sold_price, CASE WHEN sold_price IS NOT NULL THEN CAST(sold_date AS VARCHAR) END AS sold_date,
  CASE WHEN sold_price IS NOT NULL THEN sale_method END AS sale_method, CAST(floorplan AS BIGINT) AS floorplan,
  CASE WHEN has_agent THEN 'Agent ' || (k % 50) || CASE WHEN has_contact THEN ':0400000000' ELSE '' END ELSE '' END AS people,
  CASE WHEN has_visit THEN last_seen || 'T10:00:00/' || last_seen || 'T10:30:00' ELSE '' END AS times, f1 || '|' || f2 AS features FROM listings""", LISTINGS)
add("page_open_homes", """SELECT 'https://listings.example/sale/page-' || (o_orderkey // 20) AS source_url, 'Open home' AS type, '2026-06-06' AS start_date, (min(o_orderkey) + 10000) || ' Example St' AS address FROM orders GROUP BY o_orderkey // 20""")
add("daily_report", """SELECT source_url, item, id, CAST(item <= 5 AS BIGINT) AS enriched, CASE WHEN item <= 5 THEN headline END AS headline, CASE WHEN item <= 5 THEN price_from END AS price_from, beds FROM (
  SELECT 'https://listings.example/sale/page-' || (k // 20) AS source_url, CAST(k + 10000 AS VARCHAR) AS id, headline, price_from, beds,
    row_number() OVER (PARTITION BY k // 20 ORDER BY CASE WHEN (k // 20) % 3 = 0 THEN -k ELSE k END) AS item FROM listings) WHERE item <= 12""", LISTINGS)

# ---- streams ----------------------------------------------------------------------

# what the watermark (latest event minus a day) has closed
add("stream_vanished", """SELECT id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts) + INTERVAL 12 HOUR) AS vanished_us, count(*) AS sightings FROM (
  SELECT *, sum(brk) OVER (PARTITION BY id ORDER BY ts, event_id) AS grp FROM (SELECT CAST(user_id AS VARCHAR) AS id, ts, event_id,
    CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS brk FROM events))
  GROUP BY id, grp HAVING max(ts) + INTERVAL 12 HOUR <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 DAY FROM events)""")
add("stream_supply", """SELECT event_type AS hunt, epoch_us(date_trunc('day', ts) + INTERVAL 1 DAY) AS run_us, count(DISTINCT user_id) AS total_results FROM events
  GROUP BY ALL HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""".replace("GROUP BY ALL", "GROUP BY event_type, date_trunc('day', ts)"))
