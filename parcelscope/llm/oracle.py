"""DuckDB SQL of the queries that SQL can express."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP3 = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""

OP6 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END AS bag FROM d),
c AS (SELECT doc_id, len(bag) AS n_bag, min(CASE WHEN len(bag) > 0 THEN doc_id END) OVER (PARTITION BY list_sort(bag)) AS copy FROM s),
g AS (SELECT DISTINCT doc_id, unnest(bag) AS g FROM s),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM both_ JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 5 * k >= 4 * (na.n + nb.n - k)),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
root AS (SELECT a, least(a, min(b)) AS r FROM reach GROUP BY a),
cnt AS (SELECT a, count(*) AS n_links, count(DISTINCT cb.copy) FILTER (cb.copy <> ca.copy) AS n_linked_texts
        FROM links JOIN c ca ON ca.doc_id = a JOIN c cb ON cb.doc_id = b GROUP BY a)
SELECT c.doc_id, coalesce(r, c.doc_id) AS class_id, coalesce(copy, c.doc_id) AS copy_id,
       coalesce(n_links, 0) AS n_links, coalesce(n_linked_texts, 0) AS n_linked_texts
FROM c LEFT JOIN root ON root.a = c.doc_id LEFT JOIN cnt ON cnt.a = c.doc_id
"""

#: A level settles all targets: sources are capped in the order of cap / weight, until one is not.
OP7 = f"""
WITH d AS (SELECT doc_id, source, len({WORDS}) AS size,
      greatest(0.25::DOUBLE, 1.0::DOUBLE - 10.0::DOUBLE * ((length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>!]', '', 'g')))::DOUBLE / greatest(length(coalesce(text, '')), 1)::DOUBLE)) AS q,
      (('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM documents),
k AS (SELECT *, -ln(u) / q AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
w AS (SELECT *, [1.0, 2.0, 3.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w, 3 * source_size AS cap FROM s),
o AS (SELECT *, row_number() OVER z AS nth,
      (sum(source_size) OVER () - coalesce(sum(cap) OVER (z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
      / (sum(w) OVER () - coalesce(sum(w) OVER (z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level
      FROM w WINDOW z AS (ORDER BY cap::DOUBLE / w, source NULLS LAST)),
f AS (SELECT arg_min(level, nth) AS fits FROM o WHERE level * w <= cap),
t AS (SELECT source, source_size, least(cap::DOUBLE, coalesce(fits * w, cap::DOUBLE)) AS target FROM o, f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS times FROM t),
r AS (SELECT *, floor(target - times * source_size + 0.5)::BIGINT AS rest FROM e)
SELECT doc_id, size, source_size, target, (times * size + least(size, greatest(0, rest - coalesce(sum(size) OVER
      (PARTITION BY k.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))))::BIGINT AS taken
FROM k JOIN r ON k.source IS NOT DISTINCT FROM r.source
"""

#: CRC-32 is taken byte by byte over the table of its reflected polynomial.
OP8 = """
WITH RECURSIVE step AS (SELECT i::BIGINT AS i, i::BIGINT AS v, 0 AS k FROM range(256) q(i)
      UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM step WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS tab FROM step WHERE k = 8),
d AS (SELECT doc_id, source, strlen(coalesce(text, '')) + 1 AS size, md5('23:' || coalesce(doc_id::VARCHAR, 'null')) AS mark,
      xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) AS text_crc32 FROM documents, tab),
r AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY mark, doc_id) - 1 + 0.5::DOUBLE) / count(*) OVER (PARTITION BY source) AS share FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY share, source NULLS LAST, mark, doc_id) - 1 AS place, count(*) OVER () AS n FROM r),
q AS (SELECT *, (place * 8 // n)::INTEGER AS shard FROM p)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard, (place - (shard * n + 7) // 8)::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM q
"""

CRC_TABLE = """step AS (SELECT i::BIGINT AS i, i::BIGINT AS v, 0 AS k FROM range(256) q(i)
      UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM step WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS tab FROM step WHERE k = 8)"""


def crc32(text: str) -> str:
    """CRC-32 of a text, beside ``tab``."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295::BIGINT)"


def moved(state: str, cost: str, op: str, line: str | None = None) -> str:
    """A way (cost, audit, lines) after one more edit."""
    lines = f"{state}.l" if line is None else f"list_append({state}.l, {line})"
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{op}', 'l': {lines}}}"


def best(*ways: str) -> str:
    return f"list_sort([{', '.join(ways)}])[1]"


def written(state: str, to: str, name: str) -> str:
    """Keep or rerole a row so that it becomes one of the named role."""
    keep = f"CASE WHEN code < 8 AND code % 4 = {to} THEN {moved(state, '(code // 4)', 'K', 'line')} ELSE {{'c': 1000000::BIGINT, 'a': '', 'l': []::VARCHAR[]}} END"
    change = f"CASE WHEN code < 8 THEN {moved(state, '(2 + code // 4)', 'R', f"'{name}:' || text")} ELSE {{'c': 1000000::BIGINT, 'a': '', 'l': []::VARCHAR[]}} END"
    return f"{keep}, {change}"


NO_WAY = "{'c': 1000000::BIGINT, 'a': '', 'l': []::VARCHAR[]}"

#: s0 to s3: the best way to each state (nothing, system, user, assistant last) after row i; ways compare by cost, then audit.
OP11 = rf"""
WITH RECURSIVE {CRC_TABLE},
c AS (SELECT conv_id, coalesce(conv_id::VARCHAR, ' ') AS key, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations),
f AS (SELECT c.*, {crc32("key || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS f FROM c, tab),
r AS (SELECT key, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
      CASE WHEN f = 1 THEN '' WHEN f = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM f, range(2) q(copy) WHERE f <> 0 AND (copy = 0 OR f = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM r),
m AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY key, role, text ORDER BY i) > 1 AS again,
      NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut, coalesce(list_position(['s', 'u', 'a'], substr(role, 1, 1)), 4) - 1 AS cls FROM o),
n AS (SELECT *, CASE WHEN blank OR again THEN 8 ELSE cls + 4 * cut::INTEGER END AS code, role || ':' || text AS line,
      lag(substr(role, 1, 1)) OVER (PARTITION BY key ORDER BY i) || substr(role, 1, 1) AS pair FROM m),
w AS (SELECT DISTINCT key, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 'l': []::VARCHAR[]}} AS s0, {NO_WAY} AS s1,
      {{'c': 2::BIGINT, 'a': 'I', 'l': ['user:']}} AS s2, {{'c': 4::BIGINT, 'a': 'II', 'l': ['user:', 'assistant:']}} AS s3 FROM c
      UNION ALL SELECT key, i, n0, n1, m2, {best("n3", moved("m2", "2", "I", "'assistant:'"))} FROM (SELECT *,
      {best("n2", *[moved(f"n{k}", "2", "I", "'user:'") for k in (0, 1, 3)])} AS m2 FROM (SELECT n.key, n.i, {moved("s0", "3", "D")} AS n0,
      {best(moved("s1", "3", "D"), f"CASE WHEN code < 8 AND code % 4 = 0 THEN {moved('s0', '(code // 4)', 'K', 'line')} ELSE {NO_WAY} END")} AS n1,
      {best(moved("s2", "3", "D"), *[written(f"s{k}", "1", "user") for k in (0, 1, 3)])} AS n2,
      {best(moved("s3", "3", "D"), written("s2", "2", "assistant"))} AS n3 FROM w JOIN n ON n.key = w.key AND n.i = w.i + 1))),
z AS (SELECT key, arg_max({best("s0", "s3")}, i) AS z FROM w GROUP BY key),
t AS (SELECT key, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank::BIGINT) AS blank, sum((again AND NOT blank)::BIGINT) AS duplicate,
      sum((cut AND code < 8)::BIGINT) AS truncated, sum((pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au'))::BIGINT) AS illegal FROM n GROUP BY key)
SELECT q.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
      coalesce(illegal, 0)::BIGINT AS illegal, z.c AS cost, z.a AS audit, sha256(coalesce(array_to_string(z.l, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, key FROM c) q JOIN z USING (key) LEFT JOIN t USING (key)
"""


def hashed_leaf(text: str) -> str:
    parts = ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)
    return "sha256(" + " || ".join(f"coalesce(strlen({p}) || ':' || {p}, '-')" for p in parts) + ")"


def tree_levels(name: str, start: str) -> str:
    """All nodes (t, k, p, h) of trees whose leaves ``start`` gives, n nodes on level k; with what stands beside each one."""
    beside = "string_agg(h, '') OVER (PARTITION BY t, k, p // 8 ORDER BY p ROWS BETWEEN"
    return f"""{name} AS (SELECT t, 0 AS k, p, h, n FROM {start} UNION ALL
      SELECT t, k + 1, p // 8, sha256(string_agg(h, '' ORDER BY p)), (max(n) + 7) // 8 FROM {name} WHERE n > 1 GROUP BY t, k, p // 8),
{name}_sides AS (SELECT t, k, p, coalesce({beside} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
      coalesce({beside} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name} WHERE n > 1)"""


OP12 = f"""
WITH RECURSIVE {CRC_TABLE},
d AS (SELECT doc_id, coalesce('+' || lang, '') AS t, {hashed_leaf("text")} AS h,
      CASE WHEN {crc32("doc_id::VARCHAR")} % 3 = 0 THEN {hashed_leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS other FROM documents, tab),
leaf AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, h) - 1 AS p, count(*) OVER (PARTITION BY t) AS n FROM d),
{tree_levels("low", "leaf")},
sub AS (SELECT t AS name, '' AS t, h, row_number() OVER (ORDER BY t) - 1 AS p, count(*) OVER () AS n FROM low WHERE n = 1),
{tree_levels("high", "sub")},
root AS (SELECT h AS root FROM high WHERE n = 1),
steps AS (SELECT leaf.t, leaf.p, s.k, s.l, s.r FROM leaf JOIN low_sides s ON s.t = leaf.t AND s.p = leaf.p // (8 ** s.k)::BIGINT
      UNION ALL SELECT leaf.t, leaf.p, 100 + s.k, s.l, s.r FROM leaf JOIN sub ON sub.name = leaf.t JOIN high_sides s ON s.p = sub.p // (8 ** s.k)::BIGINT),
ways AS (SELECT t, p, list({{'l': l, 'h': '', 'r': r}} ORDER BY k) AS way FROM steps GROUP BY t, p),
folded AS (SELECT leaf.doc_id, leaf.h AS leaf, sub.h AS subroot, root, coalesce(array_to_string(list_transform(way, lambda s: s.l || s.r), ''), '') AS siblings,
      list_reduce(list_prepend({{'l': '', 'h': coalesce(other, leaf.h), 'r': ''}}, coalesce(way, [])), lambda a, b: {{'l': '', 'h': sha256(b.l || a.h || b.r), 'r': ''}}).h AS folded_root
      FROM leaf JOIN sub ON sub.name = leaf.t JOIN root ON true LEFT JOIN ways ON ways.t = leaf.t AND ways.p = leaf.p)
SELECT doc_id, leaf, subroot, root, sha256(siblings) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""

ORACLE = {"op3_exact_dedup": OP3, "op6_jaccard": OP6, "op7_mix": OP7, "op8_shard": OP8, "op11_repair": OP11, "op12_manifest": OP12}
