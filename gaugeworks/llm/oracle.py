"""DuckDB SQL for the queries that SQL can express."""

SQL: dict[str, str] = {}

_SPACE = r"[\x20\x09-\x0D]"

SQL["op3_line_dedup"] = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS pos FROM d),
k AS (SELECT doc_id, pos, line, translate(regexp_replace(regexp_replace(line, '^{_SPACE}+', ''), '{_SPACE}+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, pos, line, coalesce(f.keeper <> k.doc_id, false) AS dropped FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

SQL["op5_wacz_archives"] = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, p.d AS payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""

SQL["op7_suffix_automaton"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(8, len(ws)) AS size, array_to_string(ws[i:i + least(8, len(ws)) - 1], ' ') AS win
       FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 7) + 1)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, i, size, array_to_string(ws[i:i + size - 1], ' ') AS win FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM w, sizes WHERE len(ws) >= size)),
hits AS (SELECT DISTINCT doc_id, i, dw.size, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.size = bw.size),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM w LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id)
"""

_D = {"assign": r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", "access": "(AKIA[A-Z0-9]+)", "hex": "([0-9a-f]+)"}
_LEAST = {"assign": 12, "access": 18, "hex": 16}


def _spans(kind: str, rank: int) -> str:
    p = _D[kind]
    # places: the lengths of the gaps and matches before
    return f"""SELECT doc_id, source, t, {rank} AS rank, '{kind}' AS kind, value, s AS b, s + size AS e FROM (
  SELECT doc_id, source, t, unnest(m) AS size, unnest(v) AS value, unnest(list_transform(range(1, len(m) + 1), lambda i: list_sum(g[1:i]) + coalesce(list_sum(m[1:i - 1]), 0)))::BIGINT AS s
  FROM (SELECT doc_id, source, t, list_transform(regexp_extract_all(t, '{p}'), lambda x: length(x)) AS m, regexp_extract_all(t, '{p}', 1) AS v, list_transform(regexp_split_to_array(t, '{p}'), lambda x: length(x)) AS g FROM d)
) WHERE length(value) >= {_LEAST[kind]}"""


_RUNS = r"""SELECT doc_id, source, t, 3 AS rank, 'live' AS kind, value, s AS b, s + size AS e FROM (
  SELECT doc_id, source, t, unnest(m) AS size, unnest(v) AS value, unnest(list_transform(range(1, len(m) + 1), lambda i: list_sum(g[1:i]) + coalesce(list_sum(m[1:i - 1]), 0)))::BIGINT AS s
  FROM (SELECT doc_id, source, t, list_transform(regexp_extract_all(t, '[A-Za-z0-9+/_-]+'), lambda x: length(x)) AS m, regexp_extract_all(t, '[A-Za-z0-9+/_-]+') AS v, list_transform(regexp_split_to_array(t, '[A-Za-z0-9+/_-]+'), lambda x: length(x)) AS g FROM d)
) WHERE size >= 20 AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]')"""

SQL["op1_secret_ownership"] = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
base AS ({_spans("assign", 0)} UNION ALL {_spans("access", 1)} UNION ALL {_spans("hex", 2)}),
found AS (SELECT * FROM base UNION ALL {_RUNS}),
counted AS (SELECT value, count(DISTINCT coalesce(source, chr(0))) AS owners, count(DISTINCT t) AS texts FROM found GROUP BY value),
owned AS (SELECT value FROM counted WHERE texts < 10 AND (owners = 1 OR owners = 2 AND texts = 1)),
live AS (SELECT DISTINCT doc_id, 3 AS rank, 'live' AS kind, e - length(value) AS b, e FROM found JOIN owned USING (value)
  WHERE regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND len(list_distinct(string_split(value, ''))) >= 8
    AND NOT regexp_matches(lower(value), 'example|sample|dummy|test|changeme|placeholder|your|xxxx|0123|1234|abcd')),
b AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
  string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, rank) AS js FROM base GROUP BY doc_id),
a AS (SELECT doc_id, string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, rank, e) AS js, count(*) FILTER (WHERE kind = 'live') AS n_live
  FROM (SELECT doc_id, rank, kind, b, e FROM base UNION ALL SELECT doc_id, rank, kind, b, e FROM live) GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b.js, '')) AS base_sha256, coalesce(a.js, '') AS spans, coalesce(n_live, 0) AS n_live
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id)
"""

_DENSE = " || ".join(f"printf('%010x', coalesce(sum(CASE WHEN TAG = tag THEN ('0x' || substr(h, {1 + 10 * k}, 10))::BIGINT END), 0)::BIGINT & 1099511627775)" for k in range(6))


def _cut(unit: str, parts: str, long: int) -> str:
    marked = f"array_to_string(list_transform({parts}, lambda w: CASE WHEN substr(md5(w), 1, 1) IN ('0', '8') THEN w || chr(10) ELSE w END), '')"
    return f"unnest(CASE WHEN length({unit}) > {long} THEN string_split({marked}, chr(10)) ELSE [{unit}] END)"


def _near(k: int) -> str:
    least = f"coalesce(sum(least(n0, n{k})) FILTER (WHERE n0 > 0 AND n{k} > 0 AND s0 / n0 = s{k} / n{k}), 0)"
    return f"CASE WHEN coalesce(sum(n0 + n{k}), 0) = 0 THEN 1.0::DOUBLE ELSE {least}::DOUBLE / (sum(n0 + n{k}) - {least})::DOUBLE END"


_WORD = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+"
_COUNTS = ", ".join(f"count(*) FILTER (WHERE tag = {k}) AS n{k}, coalesce(sum(v) FILTER (WHERE tag = {k}), 0)::DOUBLE AS s{k}" for k in range(3))
SQL["op4_multiset_hash"] = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
o AS (SELECT doc_id, t, length(t) AS n, length(t) // 4 AS q, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS nt FROM d),
x AS (SELECT doc_id, n, t, substr(t, 1, n - q) || substr(nt, 1, q) AS et, nt FROM o),
texts AS (SELECT doc_id, 0 AS tag, t FROM x UNION ALL SELECT doc_id, 1 AS tag, et FROM x UNION ALL SELECT doc_id, 2 AS tag, nt FROM x),
-- a sentence's end goes with what stands before the cut
lines AS (SELECT doc_id, tag, unnest(regexp_split_to_array(regexp_replace(regexp_replace(t, '([.!?]) +', '\1' || chr(10), 'g'), '([。！？])', '\1' || chr(10), 'g'), '\n+')) AS u FROM texts),
pieces AS (SELECT doc_id, tag, {_cut("u", f"regexp_extract_all(u, '{_WORD}')", 200)} AS u FROM lines),
units AS (SELECT doc_id, tag, {_cut("u", "regexp_extract_all(u, '(?s).')", 1000)} AS u FROM pieces),
hashed AS (SELECT doc_id, tag, h, substr(h, 1, 5) AS lane, ('0x' || substr(h, 11, 10))::BIGINT & 4294967295 AS v FROM (SELECT doc_id, tag, sha256(u) AS h FROM units WHERE u <> '')),
f AS (SELECT doc_id, {_DENSE.replace("TAG", "0")} AS fp, {_DENSE.replace("TAG", "1")} AS efp FROM hashed GROUP BY doc_id),
lanes AS (SELECT doc_id, lane, {_COUNTS} FROM hashed GROUP BY doc_id, lane),
l AS (SELECT doc_id, {_near(1)} AS near_edited, {_near(2)} AS near_next FROM lanes GROUP BY doc_id)
SELECT x.doc_id, x.n::BIGINT AS n_chars, sha256(x.et) AS edited_sha256, coalesce(fp, repeat('0', 60)) AS fingerprint, coalesce(efp, repeat('0', 60)) AS edited_fingerprint,
  coalesce(near_edited, 1.0::DOUBLE) AS near_edited, coalesce(near_next, 1.0::DOUBLE) AS near_next
FROM x LEFT JOIN f USING (doc_id) LEFT JOIN l USING (doc_id)
"""
