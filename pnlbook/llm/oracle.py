"""DuckDB SQL for the operators that SQL can express, written on its own."""

from __future__ import annotations

from html.entities import html5

OP5 = r"""
WITH words AS (
  SELECT doc_id, coalesce(text, '') AS t,
         [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0b\f\r]+') IF x <> ''] AS w,
         [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^ \t\n\x0b\f\r]')] AS l
  FROM documents),
windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM words WHERE len(w) >= 8),
keyed AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS k FROM windows),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM keyed),
runs AS (
  SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS own
  FROM twice WHERE c > 1),
repeats AS (SELECT doc_id, sum(own) AS n FROM runs GROUP BY doc_id),
base AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) AS BIGINT) AS n_lines,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM words LEFT JOIN repeats USING (doc_id)),
bits AS (
  SELECT *, CAST((n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT
         + 4 * (10 * n_symbols > n_words)::INT
         + 8 * (n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines)::INT
         + 16 * (word_chars > 14 * n_words)::INT + 32 * (word_chars < 2 * n_words)::INT AS BIGINT) AS fail_bits
  FROM base)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, fail_bits = 0 AS kept FROM bits
"""

SQL: dict[str, str] = {"op5_rule_ledger": OP5}


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


# every name of HTML5, in hexadecimal so that the SQL stays plain ASCII
_NAMES = ", ".join(f"({_text(k)}, decode(unhex('{v.encode().hex()}')))" for k, v in html5.items())
_OPEN = "|".join(sorted((n for n in html5 if n[-1] != ";"), key=len, reverse=True))
_WESTERN = "[" + ", ".join(str(ord(bytes([c]).decode("cp1252", "ignore") or chr(c))) for c in range(128, 160)) + "]"


def _entities(sql: str) -> str:
    """Character references decoded: the text is cut at each ampersand (CTE names has the map m)."""
    head = r"regexp_extract(p, '^(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)')"
    digits = f"regexp_extract({head}, '^#[xX]?0*([0-9a-fA-F]*)', 1)"
    code = (f"CASE WHEN {head} ILIKE '#x%' THEN CASE WHEN length({digits}) > 6 THEN 2097152 ELSE coalesce(TRY_CAST('0x' || {digits} AS BIGINT), 0) END "
            f"ELSE CASE WHEN length({digits}) > 7 THEN 2097152 ELSE coalesce(TRY_CAST({digits} AS BIGINT), 0) END END")
    shown = (f"[CASE WHEN c BETWEEN 128 AND 159 THEN chr({_WESTERN}[c - 127]) WHEN c = 0 OR c BETWEEN 55296 AND 57343 OR c > 1114111 THEN chr(65533) "
             "WHEN c BETWEEN 1 AND 8 OR c BETWEEN 14 AND 31 OR c IN (11, 127) OR c BETWEEN 64976 AND 65007 OR c & 65534 = 65534 THEN '' "
             f"ELSE chr(CAST(c AS INTEGER)) END FOR c IN [{code}]][1]")
    begin = f"regexp_extract({head}, '^(?:{_OPEN})')"
    name = (f"coalesce(m[{head}], CASE WHEN {begin} <> '' THEN m[{begin}] || substr({head}, length({begin}) + 1) END, '&' || {head})")
    return (f"array_to_string(list_transform(string_split({sql}, '&'), lambda p, i: CASE WHEN i = 1 THEN p WHEN starts_with(p, '#') AND {head} <> '' "
            f"THEN {shown} || substr(p, length({head}) + 1) ELSE {name} || substr(p, length({head}) + 1) END), '')")


_URN = "'<urn:uuid:' || {0}[1:8] || '-' || {0}[9:12] || '-' || {0}[13:16] || '-' || {0}[17:20] || '-' || {0}[21:32] || '>'"
_CRLF = "chr(13) || chr(10)"
OP2 = rf"""
WITH names AS (SELECT map_from_entries(list(struct_pack(k := k, v := v))) AS m FROM (VALUES {_NAMES}) AS n(k, v)),
source AS (
  SELECT page_id, url AS target_uri, coalesce(html, '') AS h, sha256(coalesce(html, '')) AS d FROM pages),
response AS (
  SELECT *, md5('response|' || coalesce(page_id::VARCHAR, '') || '|' || coalesce(target_uri, '') || '|sha256:' || d) AS u,
    regexp_replace(h, '(?is)<!--.*?(?:-->|\z)|<script(?:[ \t\r\n\f/][^>]*)?>.*?(?:</script[ \t\r\n\f]*>|\z)|<style(?:[ \t\r\n\f/][^>]*)?>.*?(?:</style[ \t\r\n\f]*>|\z)', '', 'g') AS seen,
    regexp_replace(regexp_extract(h, '(?is)<title(?:[ \t\r\n\f][^>]*)?>(.*?)</title', 1), '</?[A-Za-z!?][^>]*>', '', 'g') AS raw_title,
    lower(regexp_extract(h, '(?i)<html[^>]*[ \t\r\n\f]lang=["'']?([A-Za-z0-9-]+)', 1)) AS lang,
    lower(regexp_extract(h, '(?i)<meta[^>]*charset=["'']?([A-Za-z0-9_-]+)', 1)) AS charset
  FROM source),
bare AS (
  SELECT *, regexp_replace(regexp_replace(seen, '(?i)</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|figcaption|footer|form|h[1-6]|head|header|hr|li|main|nav|ol|option|p|pre|section|table|td|th|title|tr|ul)(?:[ \t\r\n\f/][^>]*)?>', chr(10), 'g'), '</?[A-Za-z!?][^>]*>', '', 'g') AS b
  FROM response),
both_kinds AS (
  SELECT page_id, target_uri, {_URN.format('u')} AS refers_to, 'sha256:' || d AS payload_digest, 'metadata' AS warc_type, 'application/warc-fields' AS content_type,
    'title: ' || trim(regexp_replace({_entities('raw_title')}, '[\x00-\x20\x7F\x{{85}}\x{{A0}}\x{{2028}}\x{{2029}}]+', ' ', 'g'), ' ') || {_CRLF} || 'language: ' || lang || {_CRLF} || 'charset: ' || charset || {_CRLF} || 'source-status: HTTP/1.1 200 OK' || {_CRLF}
      || 'source-content-type: text/html; charset=utf-8' || {_CRLF} || 'source-payload-length: ' || strlen(h)::VARCHAR || {_CRLF}
      || 'source-payload-digest: sha256:' || d || {_CRLF} || 'source-header: Content-Type: text/html; charset=utf-8' || {_CRLF}
      || 'source-header: Content-Length: ' || strlen(h)::VARCHAR || {_CRLF} AS block FROM bare, names
  UNION ALL
  SELECT page_id, target_uri, {_URN.format('u')}, 'sha256:' || d, 'conversion', 'text/plain; charset=utf-8',
    regexp_replace(regexp_replace(regexp_replace({_entities('b')}, '[ \t\r\f\x{{A0}}]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+\z', '', 'g') FROM bare, names),
named AS (
  SELECT *, md5(warc_type || '|' || refers_to) AS m, 'sha256:' || sha256(block) AS block_digest, CAST(strlen(block) AS BIGINT) AS content_length,
    '2024-01-01T00:00:00Z' AS date FROM both_kinds),
ids AS (SELECT * EXCLUDE (m), {_URN.format('m')} AS record_id FROM named)
SELECT *, 'WARC/1.1' || {_CRLF} || 'WARC-Type: ' || warc_type || {_CRLF} || 'WARC-Record-ID: ' || record_id || {_CRLF} || 'WARC-Refers-To: ' || refers_to || {_CRLF}
  || CASE WHEN target_uri IS NULL THEN '' ELSE 'WARC-Target-URI: ' || regexp_replace(replace(replace(target_uri, chr(13), '%0D'), chr(10), '%0A'), '[\x00-\x1F\x7F]', '', 'g') || {_CRLF} END || 'WARC-Date: ' || date || {_CRLF}
  || 'WARC-Block-Digest: ' || block_digest || {_CRLF} || 'Content-Type: ' || content_type || {_CRLF}
  || 'Content-Length: ' || content_length::VARCHAR || {_CRLF} || {_CRLF} AS header
FROM ids
"""

OP7 = """
WITH ok AS (
  SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
pairs AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
  FROM ok q JOIN ok c ON q.r <> c.r AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

SQL |= {"op2_warc_derivatives": OP2, "op7_block_neighbours": OP7}

_CUT = r"[^A-Za-z0-9_.%-]"
OP11 = rf"""
WITH scheme AS (SELECT page_id, url, strpos(url, '://') AS k FROM pages),
rest AS (SELECT *, CASE WHEN k > 0 THEN substr(url, k + 3) ELSE '' END AS r FROM scheme),
cut AS (
  SELECT *, coalesce(translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') AS path FROM rest),
whole AS (SELECT *, host || substr(r, length(host) + 1) AS site, CASE WHEN k > 0 THEN substr(url, 1, k + 2) || host || substr(r, length(host) + 1) ELSE url END AS f FROM cut),
sites(h, p, action) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
best AS (
  SELECT url, arg_max(h || p, length(h || p)) AS rule, arg_max(action, length(h || p)) AS action
  FROM (SELECT DISTINCT url, host, path FROM whole) JOIN sites ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY url),
others AS (
  SELECT page_id, host, path, rule, action,
    CASE WHEN rule IS NOT NULL THEN NULL
      WHEN regexp_matches(f, '(?s)/de/.*utm_source=feed\z') THEN '/de/*utm_source=feed|'
      WHEN regexp_matches(site, '(?s)^([^/?#]*\.)?spam-farm\.example\.net/fr/') THEN '||spam-farm.example.net/fr/*'
      WHEN regexp_matches(f, '/login({_CUT}|\z)') THEN '/login^'
      WHEN regexp_matches(f, '(?s)/tag/.*/feed({_CUT}|\z)') THEN '/tag/*/feed^'
      WHEN regexp_matches(f, '{_CUT}replytocom=') THEN '^replytocom='
      WHEN regexp_matches(f, '(?s){_CUT}sessionid=.*&page=') THEN '^sessionid=*&page='
      WHEN regexp_matches(f, '(?s)^http://m\..*\.html\z') THEN '|http://m.*.html|'
      WHEN regexp_matches(site, '^([^/?#]*\.)?ads-track\.') THEN '||ads-track.'
      WHEN regexp_matches(site, '^([^/?#]*\.)?cheap-pills\.') THEN '||cheap-pills.'
      WHEN regexp_matches(site, '(?s)^([^/?#]*\.)?example\.net({_CUT}|\z).*\.html({_CUT}|\z)page=2&') THEN '||example.net^*.html^page=2&'
      WHEN regexp_matches(site, '^([^/?#]*\.)?spam-farm\.') THEN '||spam-farm.' END AS pattern
  FROM whole LEFT JOIN best USING (url))
SELECT page_id, host, path, rule, pattern,
  CASE WHEN rule IS NOT NULL THEN action WHEN pattern IS NULL OR pattern IN ('/de/*utm_source=feed|', '||spam-farm.example.net/fr/*') THEN 'allow' ELSE 'block' END AS verdict
FROM others
"""

SQL |= {"op11_url_rules": OP11}

OP12 = r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
words AS (
  SELECT *, [x FOR x IN regexp_split_to_array(t, '[ \t\n\x0b\f\r]+') IF x <> ''] AS w, min(doc_id) OVER (PARTITION BY t) AS first_id FROM texts),
fails AS (
  SELECT doc_id, part, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b,
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
    coalesce(first_id < doc_id, false) AS e FROM words),
listed AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    [x.f FOR x IN [{'f': 'A', 'v': a}, {'f': 'B', 'v': b}, {'f': 'C', 'v': c}, {'f': 'D', 'v': d}, {'f': 'E', 'v': e}] IF x.v] AS f
  FROM fails LEFT JOIN marks USING (doc_id)),
combos AS (SELECT part, good, toxic, f, count(*) AS n FROM listed GROUP BY ALL),
letters(l) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT v.l || w.l || x.l || y.l || z.l AS o FROM letters v, letters w, letters x, letters y, letters z
  WHERE len(list_distinct([v.l, w.l, x.l, y.l, z.l])) = 5),
steps AS (SELECT o, s, o[s:s] AS own, string_split(o[1:s - 1], '') AS before FROM orders, range(1, 6) AS r(s)),
counted AS (
  SELECT part, o AS filter_order, CAST(s AS INTEGER) AS step, own,
    sum(CASE WHEN NOT list_has_any(f, before) AND NOT list_contains(f, own) THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN NOT list_has_any(f, before) AND list_contains(f, own) THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN list_has_any(f, before) AND list_contains(f, own) THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN f = [own] THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN NOT list_has_any(f, before) AND list_contains(f, own) AND good THEN n ELSE 0 END) AS good_lost,
    sum(CASE WHEN NOT list_has_any(f, before) AND list_contains(f, own) AND toxic THEN n ELSE 0 END) AS toxic_lost
  FROM combos, steps GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM counted
"""

SQL |= {"op12_filter_audit": OP12}

# crc32 of decimal text as SQL: a table of the eight shifts of each byte, folded over the characters
OP13 = """
WITH table_(b, v) AS (
  SELECT b, list_reduce(list_prepend(b::UBIGINT, [0::UBIGINT, 1, 2, 3, 4, 5, 6, 7]), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)
  FROM range(256) AS r(b)),
lookup AS (SELECT list(v ORDER BY b) AS v FROM table_),
sorted AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS idx,
    coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT conv_id, count(*) AS own FROM sorted GROUP BY conv_id),
convs AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, own,
    CAST(xor(list_reduce(list_prepend(4294967295::UBIGINT, [ascii(c)::UBIGINT FOR c IN string_split(conv_id::VARCHAR, '')]),
      lambda x, c: xor(x >> 8, lookup.v[CAST(xor(x, c) & 255 AS BIGINT) + 1])), 4294967295::UBIGINT) % 9 AS BIGINT) AS h
  FROM sizes, lookup),
rebuilt AS (
  SELECT c.conv_id, s.idx AS depth, role, t FROM convs c JOIN sorted s ON s.conv_id = c.base AND s.idx <= c.h
  UNION ALL
  SELECT c.conv_id, s.idx - h + least(h, coalesce(b.own, 0)), role, t FROM convs c JOIN sorted s USING (conv_id) LEFT JOIN sizes b ON b.conv_id = c.base WHERE s.idx > h),
paths AS (
  SELECT conv_id, depth, t, sha256(string_agg(sha256(role) || sha256(t), '') OVER (PARTITION BY conv_id ORDER BY depth)) AS k FROM rebuilt
  UNION ALL SELECT conv_id, 0, '', '' FROM convs),
lengths AS (SELECT conv_id, max(depth) AS n FROM paths GROUP BY conv_id),
nodes AS (SELECT depth, k, min(conv_id) AS node, count(*) AS n_convs, any_value(strlen(t)) AS bytes FROM paths GROUP BY depth, k),
named AS (SELECT conv_id, depth, node, n_convs, bytes FROM paths JOIN nodes USING (depth, k)),
own AS (SELECT c.node, c.depth, p.node AS parent, c.n_convs, (c.n_convs - 1) * c.bytes AS saved
        FROM named c LEFT JOIN named p ON p.conv_id = c.conv_id AND p.depth = c.depth - 1 WHERE c.conv_id = c.node),
kids AS (SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM own WHERE depth > 0 GROUP BY ALL),
full_ AS (SELECT own.*, coalesce(n_children, 0) AS n_children FROM own LEFT JOIN kids USING (node, depth)),
totals AS (
  SELECT a.node, a.depth, sum(CASE WHEN u.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(u.saved) AS saved_tokens
  FROM full_ u JOIN named a ON a.conv_id = u.node AND a.depth <= u.depth GROUP BY ALL),
ends AS (
  SELECT node, depth, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS d FROM named JOIN lengths USING (conv_id) WHERE depth = n GROUP BY ALL)
SELECT f.node AS conv_id, f.depth, parent AS parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens,
  coalesce(d, sha256('')) AS ends_sha256
FROM full_ f JOIN totals USING (node, depth) LEFT JOIN ends USING (node, depth)
"""

SQL |= {"op13_centroid_trie": OP13}
