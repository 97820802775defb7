"""The contracts that SQL can express, for DuckDB over the test tables."""

from __future__ import annotations

from . import licenses

OP1 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS pos, ws FROM w WHERE len(ws) >= 20),
g AS (SELECT doc_id, pos, array_to_string(ws[pos : pos + 19], ' ') AS k FROM p),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS nth FROM g),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS pos FROM r WHERE nth > 1),
one AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS pos, unnest(ws) AS word FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS t, count(*) AS n FROM one ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""

OP3 = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h),
v AS (SELECT p.*, first, list_transform(range(0, 8), lambda i: CAST('0x' || substr(p.h, 5 * CAST(i AS INTEGER) + 1, 5) AS BIGINT)) AS parts FROM p JOIN f USING (h))
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(parts, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x >> 15) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x >> 10) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x >> 5) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', x % 32 + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM v
"""

OP7 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(ws[s : s + n - 1], ' ') AS k FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS s FROM (SELECT *, least(13, len(ws)) AS n FROM b WHERE len(ws) > 0))),
dw AS (SELECT doc_id, s, n, array_to_string(ws[s : s + n - 1], ' ') AS k FROM (SELECT d.*, n, unnest(range(1, len(ws) - n + 2)) AS s FROM d CROSS JOIN (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n)),
m AS (SELECT doc_id, s, n, item_id FROM dw JOIN bw USING (n, k)),
h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""

OP9 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[p : p + 2], ' ') AS k FROM (SELECT *, unnest(range(1, greatest(len(ws) - 1, 2))) AS p FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT s.doc_id, s.k, n.n FROM s JOIN n USING (doc_id)),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM x a JOIN x b ON a.k = b.k AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM i WHERE 100 * c >= 85 * (na + nb - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id),
c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""

OP6 = """
WITH c AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS code FROM embeddings WHERE len(embedding) > 0),
p AS (SELECT q.vec_id AS query_id, n.vec_id AS neighbor_id,
        CAST(list_sum(list_transform(range(1, 65), lambda i: abs(q.code[i] - n.code[i]))) AS INTEGER) AS distance
      FROM c q JOIN c n ON q.vec_id <> n.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, neighbor_id, distance FROM r WHERE rank <= 10
"""

#: The text of the only article element of each given page, by its markup: blocks p and h1, markup b and br.
OP8 = r"""
WITH a AS (SELECT page_id, url, replace(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '</?b>', '', 'g'), '<br>', ' ') AS x FROM pages),
b AS (SELECT page_id, url, regexp_split_to_array(x, '</?(?:p|h1)>') AS parts FROM a),
c AS (SELECT page_id, url, list_filter(list_transform(parts, lambda s: trim(regexp_replace(regexp_replace(replace(replace(replace(s, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda s: s <> '') AS blocks FROM b)
SELECT page_id, url, array_to_string(blocks, chr(10) || chr(10)) AS text, CAST(length(array_to_string(blocks, chr(10) || chr(10))) AS BIGINT) AS n_chars FROM c
"""

#: CRC-32 of each text t of s, a byte at a time over the table of remainders.
CRC = r"""
remainders AS (SELECT list(r ORDER BY i) AS r FROM (SELECT i, list_reduce(range(8), lambda x, j: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, i) AS r FROM range(256) u(i))),
crcs AS (SELECT t, xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda b: CAST('0x' || b AS BIGINT)), lambda x, b: xor(x >> 8, r[xor(x, b) % 256 + 1]), 4294967295)) AS crc FROM (SELECT DISTINCT t FROM s), remainders)
"""

OP10 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, CAST('0x' || substr(md5(coalesce(text, '')), 1, 15) AS BIGINT) AS k FROM documents),
c AS (SELECT *, CAST(sum(size) OVER (ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto, CAST(sum(size) OVER (PARTITION BY k) AS BIGINT) AS own, CAST(sum(size) OVER () AS BIGINT) AS total FROM d),
m AS (SELECT *, CASE WHEN 800 * own > total THEN 2 * upto - size ELSE 2 * max(upto) OVER (PARTITION BY k) - own END AS twice FROM c),
s AS (SELECT *, CAST(least(7, 8 * twice // (2 * total)) AS INTEGER) AS shard FROM m),
""" + CRC + r"""
SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY k, doc_id) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM s JOIN crcs USING (t)
"""

def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _spread(rx: str) -> str:
    """A rule's expression for texts with two spaces between words, each match with a space on either side."""
    return " (?:" + rx.replace(" ?", "\0").replace(" ", "  ").replace("\0", "(?:  )?") + ") "


def _licenses() -> str:
    """Every rule's places in the texts that hold a root; what lies in another place of the same or a higher priority goes."""
    rules = ",\n".join(f"({i}, {_quoted(label)}, {priority}, {_quoted('(' + _spread(rx) + ')')})" for i, (label, priority, _, rx) in enumerate(licenses.RULES))
    scores = " ".join(f"WHEN {p} THEN {c}" for p, c in licenses.CONFIDENCE.items())
    return rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
j AS (SELECT doc_id, ' ' || array_to_string(ws, '  ') || ' ' AS t FROM w WHERE regexp_matches(' ' || array_to_string(ws, ' ') || ' ', {_quoted("|".join(licenses.ROOTS))})),
r(rule, label, priority, rx) AS (VALUES {rules}),
m AS (SELECT doc_id, rule, label, priority, string_split(regexp_replace(t, rx, chr(1) || '\1' || chr(2), 'g'), chr(1)) AS parts FROM j, r),
p AS (SELECT doc_id, rule, label, priority, parts, unnest(range(2, len(parts) + 1)) AS i FROM m WHERE len(parts) > 1),
f AS (SELECT doc_id, rule, label, priority, len(list_filter(string_split(replace(array_to_string(parts[1 : i - 1], ''), chr(2), ''), ' '), lambda x: x <> '')) AS a, len(list_filter(string_split(split_part(parts[i], chr(2), 1), ' '), lambda x: x <> '')) AS n FROM p),
k AS (SELECT * FROM f x WHERE NOT EXISTS (SELECT 1 FROM f y WHERE y.doc_id = x.doc_id AND y.a <= x.a AND x.a + x.n <= y.a + y.n AND y.priority >= x.priority AND (y.a <> x.a OR y.n <> x.n OR y.priority <> x.priority OR y.rule < x.rule))),
b AS (SELECT doc_id, count(*) AS n_base, min(a) AS first_word, max(a) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM f WHERE rule < {len(licenses.BASE)} GROUP BY doc_id),
l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM k UNION SELECT doc_id, label FROM f WHERE rule < {len(licenses.BASE)}) GROUP BY doc_id),
s AS (SELECT doc_id, max(priority) AS best FROM k GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(CASE coalesce(best, 0) {scores} END AS DOUBLE) AS score
FROM w LEFT JOIN b USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN s USING (doc_id)
"""


ORACLES = {"op1_substring_dedup": OP1, "op3_warc": OP3, "op5_licenses": _licenses(), "op6_exact_topk": OP6, "op7_decontaminate": OP7, "op8_main_text": OP8, "op9_near_duplicates": OP9, "op10_sharding": OP10}
