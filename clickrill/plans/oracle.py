"""The same queries in SQL, for DuckDB over the test tables."""

from __future__ import annotations

from ..operators.sessions import STEP_LIMITS, VISIT_LIMITS
from ..schema import STEP_BUCKETS, VISIT_BUCKETS

START_MS, END_MS = 1_704_412_800_000, 1_705_017_600_000
AS_OF_MS, WEEK_MS = END_MS, 7 * 86_400_000

EVENTS = """
el AS (SELECT *, CAST(s_time // 86400000 AS INTEGER) + DATE '1970-01-01' AS day FROM (
  SELECT lpad(CAST((epoch_us(e.ts) // 1000) AS VARCHAR), 13, '0') || '_' || e.event_id AS row_key, e.event_id, (epoch_us(e.ts) // 1000) AS s_time,
    CASE e.event_type WHEN 'signup' THEN 'e_l' WHEN 'view' THEN 'e_pv' WHEN 'click' THEN 'e_cart' WHEN 'purchase' THEN 'e_sod' ELSE 'e_e' END AS en,
    CAST(e.user_id AS VARCHAR) AS uid, e.user_id || '_' || strftime(e.ts, '%Y%m%d') AS sid,
    r_name AS country, n_name AS province, c_mktsegment AS city,
    CASE WHEN e.event_type IN ('view', 'click', 'purchase') THEN CAST(json_extract_string(e.props, '$.k') AS BIGINT) END AS gid,
    CASE WHEN e.event_type = 'view' THEN 'w' || (CAST(json_extract_string(e.props, '$.k') AS BIGINT) % 20) END AS kw,
    (coalesce(c_nationkey, 200) + 10) || '.' || (e.user_id % 256) || '.0.' || (e.event_id % 256) AS ip
  FROM events e LEFT JOIN customer ON e.user_id = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)),
goods AS (SELECT p_partkey AS goods_id, CAST(regexp_extract(p_brand, '#([0-9]+)', 1) AS BIGINT) AS cat_id, p_name AS goods_name FROM part)
"""
JOINED = "j AS (SELECT el.*, cat_id FROM el JOIN goods ON gid = goods_id)"
CITY = "c AS (SELECT province, city, goods_id, goods_name, CAST(count(*) AS BIGINT) AS click_count FROM el JOIN goods ON gid = goods_id GROUP BY ALL)"
PRODUCT = "p AS (SELECT province, goods_id, goods_name, string_agg(coalesce(city, 'null') || ':' || click_count, ',' ORDER BY city) AS city_infos, CAST(sum(click_count) AS BIGINT) AS click_count FROM c GROUP BY province, goods_id, goods_name)"
SESSIONS = """s AS (SELECT sid, arg_max(uid, row_key) AS uid, coalesce(string_agg(CAST(gid AS VARCHAR), ',' ORDER BY s_time, row_key), '') AS gids,
  CAST(count(*) FILTER (WHERE en = 'e_pv') AS BIGINT) AS step_length, CAST((max(s_time) - min(s_time)) // 1000 AS BIGINT) AS visit_length FROM el GROUP BY sid)"""
LEVELS = ["country, 'all' AS province, 'all' AS city", "country, province, 'all' AS city", "country, province, city"]


def _buckets(column: str, names: list[str], limits: list[int], low: int) -> list[str]:
    edges = [(low if i == 0 else limits[i - 1] + 1, limits[i] if i < len(limits) else None) for i in range(len(names))]
    return [f"""CAST(count(*) FILTER (WHERE {column} >= {a}{f" AND {column} <= {b}" if b is not None else ""}) AS BIGINT) AS "{n}\"""" for n, (a, b) in zip(names, edges, strict=True)]


HISTOGRAM = "h AS (SELECT CAST(count(*) AS BIGINT) AS session_count, " + ", ".join(_buckets("visit_length", VISIT_BUCKETS, VISIT_LIMITS, 0) + _buckets("step_length", STEP_BUCKETS, STEP_LIMITS, 1)) + " FROM s)"


def _rounded(n: str) -> str:
    """n / session_count to 2 digits, half up by the double's exact value."""
    x = f'coalesce(CAST("{n}" AS DOUBLE) / nullif(session_count, 0), 0.0)'
    return f"""(SELECT (w + CASE WHEN p - w > 0.5 OR (p - w = 0.5 AND lost >= 0) THEN 1.0 ELSE 0.0 END) / 100.0 FROM (
      SELECT p, floor(p) AS w, (hi * CAST(100 AS DOUBLE) - p) + (x - hi) * CAST(100 AS DOUBLE) AS lost FROM (
      SELECT x, x * CAST(100 AS DOUBLE) AS p, (x * CAST(134217729 AS DOUBLE)) - ((x * CAST(134217729 AS DOUBLE)) - x) AS hi FROM (SELECT {x} AS x)))) AS "{n}\""""


FLOW = "f AS (" + " UNION ALL ".join(f"""SELECT day, {level}, sid, uid, en FROM el""" for level in LEVELS) + """),
fs AS (SELECT day, country, province, city, sid, count(*) AS n, count(*) FILTER (WHERE en = 'e_pv') AS pv, count(*) FILTER (WHERE en = 'e_l') AS nu FROM f GROUP BY ALL),
fu AS (SELECT day, country, province, city, count(DISTINCT uid) AS uv FROM f GROUP BY ALL),
flow AS (SELECT day, country, province, city, CAST(any_value(uv) AS BIGINT) AS uv, CAST(sum(pv) AS BIGINT) AS pv, CAST(sum(nu) AS BIGINT) AS nu, CAST(count(sid) AS BIGINT) AS sn, CAST(count(*) FILTER (WHERE n = 1) AS BIGINT) AS "on"
  FROM fs JOIN fu USING (day, country, province, city) GROUP BY ALL)"""
PANES = "pn AS (SELECT (s_time // 4000 + 1) * 4000 AS pane, CAST(day AS VARCHAR) AS day, country, province, city, kw AS keyword FROM el WHERE kw IS NOT NULL)"
TRAIL = f'tr AS (SELECT day, country, province, city, keyword, CAST(count(*) AS BIGINT) AS "count" FROM pn WHERE pane > {AS_OF_MS - WEEK_MS} AND pane <= {AS_OF_MS} GROUP BY ALL)'
LINES = """
raw AS (SELECT event_id, ip || ' ' || (s_time // 1000) || '.' || lpad(CAST(s_time % 1000 AS VARCHAR), 3, '0') || ' host1 /log.gif?en=' || en || '&ver=1&pl=website&uid=' || uid || '&sid=' || sid || '&url='
   || CASE event_id % 3 WHEN 0 THEN 'http%3A%2F%2Fshop%2Fgoods.php%3Fid%3D' || coalesce(CAST(gid AS VARCHAR), 'x') WHEN 1 THEN 'http%3A%2F%2Fshop%2Fcategory.php%3Fid%3D' || (event_id % 25) || '%26a' ELSE 'http%3A%2F%2Fshop%2Fsearch.php' END
   || '&tt=find_' || coalesce(kw, '') || '_page&&a=&=b' AS line0, * FROM el),
ln AS (SELECT * REPLACE (CASE WHEN event_id % 97 = 0 THEN '  ' WHEN event_id % 89 = 0 THEN line0 || ' more' WHEN event_id % 83 = 0 THEN replace(line0, 'en=e_', 'en=q_') ELSE line0 END AS line0) FROM raw),
sp AS (SELECT event_id, line0 AS line, string_split(trim(line0), ' ') AS f FROM ln),
kv AS (SELECT event_id, string_split(p, '=')[1] AS name, url_decode(string_split(p, '=')[2]) AS value FROM (SELECT event_id, unnest(string_split(string_split(f[4], '?')[2], '&')) AS p FROM sp WHERE len(f) = 4) WHERE string_split(p, '=')[1] <> '' AND coalesce(string_split(p, '=')[2], '') <> ''),
pm AS (SELECT event_id, max(value) FILTER (WHERE name = 'en') AS en, max(value) FILTER (WHERE name = 'uid') AS uid, max(value) FILTER (WHERE name = 'sid') AS sid, max(value) FILTER (WHERE name = 'url') AS url, max(value) FILTER (WHERE name = 'tt') AS tt FROM kv GROUP BY event_id),
ps AS (SELECT line, CASE WHEN len(f) = 4 THEN f[1] END AS ip, CASE WHEN len(f) = 4 THEN CAST(trunc(CAST(f[2] AS DOUBLE) * 1000) AS BIGINT) END AS s_time, en, uid, sid, url,
   CASE WHEN contains(url, 'search.php') AND string_split(tt, '_')[2] <> '' THEN string_split(tt, '_')[2] END AS kw,
   CASE WHEN contains(url, 'goods.php') THEN TRY_CAST(regexp_extract(url, 'id=([^&]*)', 1) AS BIGINT) END AS gid,
   CASE WHEN contains(url, 'category.php') THEN TRY_CAST(regexp_extract(url, 'id=([^&]*)', 1) AS BIGINT) END AS c_id,
   CASE WHEN trim(line) = '' THEN 'blank' WHEN len(f) <> 4 THEN 'fields' WHEN en NOT IN ('e_l', 'e_pv', 'e_sod', 'e_s', 'e_cart', 'e_e') THEN 'event' END AS reject
   FROM sp LEFT JOIN pm USING (event_id))
"""
SIDES = f"""a AS (SELECT uid, CAST(count(*) AS BIGINT) AS pv, max(s_time) AS seen FROM el WHERE en = 'e_pv' AND s_time < {START_MS} GROUP BY uid),
b AS (SELECT uid, CAST(count(*) AS BIGINT) AS pv, max(s_time) AS seen FROM el WHERE en = 'e_pv' AND s_time >= {START_MS} AND s_time < {END_MS} GROUP BY uid)"""
DAYS = "days AS (SELECT DISTINCT day FROM el UNION SELECT DISTINCT CAST(o_orderdate AS DATE) FROM orders)"
WEEK = "least(53, CAST(floor((dayofyear({0}) + dayofweek(date_trunc('year', {0})) - 1) / 7) AS INTEGER) + 1)"


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join([EVENTS.strip(), *parts]) + "\n"


def _dimension(grain: str) -> str:
    year, season, month, day = "CAST(year(day) AS INTEGER)", "CAST(quarter(day) AS INTEGER)", "CAST(month(day) AS INTEGER)", "CAST(day(day) AS INTEGER)"
    sunday = "day - CAST(dayofweek(day) AS INTEGER)"
    week = WEEK.format("day") if grain == "day" else f"CASE WHEN month(day) = 1 AND month({sunday}) = 12 THEN 1 ELSE {WEEK.format(f'({sunday})')} END"
    shown = {"year": 1, "season": 2, "month": 3, "week": 4, "day": 5}[grain]
    values = [v if i < shown else "0" for i, v in enumerate((year, season, month, week, day))]
    start = {"year": "date_trunc('year', day)", "season": "date_trunc('quarter', day)", "month": "date_trunc('month', day)", "week": sunday, "day": "day"}[grain]
    cols = ", ".join(f"CAST({v} AS INTEGER) AS {n}" for v, n in zip(values, ("year", "season", "month", "week", "day_"), strict=True))
    return _with(DAYS) + f"SELECT DISTINCT year, season, month, week, day_ AS day, calendar, type FROM (SELECT {cols}, CAST({start} AS DATE) AS calendar, '{grain}' AS type FROM days)"


_FLOW_OUT = 'SELECT day, country, province, city, uv, pv, nu, sn, "on" FROM flow'
_HOT_OUT = """SELECT * FROM (SELECT CAST(row_number() OVER (PARTITION BY day, country, province ORDER BY "count" DESC, keyword, city) AS INTEGER) AS rank, * FROM tr) WHERE rank <= 3"""
_WORDS = "SELECT word, CAST(count(*) AS BIGINT) AS \"count\" FROM (SELECT unnest(string_split(rtrim({0}, ' '), ' ')) AS word FROM {1}) GROUP BY word"

#: Places of addresses, over the rules that the test tables stand for.
RULES = "ru AS (SELECT (n_nationkey + 10) * 16777216 AS lo, (n_nationkey + 10) * 16777216 + 4194303 AS hi, r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey)"
_IP = "CAST(split_part(ip, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(ip, '.', 2) AS BIGINT) * 65536 + CAST(split_part(ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(ip, '.', 4) AS BIGINT)"
#: CRC-32 of each text t of w, a byte at a time over the table of remainders.
CRC = """remainders AS (SELECT list(r ORDER BY i) AS r FROM (SELECT i, list_reduce(range(8), lambda x, j: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, i) AS r FROM range(256) u(i))),
crcs AS (SELECT t, xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda b: CAST('0x' || b AS BIGINT)), lambda x, b: xor(x >> 8, r[xor(x, b) % 256 + 1]), 4294967295)) AS crc FROM (SELECT DISTINCT t FROM w), remainders)"""
AGENTS = r"""
WITH v AS (SELECT event_id, (event_id % 90 + 10) || '.0.' || (event_id % 7) AS v FROM events),
a AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'Mozilla/5.0 (Windows NT 6.1; Win64; x64) Engine/1 Chrome/' || v || ' Safari/537' WHEN 1 THEN 'Mozilla/5.0 (Linux; Android 9; Tablet) Engine/1 Chrome/' || v || ' Safari/537'
  WHEN 2 THEN 'Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) Engine/2 Version/' || v || ' Safari/605' WHEN 3 THEN 'Mozilla/5.0 (X11; Linux x86_64; rv:9) Firefox/' || v
  WHEN 4 THEN 'Mozilla/5.0 (Windows NT 10.0) Engine/1 Chrome/90 Safari/537 Edg/' || v WHEN 5 THEN 'Mozilla/4.0 (compatible; MSIE ' || v || '; Windows NT 5.1)' WHEN 6 THEN 'spider/' || v || ' (+http://crawl.example)' ELSE 'plain tool ' || v END AS agent FROM v),
p AS (SELECT *, nullif(regexp_extract(agent, '(Edg|Firefox|MSIE|spider|Version|Chrome)[/ ][0-9.]+', 1), '') AS b FROM a),
q AS (SELECT *, CASE WHEN contains(agent, 'Edg/') THEN 'Edge' WHEN b = 'MSIE' THEN 'IE' WHEN b = 'spider' THEN 'Bot' WHEN b = 'Version' THEN 'Safari' ELSE b END AS b_n, nullif(regexp_extract(agent, '(Windows NT|Android|Mac OS X|Linux)', 1), '') AS o FROM p)
SELECT event_id, agent, b_n,
  CASE b_n WHEN 'Edge' THEN regexp_extract(agent, 'Edg/([0-9.]+)', 1) WHEN 'IE' THEN regexp_extract(agent, 'MSIE ([0-9.]+)', 1) WHEN 'Bot' THEN regexp_extract(agent, 'spider/([0-9.]+)', 1) WHEN 'Safari' THEN regexp_extract(agent, 'Version/([0-9.]+)', 1) WHEN 'Firefox' THEN regexp_extract(agent, 'Firefox/([0-9.]+)', 1) WHEN 'Chrome' THEN regexp_extract(agent, 'Chrome/([0-9.]+)', 1) END AS b_v,
  CASE WHEN o = 'Windows NT' THEN 'Windows' WHEN contains(agent, 'Android') THEN 'Android' WHEN o = 'Mac OS X' THEN 'OS X' ELSE o END AS os_n,
  CASE WHEN contains(agent, 'NT 6.1') THEN 'Windows 7' WHEN contains(agent, 'NT 10.0') THEN 'Windows 10' WHEN contains(agent, 'NT 5.1') THEN 'Windows XP' WHEN contains(agent, 'Android') THEN 'Android 9' WHEN o = 'Mac OS X' THEN 'OS X 10.15.7' ELSE o END AS os_v
FROM q
"""
_TOP3 = _with(CITY, PRODUCT) + "SELECT CAST(2 AS BIGINT) AS task_id, province AS area, goods_id AS product_id, goods_name AS product_name, city_infos, click_count FROM (SELECT *, row_number() OVER (PARTITION BY province ORDER BY click_count DESC, goods_id) AS r FROM p) WHERE r <= 3"

ORACLES = {
    "area_top3_sql": _TOP3,
    "user_agent": AGENTS,
    "row_key_crc32": _with("w AS (SELECT event_id, s_time, uid || en AS t FROM el)", CRC) + "SELECT event_id, s_time || '_' || crc AS key FROM w JOIN crcs USING (t)",
    "etl_store": _with(LINES.strip(), RULES, f"x AS (SELECT *, {_IP} AS n FROM ps WHERE reject IS NULL AND s_time >= {START_MS} AND s_time < {END_MS})") + "SELECT en, coalesce(r_name, 'unknown') AS country, CAST(s_time // 86400000 AS INTEGER) + DATE '1970-01-01' AS day, CAST(count(*) AS BIGINT) AS n FROM x LEFT JOIN ru ON n BETWEEN lo AND hi GROUP BY ALL",
    "geo_stream_join": _with(RULES, f"x AS (SELECT row_key, {_IP} AS n FROM el)") + "SELECT row_key, coalesce(r_name, 'all') AS country, coalesce(n_name, 'all') AS province, CASE WHEN r_name IS NULL THEN 'all' ELSE 'main' END AS city FROM x LEFT JOIN ru ON n BETWEEN lo AND hi",
    "stats_location_flow": _with(FLOW) + 'SELECT day, country, province, city, CAST(uv AS INTEGER) AS uv, CAST(pv AS INTEGER) AS pv, CAST(nu AS INTEGER) AS nu, CAST(sn AS INTEGER) AS sn, CAST("on" AS INTEGER) AS "on" FROM flow',
    "search_hot_keyword": _with(PANES, 'tr AS (SELECT day, country, province, city, keyword, CAST(count(*) AS INTEGER) AS "count" FROM pn WHERE pane > (SELECT max(pane) FROM pn) - 3600000 GROUP BY ALL)') + _HOT_OUT,
    "area_top3_product": _TOP3,
    "area_click_count": _with(CITY) + "SELECT * FROM c",
    "area_city_concat": _with(CITY, PRODUCT) + "SELECT * FROM p",
    "goods_join": _with() + "SELECT goods_id, goods_name, CAST(count(*) AS BIGINT) AS n FROM el JOIN goods ON gid = goods_id GROUP BY ALL",
    "event_filter_range": _with() + f"SELECT row_key, en, uid, sid, s_time, gid FROM el WHERE s_time >= {START_MS} AND s_time < {END_MS}",
    "session_aggregate": _with(SESSIONS) + "SELECT * FROM s",
    "session_stats_histogram": _with(SESSIONS, HISTOGRAM) + "SELECT * FROM h",
    "session_ratio": _with(SESSIONS, HISTOGRAM) + "SELECT CAST(2 AS BIGINT) AS task_id, session_count, " + ", ".join(_rounded(n) for n in VISIT_BUCKETS + STEP_BUCKETS) + " FROM h",
    "distinct_categories": _with(JOINED) + "SELECT DISTINCT cat_id AS category_id FROM j",
    "category_click_cart": _with(JOINED) + "SELECT cat_id AS category_id, CAST(count(*) FILTER (WHERE en = 'e_pv') AS BIGINT) AS click_count, CAST(count(*) FILTER (WHERE en = 'e_cart') AS BIGINT) AS cart_count, CAST(0 AS BIGINT) AS pay_count FROM j GROUP BY cat_id",
    "top5_category": _with(JOINED) + "SELECT CAST(2 AS BIGINT) AS task_id, cat_id AS category_id, CAST(count(*) FILTER (WHERE en = 'e_pv') AS BIGINT) AS click_count, CAST(count(*) FILTER (WHERE en = 'e_cart') AS BIGINT) AS cart_count, CAST(0 AS BIGINT) AS pay_count FROM j GROUP BY cat_id ORDER BY 3 DESC, 4 DESC, 2 LIMIT 5",
    "location_levels": _with() + "SELECT country, province, city, CAST(count(*) AS BIGINT) AS n FROM (" + " UNION ALL ".join(f"SELECT {x} FROM el" for x in LEVELS) + ") GROUP BY ALL",
    "flow_stats": _with(FLOW) + _FLOW_OUT,
    "streaming_flow_stats": _with(FLOW) + _FLOW_OUT,
    **{f"date_dimension_{g}": _dimension(g) for g in ("year", "season", "month", "week", "day")},
    "dimension_ids": _with(FLOW, "k AS (SELECT DISTINCT country, province, city FROM flow)", "ids AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN province = 'all' THEN 0 ELSE 1 END, country, province, city) AS id FROM k)") + "SELECT day, CAST(id AS INTEGER) AS location_dimension_id, pv FROM flow JOIN ids USING (country, province, city)",
    "hot_words_window": _with(PANES, TRAIL) + "SELECT * FROM tr",
    "hot_words_top3": _with(PANES, TRAIL) + _HOT_OUT,
    "streaming_hot_words": _with(PANES, TRAIL) + _HOT_OUT,
    "word_count": _WORDS.format("text", "documents"),
    "streaming_word_count": _WORDS.format("text", "documents"),
    "union_streams": _WORDS.format("text", "(SELECT text FROM documents UNION ALL SELECT text FROM benchmark UNION ALL SELECT text FROM benchmark)"),
    "upsert_set": _with(SIDES) + "SELECT uid, coalesce(b.pv, a.pv) AS pv, coalesce(b.seen, a.seen) AS seen FROM a FULL JOIN b USING (uid)",
    "upsert_increment": _with(SIDES) + "SELECT uid, coalesce(a.pv, 0) + coalesce(b.pv, 0) AS pv, coalesce(b.seen, a.seen) AS seen FROM a FULL JOIN b USING (uid)",
    "packed_kv_get_set": _with(SESSIONS, HISTOGRAM) + "SELECT packed, CAST(session_count AS VARCHAR) AS sessions, CAST(NULL AS VARCHAR) AS absent, regexp_replace(packed, '\\|4s_6s=[0-9]+', '|4s_6s=100') AS changed FROM (SELECT session_count, " + " || '|' || ".join(f"'{n}=' || \"{n}\"" for n in ["session_count", *VISIT_BUCKETS, *STEP_BUCKETS]) + " AS packed FROM h)",
    "task_param_json": _with() + f"SELECT en, CAST(count(*) AS BIGINT) AS n FROM el WHERE s_time >= {START_MS} AND s_time < {END_MS} GROUP BY en",
    "etl_parse_log": _with(LINES.strip()) + "SELECT line, ip, s_time, en, uid, sid, url, kw, gid, c_id, reject FROM ps",
    "etl_url_params": _with(LINES.strip()) + "SELECT event_id, name, value FROM kv",
    "etl_goods_category_id": _with(LINES.strip()) + "SELECT gid, c_id, CAST(count(*) AS BIGINT) AS n FROM ps WHERE reject IS NULL GROUP BY ALL",
    "etl_keyword": _with(LINES.strip()) + "SELECT kw, CAST(count(*) AS BIGINT) AS n FROM ps WHERE reject IS NULL GROUP BY ALL",
    "etl_rejects": _with(LINES.strip()) + "SELECT reject, CAST(count(*) AS BIGINT) AS n FROM ps GROUP BY ALL",
    "etl_ip_to_long": _with() + "SELECT DISTINCT ip, CAST(split_part(ip, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(ip, '.', 2) AS BIGINT) * 65536 + CAST(split_part(ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(ip, '.', 4) AS BIGINT) AS n FROM el",
    "geo_range_join": _with("ru AS (SELECT (n_nationkey + 10) * 16777216 AS lo, (n_nationkey + 10) * 16777216 + 4194303 AS hi, r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey)", "x AS (SELECT row_key, CAST(split_part(ip, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(ip, '.', 2) AS BIGINT) * 65536 + CAST(split_part(ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(ip, '.', 4) AS BIGINT) AS n FROM el)")
    + "SELECT row_key, coalesce(r_name, 'unknown') AS country, coalesce(n_name, 'unknown') AS province, CASE WHEN r_name IS NULL THEN 'unknown' ELSE 'main' END AS city FROM x LEFT JOIN ru ON n BETWEEN lo AND hi",
}
