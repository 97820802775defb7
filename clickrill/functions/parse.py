"""Parsing of access-log lines, request parameters and urls; malformed parts give null, never a failed job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import EVENTS, REQUEST_KEYS
from .text import as_int32, is_blank

#: Marks of category, goods and search pages in urls.
CATEGORY_FLAG, GOODS_FLAG, SEARCH_FLAG, ID_MARK = "category.php", "goods.php", "search.php", "id="


def server_time(x: Column) -> Column:
    """Epoch seconds with a fraction -> milliseconds, truncated."""
    return (x.try_cast("double") * 1000).try_cast("bigint")


def url_entries(request: Column) -> Column:
    """array of (key, value) of `path?k=v&k=v` in order: decoded values; blank keys and values left out."""
    body = F.when(F.instr(request, "?") > 0, F.substring(request, F.instr(request, "?") + 1, F.length(request))).otherwise(request)
    pairs = F.transform(F.transform(F.split(body, "&"), lambda p: F.split(F.trim(p), "=")), lambda p: F.struct(F.get(p, F.lit(0)).alias("key"), F.try_url_decode(F.get(p, F.lit(1))).alias("value")))
    return F.filter(pairs, lambda p: ~is_blank(p["key"]) & ~is_blank(p["value"]))


def entry(entries: Column, key: str) -> Column:
    """The last value of a key, or null."""
    return F.try_element_at(F.filter(entries, lambda p: p["key"] == key), F.lit(-1))["value"]


def url_params(request: Column) -> Column:
    """map<string,string> of url_entries; the last of a key wins."""
    last = lambda all_: F.filter(all_, lambda p, i: ~F.exists(F.slice(all_, i + 2, F.size(all_)), lambda q: q["key"] == p["key"]))
    # inside a transform of one element, so the entries are made once
    return F.map_from_entries(F.get(F.transform(F.array(url_entries(request)), last), F.lit(0)))


def page_id(url: Column, flag: str) -> Column:
    """The number after the first `id=` (not at the very start) of urls that hold the flag, if it has 32 bits."""
    text = F.regexp_extract(url, r"^(?s:.+?)" + ID_MARK + r"([^&]*)", 1)
    return F.when(url.contains(flag), as_int32(text)).cast("bigint")


def keyword(url: Column, title: Column) -> Column:
    """The second part of a search page's title, between underscores."""
    part = F.get(F.split(title, "_"), F.lit(1))
    return F.when(url.contains(SEARCH_FLAG) & ~is_blank(part), part)


def row_key(s_time: Column, uid: Column, mid: Column, en: Column) -> Column:
    """s_time, an underscore, and the CRC-32 of the parts that aren't blank."""
    parts = F.concat(*[F.when(is_blank(x), F.lit("")).otherwise(x) for x in (uid, mid, en)])
    return F.concat(s_time.cast("string"), F.lit("_"), F.crc32(parts.cast("binary")).cast("string"))


def user_agent(agent: Column) -> dict[str, Column]:
    """b_n, b_v, os_n, os_v of a user-agent string, by ordered patterns; null where none fits."""
    #: Family and the pattern of its version, the more specific first.
    browsers = [("UC Browser", r"UBrowser/([\d.]+)"), ("Edge", r"Edg(?:e|A|iOS)?/([\d.]+)"), ("Opera", r"OPR/([\d.]+)"), ("QQ Browser", r"QQBrowser/([\d.]+)"), ("Firefox", r"Firefox/([\d.]+)"), ("IE", r"MSIE ([\d.]+)"), ("IE", r"Trident/.*rv:([\d.]+)"), ("Chrome", r"(?:Chrome|CriOS)/([\d.]+)"), ("Safari", r"Version/([\d.]+).*Safari/"), ("Bot", r"(?i)(?:bot|spider|crawler)[/ ]?v?([\d.]*)")]
    systems = [("Windows", r"Windows NT ([\d.]+)"), ("Android", r"Android ([\d.]+)"), ("iOS", r"(?:iPhone|CPU) OS ([\d_]+)"), ("OS X", r"Mac OS X ([\d_.]+)"), ("Linux", r"(Linux)")]
    windows = F.create_map(*[F.lit(x) for kv in {"10.0": "Windows 10", "6.3": "Windows 8.1", "6.2": "Windows 8", "6.1": "Windows 7", "6.0": "Windows Vista", "5.2": "Windows XP", "5.1": "Windows XP"}.items() for x in kv])

    def first(patterns: list[tuple[str, str]], value) -> Column:
        out = F.lit(None).cast("string")
        for name, rx in reversed(patterns):
            out = F.when(agent.rlike(rx), value(name, rx)).otherwise(out)
        return out

    version = lambda name, rx: F.regexp_extract(agent, rx, 1)

    def system(name: str, rx: str) -> Column:
        if name == "Windows":
            return F.coalesce(F.try_element_at(windows, version(name, rx)), F.lit(name))
        return F.lit(name) if name == "Linux" else F.concat(F.lit(name + " "), F.translate(version(name, rx), "_", "."))

    return {"b_n": first(browsers, lambda n, _: F.lit(n)), "b_v": first(browsers, version), "os_n": first(systems, lambda n, _: F.lit(n)), "os_v": first(systems, system)}


def parse_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """`ip time host request` lines -> event columns and `reject`, the reason why a line is no event (null: it is one).

    Server fields win over parameters of the same name; ip and time come from the server alone.
    """
    fields = F.split(F.trim(F.col(value)), " ")
    x = lines.select(F.col(value).alias("line"), F.when(F.size(fields) == 4, fields).alias("f"))
    x = x.select("line", F.get("f", F.lit(0)).alias("ip"), server_time(F.get("f", F.lit(1))).alias("s_time"), F.when(F.col("f").isNotNull(), url_entries(F.get("f", F.lit(3)))).alias("p"), F.col("f").isNull().alias("broken"))
    keys = [*REQUEST_KEYS, "gid"]
    x = x.select("line", "ip", "s_time", "broken", *[entry(F.col("p"), k).alias(k) for k in keys])
    # through a generator, so that filters on what follows aren't pushed below it and each key is looked up once
    x = x.select(F.inline(F.array(F.struct(*x.columns))))
    out = x.select(
        "line", "en", "uid", "sid", "mid", "pl", "ver", "ip", "s_time", "url", "tt", keyword(F.col("url"), F.col("tt")).alias("kw"), *[c.alias(k) for k, c in user_agent(F.col("b_usa")).items()],
        F.coalesce(page_id(F.col("url"), GOODS_FLAG), as_int32(F.col("gid")).cast("bigint")).alias("gid"), page_id(F.col("url"), CATEGORY_FLAG).alias("c_id"), "broken",
    )
    reason = F.when(is_blank(F.col("line")), "blank").when(F.col("broken"), "fields").when(F.col("s_time").isNull(), "time").when(~F.coalesce(F.col("en").isin(*EVENTS.values()), F.lit(False)), "event")
    return out.select("*", reason.alias("reject"), row_key(F.col("s_time"), F.col("uid"), F.col("mid"), F.col("en")).alias("row_key")).drop("broken")
