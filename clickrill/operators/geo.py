"""IP addresses to regions: a left interval join, for tables and for streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import or_unknown

#: Rules sent to every task, at most; beyond it the join is by key.
BROADCAST_RULES = 1_000_000
BITS = 16
#: A rule that spans more buckets than this is cut at coarser ones.
WIDE = 256


def ip_to_long(ip: Column) -> Column:
    """The number of a dotted IPv4 address; null for anything else."""
    parts = F.split(ip, "\\.")
    value = lambda i: F.get(parts, F.lit(i)).cast("bigint")
    whole = ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    return F.when(whole, value(0) * (1 << 24) + value(1) * (1 << 16) + value(2) * (1 << 8) + value(3))


def is_private(ip: Column) -> Column:
    return ip.contains("192.168")


def locate(events: DataFrame, rules: DataFrame, ip: str = "ip") -> DataFrame:
    """events with country, province, city of the rule whose [start_ip, end_ip] holds the address, else `unknown`.

    Both sides get the high bits of their addresses as an equi-join key: /16 for usual rules, /8 for wide ones, so each
    event meets the few rules of its own buckets. Where rules overlap, the one with the largest start wins.
    """
    events = events.drop("country", "province", "city")
    # addresses, not events, meet the rules: each is looked up once however often it occurs
    addresses = events.select(F.col(ip).alias("_ip"), _number(F.col(ip)).alias("_number")).where("_number IS NOT NULL").distinct()
    found = _winners(addresses, rules)
    out = events.join(found, events[ip] == found["_ip"], "left")
    return out.select(*[events[c] for c in events.columns], *[or_unknown(F.col(f"r.{c}")).alias(c) for c in ("country", "province", "city")])


def _number(ip: Column) -> Column:
    return F.when(~is_private(ip), ip_to_long(ip))


def _winners(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """(_ip, r): of the rules that hold the _number of each _ip, the one with the largest start."""
    span = F.shiftright("end_ip", BITS) - F.shiftright("start_ip", BITS)
    ranges = rules.where("start_ip <= end_ip").select("start_ip", "end_ip", "country", "province", "city", F.when(span <= WIDE, BITS).otherwise(24).alias("_bits"))
    keyed = ranges.select("*", F.explode(F.when(F.col("_bits") == BITS, F.sequence(F.shiftright("start_ip", BITS), F.shiftright("end_ip", BITS))).otherwise(F.sequence(F.shiftright("start_ip", 24), F.shiftright("end_ip", 24)))).alias("_key"))
    probes = addresses.select("*", F.explode(F.array(F.struct(F.lit(BITS).alias("_bits"), F.shiftright("_number", BITS).alias("_key")), F.struct(F.lit(24).alias("_bits"), F.shiftright("_number", 24).alias("_key")))).alias("x")).select("_ip", "_number", "x.*")
    met = probes.join(keyed, ["_bits", "_key"]).where("_number BETWEEN start_ip AND end_ip")
    return met.groupBy("_ip").agg(F.max_by(F.struct("country", "province", "city"), F.struct("start_ip", -F.col("end_ip"), "country", "province", "city")).alias("r"))


def flatten(rules: DataFrame) -> DataFrame:
    """The rules as ranges that don't overlap and don't cross a /8, each with the place that wins there."""
    r = rules.where("start_ip <= end_ip")
    blocks = F.filter(F.sequence(F.shiftright("start_ip", 24), F.shiftright("end_ip", 24)), lambda b: b > F.shiftright("start_ip", 24))
    points = r.select(F.explode(F.concat(F.array("start_ip", F.col("end_ip") + 1), F.transform(blocks, lambda b: b * (1 << 24)))).alias("p")).distinct()
    block = F.shiftright("p", 24)
    ends = F.coalesce(F.lead("p").over(Window.partitionBy(block).orderBy("p")), (block + 1) * (1 << 24)) - 1
    pieces = points.select("p", ends.alias("end_ip"))
    found = _winners(pieces.select(F.col("p").alias("_ip"), F.col("p").alias("_number")), r)
    return pieces.join(found, F.col("p") == F.col("_ip")).select(F.col("p").alias("start_ip"), "end_ip", "r.country", "r.province", "r.city")


def locate_stream(events: DataFrame, rules: DataFrame, ip: str = "ip") -> DataFrame:
    """As locate(), for events of a stream, which can't be aggregated on the way: the rules are flattened first, so an
    address meets one at most, by the /16 that it lies in. Rules that are counted to be few enough are broadcast."""
    events = events.drop("country", "province", "city")
    flat = flatten(rules)
    keyed = flat.select("*", F.explode(F.sequence(F.shiftright("start_ip", BITS), F.shiftright("end_ip", BITS))).alias("_key"))
    keyed = F.broadcast(keyed) if keyed.count() <= BROADCAST_RULES else keyed
    numbered = events.withColumn("_n", _number(F.col(ip)))
    found = numbered.join(keyed, (F.shiftright("_n", BITS) == F.col("_key")) & F.col("_n").between(F.col("start_ip"), F.col("end_ip")), "left")
    return found.select(*events.columns, *[or_unknown(F.col(c)).alias(c) for c in ("country", "province", "city")])
