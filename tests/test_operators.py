import pytest
from pyspark.sql import functions as F

from clickrill.operators import areas, categories, flow, geo, hotwords, sessions, tables
from clickrill.schema import STEP_BUCKETS, VISIT_BUCKETS

EVENTS = "row_key string, en string, uid string, sid string, s_time bigint, country string, province string, city string, gid bigint, kw string"


def events(spark, *rows):
    return spark.createDataFrame([(f"{i:03}", *r) for i, r in enumerate(rows)], EVENTS)


def event(en="e_pv", uid="u", sid="s", t=0, gid=None, kw=None, place=("C", "P", "X")):
    return (en, uid, sid, t, *place, gid, kw)


def test_sessions(spark):
    e = events(spark, event(t=1000, gid=5, uid="a"), event(t=4999, gid=3, uid="b"), event("e_l", t=500), event(sid=None, t=9), event("e_cart", sid="t", t=0, gid=5), event("e_cart", sid="t", t=0, gid=5))
    got = {r["sid"]: r for r in sessions.roll_up(e).collect()}
    assert (got["s"]["uid"], got["s"]["gids"], got["s"]["step_length"], got["s"]["visit_length"]) == ("b", "5,3", 2, 4)
    assert got["t"]["gids"] == "5,5" and got["t"]["step_length"] == 0
    assert got[None]["visit_length"] == 0 and got[None]["gids"] == ""


@pytest.mark.parametrize(("x", "visit", "step"), [(0, "1s_3s", None), (1, "1s_3s", "1_3"), (3, "1s_3s", "1_3"), (4, "4s_6s", "4_6"), (7, "7s_9s", "7_9"), (9, "7s_9s", "7_9"), (10, "10s_30s", "10_30"), (30, "10s_30s", "10_30"), (31, "30s_60s", "30_60"), (60, "30s_60s", "30_60"), (61, "1m_3m", "60"), (180, "1m_3m", "60"), (181, "3m_10m", "60"), (600, "3m_10m", "60"), (1800, "10m_30m", "60"), (1801, "30m", "60")])
def test_buckets(spark, x, visit, step):
    assert tuple(spark.range(1).select(sessions.visit_bucket(F.lit(x)), sessions.step_bucket(F.lit(x))).first()) == (visit, step)


def test_ratios(spark):
    counts = spark.createDataFrame([(15, *[4, 2, 0, 0, 2, 5, 2, 0, 0], *[8, 1, 1, 5, 0, 0])], ["session_count", *VISIT_BUCKETS, *STEP_BUCKETS])
    r = sessions.ratios(counts).first()
    assert (r["1s_3s"], r["1_3"], r["4_6"], r["1m_3m"]) == (0.27, 0.53, 0.07, 0.33)
    packed = sessions.packed_histogram(counts).first()[0]
    assert packed.startswith("session_count=15|1s_3s=4|4s_6s=2") and packed.endswith("|60=0")
    none = sessions.session_stat(events(spark), 2).first()
    assert none["task_id"] == 2 and none["session_count"] == 0 and none["30m"] == 0.0


def test_range(spark):
    e = events(spark, *[event(t=t) for t in (9, 10, 19, 20)])
    assert [r["s_time"] for r in sessions.in_range(e, 10, 20).collect()] == [10, 19]


def test_categories(spark):
    goods = spark.createDataFrame([(i, i % 7, f"g{i}") for i in range(14)], "goods_id bigint, cat_id bigint, goods_name string")
    rows = [event(gid=g) for g in (0, 7, 1, 1, 2, 3)] + [event("e_cart", gid=g) for g in (2, 2, 3, 4)] + [event("e_sod", gid=5), event(gid=99), event()]
    joined = categories.with_category(events(spark, *rows), goods)
    got = [tuple(r) for r in categories.top_categories(events(spark, *rows), goods, 9).collect()]
    assert got == [(9, 0, 2, 0, 0), (9, 1, 2, 0, 0), (9, 2, 1, 2, 0), (9, 3, 1, 1, 0), (9, 4, 0, 1, 0)]
    assert {r[0] for r in categories.distinct_categories(joined).collect()} == {0, 1, 2, 3, 4, 5}
    assert categories.counts(joined, count_orders=True).where("category_id = 5").first()["pay_count"] == 1


def test_areas(spark):
    goods = spark.createDataFrame([(i, 1, f"g{i}") for i in range(6)], "goods_id bigint, cat_id bigint, goods_name string")
    rows = [event(gid=0, place=("C", "P", "X")), event(gid=0, place=("C", "P", "A")), event(gid=0, place=("C", "P", None))] + [event(gid=g) for g in (4, 3, 2, 1)] + [event(gid=1, place=("C", "Q", "X")), event("e_l", gid=9)]
    got = sorted(tuple(r)[1:] for r in areas.area_top(events(spark, *rows), goods, 2).collect())
    assert got == [("P", 0, "g0", "null:1,A:1,X:1", 3), ("P", 1, "g1", "X:1", 1), ("P", 2, "g2", "X:1", 1), ("Q", 1, "g1", "X:1", 1)]
    assert areas.clicks(events(spark, *rows), ["e_l"]).count() == 1


def test_flow(spark):
    e = events(spark, event("e_l", "a", "s1"), event("e_pv", "a", "s1"), event("e_pv", "b", "s2", place=("C", "P", "Y")), event("e_pv", None, None, place=("C", None, None)), event("e_pv", "a", "s1", t=86_400_000))
    got = {(str(r["day"]), r["country"], r["province"], r["city"]): (r["uv"], r["pv"], r["nu"], r["sn"], r["on"]) for r in flow.flow_stats(e).collect()}
    assert got[("1970-01-01", "C", "all", "all")] == (2, 3, 1, 2, 1)
    assert got[("1970-01-01", "C", "P", "all")] == (2, 2, 1, 2, 1)
    assert got[("1970-01-01", "C", "P", "X")] == (1, 1, 1, 1, 0)
    assert got[("1970-01-01", "C", None, None)] == (0, 1, 0, 0, 0)
    assert got[("1970-01-02", "C", "P", "X")] == (1, 1, 0, 1, 1)


def test_geo(spark):
    rules = spark.createDataFrame([(16777472, 16778239, "中国", "福建", "福州"), (167772160, 184549375, "A", "wide", "x"), (167772416, 167772671, "A", "narrow", "y"), (9, 3, "bad", "bad", "bad")], "start_ip bigint, end_ip bigint, country string, province string, city string")
    ips = ["1.0.1.0", "1.0.3.255", "1.0.4.0", "10.0.0.9", "10.0.1.7", "10.255.255.255", "192.168.1.1", "1192.168.1.1", "x", "::1", "300.1", None, "1.0.1.0"]
    got = geo.locate(spark.createDataFrame([(i, x) for i, x in enumerate(ips)], "i int, ip string"), rules).orderBy("i").collect()
    assert [r["province"] for r in got] == ["福建", "福建", "unknown", "wide", "narrow", "wide", *["unknown"] * 6, "福建"]
    assert [r["city"] for r in got][:3] == ["福州", "福州", "unknown"]


def test_hot_words_are_the_sliding_window(spark):
    """Trailing sums of panes against the plain count of each window."""
    import random

    r = random.Random(1)
    rows = [event("e_s", t=r.randrange(0, 9_000_000), kw=r.choice("abc"), place=("C", r.choice("PQ"), r.choice("XY"))) for _ in range(500)]
    e = events(spark, *rows, event(t=5))
    panes = hotwords.panes(e)
    for as_of in (4_000, 3_600_000, 5_000_000, 9_000_000):
        want = {}
        for x in rows:
            if as_of - 3_600_000 <= x[3] < as_of:
                key = (x[5], x[6], x[8])
                want[key] = want.get(key, 0) + 1
        got = {(x["province"], x["city"], x["keyword"]): x["count"] for x in hotwords.trailing(panes, as_of).collect()}
        assert got == want
    top = hotwords.top_words(hotwords.trailing(panes, 9_000_000)).collect()
    assert max(x["rank"] for x in top) == 3 and len(top) == 6


def test_get_or_create(spark):
    dim = spark.createDataFrame([(4, "C", "all", "all")], "id int, country string, province string, city string")
    places = spark.createDataFrame([("C", "P", "X"), ("C", "P", "X"), ("C", None, None)], "country string, province string, city string")
    wanted = tables.location_rows(places)
    keys = ["country", "province", "city"]
    out = tables.get_or_create(dim, wanted, keys)
    got = {tuple(r)[1:]: r["id"] for r in out.collect()}
    assert got[("C", "all", "all")] == 4 and sorted(got.values()) == list(range(4, 4 + len(got))) and len(got) == 5
    assert tables.get_or_create(out, wanted, keys).count() == len(got)
    assert tables.with_ids(places, out, keys, "l").where("l IS NULL").isEmpty()


def test_upsert(spark):
    old = spark.createDataFrame([(1, 10, "a"), (2, 20, "b")], "k int, n int, x string")
    new = spark.createDataFrame([(2, 5, None), (3, 7, "c")], "k int, n int, x string")
    assert sorted(map(tuple, tables.upsert(old, new, ["k"]).collect())) == [(1, 10, "a"), (2, 5, None), (3, 7, "c")] or sorted(tuple(r)[:2] for r in tables.upsert(old, new, ["k"]).collect()) == [(1, 10), (2, 5), (3, 7)]
    assert sorted(tuple(r)[:2] for r in tables.upsert(old, new, ["k"], add=["n"]).collect()) == [(1, 10), (2, 25), (3, 7)]


def test_word_count(spark):
    df = spark.createDataFrame([("a b  a ",), ("b",), (None,)], "value string")
    assert {r["word"]: r["count"] for r in tables.word_count(tables.union_all([df, df])).collect()} == {"a": 4, "b": 4, "": 2}
