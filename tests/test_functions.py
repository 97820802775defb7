import datetime as dt
import zlib
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from clickrill.config import Config
from clickrill.functions import parse, sql, text, times


def one(spark, column, *values, schema=None):
    """The column over rows of one value named x."""
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {schema or 'string'}").orderBy("i").select(column).collect()]


def test_round_half_up_is_exact(spark):
    values = [m / 200 for m in range(-300, 300)] + [a / b for b in range(1, 40) for a in range(b)] + [0.0, 1e9 + 0.005, 2.675, 1.005]
    expected = [float(Decimal(v).quantize(Decimal("0.01"), ROUND_HALF_UP)) for v in values]
    got = one(spark, text.round_half_up(F.col("x")), *values, schema="double")
    assert [abs(a - b) for a, b in zip(got, expected, strict=True) if a != b] == []


def test_int32(spark):
    assert one(spark, text.as_int32(F.col("x")), "12", "-7", "+3", " 4", "5 ", "", None, "2147483648", "2147483647", "1.0", "abc") == [12, -7, 3, None, None, None, None, None, 2147483647, None, None]


def test_packed_strings(spark):
    packed = "session_count=73|1s_3s=31|4s_6s=8|bad|a=b=c|empty=|=x|60=5"
    get = lambda name: one(spark, text.packed_get(F.col("x"), name), packed)[0]
    assert (get("session_count"), get("60"), get("bad"), get("a"), get("empty"), get("nothing")) == ("73", "5", None, None, None, None)
    assert one(spark, text.packed_set(F.col("x"), "1s_3s", F.lit("9")), packed) == [packed.replace("1s_3s=31", "1s_3s=9")]
    assert one(spark, text.packed_set(F.col("x"), "new", F.lit("9")), packed) == [packed]


def test_group_concat(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (2, None), (2, "c")], "id int, city string")
    assert {r[0]: r[1] for r in df.groupBy("id").agg(text.group_concat(F.col("city"))).collect()} == {1: "a,a,b", 2: "c"}
    assert {r[0]: r[1] for r in df.groupBy("id").agg(text.group_concat(F.col("city"), distinct=True)).collect()} == {1: "a,b", 2: "c"}
    assert one(spark, text.city_count(F.col("x"), F.lit(3)), "Rom", None) == ["Rom:3", "null:3"]


def test_json_params(spark):
    assert one(spark, text.json_param(F.col("x"), "aaa"), '{"colour":"red","size":9}', "{bad") == [None, None]
    assert one(spark, text.json_param(F.col("x"), "colour"), '{"colour":"red","size":9}') == ["red"]


LINE = "203.0.113.7 1700000000.250 web3 /log.gif?en=e_pv&ver=2&pl=phone"


def test_parse_lines(spark):
    lines = [LINE, "", "   ", "a b c", LINE + " x", LINE.replace(" web3", "  web3"), LINE.replace("e_pv", "e_zz"), LINE.replace("1700000000.250", "noon"), f"  {LINE}  ", "1.2.3.4 1 h en=e_l&uid=u%20v&uid=w+x&=z&a=&&b=1=2&c=%zz&ip=9.9.9.9&s_time=4&gid=77"]
    got = parse.parse_lines(spark.createDataFrame([(x,) for x in lines] + [(None,)], "value string").coalesce(1)).collect()
    assert [r["reject"] for r in got] == [None, "blank", "blank", "fields", "fields", "fields", "event", "time", None, None, "blank"]
    assert (got[0]["ip"], got[0]["s_time"], got[0]["en"], got[0]["pl"], got[0]["ver"]) == ("203.0.113.7", 1700000000250, "e_pv", "phone", "2")
    last = got[9]
    assert (last["ip"], last["s_time"], last["uid"], last["gid"]) == ("1.2.3.4", 1000, "w x", 77)


def test_url_params(spark):
    got = one(spark, parse.url_params(F.col("x")), "/log.gif?a=1&b=%E4%B8%AD+x&a=2&&c=&=d&e&f=g=h&%20=1&k=%zz", "no=mark", None)
    assert got[0] == {"a": "2", "b": "中 x", "f": "g", "%20": "1"} and got[1] == {"no": "mark"} and got[2] is None


def test_page_ids(spark):
    urls = ["http://shop.example/category.php?id=41", "http://shop.example/goods.php?id=902", "http://shop.example/category.php?id=41&a", "category.php?id=abc", "category.php?id=99999999999", "id=4category.php", "category.php?x=1", None]
    assert one(spark, parse.page_id(F.col("x"), parse.CATEGORY_FLAG), *urls) == [41, None, 41, None, None, None, None, None]
    assert one(spark, parse.page_id(F.col("x"), parse.GOODS_FLAG), *urls)[:3] == [None, 902, None]


def test_keyword(spark):
    df = spark.createDataFrame([("a/search.php?x", "find_shoes_1"), ("a/search.php", "none"), ("a/search.php", "x_ _y"), ("a/goods.php", "find_shoes"), ("a/search.php", None)], "url string, tt string")
    assert [r[0] for r in df.coalesce(1).select(parse.keyword(F.col("url"), F.col("tt"))).collect()] == ["shoes", None, None, None, None]


def test_row_key(spark):
    df = spark.createDataFrame([(5, "u", "m", "e_l"), (5, None, " ", "e_l")], "t bigint, uid string, mid string, en string")
    assert [r[0] for r in df.coalesce(1).select(parse.row_key(*map(F.col, df.columns))).collect()] == [f"5_{zlib.crc32(b'ume_l')}", f"5_{zlib.crc32(b'e_l')}"]


def test_user_agents(spark):
    agents = ["Mozilla/5.0 (Windows NT 10.0) Engine/1 Chrome/70.0 UBrowser/7.4.12 Safari/1", "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_12_3) AppleWebKit/602.4.8 (KHTML, like Gecko) Version/10.0.3 Safari/602.4.8", "x", None]
    columns = parse.user_agent(F.col("x"))
    got = one(spark, F.struct(*[c.alias(k) for k, c in columns.items()]), *agents)
    assert tuple(got[0]) == ("UC Browser", "7.4.12", "Windows", "Windows 10")
    assert tuple(got[1]) == ("Safari", "10.0.3", "OS X", "OS X 10.12.3")
    assert tuple(got[2]) == tuple(got[3]) == (None,) * 4


def week(d):
    """Sunday weeks, week 1 holds January 1, by counting."""
    sunday = d - dt.timedelta(days=(d.weekday() + 1) % 7)
    year = (sunday + dt.timedelta(days=6)).year
    first = dt.date(year, 1, 1)
    first -= dt.timedelta(days=(first.weekday() + 1) % 7)
    return (sunday - first).days // 7 + 1


def test_date_dimensions(spark):
    days = [dt.date(1999, 12, 20) + dt.timedelta(days=i) for i in range(0, 9000, 1)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    got = df.select("d", *[times.date_dimension(F.col("d"), g).alias(g) for g in times.GRAINS]).collect()
    for r in got:
        d = r["d"]
        sunday = d - dt.timedelta(days=(d.weekday() + 1) % 7)
        quarter = (d.month + 2) // 3
        fixed = lambda w: 53 if w == 1 and d.month == 12 else w  # noqa: B023, E731
        assert tuple(r["year"]) == (d.year, 0, 0, 0, 0, dt.date(d.year, 1, 1), "year")
        assert tuple(r["season"]) == (d.year, quarter, 0, 0, 0, dt.date(d.year, 3 * quarter - 2, 1), "season")
        assert tuple(r["month"]) == (d.year, quarter, d.month, 0, 0, d.replace(day=1), "month")
        assert tuple(r["week"]) == (d.year, quarter, d.month, fixed(week(sunday)), 0, sunday, "week")
        assert tuple(r["day"]) == (d.year, quarter, d.month, fixed(week(d)), d.day, d, "day")


def test_times(spark):
    assert one(spark, times.to_millis(F.col("x")), "2017-07-16", "x", None) == [1500163200000, None, None]
    assert one(spark, times.from_millis(F.col("x"), "yyyy-MM-dd HH:mm"), 1500163200000, schema="bigint") == ["2017-07-16 00:00"]
    assert one(spark, times.is_run_date(F.col("x")), "2017-07-16", "2017-7-6", "2017-99-99", "x", None) == [True, True, False, False, False]
    assert one(spark, times.day_of(F.col("x")), -1, 0, 86_400_000, schema="bigint") == [dt.date(1969, 12, 31), dt.date(1970, 1, 1), dt.date(1970, 1, 2)]
    assert spark.range(1).select(F.datediff(F.current_date(), times.yesterday())).first()[0] == 1


def test_sql_functions(spark):
    sql.register(spark)
    one_ = lambda x: spark.sql(f"SELECT {x} AS x").first()[0]
    assert one_("concat_city_clickCount('Rom', 3)") == "Rom:3" and one_("concat_city_clickCount(NULL, 3)") == "null:3"
    assert one_("ip_to_long('1.2.3.4')") == 16909060 and one_("ip_to_long('x')") is None
    assert one_("packed_value('a=1|b=2|c', 'b')") == "2" and one_("packed_value('a=1|c', 'c')") is None
    spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (2, None)], "id int, city string").createOrReplaceTempView("cities")
    got = {r[0]: (r[1], r[2]) for r in spark.sql("SELECT id, group_concat(collect_list(city)), group_concat_distinct(collect_list(city)) FROM cities GROUP BY id").collect()}
    assert got == {1: ("a,a,b", "a,b"), 2: ("", "")}


def test_config():
    c = Config.parse("# comment\nstreaming.interval = 4\njdbc.bi.url=jdbc:x\njdbc.bi.user=me\n")
    assert Config.parse("jdbc.url=u\njdbc.driver=d").jdbc() == ("u", {"driver": "d"})
    assert c.integer("streaming.interval") == 4 and c.jdbc("bi") == ("jdbc:x", {"user": "me"})
    with pytest.raises(KeyError):
        c.text("missing")
