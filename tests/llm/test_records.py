"""Sharding, WARC, exact top-k, main text, quality, mixing and the pipeline."""

import base64
import gzip
import hashlib
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from conftest import SCHEMA, rows, texts

from clickrill.llm import common, extract, hamming, mixing, quality, registry, sharding, warc


def test_shared_folder_must_be_named_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session())


def test_scratch_goes_when_done(spark):
    with common.scratch(spark) as path:
        a = common.stored(spark.range(3), "a")
        b = common.stored(a, "b", instead=a)
        assert b.count() == 3 and [p.name.split("-")[0] for p in Path(path.removeprefix("file:")).iterdir()] == ["b"]
    assert not Path(path.removeprefix("file:")).exists()
    assert "scratch" not in common.stored(spark.range(1), "c")._stored_at


def shards_of(df, n=8):
    out = sharding.shard(df, n)
    assert out.columns == [c for c in df.columns if c not in ("shard", "slot", "size")] + ["size", "shard", "slot"]
    return out.collect()


def check_law(got, n):
    total, largest = sum(r["size"] for r in got), max(r["size"] for r in got)
    for s in range(n):
        own = [r for r in got if r["shard"] == s]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / n) <= largest + 1


def test_sharding(documents, odd_documents):
    for df in (documents, odd_documents):
        got = shards_of(df)
        assert len(got) == df.count()
        assert all(r["size"] == len((r["text"] or "").encode()) + 1 for r in got)
        check_law(got, 8)


def test_sharding_is_the_same_in_any_order(documents):
    where = lambda df: {(r["doc_id"], r["shard"], r["slot"]) for r in shards_of(df, 5)}
    assert where(documents) == where(documents.orderBy(F.desc("doc_id")).repartition(11))


def test_sharding_of_a_hot_text(spark):
    """One text holds nearly all bytes: it is split, and the law still holds."""
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 > 0, "the same text " * 9).otherwise(F.col("id").cast("string")).alias("text"))
    got = shards_of(df)
    check_law(got, 8)
    assert len({r["shard"] for r in got if r["text"].startswith("the same")}) >= 7


def test_sharding_with_subdivided_ranges(documents, monkeypatch):
    monkeypatch.setattr(sharding, "MAX_RANGES", 4)
    got = shards_of(documents)
    assert len(got) == documents.count()
    check_law(got, 8)


def test_equal_texts_share_a_shard(spark):
    """Groups up to a hundredth of a shard stay whole, also where ranges are subdivided; a larger one is cut."""
    r = np.random.default_rng(4)
    texts_ = [f"text {i} " * int(k) for i, k in enumerate(r.integers(1, 30, 3000))]
    data = [(i, texts_[i // 3] if i < 6000 else "hot " * 20) for i in range(8000)]
    df = spark.createDataFrame(data, "doc_id bigint, text string").repartition(6)
    got = shards_of(df)
    share = sum(x["size"] for x in got) / 8
    assert all(abs(sum(x["size"] for x in got if x["shard"] == k) - share) <= share / 100 for k in range(8))
    where = {}
    for x in got:
        where.setdefault(x["text"], set()).add(x["shard"])
    assert len(where.pop("hot " * 20)) > 1 and all(len(v) == 1 for v in where.values())


def test_sharding_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, "a", 5, 6, {"x": 1}), (2, "b", 7, 8, None)], "doc_id bigint, text string, `a.b` int, _key int, m map<string,int>")
    out = sharding.shard(df, 2)
    assert out.columns == [*df.columns, "size", "shard", "slot"]
    assert sorted(tuple(r)[:4] for r in out.collect()) == [(1, "a", 5, 6), (2, "b", 7, 8)]


def test_sharding_of_nothing(no_documents, spark):
    assert shards_of(no_documents) == []
    assert [(r["shard"], r["slot"]) for r in shards_of(spark.createDataFrame(rows([(1, None)]), SCHEMA))] in ([(s, 0)] for s in range(8))


def test_splitters_follow_the_weights(spark):
    df = spark.range(20000).select(F.col("id").alias("k"), F.when(F.col("id") < 10000, 3.0).otherwise(1.0).alias("w"))
    cuts = sharding.splitters(df, "k", "w", 40000.0, 16)
    assert cuts == sorted(cuts) and len(cuts) == 15
    assert sum(c < 10000 for c in cuts) >= 9
    assert [r[0] for r in df.where(F.col("k").isin(cuts[3] - 1, cuts[3], cuts[3] + 1)).orderBy("k").select(common.rank_in(cuts, F.col("k"))).collect()] == [3, 4, 4]


PAGES = "page_id bigint, url string, html string, key string, member string, sha string"


def pages(spark, n=60):
    found = [(i, f"http://x.example/{i}\r\nX: y" if i % 7 == 0 else f"http://x.example/{i}", ["<p>same</p>", "<p>é " + str(i) + "</p>", "", "\r\n\r\nWARC/1.1 " * (i + 1), None][i % 5], "k", "m", "s") for i in range(n)]
    return spark.createDataFrame([*found, (1000, None, "<p>long</p>" * 20000, "k", "m", "s"), (1001, "u", "<p>long</p>" * 20000, "k", "m", "s")], PAGES).repartition(4)


def test_warc_round_trip(spark, tmp_path):
    df = pages(spark)
    warc.write(df, f"file://{tmp_path}/a", roll_bytes=3000)
    got = {r["key"]: r for r in warc.read(spark, f"file://{tmp_path}/a").collect()}
    source = {r["page_id"]: (r["url"], (r["html"] or "").encode()) for r in df.collect()}
    first = {}
    for i in sorted(source):
        first.setdefault(source[i][1], i)
    assert set(got) == set(source)
    for i, (url, payload) in source.items():
        r = got[i]
        kind = "response" if first[payload] == i else "revisit"
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), kind, None if kind == "response" else first[payload])
        assert r["payload"] == (payload if kind == "response" else None)
        assert r["url"] == (url.replace("\r\n", "%0D%0A") if url else None)
    files = sorted((tmp_path / "a").glob("*.warc.gz"))
    assert len(files) > 3 and not list((tmp_path / "a").glob("_temporary*"))
    for f in files:
        assert gzip.decompress(f.read_bytes()).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    keys = [r["key"] for f in files for r in spark.read.format("binaryFile").load(str(f)).select("content").mapInArrow(warc._records, "key bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary").collect()]
    assert keys == sorted(keys)


def test_warc_is_deterministic(spark, tmp_path):
    df = pages(spark)
    warc.write(df, f"file://{tmp_path}/a", roll_bytes=3000)
    warc.write(df.repartition(9), f"file://{tmp_path}/b", roll_bytes=3000)
    assert (tmp_path / "a/manifest.json").read_bytes() == (tmp_path / "b/manifest.json").read_bytes()
    warc.write(df.limit(0), f"file://{tmp_path}/a")
    assert warc.read(spark, f"file://{tmp_path}/a").collect() == []


def test_warc_reruns_replace_whole_runs(spark, tmp_path):
    """Another run's manifest takes the place of the first one's, files that only that has go, those of both stay."""
    out = f"file://{tmp_path}/a"
    df = pages(spark)
    warc.write(df, out, roll_bytes=3000)
    first = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "a").glob("*.warc.gz")}
    warc.write(df, out, roll_bytes=3000)
    assert {f.name: f.stat().st_mtime_ns for f in (tmp_path / "a").glob("*.warc.gz")} == first
    warc.write(df.where("page_id < 20"), out, roll_bytes=3000)
    assert {f.name for f in (tmp_path / "a").glob("*.warc.gz")} == set(warc._manifest(spark, out))
    assert sorted(r["key"] for r in warc.read(spark, out).collect()) == list(range(20))


@pytest.mark.parametrize("key", [5, None])
def test_warc_of_one_key(spark, tmp_path, monkeypatch, key):
    """Ranges are subdivided inside a key, or among records without one."""
    monkeypatch.setattr(sharding, "MAX_RANGES", 3)
    df = spark.createDataFrame([(key, f"u{i}", f"payload {i} " * 300) for i in range(200)] + [(9, "u", "x")], "page_id bigint, url string, html string")
    warc.write(df, f"file://{tmp_path}/a", roll_bytes=2000)
    assert len({f.name.split("-")[1] for f in (tmp_path / "a").glob("*.warc.gz")}) > 8
    got = warc.read(spark, f"file://{tmp_path}/a").collect()
    assert len(got) == 201 and {r["payload"] for r in got if r["key"] == key} == {(f"payload {i} " * 300).encode() for i in range(200)}


def test_warc_revisits_name_their_originals(spark, tmp_path):
    """Another reader finds the response by the standard fields."""
    df = spark.createDataFrame([(7, "http://b", "same"), (5, "http://a", "same"), (None, "http://c", "same")], "page_id bigint, url string, html string")
    warc.write(df, f"file://{tmp_path}/a")
    found = [f for file in (tmp_path / "a").glob("*.warc.gz") for f, _ in warc.parse(file.read_bytes())]
    response = next(f for f in found if f["warc-type"] == "response")
    revisits = [f for f in found if f["warc-type"] == "revisit"]
    assert len(revisits) == 2 and response["warc-target-uri"] == "http://a"
    for f in revisits:
        assert (f["warc-refers-to"], f["warc-refers-to-target-uri"], f["warc-refers-to-date"]) == (response["warc-record-id"], "http://a", response["warc-date"])


def test_warc_odd_rows(spark, tmp_path):
    """Null keys, a key that occurs twice, repeated rows; short payloads are responses with min_revisit."""
    df = spark.createDataFrame([(None, "a", "xyz", "", "", ""), (5, "a", "xyz", "", "", ""), (5, "a", "xyz", "", "", ""), (5, "b", "other", "", "", ""), (7, "a", "xyz", "", "", ""), (8, "a", "q", "", "", ""), (9, "a", "q", "", "", ""), (None, "n", "alone", "", "", "")], PAGES)
    warc.write(df, f"file://{tmp_path}/a", min_revisit=2)
    got = sorted(((r["key"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.read(spark, f"file://{tmp_path}/a").collect()), key=str)
    assert got == sorted([(None, "revisit", 5, 3), (5, "response", None, 3), (5, "response", None, 3), (5, "response", None, 5), (7, "revisit", 5, 3), (8, "response", None, 1), (9, "response", None, 1), (None, "response", None, 5)], key=str)


def test_warc_finds_damage(spark, tmp_path):
    warc.write(pages(spark, 5), f"file://{tmp_path}/a")
    with pytest.raises(ValueError, match="truncated|length"):
        list(warc.parse(next((tmp_path / "a").glob("*.gz")).read_bytes()[:-30]))


@pytest.mark.parametrize(("n", "dims"), [(300, 64), (90, 20), (40, 70)])
def test_top_k(spark, n, dims):
    r = np.random.default_rng(n)
    x = r.normal(size=(n, dims))
    x[: n // 3] = x[0]  # a hot code
    x[n // 3 : n // 2] += 3 * x[1]
    data = [(int(i), [float(v) for v in x[i]], 1, "c") for i in range(n)]
    extra = [(n + 1, None, 1, "c"), (n + 2, [], 1, "c"), (None, data[0][1], 1, "c"), data[3], (n + 3, [float("nan")] * dims, 1, "c"), (n + 4, data[2][1][: dims // 2], 1, "c")]
    df = spark.createDataFrame(data + extra, "vec_id bigint, embedding array<double>, label int, code string")
    bits = {i: [v > 0 for v in e] + [False] * (dims - len(e)) for i, e, *_ in data + extra if e and i is not None}
    got = {}
    for row in hamming.top_k(df, df.where("vec_id % 7 = 0"), 6, dims).collect():
        got.setdefault(row["query_id"], []).append((row["rank"], row["distance"], row["neighbor_id"]))
    for q in (i for i in bits if i % 7 == 0):
        best = sorted((sum(a != b for a, b in zip(bits[q], bits[i], strict=True)), i) for i in bits if i != q)[:6]
        assert sorted(got[q]) == [(k + 1, d, i) for k, (d, i) in enumerate(best)]
    assert set(got) == {i for i in bits if i % 7 == 0}


def test_top_k_with_long_lists(spark, monkeypatch):
    """Lists of more than LIST codes are cut, and the answer is the same."""
    monkeypatch.setattr(hamming, "LIST", 3)
    test_top_k(spark, 300, 64)


def test_top_k_takes_whole_vectors(spark):
    df = spark.createDataFrame([(i, [1.0] * 70 + [1.0 if i > k else -1.0 for k in range(20)]) for i in range(21)], "vec_id bigint, embedding array<double>")
    got = hamming.top_k(df, df.where("vec_id = 5"), 3).orderBy("rank").collect()
    assert [(r["neighbor_id"], r["distance"]) for r in got] == [(4, 1), (6, 1), (3, 2)]
    with pytest.raises(ValueError, match="90 components"):
        hamming.top_k(df, df, 3, 64)


def test_top_k_of_few(spark):
    df = spark.createDataFrame([(1, [1.0] * 64), (2, [-1.0] * 64)], "vec_id bigint, embedding array<double>")
    assert [tuple(r) for r in hamming.top_k(df, df, 10).orderBy("query_id").collect()] == [(1, 1, 2, 64), (2, 1, 1, 64)]
    assert hamming.top_k(df.limit(0), df.limit(0), 10).collect() == []
    assert hamming.top_k(df.where("vec_id = 1"), df.where("vec_id = 1"), 10).collect() == []


SF = "/root/testdata/sf0.01"
ARTICLE = "<article><h1>Title &amp; more</h1><p><b>First&nbsp;one\n is here, long enough to count.<br><p>Second paragraph of the text with an <a href=x>inner link</a> &eacute;.</p></article>"


@pytest.mark.parametrize("page", [
    f"<html><body><nav><ul><li><a href=1>Home</a></ul></nav>{ARTICLE}<footer>&copy; me</footer></body></html>",
    f"<body><header><h2>Site</h2></header><aside>Side words that go on</aside><div class='cookie-notice'>We use cookies on this site</div>{ARTICLE}<form><p>Name <input></p></form><script>var t='</p>';</script>",
    f"<div id=wrap><div class='sidebar'>more more more more</div><main>{ARTICLE}<section id='comments'><p>What a fine article this is, I think.</p></section></main></div>",
    f"<div class='site with-sidebar has-share'><div class='widget sidebar'><p>Other things to read here today.</p></div><div id=respond><h1>Leave a reply</h1></div>{ARTICLE}</div>",
    f"<div class='entry-content social-links'>{ARTICLE}</div><div class='newsletter-signup'>Get our news every day by mail</div>",
    f"<p>{'<ul><li><a href=a>one link</a><li><a href=b>two links</a><li><a href=c>three links</a></ul>'}{ARTICLE}",
])
def test_main_text(page):
    assert extract.main_text(page) == "Title & more\n\nFirst one is here, long enough to count.\n\nSecond paragraph of the text with an inner link é."


def given_pages():
    import duckdb

    return [h for (h,) in duckdb.sql(f"SELECT html FROM '{SF}/pages.parquet' ORDER BY page_id").fetchall()]


def article_of(html):
    """The text of the only article element of the given pages, by their markup."""
    import html as entities
    import re

    inner = re.search(r"<article>(.*)</article>", html, re.S).group(1)
    blocks = re.split(r"</?(?:p|h1)>", inner)
    return "\n\n".join(x for x in (" ".join(entities.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in blocks) if x)


def test_main_text_of_given_pages():
    for page in given_pages():
        assert extract.main_text(page) == article_of(page)


def test_density_selects_and_not_the_lists(monkeypatch):
    """Without the selection every given page changes; without the words of classes none does."""
    given = given_pages()
    expected = [extract.main_text(p) for p in given]
    with monkeypatch.context() as m:
        m.setattr(extract, "BOILERPLATE", frozenset())
        m.setattr(extract, "_STARTS", ("\0",) * 6)
        assert [extract.main_text(p) for p in given] == expected
    monkeypatch.setattr(extract, "_select", lambda page, d, marked: d.body)
    assert not any(extract.main_text(p) == x for p, x in zip(given, expected, strict=True))


def test_densities():
    """Densities and their sums against a recursive version over a tree of its own."""
    import math
    from html.parser import HTMLParser

    class Tree(HTMLParser):
        def __init__(self, html):
            super().__init__()
            self.root = self.at = {"tag": "#root", "up": None, "kids": []}
            self.feed(html)

        def handle_starttag(self, tag, attrs):
            self.at = {"tag": tag, "up": self.at, "kids": []}
            self.at["up"]["kids"].append(self.at)

        def handle_endtag(self, tag):
            self.at = self.at["up"]

        def handle_data(self, data):
            self.at["kids"].append(data)

    page = "<body><nav><ul><li><a>Home page</a></li><li><a>News</a></li></ul></nav><div><p>Some <b>bold words</b> and a <a>link here</a>.</p><p>More words of text</p></div><footer>End</footer></body>"
    tree = Tree(page).root["kids"][0]

    def measure(x, linked=False):
        linked = linked or x["tag"] == "a"
        c = l = 0
        t, lt = 1, int(x["tag"] == "a")
        for k in x["kids"]:
            if isinstance(k, str):
                size = len("".join(k.split()))
                own = (size, size * linked, 0, 0)
            else:
                own = measure(k, linked)
            c, l, t, lt = c + own[0], l + own[1], t + own[2], lt + own[3]
        x["m"] = (c, l, t, lt)
        return x["m"]

    measure(tree)
    whole = tree["m"][1] / tree["m"][0]

    def density(x):
        c, l, t, lt = x["m"]
        if c == 0:
            return 0.0
        base = math.log(c / max(1, c - l) * l + whole * c + math.e)
        return c / t * max(0.0, math.log(c / max(1, l) * t / max(1, lt)) / math.log(max(1.5, base)))

    got, found = extract._Density(extract._Page(page)), []

    def walk(x):
        kids = [k for k in x["kids"] if not isinstance(k, str)]
        block = [k for k in kids if k["tag"] not in ("a", "b")]
        found.append((density(x), None if x["tag"] in ("a", "b") else sum(map(density, block)) if block else density(x)))
        for k in kids:
            walk(k)

    walk(tree)
    assert np.allclose([d for d, _ in found], got.density[1:])
    assert all(s is None or abs(s - t) < 1e-9 for (_, s), t in zip(found, got.sums[1:], strict=True))


LONG = [" ".join(f"word{i}x{k}" for k in range(25)) + "." for i in range(6)]


@pytest.mark.parametrize(("page", "blocks"), [
    # parts of one kind belong together; a box of another kind doesn't
    (f"<body><div class=menu><a href=1>One</a><a href=2>Two</a><a href=3>Three</a></div><div class=t><section><p>{LONG[0]}</p><p>{LONG[1]}</p></section><section><p>{LONG[2]}</p><p>{LONG[3]}</p></section></div><div class=x>Side words</div></body>", LONG[:4]),
    # a title beside the container, and a sidebar
    (f"<body><div id=top><a href=/>Site</a></div><div id=content><h1>Head line</h1><div class=post-body><p>{LONG[0]}</p><p>{LONG[1]}</p></div></div><div id=side><h3>More</h3><p>few words</p><p>few too</p></div></body>", ["Head line", *LONG[:2]]),
    # cells of a table as columns
    (f"<body><table><tr><td><a href=1>One</a> <a href=2>Two</a></td><td><h1>Head line</h1><p>{LONG[0]}</p><p>{LONG[1]}</p></td><td><p>few words</p></td></tr></table></body>", ["Head line", *LONG[:2]]),
    # an advert beside paragraphs in the body
    (f"<body><div class=ad>Buy this now</div><h1>Head line</h1><p>{LONG[0]}</p><p>{LONG[1]}</p><footer>(c) me</footer></body>", ["Head line", *LONG[:2]]),
    # no container: paragraphs stand in the body
    (f"<body><nav><a href=1>One</a> <a href=2>Two</a> <a href=3>Three</a></nav><h1>Head line</h1><p>{LONG[0]}</p><p>{LONG[1]}</p><footer>(c) me</footer></body>", ["Head line", *LONG[:2]]),
    # reader comments in articles of their own, more of them than text
    (f"<body><main><article><h1>Head line</h1><p>{LONG[0]}</p></article><section class=comments>{''.join(f'<article class=comment><p>{x}</p><p>{x} too</p></article>' for x in LONG[1:])}</section></main></body>", None),
    # boxes inside the article's element
    (f"<body><div id=p><div class=content><h1>Head line</h1><p>{LONG[0]}</p><div class=ad>Buy this now</div><p>{LONG[1]}</p><aside>See also</aside><div class=share><a href=1>A</a><a href=2>B</a><a href=3>C</a></div><form><p>Your mail</p></form></div><div class=right><p>Other things</p></div></div></body>", ["Head line", *LONG[:2]]),
])
def test_main_text_of_other_layouts(page, blocks):
    assert extract.main_text(page).split("\n\n") == (blocks or ["Head line", LONG[0]])


def test_main_text_odd(spark):
    assert extract.main_text(None) == extract.main_text("") == extract.main_text("<script>x</script>") == ""
    assert extract.main_text("only words") == "only words"
    deep = "<div>" * 5000 + "deep words" + "</div>" * 4000
    assert extract.main_text(deep) == "deep words"
    long = "<article>" + "".join(f"<p>word{i} and text</p>" for i in range(20000)) + "</article>"
    assert extract.main_text(long).count("\n\n") == 19999
    df = spark.createDataFrame([(1, "u", None, "c"), (2, None, ARTICLE, "c"), (2, None, ARTICLE, "c"), (None, "u", "<p>x y z</p>", "c")], "page_id bigint, url string, html string, text string")
    got = extract.extract(df).collect()
    assert len(got) == 4 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert extract.extract(df.limit(0)).collect() == []


def test_lines():
    data = ["one\ntwo\n", "", "\n", "a", "x\n\ny\n"]
    raw = [d.encode() for d in data]
    x = quality.lines_of(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])])
    assert np.diff(x.first).tolist() == [2, 1, 1, 1, 3]
    assert x.weight.tolist() == [3, 3, 1, 1, 1, 1, 1, 1]


def test_marginals():
    """Forward-backward against a sum over all labellings."""
    from itertools import product

    r = np.random.default_rng(3)
    sizes, moves = [3, 1, 4], r.normal(size=(2, 2))
    u = r.normal(size=sum(sizes))
    good, expected = quality.marginals(u, np.r_[0, np.cumsum(sizes)], moves)
    at, pairs = 0, np.zeros((2, 2))
    for n in sizes:
        own, total, counts = np.zeros(n), 0.0, np.zeros((2, 2))
        for y in product((0, 1), repeat=n):
            w = np.exp(sum(u[at + i] * y[i] for i in range(n)) + sum(moves[a, b] for a, b in zip(y, y[1:], strict=False)))
            total += w
            own += w * np.array(y)
            for a, b in zip(y, y[1:], strict=False):
                counts[a, b] += w
        assert np.allclose(good[at : at + n], own / total)
        pairs += counts / total
        at += n
    assert np.allclose(expected, pairs)


def test_quality_on_held_out_documents(spark):
    got = registry.op4_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    held = got.where("held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got.collect())
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.95
    good, bad = [r["score"] for r in held if r["quality"] == 1], [r["score"] for r in held if r["quality"] == 0]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.97


def test_quality_trains_on_lines_of_whole_texts(monkeypatch):
    """The lines that a long text trains on come from anywhere in it."""
    import pyarrow as pa

    monkeypatch.setattr(quality, "TRAIN_LINES", 4)
    long = [f"{i} " + "".join(f"line {k}\n" for k in range(40)) for i in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array([1] * 41), pa.array([*long, None])], names=["label", "text"])
    out = [np.frombuffer(x, np.float32).reshape(-1, quality.N_FEATURES) for b in quality._features(iter([batch])) for x in b.column(1).to_pylist()]
    assert {len(x) for x in out[:-1]} == {4} and len(out[-1]) == 1
    assert 0 < sum(x[0, -2] == 1 for x in out[:-1]) < 15  # few are a text's first lines


def brute_quality(model, text):
    """The score of a text as a sum over all labellings of its lines."""
    from itertools import product

    raw = (text or "").encode()
    x = quality.lines_of(np.frombuffer(raw, np.uint8), np.r_[0, len(raw)])
    u, n = model.odds(x.features), len(x.weight)
    total = good = 0.0
    for y in product((0, 1), repeat=n):
        w = np.exp(sum(u[i] * y[i] for i in range(n)) + sum(model.moves[a, b] for a, b in zip(y, y[1:], strict=False)))
        total += w
        good += w * sum(x.weight[i] * y[i] for i in range(n)) / x.weight.sum()
    return good / total


def test_quality_query_equals_brute_force(spark):
    """Scores of the query's documents with few lines against a sum over all labellings."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, labels.where("crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 != 1"))
    found = {r["doc_id"]: r["score"] for r in registry.op4_quality(spark, SF).collect()}
    few = [r for r in docs.select("doc_id", "text").collect() if (r["text"] or "").count("\n") < 9]
    assert len(few) > 200 and set(found) == {r["doc_id"] for r in docs.collect()}
    for r in few[:300]:
        assert abs(found[r["doc_id"]] - brute_quality(model, r["text"])) < 1e-6


def test_quality_odd(spark, odd_documents, no_documents):
    model = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    got = quality.score(odd_documents.drop("score"), model, ["doc_id", "lang"]).collect()
    assert len(got) == odd_documents.count() and all(0 <= r["score"] <= 1 for r in got)
    assert quality.score(odd_documents, model, ["doc_id", "score"]).columns == ["doc_id", "score"]
    assert quality.score(no_documents, model, ["doc_id"]).collect() == []
    nothing = quality.train(no_documents, spark.createDataFrame([], "doc_id bigint, quality int"))
    assert {r["score"] for r in quality.score(odd_documents, nothing, ["doc_id"]).collect()} == {0.5}


def test_mixing_reaches_its_targets(spark):
    got = registry.op2_mixing(spark, SF)
    sums = got.agg(F.sum("n_tokens").alias("all"), *[F.sum(F.col("rate") * F.col("n_tokens") * F.col(f"p_{d}")).alias(d) for d in registry.WEIGHTS], F.min("rate").alias("least")).first()
    for d, w in registry.WEIGHTS.items():
        assert abs(sums[d] / sums["all"] - w) < 1e-4
    assert sums["least"] >= 0
    assert got.where("abs(p_clean + p_low + p_toxic - 1) > 1e-9").isEmpty()
    labels = registry.domain_labels(spark.read.parquet(f"{SF}/labels.parquet"))
    best = F.when(F.col("p_clean") >= F.greatest("p_low", "p_toxic"), "clean").when(F.col("p_low") >= F.col("p_toxic"), "low").otherwise("toxic")
    assert got.join(labels, "doc_id").agg(F.avg((best == F.col("domain")).cast("double"))).first()[0] > 0.85


def test_rates_with_a_bound(spark):
    """Rates at the bound leave the fit, which then needs more than one step; brute force agrees on what is reached."""
    r = np.random.default_rng(5)
    p = r.dirichlet([0.3, 0.3], size=400)
    t = r.integers(1, 200, 400)
    df = spark.createDataFrame([(int(a), float(b), float(c)) for a, (b, c) in zip(t, p, strict=True)], "n_tokens bigint, p_a double, p_b double")
    targets = {"a": 0.98 * t.sum(), "b": 0.05 * t.sum()}
    rate, report = mixing.fit_rates(df, targets)
    got = df.select("*", rate.alias("r")).collect()
    assert min(x["r"] for x in got) == 0
    for d in targets:
        assert abs(sum(x["r"] * x["n_tokens"] * x[f"p_{d}"] for x in got) - targets[d]) < 1e-3 * t.sum()
        assert abs(report[d]["reached"] - targets[d]) < 1e-3 * t.sum()
    _, report = mixing.fit_rates(df.limit(0), targets)
    assert report["a"]["reached"] == 0


def least_squares(p, t, want):
    """Nonnegative least squares by coordinate descent."""
    a = (p * t[:, None]).T
    r = np.ones(len(t))
    for _ in range(4000):
        res = a @ r - want
        for k in range(len(t)):
            if a[:, k] @ a[:, k] > 0:
                new = max(0.0, r[k] - a[:, k] @ res / (a[:, k] @ a[:, k]))
                res += a[:, k] * (new - r[k])
                r[k] = new
    return ((a @ r - want) ** 2).sum()


@pytest.mark.parametrize("want", [(500.0, 4000.0, 100.0), (3000.0, 10.0, 10.0)])
def test_rates_that_cannot_meet_their_targets(spark, want):
    """The rates reach the least-squares point, by brute force."""
    r = np.random.default_rng(8)
    p = r.dirichlet([4, 3, 3], size=40)
    t = r.integers(1, 100, 40).astype(float)
    df = common.stored(spark.createDataFrame([(int(n), *map(float, x)) for n, x in zip(t, p, strict=True)], "n_tokens bigint, p_a double, p_b double, p_c double").coalesce(1), "m")
    rate, report = mixing.fit_rates(df, dict(zip("abc", want, strict=True)))
    got = df.select("*", rate.alias("r")).collect()
    sums = [sum(x["r"] * x["n_tokens"] * x[f"p_{d}"] for x in got) for d in "abc"]
    assert np.allclose(sums, [report[d]["reached"] for d in "abc"], rtol=1e-6) and min(x["r"] for x in got) >= 0
    best, own = least_squares(p, t, np.array(want)), sum((a - b) ** 2 for a, b in zip(sums, want, strict=True))
    assert best > 1000 and own <= 1.02 * best


def test_memberships_replace_columns_of_their_names(spark):
    model = mixing.Classifier(["a", "b"], [0.0, 0.0])
    df = spark.createDataFrame([("x y", 5, 6, 7)], "text string, n_tokens int, p_a int, `_words.x` int")
    assert [tuple(r) for r in mixing.memberships(df, model).collect()] == [("x y", 7, 2, 0.5, 0.5)]


def test_mixing_odd(spark, odd_documents, no_documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = mixing.train(docs, registry.domain_labels(spark.read.parquet(f"{SF}/labels.parquet")), sorted(registry.WEIGHTS))
    got = mixing.mix(mixing.memberships(odd_documents, model), registry.WEIGHTS)
    assert got.count() == odd_documents.count()
    assert got.where("text IS NULL AND n_tokens != 0").isEmpty() and got.where("rate < 0 OR rate IS NULL").isEmpty()
    assert mixing.mix(mixing.memberships(no_documents, model), registry.WEIGHTS).collect() == []
    blank = mixing.train(no_documents, spark.createDataFrame([], "doc_id bigint, domain string"), ["a", "b"])
    assert {(r["p_a"], r["p_b"]) for r in mixing.memberships(odd_documents, blank).select("p_a", "p_b").collect()} == {(0.5, 0.5)}


def test_copies(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") % 2 == 0, 0.96).otherwise(1.5).alias("r")).select("id", "r", mixing.copies(F.col("r"), F.col("id")).alias("n"))
    assert {r["n"] for r in df.where("r < 1").collect()} == {1}
    assert abs(df.where("r > 1").agg(F.avg("n")).first()[0] - 1.5) < 0.05


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    got = out.collect()
    assert out.columns == [*docs.columns, "size", "shard", "slot"]
    check_law(got, corpus_pipeline.SHARDS)
    assert len({r["doc_id"] for r in got}) == len(got) and len(got) > 300
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = {r["doc_id"] for r in got}
    assert np.mean([i in left for i, (q, _) in labels.items() if q == 0]) < 0.1
    assert np.mean([i in left for i, x in labels.items() if x == (1, 0)]) > 0.8


def test_pipeline_stages_on_odd_rows(spark, odd_documents, no_documents):
    import corpus_pipeline

    for df in (odd_documents, no_documents):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, SF)
            assert name == "sharding" or out.columns == df.columns
            assert out.count() <= df.count()


@pytest.mark.parametrize("percent", [6, 12, 33])
def test_pipeline_mixing_meets_the_weights(spark, tmp_path, percent):
    import corpus_pipeline

    n = 4000
    toxic = F.pmod(F.xxhash64("doc_id"), F.lit(100)) < percent
    word = lambda k: F.concat(F.when(toxic, "vile").otherwise("fair"), F.pmod(F.xxhash64("doc_id", F.lit(k)), F.lit(20)).cast("string"))
    docs = spark.range(n).withColumnRenamed("id", "doc_id").select("doc_id", F.concat_ws(" ", *[word(k) for k in range(20)]).alias("text"))
    docs.select("doc_id", toxic.cast("int").alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    had = {r[0]: r[1] for r in docs.groupBy(toxic).count().collect()}
    got = {r[0]: r[1] for r in corpus_pipeline.mix_domains(spark, docs, str(tmp_path)).groupBy(toxic).count().collect()}
    assert had[True] > 1.1 * n * corpus_pipeline.WEIGHTS["toxic"]
    assert got[False] >= 0.99 * had[False]
    assert abs(got.get(True, 0) / sum(got.values()) - corpus_pipeline.WEIGHTS["toxic"]) < 0.008


def test_pipeline_stages_pass_any_names_on(spark):
    """Columns named like what operators use inside, in other cases, with dots: all come out as they were."""
    import corpus_pipeline

    names = ["Score", "_scored", "score", "_score", "a.b", "n_tokens", "p_clean", "_id", "_document", "TEXT", "id", "c", "sig", "k", "Shard"]
    docs = [(i, t) for i, t in texts(6, 24) if t is None or len(t) < 3000]
    df = spark.createDataFrame([(i, t, *[f"{n}{i}" for n in names]) for i, t in docs], ["doc_id", "text", *[f"x{k}" for k in range(len(names))]]).toDF("doc_id", "text", *names)
    had = {r[0]: tuple(r) for r in df.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, SF)
        kept = [c for c in df.columns if name != "sharding" or c != "Shard"]
        assert out.columns == (kept if name != "sharding" else [*kept, "size", "shard", "slot"])
        got = [tuple(r)[: len(kept)] for r in out.collect()]
        assert all(r == tuple(x for x, c in zip(had[r[0]], df.columns, strict=True) if c in kept) for r in got)
        assert len(got) >= (len(docs) if name in ("sharding", "decontamination") else 1 if name == "quality" else 8), name


def test_pipeline_stages_judge_documents_not_ids(spark, odd_documents):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    got = stages["near_duplicates"](spark, odd_documents, SF).select("doc_id", "text").collect()
    had = {tuple(r) for r in odd_documents.select("doc_id", "text").collect()}
    assert len(set(got)) == len(got) and {tuple(r) for r in got} <= had
    left = {tuple(r) for r in got}
    # unique documents without an id stay, the copy without an id goes, and so does not what shares its id
    assert {(None, None), (None, "x y z")} <= left and (None, texts(2, 3)[1][1]) not in left
    assert (5, "another text under id five " * 8) in left and {(1, None), (2, ""), (3, " \n\t "), (403, "a")} <= left

    words = lambda seed, n: " ".join(f"{w}{seed}" for w in "alpha beta gamma delta eps zeta eta theta iota kappa".split()[:n] * 3)
    near = words(1, 10)
    odd = [(None, near), (None, near + " more"), (None, words(2, 10)), (7, words(3, 10)), (7, words(3, 10) + " more"), (7, words(4, 10)), (9, words(5, 10)), (9, words(5, 10)), (8, words(2, 10) + " more")]
    df = spark.createDataFrame(rows(odd), SCHEMA)
    got = stages["near_duplicates"](spark, df, SF).select("doc_id", "text").collect()
    ids = sorted(str(r["doc_id"]) for r in got)
    assert ids == ["7", "7", "8", "9", "None"] and (7, words(4, 10)) in got  # one of each group, one row of each document

    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 100").orderBy("item_id").first()["text"]
    df = spark.createDataFrame(rows([(None, item), (None, words(1, 10)), (7, item), (7, words(2, 10)), (None, None)]), SCHEMA)
    got = {tuple(r) for r in stages["decontamination"](spark, df, SF).select("doc_id", "text").collect()}
    assert got == {(None, words(1, 10)), (7, words(2, 10)), (None, None)}


def test_pipeline_mixing_draws_documents_without_ids_one_by_one(spark, tmp_path):
    import corpus_pipeline

    n = 1000
    toxic = F.col("id") % 3 == 0
    docs = spark.range(n).select(F.when(F.col("id") < n // 2, F.col("id")).alias("doc_id"), F.concat(F.when(toxic, "vile bad ").otherwise("fair good "), F.col("id").cast("string")).alias("text"))
    docs.where("doc_id IS NOT NULL").select("doc_id", F.col("text").startswith("vile").cast("int").alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.mix_domains(spark, docs, str(tmp_path)).where("doc_id IS NULL").select(F.col("text").startswith("vile").alias("vile")).collect()
    assert len([r for r in got if not r["vile"]]) > 300 and 0 < len([r for r in got if r["vile"]]) < 60
