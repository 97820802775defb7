"""Operators on words against brute force: substrings, decontamination, near-duplicates, licenses."""

import sys
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute
from conftest import SCHEMA, rows, texts

from clickrill.llm import decontaminate, licenses, neardup, substrings, tokens
from clickrill.llm.common import spread_join, stored


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_tokens_are_the_words():
    for text in [t for _, t in texts(3, 30) if t]:
        assert tokens.SPACED.split(text) == [w.encode() for w in brute.SPACED.findall(text)]
        assert tokens.ALNUM_LOWER.split(text) == [w.encode() for w in brute.ALNUM.findall(text.translate(brute.LOWER))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aBé \t\n\x1c.-K😀", max_size=30)), max_size=12))
def test_word_hashes(found):
    import pyarrow as pa

    for alphabet in (tokens.SPACED, tokens.SPACED_LOWER, tokens.ALNUM_LOWER):
        known = {}
        for i, j, words in tokens.chunks(pa.array(found, pa.string()), alphabet):
            for k in range(i, j):
                own = alphabet.split(found[k])
                hashes = words.hashes[words.first[k - i] : words.first[k - i + 1]]
                assert len(own) == len(hashes)
                for w, h in zip(own, hashes.tolist(), strict=True):
                    assert known.setdefault(w, h) == h
        assert len(set(known.values())) == len(known)


def test_substrings(documents):
    expected = brute.substring(pairs(documents))
    got = substrings.dedup(documents).collect()
    assert len(got) == len(expected)
    assert {r["id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == expected
    for r in got:
        assert sum(s["stop"] - s["start"] for s in r["removed"]) == r["n_removed"]
        assert len(r["kept_text"].encode().split()) == r["n_words"] - r["n_removed"]


@pytest.mark.parametrize("length", [4, 9])
def test_substrings_of_other_lengths(spark, length):
    docs = [(i, t) for i, t in texts(5, 24) if t is None or len(t) < 5000]
    got = substrings.dedup(spark.createDataFrame(rows(docs), SCHEMA), length).collect()
    assert {r["id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == brute.substring(docs, length)


def test_substrings_in_small_batches(spark, documents):
    """Groups that go on from batch to batch, and chunks of a few texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = substrings.dedup(documents.coalesce(1)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r["id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == brute.substring(pairs(documents))


def test_substrings_with_hot_anchors(documents, monkeypatch):
    """Windows of an anchor with many places meet by their own names, and the result is the same."""
    monkeypatch.setattr(substrings, "HOT_PLACES", 2)
    monkeypatch.setattr(substrings, "HOT_ANCHORS", 10**9)
    got = substrings.dedup(documents).collect()
    assert {r["id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == brute.substring(pairs(documents))


def test_substrings_of_one_line_beside_other_words(spark):
    """One anchor with a place in each document: all of them hot, none a repeat but the last."""
    line = " ".join(f"line{i}" for i in range(10))
    docs = [(i, f"{' '.join(f'a{i}x{k}' for k in range(9))} {line} {' '.join(f'b{i}x{k}' for k in range(9))}") for i in range(300)]
    docs.append((300, docs[7][1]))
    sent, hot = substrings._sent(substrings._keyed(spark.createDataFrame(docs, "doc_id bigint, text string"), "doc_id", "text"), 20)
    assert sent.count() > 0 and not len(hot)
    got = {r["id"]: r["n_removed"] for r in substrings.dedup(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)).collect()}
    assert got == {**dict.fromkeys(range(300), 0), 300: 28}


def test_first_rung_counts_places(spark, monkeypatch):
    """Anchors that a task has met twice send counts in place of rows, and count as hot with all their places."""
    import pyarrow as pa

    from clickrill.llm import tokens as t

    monkeypatch.setattr(t, "CHUNK", 400)
    r = __import__("random").Random(3)
    line = " ".join(f"line{i}" for i in range(20))
    docs = [f"{' '.join(r.choice('abcdefgh') + str(r.randrange(99)) for _ in range(10))} {line}" for _ in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(200), pa.int64()), pa.array([7] * 200, pa.int64()), pa.array(docs)], names=["id", "t", "text"])
    out = pa.Table.from_batches(list(substrings._rung1(20)(iter([batch])))).combine_chunks()
    counts = out.filter(pa.compute.equal(out["pos"], substrings._COUNT))
    assert counts.num_rows and sum(counts["n"].to_pylist()) > 150
    rows_ = out.sort_by("h").to_batches(max_chunksize=3)
    found = pa.Table.from_batches(list(substrings._repeated(100)(iter(rows_)))).to_pylist()
    assert {x["id"] for x in found if x["pos"] >= 0} == set(range(200))
    assert len({x["id"] for x in found if x["pos"] < 0}) >= 1 and all(x["id"] == x["t"] for x in found if x["pos"] < 0)
    assert not [x for x in pa.Table.from_batches(list(substrings._repeated(200)(iter(rows_)))).to_pylist() if x["pos"] < 0]


#: Two words that share every polynomial hash modulo 2**64, whatever its base.
TWINS = ["".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(2048)) for flip in (0, 1)]


def test_words_that_fool_polynomial_hashes(spark):
    rest = " ".join(f"w{i}" for i in range(19))
    docs = spark.createDataFrame([(1, f"{TWINS[0]} {rest}"), (2, f"{TWINS[1]} {rest}"), (3, f"{TWINS[0]} {rest}")], "doc_id bigint, text string")
    assert {r["id"]: r["n_removed"] for r in substrings.dedup(docs).collect()} == {1: 0, 2: 0, 3: 20}
    items = spark.createDataFrame([(9, f"{TWINS[0]} {' '.join(rest.split()[:12])}")], "item_id bigint, text string")
    assert {r["id"]: r["n_hit"] for r in decontaminate.find(docs, items).collect()} == {1: 13, 2: 0, 3: 13}
    short = spark.createDataFrame([(1, TWINS[0]), (2, TWINS[1]), (3, TWINS[0])], "doc_id bigint, text string")
    assert {r["doc_id"]: r["component_id"] for r in neardup.link(short, 3, 85).collect()} == {1: 1, 2: 2, 3: 1}


def test_equal_hashes_in_a_window_are_no_match(spark, monkeypatch):
    """Hashes of words only choose candidates: with all of them equal, bytes still decide."""
    import numpy as np

    monkeypatch.setattr(tokens.Words, "_hash", lambda self, key: np.ones(len(self.starts), np.uint64))
    import pyarrow as pa

    text = [" ".join(f"{x}{i}" for i in range(20)) for x in "ab"]
    docs = pa.array([*text, text[0]])
    for _, _, words in tokens.chunks(docs, tokens.SPACED):
        names = words.digests(np.array([0, 20, 40]), 20)
    assert names[0] == names[2] != names[1]


def test_ladder(documents, no_documents):
    """Every rung against counts of all windows, up to the longest that repeats."""
    docs = [(i, brute.SPACED.findall(t or "")) for i, t in pairs(documents)]
    want, length = set(), 20
    while True:
        places = {}
        for i, w in docs:
            for s in range(len(w) - length + 1):
                places.setdefault(hash(tuple(w[s : s + length])), []).append((i, s, length))
        rung = {x for v in places.values() if len(v) > 1 for x in v}
        if not rung:
            break
        want |= rung
        length *= 2
    assert length > 5000
    got = [tuple(r) for r in substrings.ladder(documents).collect()]
    assert len(got) == len(want) and set(got) == want
    assert substrings.ladder(no_documents).collect() == []


def test_substrings_odd(odd_documents, no_documents):
    got = substrings.dedup(odd_documents).collect()
    assert len(got) == odd_documents.count()
    assert all(r["n_words"] == 0 and r["kept_text"] == "" for r in got if r["n_words"] == 0)
    twins = {}
    for r in got:
        if r["id"] not in (None, 4, 5, 400):  # two texts each
            twins.setdefault(r["id"], set()).add(r["kept_sha256"])
    assert all(len(v) == 1 for v in twins.values())
    copied = [r for r in got if r["id"] is None and r["n_words"] > 100]
    assert copied and all(r["n_removed"] == r["n_words"] for r in copied)  # null ids come last
    assert substrings.dedup(no_documents).collect() == []


ITEMS = [(1, texts()[0][1].split("\n")[1][:200]), (2, "Base: BAMA, x"), (10, " ".join(texts()[1][1].split()[20:60])), (3, None), (4, ""), (5, "the the"), (6, "É"), (10, "another item with the same number and quite a few words more than thirteen in it"), (7, texts()[0][1][:90])]


def test_decontamination(spark, documents):
    items = spark.createDataFrame([(i, x, "clash") for i, x in ITEMS], "item_id bigint, text string, term string")
    expected = sorted(brute.contamination(pairs(documents), ITEMS), key=lambda x: x[0])
    got = sorted(((r["id"], r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.find(documents, items).collect()), key=lambda x: x[0])
    assert got == expected
    assert any(x[2] for x in got)


def test_decontamination_odd(spark, odd_documents, no_documents):
    items = spark.createDataFrame([*ITEMS, (None, texts(2, 3)[1][1])], "item_id bigint, text string")
    got = [(r["id"] is None, r["id"], r["n_words"], r["n_hit"]) for r in decontaminate.find(odd_documents, items).collect()]
    expected = [(i is None, i, n, h) for i, n, h, _ in brute.contamination(pairs(odd_documents), [*ITEMS, (None, texts(2, 3)[1][1])])]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert decontaminate.find(no_documents, items).collect() == []
    assert all(r["n_hit"] == 0 for r in decontaminate.find(odd_documents, items.limit(0)).collect())


def spread(text, window, slop):
    """Stretches of the text that have the window's words in order, with 1 to slop others: all of them, by brute force."""
    w = brute.ALNUM.findall((text or "").translate(brute.LOWER))
    out = set()
    for s in range(len(w)):
        at, k = s, 0
        while at < len(w) and k < len(window):
            if w[at] == window[k]:
                k += 1
            elif at == s:
                break
            at += 1
        if k == len(window) and len(window) < at - s <= len(window) + slop:
            out.add((s, at - s))
    return out


@pytest.mark.parametrize("slop", [2, 5])
def test_proximity(spark, slop):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    r = __import__("random").Random(slop)
    docs = [(1, f"x {item} y"), (2, item.replace("six", "six extra words")), (3, "one seven thirteen"), (4, " ".join(reversed(item.split()))), (5, None), (6, item.replace("two", "two a b c d e f g")), (7, item.replace("two", "too"))]
    for i in range(60):
        w = item.split()
        for _ in range(r.randrange(1, 7)):
            w.insert(r.randrange(1, len(w)), r.choice(["x", "y", "one", "six", "thirteen"]))
        docs.append((10 + i, " ".join(["z"] * r.randrange(4) + w)))
    items = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    got = decontaminate.find(spark.createDataFrame(docs, "doc_id bigint, text string"), items, slop=slop).collect()
    expected = {i: spread(x, item.split(), slop) for i, x in docs}
    for r in got:
        own = {(m["position"], m["length"]) for m in r["near"]}
        assert own <= expected[r["id"]] and bool(own) == bool(expected[r["id"]]), r["id"]
    assert sum(bool(x) for x in expected.values()) > 10
    assert {r["id"] for r in got if r["n_hit"]} == {1}


def test_one_index_serves_several_benchmarks(spark, documents, monkeypatch):
    """The index holds every word, long lists in several rows; terms with many occurrences are dealt out."""
    monkeypatch.setattr(decontaminate, "SHARE", 3)
    postings = decontaminate.index(documents)
    assert postings.agg(F.sum(F.size("ids"))).first()[0] == sum(len(brute.ALNUM.findall((t or "").translate(brute.LOWER))) for _, t in pairs(documents))
    for own in (ITEMS[:3], ITEMS[3:]):
        items = spark.createDataFrame(own, "item_id bigint, text string")
        expected = {x[0]: x[2] for x in brute.contamination(pairs(documents), own)}
        assert {r["id"]: r["n_hit"] for r in decontaminate.find(documents, items, postings=postings).collect()} == expected


def test_long_lists_are_cut(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(decontaminate, "LIST", 3)
    b = pa.RecordBatch.from_arrays([pa.array([1, None, 3]), pa.array(["a a a a a", "a b", None])], names=["id", "text"])
    rows_ = [x for out in decontaminate._postings(iter([b])) for x in out.to_pylist()]
    assert sorted(len(x["ids"]) for x in rows_) == [1, 3, 3]
    assert sorted(((x["term"], i, p) for x in rows_ for i, p in zip(x["ids"], x["positions"], strict=True)), key=str)
    assert {(i, p) for x in rows_ for i, p in zip(x["ids"], x["positions"], strict=True)} == {*((1, p) for p in range(5)), (None, 0), (None, 1)}


@pytest.mark.parametrize(("length", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(documents, length, percent):
    expected = brute.near(pairs(documents), length, percent)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.link(documents, length, percent).collect()}
    assert got == expected
    assert any(c != i for i, (_, c) in got.items())


def test_near_duplicates_in_cells(documents, monkeypatch):
    """Lists longer than a cell are dealt out, and the result is the same."""
    monkeypatch.setattr(neardup, "CELL", 4)
    expected = brute.near(pairs(documents), 3, 85)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.link(documents, 3, 85).collect()} == expected


def test_near_duplicates_in_cells_of_few_values(documents, monkeypatch):
    """Large sets share a cell with few others, or none."""
    monkeypatch.setattr(neardup, "CELL_VALUES", 300)
    expected = brute.near(pairs(documents), 3, 85)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.link(documents, 3, 85).collect()} == expected


def test_least_shared():
    """The exact chance that a pair at the threshold is let go by its sketches."""
    from math import comb

    for percent in (80, 85):
        c, t = neardup.least_shared(percent), percent / 100
        chance = lambda c: sum(comb(32, k) * t**k * (1 - t) ** (32 - k) for k in range(c))  # noqa: B023, E731
        assert chance(c) <= neardup.MISS < chance(c + 1)


def test_spread_join(spark):
    """Hot keys go by broadcast, the others by shuffle, and the result is that of a join."""
    rows_ = spark.range(1000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("k"), "id")
    table = stored(rows_.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("m")).where("k % 2 = 0"), "t")
    joined = spread_join(rows_, table, "k", "n", 5, 1000)
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().toString()
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, rows_.join(table, "k").collect()))


def test_components_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HUB", 5)
    edges = [("hub", f"s{i:03}") for i in range(200)] + [(f"s{i:03}", f"x{i:03}") for i in range(200)] + [("a", "z")]
    got = {r["node"]: r["root"] for r in neardup.components(stored(spark.createDataFrame(edges, "a string, b string").repartition(3), "e")).collect()}
    assert len(got) == 403 and {v for k, v in got.items() if k not in ("a", "z")} == {"hub"} and got["z"] == "a"


def test_near_duplicates_odd(odd_documents, no_documents):
    got = neardup.link(odd_documents, 3, 85).collect()
    assert len(got) == odd_documents.count()
    assert all(r["component_id"] == r["doc_id"] and r["kept"] for r in got if r["n_shingles"] == 0)
    null = [r for r in got if r["doc_id"] is None and r["n_shingles"] > 100]
    assert null and all(not r["kept"] and r["component_id"] is not None for r in null)
    assert neardup.link(no_documents).collect() == []


def test_sketch_estimate():
    import numpy as np

    r = np.random.default_rng(1)
    a = np.unique(r.integers(1, 2**63, 1000, dtype=np.uint64))
    b = np.unique(np.r_[a[:900], r.integers(1, 2**63, 100, dtype=np.uint64)])
    est, least = neardup.estimate(a[None, :256], b[None, :256])
    assert abs(est[0] - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.2
    assert least[0] == np.intersect1d(a, b)[0]


def test_components(spark):
    edges = [(f"n{i:03}", f"n{i + 1:03}") for i in range(40)] + [("z1", "z2"), ("z3", "z2"), ("z3", "z3")] + [("hub", f"s{i}") for i in range(50)]
    got = {r["node"]: r["root"] for r in neardup.components(stored(spark.createDataFrame(edges, "a string, b string"), "e")).collect()}
    assert {got[f"n{i:03}"] for i in range(41)} == {"n000"}
    assert got["z3"] == "z1" and got["s49"] == "hub" and len(got) == 41 + 3 + 51


NOTICES = ["All rights reserved.", "ALL RIGHTS\n reserved, all rights reserved", "Licensed under CC BY-NC 4.0.", "GNU General Public License, version 3 or later.", "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "general public licenses", "cc  by", None, "", "cc by cc by-sa", "caring", "Kall rights reserved K", "overall rights reserved"]


def test_licenses(spark, documents):
    docs = [*[(i, x) for i, x in enumerate(NOTICES)], *[(100 + i, t) for i, t in texts(4, 10)], (99, "lorem " * 3000 + "All rights reserved. " * 300)]
    got = licenses.scan(spark.createDataFrame(rows(docs), SCHEMA)).collect()
    assert len(got) == len(docs)
    by = {r["doc_id"]: r for r in got}
    for i, text in docs:
        n, places, first, last, base = brute.licenses(text)
        r = by[i]
        starts = [x["start"] for x in r["base"]]
        assert (r["n_words"], len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted({x["label"] for x in r["base"]}))) == (n, places, first, last, base)
        assert (r["score"] > 0) == bool(r["detections"]) and set(x["label"] for x in r["base"]) <= set(r["labels"])
    assert by[2]["labels"] == ["cc-by", "cc-by-nc-4.0", "licensed"]
    assert by[3]["labels"] == ["gpl", "gpl-3"]
    assert by[4]["labels"] == ["mit"] and by[5]["labels"] == ["apache-2.0"]


def plain_detections(text):
    """Every rule by Python's re, each place against all others."""
    import re

    joined = " " + " ".join(brute.ALNUM.findall((text or "").translate(brute.LOWER))) + " "
    found = []
    for i, (label, priority, keyword, rx) in enumerate(licenses.RULES):
        if keyword in joined:
            for m in re.finditer(f"(?<= )(?:{rx})(?= )", joined):
                start = joined[: m.start()].count(" ") - 1
                found.append((start, start + m.group().count(" ") + 1, priority, i, label))
    inside = lambda a, b: b[0] <= a[0] and a[1] <= b[1] and b[2] >= a[2] and (b[:3] != a[:3] or b[3] < a[3])
    return sorted((a[0], a[1], a[2], a[4]) for a in found if not any(inside(a, b) for b in found if b is not a))


def test_license_detections(spark):
    r = __import__("random").Random(2)
    samples = [x for _, _, _, x in licenses.RULES if "(" not in x and "[" not in x and "?" not in x]
    docs = [(i, "Some words. " + " and ".join(r.choice(samples) for _ in range(r.randrange(1, 6))) + " " + r.choice([n for n in NOTICES if n])) for i in range(150)]
    docs += [(1000 + i, f"Text {label} under Creative Commons Attribution-NonCommercial 4.0 International, GPL-3.0 or later, GNU Lesser General Public License v2.1") for i, label in enumerate("ab")]
    got = {x["doc_id"]: sorted((d["start"], d["stop"], d["priority"], d["label"]) for d in x["detections"]) for x in licenses.scan(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    for i, text in docs:
        assert got[i] == plain_detections(text), text
    assert {x[3] for x in got[1000]} >= {"cc-by-nc-4.0", "gpl-3", "lgpl-2.1"}


def test_license_suppression(spark):
    """No detection that is left lies inside another of the same or a higher priority."""
    docs = spark.createDataFrame([(i, x) for i, x in enumerate([n for n in NOTICES if n] + [" ".join(n for n in NOTICES if n) * 5])], "doc_id bigint, text string")
    for r in licenses.scan(docs).collect():
        d = r["detections"]
        for i, a in enumerate(d):
            assert not any(j != i and b["start"] <= a["start"] and a["stop"] <= b["stop"] and b["priority"] >= a["priority"] for j, b in enumerate(d))


def test_license_rules():
    import re

    assert len(licenses.RULES) >= 200
    for label, priority, keyword, rx in licenses.RULES:
        re.compile(rx)
        assert label and priority in (1, 2, 3) and any(r in " " + keyword for r in licenses.ROOTS), (label, keyword)


def samples_of(rx):
    """Texts that a rule's expression matches: every alternative, optional parts left out and put in."""
    from itertools import product
    from re import _parser as parser

    def expand(node):
        out = [""]
        for op, x in node:
            kind = str(op)
            if kind == "LITERAL":
                each = [chr(x)]
            elif kind == "ANY":
                each = ["x"]
            elif kind == "IN":
                each = [chr(v if str(o) == "LITERAL" else v[0]) for o, v in x]
            elif kind == "BRANCH":
                each = [y for b in x[1] for y in expand(b)]
            elif kind == "SUBPATTERN":
                each = expand(x[-1])
            else:
                assert kind == "MAX_REPEAT", kind
                each = [""] * (x[0] == 0) + [y * max(1, x[0]) for y in expand(x[2])]
            out = ["".join(p) for p in product(out, dict.fromkeys(each))]
        return out

    return expand(parser.parse(rx))


def test_license_gates_let_their_own_texts_through():
    shut = [(label, keyword, x) for label, _, keyword, rx in licenses.RULES for x in samples_of(rx) if keyword not in f" {x} " or not any(r in f" {x} " for r in licenses.ROOTS)]
    assert not shut, shut[:10]


def test_license_rules_have_gates_of_their_own():
    """Every text that a rule matches holds its gate, and no gate serves many rules."""
    from collections import Counter

    assert licenses.plain_runs("a(?:b|c)? dx?e [fg]h+i{2}j") == ["a", " d", "e ", "h", "j"]
    shut = [(label, licenses.gate(k, rx), x) for label, _, k, rx in licenses.RULES for x in samples_of(rx) if licenses.gate(k, rx) not in f" {x} "]
    assert not shut, shut[:10]
    assert max(Counter(licenses.gate(k, rx) for _, _, k, rx in licenses.RULES).values()) <= 24


def test_license_texts_without_english_words_are_found(spark):
    wanted = {"alle rechte vorbehalten": "reserved", "Datenlizenz Deutschland - Namensnennung": "dl-de-by", "Deutsche Freie Software Lizenz": "d-fsl", "CeCILL": "cecill", "a trade secret": "trade-secret", "without prior written consent": "permission-required"}
    docs = spark.createDataFrame(list(enumerate(wanted)), "doc_id bigint, text string")
    got = {r["text"]: r["labels"] for r in licenses.scan(docs).collect()}
    assert got == {x: [label] for x, label in wanted.items()}


def test_license_scan_of_nothing(no_documents):
    assert licenses.scan(no_documents).collect() == []
    assert licenses.scan(no_documents).where(F.lit(True)).columns[: len(no_documents.columns)][0] == "doc_id"
