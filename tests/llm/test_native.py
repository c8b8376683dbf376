"""URL filters, decontamination and licence scans: plain versions and edge cases."""

import datetime as dt
import math
import re

import pytest
from pyspark.sql import functions as F

from sheaf.llm import decontam, licenses, urlfilter


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def test_patterns_of(spark):
    rows = [("http://u@A.b.Com:80/x//y/?q#f",), ("nonsense",), (None,), ("https://h.org",)]
    out = spark.createDataFrame(rows, "url string").select(urlfilter.patterns_of(F.col("url")).alias("p")).collect()
    found = [[x.pattern for x in (r.p or [])] for r in out]
    assert found[0] == ["a.b.com", "b.com", "com", "a.b.com/x", "a.b.com/x/y"]
    assert found[1] == [] and found[2] == [] and found[3] == ["h.org", "org"]


def test_url_filter_against_loops(spark):
    entries = [
        ("l", "b.com", "block", day(10)), ("l", "b.com", "remove", day(20)), ("l", "b.com", "block", day(90)), ("m", "a.b.com/ok", "allow", day(12)),
        ("m", "b.com", "allow", day(15)), ("l", "c.com", "block", day(5)), ("l", "c.com", "remove", day(5)), ("l", None, "block", day(1)),
        ("l", "d.com", "block", None), ("l", "e.com", "what", day(1)), ("l", "b.com", "block", day(10)),
    ]
    urls = ["http://a.b.com/ok/1", "http://b.com/", "http://c.com", "http://d.com", "http://e.com", "bad", None]
    captures = [(i, u, day(n)) for i, u in enumerate(urls) for n in (0, 4, 5, 10, 13, 16, 20, 50, 90, 300)] + [(99, "http://b.com/", None)] * 2
    clash = spark.createDataFrame(captures, "page_id long, url string, fetched_at timestamp").withColumns({"host": F.lit(1), "bucket": F.lit("x"), "rank": F.lit(0)})
    out = urlfilter.filter_captures(clash, spark.createDataFrame(entries, "list string, pattern string, action string, listed_at timestamp")).collect()
    severity = {"block": 2, "allow": 1, "remove": 0}

    def state(name, pattern, at):
        log = {}
        for l, p, a, t in entries:
            if l == name and p == pattern and t and a in severity and t <= at:
                log.setdefault(t, []).append(severity[a])
        return max(log[max(log)]) if log else 0

    assert len(out) == len(captures)
    for r in out:
        best = (-1, 0)
        if r.url and r.fetched_at and r.url.startswith("http"):
            host, _, path = r.url[7:].partition("/")
            keys = [(len(k.split(".")), k) for k in (host, ".".join(host.split(".")[1:])) if k]
            parts = [p for p in path.split("/") if p]
            keys += [(1000 + i, "/".join([host, *parts[:i]])) for i in range(1, len(parts) + 1)]
            for rank, k in keys:
                best = max(best, *((rank, s) for s in (state("l", k, r.fetched_at), state("m", k, r.fetched_at)) if s), key=lambda x: x) if any((state("l", k, r.fetched_at), state("m", k, r.fetched_at))) else best
        assert r.blocked == (best[1] == 2), r


def test_url_filter_capitals(spark):
    """Hosts are the same in any case, paths are not."""
    entries = [("l", "H.org/Private", "block", day(1)), ("l", "h.ORG/Private/Open", "allow", day(1)), ("l", "Whole.COM", "block", day(1))]
    urls = {"http://h.org/Private/x": True, "http://H.ORG/Private": True, "http://h.org/private": False, "http://h.org/Private/Open/1": False, "http://h.org/Private/open": True, "http://whole.com/A": True, "http://h.org": False}
    captures = spark.createDataFrame([(i, u, day(2)) for i, u in enumerate(urls)], "page_id long, url string, fetched_at timestamp")
    out = urlfilter.filter_captures(captures, spark.createDataFrame(entries, "list string, pattern string, action string, listed_at timestamp")).collect()
    assert {r.url: r.blocked for r in out} == urls
    assert {r.pattern for r in out if r.blocked} == {"h.org/Private", "whole.com"}


def test_url_filter_runs_no_python(spark, monkeypatch):
    """DataFrame operations only, the numbering of the changes of a pattern among them."""

    def refused(*_args, **_kwargs):
        raise AssertionError("Python on the executors")

    captures = spark.createDataFrame([(i, "http://a.org/x", day(i)) for i in range(40)], "page_id long, url string, fetched_at timestamp")
    entries = spark.createDataFrame([("l", "a.org", ("block", "remove")[i % 2], day(3 * i)) for i in range(12)], "list string, pattern string, action string, listed_at timestamp")
    captures, entries = captures.cache(), entries.cache()
    for step in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(type(captures), step, refused)
    out = {r.page_id: r.blocked for r in urlfilter.filter_captures(captures, entries).collect()}
    assert out == {i: min(i // 3, 11) % 2 == 0 for i in range(40)}


@pytest.mark.parametrize("empty", ["captures", "entries"])
def test_url_filter_empty(spark, empty):
    captures = spark.createDataFrame([(1, "http://a.com", day(0))], "page_id long, url string, fetched_at timestamp")
    entries = spark.createDataFrame([("l", "a.com", "block", day(-9))], "list string, pattern string, action string, listed_at timestamp")
    captures, entries = (captures.limit(0), entries) if empty == "captures" else (captures, entries.limit(0))
    out = urlfilter.filter_captures(captures, entries).collect()
    assert [r.blocked for r in out] == ([] if empty == "captures" else [False])


ITEM = "when Anna buys 12 apples and gives 5 apples to Ben the shop owner counts 12 boxes again in the yard"


def decontaminated(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"hash": F.lit(1), "item": F.lit(2), "tpl": F.lit("x")})
    rows = decontam.contaminated(d, spark.createDataFrame(items, "item_id long, text string")).collect()
    return {r.doc_id: (r.contaminated, r.item_id) for r in rows}, len(rows)


def test_decontamination_templates(spark):
    other = ITEM.replace("12", "31").replace("5 ", "8 ").replace("Anna", "Carla").replace("Ben", "Dora")
    mixed = ITEM.replace("12 apples", "31 apples").replace("12 boxes", "77 boxes")  # one value became two
    docs = [
        (1, f"some words before. {ITEM} and words behind"), (2, f"x y z {other} more"), (3, mixed), (4, ITEM.upper()), (5, "when the shop owner counts"),
        (6, None), (7, ""), (8, "word " * 3000), (9, ITEM), (9, ITEM), (None, ITEM), (10, ITEM[: len(ITEM) // 3]), (11, ITEM.replace("gives", "quickly gives")),
    ]
    found, n = decontaminated(spark, docs, [(7, ITEM), (8, ITEM), (9, None), (10, ""), (11, "two words")])
    assert n == len(docs)
    assert all(found[i] == (True, 7) for i in (1, 2, 4, 9, None, 11))
    assert not any(found[i][0] for i in (5, 6, 7, 8, 10))
    assert not found[3][0], "the two values of 12 no longer agree"


def test_decontamination_short_and_empty(spark):
    found, _ = decontaminated(spark, [(1, "a b seven c d e"), (2, "b seven c d e")], [(1, "b seven c d e")])
    assert found == {1: (True, 1), 2: (True, 1)}
    assert decontaminated(spark, [], [(1, ITEM)])[1] == 0
    assert decontaminated(spark, [(1, ITEM)], [])[0] == {1: (False, None)}


def test_decontamination_against_plain_windows(spark):
    folder = "/root/testdata/sf0.001"
    docs, items = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    got = {r.doc_id for r in decontam.contaminated(docs, items).where("contaminated").collect()}
    words = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    sets = [{tuple(w[i : i + 8]) for i in range(len(w) - 7)} for w in (words(r.text) for r in items.collect())]
    expected = {r.doc_id for r in docs.collect() for w in [words(r.text)] for s in sets if s and len(s & {tuple(w[i : i + 8]) for i in range(len(w) - 7)}) >= 0.6 * len(s)}
    assert expected <= got and len(got - expected) <= 1


def licensed(spark, files, templates=None):
    df = spark.createDataFrame(files, "file_id long, path string, text string").withColumns({"terms": F.lit(1), "line": F.lit(2), "score": F.lit("x")})
    t = licenses.notices(spark) if templates is None else spark.createDataFrame(templates, "license_id string, text string")
    return {(r.file_id): (r.license_id, r.origin, r.source_dir) for r in licenses.file_licenses(df, t).collect()}


def test_licenses(spark):
    files = [
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/c/x.py", "code\nmore code"), (3, "a/b/y.py", "x = 1\n# Licensed under the Apache License, Version 2.0.\ny = 2"),
        (4, "z/y.py", "nothing"), (5, "a/b/COPYING.txt", "This work is licensed under the GNU General Public License,\nversion 3."), (6, "a/b/q.py", ""), (7, "a/b/r.py", None),
        (8, None, "All rights reserved."), (9, None, "nothing"), (10, "top.py", "x"), (11, "ab/x.py", "y"), (12, "a/b/q.py", ""), (13, "a/long.txt", "license word " * 4000),
    ]
    got = licensed(spark, files)
    assert got[1] == ("MIT", "header", None) and got[3] == ("Apache-2.0", "header", None) and got[5] == ("GPL-3.0", "header", None)
    assert got[2] == ("GPL-3.0", "inherited", "a/b") and got[6] == got[7] == got[12] == ("GPL-3.0", "inherited", "a/b")
    assert got[13] == ("MIT", "inherited", "a")
    assert got[8] == ("Proprietary", "header", None)
    assert all(got[i] == (None, "none", None) for i in (4, 9, 10, 11))


def test_other_text_does_not_hide_a_licence(spark):
    head = "This file is licensed under the Apache License, Version 2.0, see LICENSE in the project root."
    common = "the in of to and this file see project root is for we you text code line with on by from".split()
    lines = ["\n".join(f"{common[i % 21]} {common[(i * 7 + j) % 21]} word{chr(97 + j % 26)} {common[j % 21]}" for j in range(200)) for i in range(25)]
    others = [(i + 1, f"b/{i}.txt", t) for i, t in enumerate(lines)]
    for files in ([(0, "a/x.py", head)], [(0, "a/x.py", head), *others]):
        assert licensed(spark, files)[0] == ("Apache-2.0", "header", None)


def test_licenses_empty(spark):
    assert licensed(spark, []) == {}
    assert licensed(spark, [(1, "a", "Released under the MIT License.")], []) == {1: (None, "none", None)}


def test_license_pruning_loses_nothing(spark):
    """All lines against all templates, in plain Python."""
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    files = [(i, f"d/{i}", t) for i, t in enumerate(docs)]
    got = licensed(spark, files)
    terms = lambda t: re.findall(r"[^\W\d_]+|[0-9]+(?:\.[0-9]+)*", t.lower())
    lines = [(i, terms(x)) for i, _, t in files for x in re.split(r"\r\n|[\n\v\f\r\x85  ]", t or "")]
    known = {w for ts in licenses.NOTICES.values() for t in ts for w in terms(t)}
    n = len(lines)
    df = {w: sum(w in set(ts) for _, ts in lines) for w in known}
    idf = lambda w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1 if w in known else math.log(n + 1) + 1
    vec = lambda ts: {w: ts.count(w) * idf(w) for w in set(ts)}
    length = lambda ts: math.sqrt(sum((ts.count(w) * idf(w)) ** 2 for w in set(ts) & known) + sum(w not in known for w in ts) * (math.log(n + 1) + 1) ** 2)
    templates = [(k, terms(t)) for k, ts in licenses.NOTICES.items() for t in ts]
    best = {}
    for i, ts in lines:
        for k, tt in templates:
            if set(ts) & set(tt):
                a, b = vec(ts), vec(tt)
                c = round(sum(a[w] * b[w] for w in a.keys() & b.keys()) / (length(ts) * length(tt)), 9)
                if c >= licenses.COSINE:
                    best[i] = min(best.get(i, (0, "")), (-c, k))
    assert {i: k for i, (_, k) in best.items()} == {i: v[0] for i, v in got.items() if v[1] == "header"}
