import datetime as dt

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sheaf.functions import cards as C
from sheaf.functions import html as H
from sheaf.operators import cards
from sheaf.sources import pages
from sheaf.sources.pages import layout_cards, layout_faults, layouts, raw_cards, selector_texts

NOW = "2030-01-01 00:00:00"


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r.o for r in df.select("i", expr(F.col("v")).alias("o")).orderBy("i").collect()]


def test_designation(spark):
    raw = ["Lead\n(Verified job)", " (Verified job) x\n\n Head ", "", None, "(Verified job)"]
    assert column(spark, raw, C.clean_designation) == ["Lead", "Head", None, None, None]


def test_noise(spark):
    rows = [(None, None), ("Lead", None), ("Head of Privacy", "X"), ("Long", "terms inc"), ("Data", "Cookie"), ("business", "services")]
    df = spark.createDataFrame(rows, "d string, c string")
    got = [r.o for r in df.select(C.is_noise(F.col("d"), F.col("c")).alias("o")).collect()]
    assert got == [True, False, True, True, True, True]


def test_posted_date(spark):
    raw = [
        "Posted on April 5, 2026, 3:07 PM",
        "Posted on April 05, 2026, 03:07 pm",
        "Posted on april 5, 2026\nmore",
        "recently",
        "",
        None,
    ]
    got = column(spark, raw, lambda c: C.posted_date(c, F.lit(NOW).cast("timestamp")))
    now = dt.datetime(2030, 1, 1)
    assert got == [dt.datetime(2026, 4, 5, 15, 7), dt.datetime(2026, 4, 5, 15, 7), dt.datetime(2026, 4, 5), now, now, now]


def test_addresses(spark):
    urls = [
        "https://www.Example.com/a?x=1",
        "http://user@jobs.example.com:80/view?currentJobId=12#t",
        "https://www.www.example.com",
        "no url",
        None,
        "https://a b.example.com/x y",
    ]
    assert column(spark, urls, C.domain_key) == ["example.com", "jobs.example.com", "www.example.com", "", "", "a b.example.com"]
    assert column(spark, urls[:2], C.job_id) == ["none", "12"]
    ids = ["http://h/p?currentJobId=&currentJobId=4%352", "http://h/p#currentJobId=3", "http://h/p?acurrentJobId=3"]
    assert column(spark, ids, C.canonical_url) == ["https://www.linkedin.com/jobs/view/452/", *ids[1:]]


def test_search(spark):
    assert C.search_query(["a", "b"], ["c"], ["d"]) == "(a OR b) AND (c) AND (d)"
    got = column(spark, ["Lead ML in India", "Lead ML", None], lambda c: C.matches_search(c, ["lead"], ["ml"], ["india"]))
    assert got == [True, False, False]


def test_id_numbers(spark):
    assert column(spark, ["12345678 x123456789 123456789012,12345678 1234567"], C.id_numbers) == [["12345678", "123456789012"]]


def test_first_by_key_keeps_document_order(spark):
    rows = [("s", 1, 0, "a"), ("s", 1, 1, "a"), ("s", 1, 2, None), ("s", 1, 3, None), ("s", 2, 0, "a"), ("s", 1, 4, "")]
    df = spark.createDataFrame(rows, "source string, page_num int, pos int, key string")
    kept = {(r.page_num, r.pos) for r in cards.first_by_key(df).collect()}
    assert kept == {(1, 0), (1, 2), (1, 4), (2, 0)}


def plain_cap(pages, jobs, max_pages):
    kept = []
    for number, page in enumerate(pages, 1):
        if number > max_pages or len(kept) >= jobs:
            break
        for idx, noise in enumerate(page[: jobs - len(kept)]):
            if not noise:
                kept.append((number, idx))
    return kept


@pytest.mark.parametrize(
    "pages,jobs,max_pages",
    [
        ([[0, 1, 0], [0, 0, 0]], 4, 5),
        ([[1, 1, 1], [0, 0, 0, 0]], 2, 5),
        ([[0] * 10], 3, 5),
        ([[0], [0], [0], [0]], 10, 2),
        ([[0, 1, 1, 0], [1, 0], [0, 0, 0]], 3, 5),
    ],
)
def test_cap_counts_after_noise_and_cuts_before(spark, pages, jobs, max_pages):
    rows = [("s", p, i, bool(n)) for p, page in enumerate(pages, 1) for i, n in enumerate(page)]
    df = spark.createDataFrame(rows, "source string, page_num int, pos int, noise boolean")
    got = sorted((r.page_num, r.pos) for r in cards.cap_per_source(df, jobs, max_pages).collect())
    assert got == plain_cap(pages, jobs, max_pages)


def test_sources(spark):
    sources = spark.createDataFrame([("https://www.a.com/x",), ("https://b.com",)], "source string")
    conf = spark.createDataFrame([("a.com", "card", ["div"])], "domain string, field string, selectors array<string>")
    assert [r.source for r in cards.known_sources(sources, conf).collect()] == ["https://www.a.com/x"]
    assert [r.source for r in cards.skipped_sources(sources, conf).collect()] == ["https://b.com"]
    with pytest.raises(RuntimeError, match="b.com"):
        cards.require_rows(sources, sources.where("source like '%a.com%'"))


PAGE = """
<html><head><title>T</title><style>p{}</style></head><body><div data-testid='lazy-column'>
<div role="button" componentkey="k1"><p> Lead&amp;Co </p><p>&middot;</p><p>Acme</p><span>x</span><span> Posted on May 1, 2026 </span></div>
<div role="button" componentkey="k1"><p>again</p></div>
<div role="button"><p>no key</p></div></div>
<div class="a show-more b">First<br>line <b>bold</b><script>no()</script><p>Para one<p>Para two</div></body></html>
"""


def test_cards_from_html(spark):
    pages = spark.createDataFrame([(7, PAGE), (8, "<p>none</p>"), (9, None)], "page_id bigint, html string")
    rows = raw_cards(pages, "div[data-testid='lazy-column']", "div[role='button'][componentkey]")
    rows = rows.select("page_id", "pos", "key", C.card_texts(F.col("texts")).alias("t"), C.date_text(F.col("spans")).alias("d"))
    got = [tuple(r) for r in rows.orderBy("pos").collect()]
    assert got == [(7, 0, "k1", ["Lead&Co", "Acme"], "Posted on May 1, 2026"), (7, 1, "k1", ["again"], "")]


def test_visible_text():
    root = H.parse(PAGE)
    box = next(H.select(root, "div.show-more"))
    assert H.visible_text(box) == "First\nline bold\n\nPara one\n\nPara two"


@pytest.mark.parametrize(
    "selector,hit",
    [("div.show-more.b", True), ("div.show", False), ("div[class*='MORE' i]", True), ("[data-testid]", True), ("p[class^='x']", False), ("*", True)],
)
def test_selectors(selector, hit):
    assert (next(H.select(H.parse(PAGE), selector), None) is not None) == hit


@pytest.mark.parametrize("selector", ["div.a > p", "div p", "div.a, p", "", "div:first-child", "p[]"])
def test_selectors_beyond_the_simple_ones_raise(selector):
    with pytest.raises(ValueError):
        H.compile_selector(selector)


def test_selector_texts(spark):
    pages = spark.createDataFrame([(1, "u", PAGE)], "page_id bigint, url string, html string")
    assert selector_texts(pages, ["main", "span"]).first().found == [None, "x"]
    with pytest.raises(ValueError):
        selector_texts(pages, [])


def test_pages_of_a_batch_are_read_some_at_a_time(monkeypatch):
    """A batch of many pages is not held as Python values, nor are its texts."""
    read, parse = [], H.parse
    monkeypatch.setattr(H, "parse", lambda source: (read.append(1), parse(source))[1])
    n = 3 * pages.SCAN_PAGES + 1
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(n)), "url": [None] * n, "html": [None, *(f"<main>{i}</main>" for i in range(1, n))]})
    sizes, texts = [], []
    for part in pages._first_texts(["main", "b"])(iter([batch])):
        sizes.append(part.num_rows)
        assert len(read) == sum(sizes)
        texts += part.column(2).to_pylist()
    assert sizes == [pages.SCAN_PAGES] * 3 + [1]
    assert texts == [[None, None], *([str(i), None] for i in range(1, n))]



def test_each_page_meets_its_own_layout(spark):
    conf = spark.createDataFrame(
        [
            ("a.com", "container", ["div[data-testid='lazy-column']", "main"]),
            ("a.com", "card", ["div[role='button'][componentkey]"]),
            ("b.com", "container", ["ul"]),
            ("b.com", "text_tag", ["b"]),
            ("b.com", "key_attribute", ["id"]),
            ("bad.com", "container", ["ul > li"]),
            ("none.com", "text_tag", ["p"]),
        ],
        "domain string, field string, selectors array<string>",
    )
    lists = "<ul><li id=1><b>One</b><a href='/x?n=1'>go</a></li><li><a>no address</a></li></ul>"
    pages = spark.createDataFrame(
        [(1, "a.com", "https://a.com/q", PAGE), (2, "b.com", "https://b.com/q", lists), (3, "bad.com", "u", lists), (4, "none.com", "u", lists)]
        + [(5, "b.com", None, None), (6, None, "u", lists), (7, "b.com", "https://b.com/q", "<p>no list</p>")]
        + [(i, "b.com", "https://b.com/q", lists) for i in range(100, 140)],
        "page_id bigint, domain string, page_url string, html string",
    )
    found = layouts(conf, card="li")
    assert {r.domain for r in found.collect()} == {"a.com", "b.com", "bad.com"}
    assert [tuple(r) for r in layout_faults(found).collect()] == [("bad.com", "container", "ul > li")]
    rows = layout_cards(pages, found).collect()
    assert sorted((r.pos, r.key, r.texts, r.link) for r in rows if r.page_id == 2) == [
        (0, "1", ["One"], "https://b.com/x?n=1"),
        (1, None, [], "https://b.com/q"),
    ]
    assert [r.key for r in rows if r.page_id == 1] == ["k1", "k1"]
    assert len(rows) == 4 + 80 and {r.page_id for r in rows} == {1, 2, *range(100, 140)}
    assert layout_cards(pages.limit(0), found).collect() == []
    with pytest.raises(ValueError):
        layouts(conf, colour="red")
