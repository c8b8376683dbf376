"""Captured pages: cards and description candidates from stored HTML.

HTML needs a parser, so these two scans run in Python workers, batch by batch.
Everything after them is column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.functions.html import compile_selector
from sheaf.functions.joins import join_counted
from sheaf.session import materialise, ship_package, spread

SCAN_PAGES = 64  # pages read at a time

_CARDS = "page_id bigint, pos int, key string, texts array<string>, spans array<string>, html_length int"

# What a layout names, and what stands in where a domain leaves it out.
LAYOUT = {"container": None, "card": None, "text_tag": "p", "span_tag": "span", "key_attribute": "componentkey", "link": "a[href]"}
_SELECTORS = ("container", "card", "text_tag", "span_tag", "link")


def raw_cards(
    pages: DataFrame,
    container: str,
    card: str,
    text_tag: str = "p",
    span_tag: str = "span",
    key_attribute: str = "componentkey",
) -> DataFrame:
    """Cards of ``pages(page_id, html)`` in document order, before any cleaning.

    Looks at the first container of a page; pages without one give no rows.
    """

    for selector in (container, card, text_tag, span_tag):
        compile_selector(selector)  # a bad one fails here, not in the tasks

    def scan(batches):
        from sheaf.functions import html as H

        for pdf in batches:
            rows = []
            for page_id, source in zip(pdf["page_id"], pdf["html"]):
                box = next(H.select(H.parse(source), container), None)
                for pos, item in enumerate(H.select(box, card) if box else ()):
                    texts = [H.visible_text(e) for e in H.select(item, text_tag)]
                    spans = [H.visible_text(e) for e in H.select(item, span_tag)]
                    rows.append((page_id, pos, item.attrs.get(key_attribute), texts, spans, len(H.visible_text(item))))
            yield pd.DataFrame(rows, columns=["page_id", "pos", "key", "texts", "spans", "html_length"])

    ship_package(pages.sparkSession)
    return spread(pages.select("page_id", "html"), "page_id").mapInPandas(scan, _CARDS)


def layouts(selectors: DataFrame, **defaults: str | None) -> DataFrame:
    """``(domain, container, card, text_tag, span_tag, key_attribute, link)``: one row for each domain that names a container.

    ``selectors(domain, field, selectors)``; the first selector of a field counts. ``defaults`` take the place of ``LAYOUT``.
    """
    unknown = set(defaults) - set(LAYOUT)
    if unknown:
        raise ValueError(f"no such field of a layout: {', '.join(sorted(unknown))}")
    values = {**LAYOUT, **defaults}
    first = F.get("selectors", F.lit(0))
    named = [F.coalesce(F.min(F.when(F.col("field") == f, first)), F.lit(v).cast("string")).alias(f) for f, v in values.items()]
    rows = selectors.where(F.col("field").isin(list(values))).groupBy("domain").agg(*named)
    return rows.where("domain IS NOT NULL AND container IS NOT NULL AND card IS NOT NULL")


def layout_faults(found: DataFrame) -> DataFrame:
    """``(domain, field, selector)`` of the selectors in ``layouts`` that are not understood."""

    def scan(batches):
        from sheaf.functions.html import compile_selector

        for pdf in batches:
            bad = []
            for domain, field, selector in pdf.itertuples(index=False):
                try:
                    compile_selector(selector)
                except ValueError:
                    bad.append((domain, field, selector))
            yield pd.DataFrame(bad, columns=["domain", "field", "selector"])

    ship_package(found.sparkSession)
    pairs = F.map_from_arrays(F.array(*map(F.lit, _SELECTORS)), F.array(*_SELECTORS))
    return found.select("domain", F.explode(pairs).alias("field", "selector")).mapInPandas(scan, "domain string, field string, selector string")


def layout_cards(pages: DataFrame, found: DataFrame) -> DataFrame:
    """Cards of ``pages(page_id, domain, page_url, html)``, each page by its own domain's layout, in one scan.

    ``(page_id, pos, key, texts, spans, html_length, link)``; ``link`` is the address that the card's first link leads to, and
    the page's own where it has none. Pages of a domain without a layout, pages without their container, and pages whose layout holds
    a selector that is not understood give no rows; ``layout_faults`` tells which. The layouts meet the pages
    by a join; the pages of a domain that holds many of them are dealt to several tasks.
    """
    columns = list(LAYOUT)
    pages = pages.select("page_id", "domain", "page_url", "html")
    counted = pages.groupBy("domain").agg(F.count(F.lit(1)).alias("_pages"))
    keyed = materialise(found.join(counted, "domain"), "layouts")
    met = join_counted(pages, keyed, ["domain"], "_pages").select("page_id", "page_url", "html", *columns)

    def scan(batches):
        from urllib.parse import urljoin

        from sheaf.functions import html as H

        def read(page_id, page_url, source, container, card, text_tag, span_tag, key, link):
            for selector in (container, card, text_tag, span_tag, link):
                H.compile_selector(selector)
            box = next(H.select(H.parse(source), container), None)
            for pos, item in enumerate(H.select(box, card) if box else ()):
                texts = [H.visible_text(e) for e in H.select(item, text_tag)]
                spans = [H.visible_text(e) for e in H.select(item, span_tag)]
                to = next((e.attrs["href"] for e in H.select(item, link) if e.attrs.get("href")), None)
                try:
                    address = page_url if to is None else urljoin(page_url or "", to)
                except ValueError:  # no address at all
                    address = page_url
                yield page_id, pos, item.attrs.get(key), texts, spans, len(H.visible_text(item)), address

        for pdf in batches:
            rows = []
            for page in pdf.itertuples(index=False):
                try:
                    rows += read(*page)
                except ValueError:  # told by layout_faults
                    continue
            yield pd.DataFrame(rows, columns=["page_id", "pos", "key", "texts", "spans", "html_length", "link"])

    ship_package(pages.sparkSession)
    return met.mapInPandas(scan, _CARDS + ", link string")


def selector_texts(pages: DataFrame, selectors: Sequence[str]) -> DataFrame:
    """``(page_id, url, found)``: visible text of the first match of each selector.

    ``found`` has one entry per selector, null where nothing matches.
    """
    wanted = list(selectors)
    if not wanted:
        raise ValueError("at least one selector is needed")
    for selector in wanted:
        compile_selector(selector)

    ship_package(pages.sparkSession)
    typed = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))
    return spread(typed, "page_id").mapInArrow(_first_texts(wanted), "page_id bigint, url string, found array<string>")


def _first_texts(wanted: Sequence[str]):
    """Reader of batches ``(page_id, url, html)``. Only SCAN_PAGES pages at a time become Python values, however many a batch holds."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sheaf.functions import html as H

        for batch in batches:
            for lo in range(0, batch.num_rows, SCAN_PAGES):
                part = batch.slice(lo, SCAN_PAGES)
                found = []
                for source in part.column(2):
                    root = H.parse(source.as_py())
                    hits = (next(H.select(root, s), None) for s in wanted)
                    found.append([None if e is None else H.visible_text(e) for e in hits])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.list_(pa.string()))], names=["page_id", "url", "found"])

    return scan
