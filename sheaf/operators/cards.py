"""Cards to opportunities: keep-first, cap per source, selector lookup, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions import cards as C
from sheaf.session import materialise


def first_by_key(cards: DataFrame) -> DataFrame:
    """Keep the first card of each key within a page; missing keys count as one key.

    Spark cuts each partition to the first row per key before the shuffle, so a
    key repeated very often does not pile up in one task.
    """
    w = Window.partitionBy("source", "page_num", F.col("key").isNull(), "key").orderBy("pos")
    return cards.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def to_opportunities(cards: DataFrame, now: Column) -> DataFrame:
    """Designation, company, location, posting date and noise flag of each card."""
    texts = C.card_texts(F.col("texts"))
    named = cards.withColumn("t", texts).withColumns(
        {
            "designation": C.clean_designation(F.get("t", F.lit(0))),
            "company_name": F.get("t", F.lit(1)),
            "location": F.get("t", F.lit(2)),
            "date_posted": C.posted_date(F.col("date_text"), now),
        }
    )
    return named.withColumn("noise", C.is_noise(F.col("designation"), F.col("company_name"))).drop("t")


def cap_per_source(cards: DataFrame, jobs: int, pages: int) -> DataFrame:
    """Cards a collector would keep with ``jobs`` per source and ``pages`` pages.

    On each page it looks at the first ``jobs - kept so far`` cards and keeps those
    that are no noise; only kept ones count. Since no page can use more than its
    first ``jobs`` cards, a source never carries more than ``jobs * pages`` flags.
    """
    order = Window.partitionBy("source", "page_num").orderBy("pos")
    near = (
        cards.where(F.col("page_num") <= pages)
        .withColumn("idx", F.row_number().over(order))
        .where(F.col("idx") <= jobs)
    )
    near = materialise(near, "near")
    flags = near.groupBy("source", "page_num").agg(
        F.sort_array(F.collect_list(F.struct("idx", "noise"))).alias("flags")
    )
    by_page = flags.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("page_num", "flags"))).alias("ps"))

    def visit(state: Column, page: Column) -> Column:
        left = F.lit(jobs) - state["kept"]
        kept = F.size(F.filter(page["flags"], lambda f: (f["idx"] <= left) & ~f["noise"]))
        entry = F.struct(page["page_num"].alias("page_num"), left.alias("look"))
        return F.struct((state["kept"] + kept).alias("kept"), F.concat(state["looks"], F.array(entry)).alias("looks"))

    start = F.struct(
        F.lit(0).alias("kept"), F.array().cast("array<struct<page_num:int,look:int>>").alias("looks")
    )
    looks = by_page.select("source", F.explode(F.aggregate("ps", start, visit)["looks"]).alias("l"))
    looks = looks.select("source", "l.page_num", "l.look")
    return near.join(looks, ["source", "page_num"]).where((F.col("idx") <= F.col("look")) & ~F.col("noise")).drop("look")


def known_sources(sources: DataFrame, selectors: DataFrame) -> DataFrame:
    """``sources(source)`` with the selector rows of their domain; others drop out."""
    keyed = sources.withColumn("domain", C.domain_key(F.col("source")))
    return keyed.join(selectors, "domain")


def skipped_sources(sources: DataFrame, selectors: DataFrame) -> DataFrame:
    keyed = sources.withColumn("domain", C.domain_key(F.col("source")))
    return keyed.join(selectors.select("domain").distinct(), "domain", "left_anti")


def empty_sources(sources: DataFrame, rows: DataFrame) -> DataFrame:
    return sources.select("source").join(rows.select("source").distinct(), "source", "left_anti")


def require_rows(sources: DataFrame, rows: DataFrame) -> None:
    """Raise when a source gave no rows; run it before anything is saved."""
    names = [r.source for r in empty_sources(sources, rows).take(20)]
    if names:
        raise RuntimeError("no opportunities from: " + ", ".join(names))


def union_in_order(*parts: DataFrame) -> DataFrame:
    """All rows of all parts with ``part`` as the place of their part."""
    tagged = [p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t)
    return out
