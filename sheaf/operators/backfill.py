"""Fill missing descriptions from captured pages, then check the result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.cards import domain_key
from sheaf.functions.text import is_blank, sanitize
from sheaf.operators.store import upsert
from sheaf.sources.pages import selector_texts

MIN_CHARS = 80


def is_target(domain: str) -> Column:
    """Has an address of the domain and no description yet."""
    url = F.col("source_url")
    return (url != "") & (domain_key(url) == domain) & is_blank(F.col("job_description"))


def targets(rows: DataFrame, domain: str) -> DataFrame:
    return rows.where(is_target(domain))


def descriptions(pages: DataFrame, selectors: Sequence[str]) -> DataFrame:
    """``(page_id, url, description)``: cleaned text of the first selector that is long enough.

    ``description`` is null when none is.
    """
    cleaned = F.transform("found", sanitize)
    long_enough = F.filter(cleaned, lambda t: F.length(t) >= MIN_CHARS)
    return selector_texts(pages, selectors).select("page_id", "url", F.get(long_enough, F.lit(0)).alias("description"))


def fill(store: DataFrame, wanted: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(store after the update, rejects(source_url))``.

    ``found(url, description)``; if an address was captured twice the first page
    with a description counts. Nothing is changed for rejects.
    """
    best = (
        found.where("description is not null")
        .groupBy(F.col("url").alias("source_url"))
        .agg(F.min_by("description", "page_id").alias("description"))
    )
    matched = wanted.join(best, "source_url", "left")
    update = matched.where("description is not null").withColumns(
        {"job_description": F.col("description"), "pos": F.lit(0).cast("bigint")}
    )
    rejects = matched.where("description is null").select("source_url")
    return upsert(store, update.select(*store.columns, "pos")), rejects


def unsaved(wanted: DataFrame, store: DataFrame) -> DataFrame:
    """Targeted addresses whose record still has no description."""
    saved = store.where(~is_blank(F.col("job_description"))).select("source_url")
    return wanted.select("source_url").distinct().join(saved, "source_url", "left_anti")


def statistics(rows: DataFrame, outcome: DataFrame, domain: str) -> DataFrame:
    """Total, eligible, updated, skipped, failed; ``outcome(source_url, description)`` is per target."""
    before = rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce(is_target(domain), F.lit(False))).alias("eligible")
    )
    after = outcome.agg(
        F.count_if(F.col("description").isNotNull()).alias("updated"),
        F.count_if(F.coalesce(F.col("source_url"), F.lit("")) == "").alias("skipped"),
        F.count_if((F.col("source_url") != "") & F.col("description").isNull()).alias("failed"),
    )
    return before.join(after)


def verify(wanted: DataFrame, store: DataFrame, stats: DataFrame) -> None:
    """Raise unless every target was updated and its text is in the store."""
    row = stats.first()
    if row.updated != row.eligible:
        raise RuntimeError(f"updated {row.updated} of {row.eligible} descriptions")
    left = [r.source_url for r in unsaved(wanted, store).take(20)]
    if left:
        raise RuntimeError("no description saved for: " + ", ".join(left))
