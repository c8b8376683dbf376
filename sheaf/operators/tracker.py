"""Application tracker: counts, order, filters and the list view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.text import preview

PREVIEW_CHARS = 200


def counts(rows: DataFrame) -> DataFrame:
    """Total, applied and not applied over all rows, complete or not."""
    applied = F.count_if(F.col("applied"))
    return rows.agg(
        F.count(F.lit(1)).alias("total"),
        applied.alias("applied"),
        (F.count(F.lit(1)) - applied).alias("not_applied"),
    )


def list_order(position: str = "doc_pos") -> list[Column]:
    """Relevant first, open before applied, newest first, then load order."""
    return [
        F.coalesce("relevant", F.lit(False)).desc(),
        F.coalesce("applied", F.lit(False)).asc(),
        F.col("date_posted").desc(),
        F.col(position).asc(),
    ]


def sorted_rows(rows: DataFrame, position: str = "doc_pos") -> DataFrame:
    return rows.orderBy(*list_order(position))


def complete(rows: DataFrame) -> DataFrame:
    """Rows with a designation and a company; blanks pass, empty text does not."""
    return rows.where((F.col("designation") != "") & (F.col("company_name") != ""))


def view(rows: DataFrame, position: str = "doc_pos") -> DataFrame:
    """What the list shows, unsorted; order it by ``list_order``."""
    text = F.col("job_description")
    return complete(rows).select(
        position,
        F.coalesce("designation", F.lit("")).alias("title"),
        F.coalesce("source_url", F.lit("")).alias("url"),
        F.col("company_name").alias("company"),
        "location",
        "date_posted",
        F.when(text != "", preview(text, PREVIEW_CHARS)).alias("preview"),
        F.coalesce(F.length(text) > PREVIEW_CHARS, F.lit(False)).alias("shortened"),
        F.coalesce("relevant", F.lit(False)).alias("relevant"),
        F.coalesce("applied", F.lit(False)).alias("applied"),
    )


def can_tailor(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("job_description") != "")
