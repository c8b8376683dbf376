"""Keyed upsert with field-level merge rules.

Fields a user manages take the last value given; all others keep the first
value that is not missing. Both rules are associative, so the rows of a batch fold
among themselves first, with partial results before the shuffle, and the
outcome is the same as merging them one by one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.functions.text import is_blank
from sheaf.session import materialise

# The fields a user manages.
USER_FIELDS = ("relevant", "applied", "applied_date", "resume_version_used", "cover_letter_version_used")


def missing(field: T.StructField) -> Column:
    """Null, or blank text; false and 0 are values."""
    c = F.col(field.name)
    return is_blank(c) if isinstance(field.dataType, T.StringType) else c.isNull()


def with_key(rows: DataFrame) -> DataFrame:
    """Set ``source_hash`` from the address; rows without an address drop out."""
    kept = rows.where(F.col("source_url").isNotNull() & (F.col("source_url") != ""))
    return kept.withColumn("source_hash", F.sha2("source_url", 256))


def with_defaults(rows: DataFrame, now: Column) -> DataFrame:
    """Fill id, posting date and applied flag. Write the result before reading it twice."""
    return rows.withColumns(
        {
            "id": F.coalesce("id", F.uuid()),
            "date_posted": F.coalesce("date_posted", now),
            "applied": F.coalesce("applied", F.lit(False)),
        }
    )


def fold(rows: DataFrame, order: str, user_fields: Sequence[str] = USER_FIELDS) -> DataFrame:
    """One row per ``source_hash`` from rows in the given order."""
    aggs = []
    for field in rows.schema:
        name = field.name
        if name in ("source_hash", order):
            continue
        if name in user_fields:
            value = F.expr(f"max_by(`{name}`, `{order}`) FILTER (WHERE `{name}` IS NOT NULL)")
        elif isinstance(field.dataType, T.StringType):
            flagged = F.when(~missing(field), F.col(order))
            value = F.coalesce(F.min_by(name, flagged), F.min_by(name, order))
        else:
            value = F.expr(f"min_by(`{name}`, `{order}`) FILTER (WHERE `{name}` IS NOT NULL)")
        aggs.append(value.alias(name))
    return rows.groupBy("source_hash").agg(*aggs).select([c for c in rows.columns if c != order])


def upsert(store: DataFrame, incoming: DataFrame, order: str = "pos") -> DataFrame:
    """The store after merging ``incoming`` (same columns plus ``order``) into it.

    Store rows without a key drop out, untouched rows stay as they are. Only the
    batch is folded and written; it then meets the store by joins on the key,
    so a small batch is broadcast by Spark and the store is not shuffled.
    """
    old = store.where(F.col("source_hash").isNotNull() & (F.col("source_hash") != ""))
    batch = with_key(incoming).select(*store.columns, order)
    folded = materialise(fold(batch, order), "batch")
    names = [f for f in store.schema if f.name != "source_hash"]
    new = folded.select("source_hash", *[F.col(f.name).alias(f"new_{f.name}") for f in names], F.lit(True).alias("hit"))
    values = []
    for field in names:
        have, got = F.col(field.name), F.col(f"new_{field.name}")
        if field.name in USER_FIELDS:
            value = F.coalesce(got, have)
        elif isinstance(field.dataType, T.StringType):
            value = F.when(F.col("hit") & is_blank(have) & ~is_blank(got), got).otherwise(have)
        else:
            value = F.coalesce(have, got)
        values.append(value.alias(field.name))
    merged = old.join(new, "source_hash", "left").select("source_hash", *values).select(store.columns)
    known = old.select("source_hash").join(folded.select("source_hash"), "source_hash", "left_semi")
    return merged.unionByName(folded.join(known, "source_hash", "left_anti").select(store.columns))


def distinct_records(rows: DataFrame) -> DataFrame:
    """One row per key; rows without a key count as equal to each other."""
    return rows.dropDuplicates(["source_hash"])


def same_record(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)
