"""URL filters that change over time: captures meet the list entries in force when they were fetched.

A list is a log of dated changes to patterns. Each change holds from its date to the next change of the same pattern,
so the log becomes validity intervals. The as-of join is an equi-join on (pattern, time bucket): an interval is
copied to the buckets it touches and a capture lies in exactly one, so a pattern with a long history meets
only that stretch of it. All of it is DataFrame work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.ranking import numbered_plainly
from sheaf.session import materialise

BUCKET_DAYS = 30
ACTIONS = ("allow", "block", "remove")  # fixed values


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and closing dots; empty if there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*?)\.*(?::[0-9]*)?(?:[/?#]|$)", 1))


def patterns_of(url: Column) -> Column:
    """All patterns that could list a URL, with how specific each is: host suffixes, then path prefixes."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    segments = F.filter(F.split(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/"), lambda s: s != "")
    index = lambda a: F.when(F.size(a) > 0, F.sequence(F.lit(1), F.size(a))).otherwise(F.array().cast("array<int>"))
    suffixes = F.transform(index(labels), lambda i: F.struct(F.concat_ws(".", F.slice(labels, i, F.size(labels) - i + 1)).alias("pattern"), (F.size(labels) - i + 1).alias("rank")))
    prefixes = F.transform(index(segments), lambda i: F.struct(F.concat(host, F.lit("/"), F.concat_ws("/", F.slice(segments, F.lit(1), i))).alias("pattern"), (1000 + i).alias("rank")))
    return F.when(host != "", F.concat(suffixes, prefixes)).otherwise(F.array().cast("array<struct<pattern:string,rank:int>>"))


def intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals ``(list, pattern, action, since, until)`` of a change log.

    ``entries (list, pattern, action, listed_at)``. Of several changes of a pattern at one instant the strictest holds
    (block, then allow, then remove). ``until`` is null while a change still holds. Removals end an interval and open none.
    Hosts of patterns are lower-cased, paths keep their case.
    """
    host = F.substring_index("pattern", "/", 1)
    pattern = F.concat(F.lower(host), F.col("pattern").substr(F.length(host) + 1, F.length("pattern")))
    severity = "CASE action WHEN 'block' THEN 2 WHEN 'allow' THEN 1 ELSE 0 END"
    sound = entries.where(F.col("pattern").isNotNull() & F.col("listed_at").isNotNull() & F.col("action").isin(*ACTIONS))
    log = sound.select(F.coalesce("list", F.lit("")).alias("list"), pattern.alias("pattern"), "listed_at", F.expr(severity).alias("act"))
    log = log.groupBy("list", "pattern", "listed_at").agg(F.max("act").alias("act"))
    log = materialise(numbered_plainly(log, ["list", "pattern"], [F.col("listed_at")], "n"), "url-log")
    after = log.select("list", "pattern", (F.col("n") - 1).alias("n"), F.col("listed_at").alias("until"))
    held = log.join(after, ["list", "pattern", "n"], "left").where("act > 0")
    return held.select("list", "pattern", F.when(F.col("act") == 2, "block").otherwise("allow").alias("action"), F.col("listed_at").alias("since"), "until")


def filter_captures(captures: DataFrame, entries: DataFrame, bucket_days: int = BUCKET_DAYS) -> DataFrame:
    """``(page_id, url, fetched_at, host, blocked, pattern, listed_at)`` for every capture ``(page_id, url, fetched_at)``.

    Of the entries in force at fetch time (``since <= fetched_at < until``) the most specific decides: the longest path
    prefix, then the longest host suffix; between lists a block beats an allow. ``pattern`` and ``listed_at`` name the entry.

    A null or malformed URL, a null fetch time and an unlisted URL are not blocked; pattern and date are then null. Repeated
    captures are returned each. Unknown actions and entries without pattern or date count for nothing. Other columns are
    not looked at. Empty tables are fine on either side.
    """
    step = bucket_days * 86400
    own = captures.select("page_id", "url", F.col("fetched_at").cast("timestamp").alias("fetched_at"))
    bucket = lambda c: F.floor(F.unix_timestamp(c) / step).cast("long")
    span = own.agg(F.min("fetched_at").alias("lo"), F.max("fetched_at").alias("hi")).first()
    held = intervals(entries.withColumn("listed_at", F.col("listed_at").cast("timestamp")))
    held = held.where((F.col("since") <= F.lit(span.hi)) & (F.col("until").isNull() | (F.col("until") > F.lit(span.lo)))) if span.lo else held.limit(0)
    first, last = bucket(F.greatest("since", F.lit(span.lo))), bucket(F.least(F.coalesce("until", F.lit(span.hi)), F.lit(span.hi)))
    held = held.withColumn("bucket", F.explode(F.sequence(first, last))) if span.lo else held.withColumn("bucket", F.lit(0).cast("long"))
    held = materialise(held, "url-intervals")
    keyed = own.where(F.col("fetched_at").isNotNull()).select("page_id", "url", "fetched_at", bucket("fetched_at").alias("bucket"), F.explode(patterns_of(F.col("url"))).alias("k"))
    keyed = keyed.select("page_id", "url", "fetched_at", "bucket", F.col("k.pattern").alias("pattern"), F.col("k.rank").alias("rank"))
    met = keyed.join(held, ["pattern", "bucket"]).where((F.col("since") <= F.col("fetched_at")) & (F.col("until").isNull() | (F.col("fetched_at") < F.col("until"))))
    order = F.struct("rank", (F.col("action") == "block").alias("block"), "since")
    best = met.groupBy("page_id", "url", "fetched_at").agg(F.max_by(F.struct("action", "pattern", "since"), order).alias("best"))
    best = best.select(F.col("page_id").alias("p"), F.col("url").alias("u"), F.col("fetched_at").alias("f"), "best")
    out = own.join(best, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("url") == F.col("u")) & (F.col("fetched_at") == F.col("f")), "left")
    return out.select(
        "page_id",
        "url",
        "fetched_at",
        F.nullif(host_of(F.col("url")), F.lit("")).alias("host"),
        F.coalesce(F.col("best.action") == "block", F.lit(False)).alias("blocked"),
        F.col("best.pattern").alias("pattern"),
        F.col("best.since").alias("listed_at"),
    )
