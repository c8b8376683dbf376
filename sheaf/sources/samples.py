"""The sample tables seen through the schemas the operators expect."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions import cards as C

DIRT = {" the ": "\t the\x00 \r\n\r\n\r\n", " de ": "\x0b de \x07\r \n\n\n\n", " und ": "  \t und\x7f  "}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_pos, job_description, source, lang)``."""
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("doc_pos"), F.col("text").alias("job_description"), "source", "lang"
    )


def source_label(docs: DataFrame) -> DataFrame:
    """``(doc_pos, cluster_id)`` with the source as ready-made cluster."""
    return docs.select("doc_pos", F.regexp_extract("source", r"(\d+)", 1).cast("bigint").alias("cluster_id"))


def opportunities(spark: SparkSession, folder: str, gaps: bool = True) -> DataFrame:
    """Documents as opportunities, labels as their status; with ``gaps``, some descriptions are left for a backfill."""
    docs = table(spark, folder, "documents")
    labels = table(spark, folder, "labels")
    i = F.col("doc_id")
    host = F.when(i % 2 == 0, "www.jobs.example.com").otherwise("jobs.example.com")
    url = F.concat(F.lit("https://"), host, F.lit("/view/"), i.cast("string"), F.lit("/"))
    posted = F.timestamp_seconds(F.lit(1704067200) + i * 60)
    applied = F.coalesce(F.col("quality") == 1, F.lit(False))
    return docs.join(labels, "doc_id", "left").select(
        i.alias("doc_pos"),
        F.concat(F.lit("op-"), i.cast("string")).alias("id"),
        F.get(F.split("text", "\n"), F.lit(0)).alias("designation"),
        (F.when(i % 7 != 0, F.col("text")) if gaps else F.col("text")).alias("job_description"),
        F.col("lang").alias("location"),
        F.when(i % 11 == 0, "").otherwise(F.col("source")).alias("company_name"),
        F.when(i % 97 != 0, url).alias("source_url"),
        (F.col("toxic") == 0).alias("relevant"),
        posted.alias("date_posted"),
        F.when(i % 97 != 0, F.sha2(url, 256)).alias("source_hash"),
        applied.alias("applied"),
        F.when(applied, F.timestamp_seconds(F.lit(1704067200 + 86400) + i * 60)).alias("applied_date"),
        F.lit(None).cast("string").alias("resume_version_used"),
        F.lit(None).cast("string").alias("cover_letter_version_used"),
    )


def incoming(spark: SparkSession, folder: str) -> DataFrame:
    """A batch for the store: labelled documents seen twice, and every page as a new record."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    known = opportunities(spark, folder).join(labels.select(F.col("doc_id").alias("doc_pos")), "doc_pos")
    texts = docs.select(F.col("doc_id").alias("doc_pos"), "text")
    copies = known.join(texts, "doc_pos").select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"))
    i = F.col("doc_pos")
    seen = copies.select(
        i,
        F.concat(F.lit("in-"), i.cast("string")).alias("id"),
        F.lit(" ").alias("designation"),
        F.col("text").alias("job_description"),
        F.when(F.col("copy") == 1, "remote").alias("location"),
        F.concat("company_name", F.lit(" new")).alias("company_name"),
        "source_url",
        F.when(F.col("copy") == 0, ~F.col("relevant")).alias("relevant"),
        F.timestamp_seconds(F.lit(1735689600) + i * 60).alias("date_posted"),
        F.lit(None).cast("string").alias("source_hash"),
        F.lit(False).alias("applied"),
        F.lit(None).cast("timestamp").alias("applied_date"),
        F.concat(F.lit("v"), F.col("copy").cast("string")).alias("resume_version_used"),
        F.lit(None).cast("string").alias("cover_letter_version_used"),
        (i * 2 + F.col("copy")).alias("pos"),
    )
    pages = table(spark, folder, "pages")
    p = F.col("page_id")
    fresh = pages.select(
        p.alias("doc_pos"),
        F.concat(F.lit("page-"), p.cast("string")).alias("id"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("designation"),
        F.lit(None).cast("string").alias("job_description"),
        F.lit(None).cast("string").alias("location"),
        F.lit("").alias("company_name"),
        F.col("url").alias("source_url"),
        F.lit(None).cast("boolean").alias("relevant"),
        F.timestamp_seconds(F.lit(1735689600) + p * 60).alias("date_posted"),
        F.lit(None).cast("string").alias("source_hash"),
        F.lit(False).alias("applied"),
        F.lit(None).cast("timestamp").alias("applied_date"),
        F.lit(None).cast("string").alias("resume_version_used"),
        F.lit(None).cast("string").alias("cover_letter_version_used"),
        p.alias("pos"),
    )
    return seen.unionByName(fresh)


def cards(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as captured cards, the customer's nation as source, 1000 order numbers to a page."""
    orders, customers = table(spark, folder, "orders"), table(spark, folder, "customer")
    nations = table(spark, folder, "nation")
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(
        nations, F.col("c_nationkey") == F.col("n_nationkey")
    )
    k = F.col("o_orderkey")
    title = F.when(k % 7 == 0, F.concat(F.lit("(Verified job)\n "), "o_orderpriority")).otherwise(F.col("o_orderpriority"))
    company = F.when(k % 9 == 0, "Privacy Office").otherwise(F.col("c_name"))
    texts = F.when(k % 11 == 0, F.array(title)).otherwise(F.array(title, company, "n_name"))
    texts = F.when(k % 5 == 0, F.concat(F.array(F.lit(" "), F.lit("·")), texts)).otherwise(texts)
    at = F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + (k % 1440) * 60)
    timed = F.date_format(at, "MMMM d, yyyy, h:mm a")
    dated = F.concat(F.lit("Posted on "), F.when(k % 3 == 0, timed).otherwise(F.date_format(at, "MMMM d, yyyy")))
    spans = F.array(F.lit("Promoted"), F.when(k % 13 == 0, "recently").otherwise(dated))
    return rows.select(
        F.col("n_name").alias("source"),
        (F.floor(k / 1000) + 1).cast("int").alias("page_num"),
        k.alias("pos"),
        F.floor(k / 50).cast("string").alias("key"),
        texts.alias("texts"),
        spans.alias("spans"),
    )


def board_layouts(spark: SparkSession, folder: str) -> DataFrame:
    """Selectors of two layouts by the length of a domain; a third of the domains has none."""
    domains = table(spark, folder, "pages").select(C.domain_key(F.col("url")).alias("domain")).distinct()
    kind = F.length("domain") % 3
    one = {"container": ["nav", "main"], "card": ["li[componentkey]"], "link": ["a[href^='/']"]}
    two = {"container": ["ul.board"], "card": ["div[role='LISTITEM' i]"], "text_tag": ["h3"], "span_tag": ["em"], "key_attribute": ["data-key"]}
    as_map = [F.map_from_entries(F.array(*[F.struct(F.lit(k), F.array(*map(F.lit, v))) for k, v in m.items()])) for m in (one, two)]
    chosen = F.when(kind == 1, as_map[0]).when(kind == 2, as_map[1])
    return domains.select("domain", F.explode(chosen).alias("field", "selectors"))


def boards(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as result lists ``(page_id, source, page_num, page_url, html)``, 16 to a source: their links become cards of two layouts.

    Every fifth card repeats the key of the one before it, every fourth is page furniture.
    """
    pages = table(spark, folder, "pages")
    number = F.col("page_id")
    links = F.regexp_extract_all("html", F.lit(r'<li><a href="[^"]*">([^<]*)</a></li>'), F.lit(1))

    def item(text, i):
        key = F.concat(F.lit("k"), (i - (i % 5 == 4).cast("int")).cast("string"))
        company = F.when(i % 4 == 1, "Privacy Office").otherwise(F.concat(F.lit("Firm "), i.cast("string")))
        posted = F.concat(F.lit("Posted on May "), (i % 28 + 1).cast("string"), F.lit(", 2026"))
        job = (number * 100 + i).cast("string")
        one = ["<li componentkey='", key, "'><p>", text, "</p><p>&middot;</p><p>", company, "</p><p>Rome</p><span>new</span><span>", posted]
        one += ["</span><a href='#'>top</a><a href='/jobs?currentJobId=", job, "'>more</a></li>"]
        two = ["<div role='listitem' data-key='", key, "'><h3>", text, "</h3><h3>", company, "</h3><em>", posted]
        two += ["</em><a href='?currentJobId=", job, "&amp;x=1'>more</a></div>"]
        return F.when(F.length("domain") % 3 == 1, _joined(one)).otherwise(_joined(two))

    html = F.concat(
        F.substring_index("html", "<ul>", 1), F.lit("<ul class='wide board'>"), F.array_join(F.transform(links, item), ""), F.lit("</ul></nav></body></html>")
    )
    return pages.withColumn("domain", C.domain_key(F.col("url"))).select(
        "page_id",
        F.concat(F.lit("https://www."), F.col("domain"), F.lit("/search/"), F.floor(number / 16).cast("string")).alias("source"),
        (number % 16 + 1).cast("int").alias("page_num"),
        F.concat(F.lit("https://"), F.col("domain"), F.lit("/list/"), number.cast("string"), F.lit("?page=1")).alias("page_url"),
        html.alias("html"),
    )


def _joined(parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def dirty_text(c):
    """Text with control characters, odd line ends and blanks put in."""
    for clean, dirty in DIRT.items():
        c = F.replace(c, F.lit(clean), F.lit(dirty))
    return F.concat(F.lit("\x00 \t"), c, F.lit(" \r\n "))


def resumes(spark: SparkSession, folder: str) -> DataFrame:
    """Every turn with the one after it as a two-section document."""
    turns = table(spark, folder, "conversations")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("role2"), F.col("text").alias("text2"))
    first = F.concat(F.lit("\n\n# "), F.upper("role"), F.lit("\n"), "text")
    second = F.coalesce(F.concat(F.lit("\n\n# "), F.upper("role2"), F.lit("\n"), "text2"), F.lit(""))
    return turns.join(after, ["conv_id", "turn"], "left").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("resume_id"),
        "conv_id",
        F.concat(F.lit(" conv "), F.col("conv_id").cast("string"), first, second).alias("body"),
    )


def section_status(spark: SparkSession, folder: str) -> DataFrame:
    """One status row per turn, spread over the four states."""
    turns = table(spark, folder, "conversations")
    states = F.array(*[F.lit(s) for s in ("Not Started", "In Progress", "Completed", "Failed")])
    return turns.select(
        "conv_id",
        "turn",
        F.col("role").alias("section"),
        F.get(states, (F.col("conv_id") % 4).cast("int")).alias("status"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600).alias("last_updated"),
        F.timestamp_seconds(F.lit(1704067200 + 2 * 86400)).alias("source_modified"),
    )
