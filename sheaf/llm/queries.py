"""Named queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm import decontam, gridjoin, kmeanstree, langid, licenses, packing, periodic, pii, prefixtrie, quality, secretscan, simhash, urlfilter
from sheaf.llm.ordered import running
from sheaf.session import materialise

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as captures, and a list whose entries follow from the pages' own hosts."""
    pages = table(spark, folder, "pages")
    captures = pages.select("page_id", "url", F.expr("timestamp'2024-01-01' + make_dt_interval(0, 0, CAST(page_id * 7919 % 525600 AS INT))").alias("fetched_at"))
    host = urlfilter.host_of(F.col("url"))
    hosts = pages.select(host.alias("host")).where("host <> ''").distinct()
    digit = lambda at: F.conv(F.substring(F.md5("host"), at, 3), 16, 10).cast("int")
    day = lambda n: F.expr("timestamp'2024-01-01'") + F.make_dt_interval(n)
    hosts = hosts.select("host", digit(1).alias("a"), digit(4).alias("b"), F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1).alias("domain"))
    entry = lambda name, pattern, action, at: F.struct(F.lit(name).alias("list"), pattern.alias("pattern"), F.lit(action).alias("action"), at.alias("listed_at"))
    h, a, b = F.col("host"), F.col("a"), F.col("b")
    log = F.array(
        F.when(a % 3 == 0, entry("hosts", h, "block", day(b % 200))),
        F.when(a % 6 == 0, entry("hosts", h, "remove", day(b % 200 + 60))),
        F.when(a % 12 == 0, entry("hosts", h, "block", day(b % 200 + 150))),
        F.when(a % 5 == 0, entry("paths", F.concat(h, F.lit("/en")), "allow", day(b % 100))),
        F.when(a % 7 == 0, entry("paths", F.concat(h, F.lit("/de")), "block", day(b % 300))),
        F.when(b % 16 == 0, entry("domains", F.col("domain"), "block", day(F.lit(300) + a % 50))),
    )
    entries = hosts.select(F.explode(F.filter(log, lambda x: x.isNotNull())).alias("e")).select("e.*")
    found = urlfilter.filter_captures(captures, entries)
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return found.select("page_id", "url", shown("fetched_at"), "host", "blocked", "pattern", shown("listed_at"))


def language_model(docs: DataFrame) -> langid.Model:
    return langid.train(docs.where(~langid.held_out(F.col("doc_id"), 4, 2)))


def language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = docs.select("doc_id", langid.label(spark, language_model(docs), F.col("text")).alias("l"))
    held = langid.held_out(F.col("doc_id"), 4, 2)
    return found.select("doc_id", held.alias("held_out"), F.col("l.lang").alias("lang_pred"), F.col("l.score").alias("score"), "l.spans")


def simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def quality_score(spark: SparkSession, folder: str) -> DataFrame:
    held = langid.held_out(F.col("doc_id"), 3, 1)
    found = quality.score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"), ~held)
    return found.select("doc_id", held.alias("held_out"), "score", "predicted")


def personal_data(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = docs.select("doc_id", pii.find(spark, pii.train(docs), F.col("text")).alias("f"))
    counts = [F.col("f.n")[i].alias(f"n_{kind}") for i, kind in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(F.col("f.base").cast("binary"), 256).alias("base_sha256"), F.col("f.spans").alias("spans"))


def secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Every candidate; values leave the query as hashes only."""
    docs = table(spark, folder, "documents")
    model = secretscan.train(docs)
    found = docs.select("doc_id", "text", F.explode(secretscan.scan(spark, model, F.col("text"), F.col("source"))).alias("f"))
    value = F.substring(F.col("text"), F.col("f.start") + 1, F.col("f.end") - F.col("f.start"))
    secret = (F.col("f.score") >= secretscan.THRESHOLD).alias("secret")
    return found.select("doc_id", "f.start", "f.end", "f.rule", F.sha2(value.cast("binary"), 256).alias("value_sha256"), F.round("f.score", 6).alias("score"), secret)


def license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files of one tree: source, then a folder per hundred; ids at round numbers are licence files."""
    docs = table(spark, folder, "documents")
    path = F.expr(
        """CASE WHEN doc_id % 1000 = 0 THEN concat(source, '/LICENSE')
                WHEN doc_id % 100 = 0 THEN concat(source, '/d', CAST(doc_id % 1000 DIV 100 AS STRING), '/LICENSE')
                ELSE concat(source, '/d', CAST(doc_id % 1000 DIV 100 AS STRING), '/', CAST(doc_id AS STRING), '.txt') END"""
    )
    files = docs.select(F.col("doc_id").alias("file_id"), path.alias("path"), "text")
    return licenses.file_licenses(files, licenses.notices(spark)).withColumnRenamed("file_id", "doc_id")


def grid_order_join(spark: SparkSession, folder: str) -> DataFrame:
    return gridjoin.near_vectors(table(spark, folder, "embeddings"))


def pack_documents(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), with_ids=False)


def tree_search(spark: SparkSession, folder: str) -> DataFrame:
    return kmeanstree.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Trie of conversations rebuilt with the first turns of the first conversation of their twenty."""
    turns = running(prefixtrie.digests(table(spark, folder, "conversations")), "conv_id", ["turn", "hi", "lo"])
    turns = materialise(turns, "trie-turns")
    members = turns.where("n = 0").select("conv_id")
    taken = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % 4
    own = turns.where(F.col("n") >= taken("conv_id")).withColumn("place", F.col("n"))
    first = turns.where((F.col("n") < 3) & (F.col("conv_id") % 20 == 0)).withColumnRenamed("conv_id", "head")
    ids = "filter(transform(sequence(-19L, 19L), k -> try_add(head, k)), c -> c IS NOT NULL AND c - c % 20 = head)"
    heads = first.withColumn("conv_id", F.explode(F.expr(ids))).where(F.col("n") < taken("conv_id"))
    heads = heads.join(members, "conv_id", "left_semi").withColumn("place", F.col("n") - 3)
    columns = ["conv_id", "place", "hi", "lo", "words"]
    return prefixtrie.nodes(own.select(*columns).unionByName(heads.select(*columns)), members)


def periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of every text; a tenth of the texts, by the hash of the id, go on with a repeated part of their own words."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = table(spark, folder, "documents").select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"))
    words = docs.withColumn("ws", F.when(F.col("h") % 10 == 0, F.expr(r"filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> '')")))
    words = words.withColumn("n", F.size("ws")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    words = words.withColumn("p", F.expr("1 + floor((n - a) / (3 + g % 8))"))
    again = "array_join(transform(ws, (w, i) -> if(i < a, w, ws[CAST(a + (i - a) % p AS INT)])), ' ')"
    texts = words.select("doc_id", F.expr(f"CASE WHEN n > 0 THEN {again} ELSE text END").alias("text"))
    found = texts.select("doc_id", periodic.scan(spark, F.col("text")).alias("f")).select("doc_id", "f.*")
    best = F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS start, -r.period AS period)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return found.withColumns({"best": best, "lines": lines}).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length DIV -best.period").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Query] = {
    "op1_url_filter": url_filter,
    "op2_language_id": language_id,
    "op3_simhash_dedup": simhash_dedup,
    "op4_decontamination": decontamination,
    "op5_quality": quality_score,
    "op6_packing": pack_documents,
    "op7_personal_data": personal_data,
    "op8_grid_order_join": grid_order_join,
    "op9_secret_scan": secret_scan,
    "op10_license_scan": license_scan,
    "op11_kmeans_tree": tree_search,
    "op12_prefix_trie": prefix_trie,
    "op13_periodic_runs": periodic_runs,
}
