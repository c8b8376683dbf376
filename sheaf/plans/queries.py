"""Named queries over the sample tables, one or more per operator.

Long lists are compared by digest: a row holds the md5 of the joined values.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions import cards as C
from sheaf.functions import text as X
from sheaf.functions.ranking import numbered
from sheaf.operators import backfill, cards, cuts, linkage, prepare, reassign, report, resume, store, summary, sweep, tiles
from sheaf.operators import tracker, vectors
from sheaf.plans import pipeline
from sheaf.session import materialise, scratch_dir, spread
from sheaf.sources import clusters, config, records
from sheaf.sources import pages as pages_
from sheaf.sources import samples as S
from sheaf.sources.pages import raw_cards
from sheaf.streaming import status

STOPWORDS = ["The", "that", "hehely", "inoran", "ing", "thth", "erin", "thatin  ononst", "orre rewh", "the tion"]
NOW = "2030-01-01 00:00:00"
SCOPE = ["lead", "head", "der ", "orre"]
SKILLS = ["tion", "Eau", "mento"]
PLACES = ["que", " the ", "und"]
SELECTORS = ["div.jobs-description-content__text", "div.ad", "article"]
MIN_SIZE = 10
PART_ROWS = 100
DYNAMIC_SHARE = 0.1
SECTIONS = (
    resume.Section("header"),
    resume.Section("user", "USER", "ASSISTANT", "Tailor the text below.", "TEXT"),
    resume.Section("assistant", "ASSISTANT", "USER"),
    resume.Section("system", "SYSTEM", "USER"),
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def digest(c: Column) -> Column:
    return F.md5(F.array_join(c, "\n").cast("binary"))


def stamp(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def prepared(spark: SparkSession, folder: str) -> DataFrame:
    return prepare.drop_explicit(prepare.tokenise(S.documents(spark, folder)), STOPWORDS)


def saved(spark: SparkSession, folder: str) -> DataFrame:
    """The same, written once: for queries that read it several times."""
    return materialise(prepared(spark, folder), "tokens")


def words(spark: SparkSession, folder: str) -> DataFrame:
    """The tokens alone, written once: for vectors, which look at nothing else."""
    return materialise(prepared(spark, folder).select("doc_pos", "tokens"), "tokens")


# Keywords


@query
def ranked_keywords_by_source(spark, folder):
    docs = S.documents(spark, folder)
    terms = summary.cluster_terms(prepared(spark, folder), S.source_label(docs))
    top = summary.top_keywords(summary.unblocked(terms, STOPWORDS), 20)
    return top.select("cluster_id", big("rank").alias("rank"), "term", big("tf").alias("tf"), big("df").alias("df"), F.round("score", 6).alias("score"))


@query
def ranked_keywords_whole(spark, folder):
    docs = S.documents(spark, folder)
    terms = summary.unblocked(summary.cluster_terms(prepared(spark, folder), S.source_label(docs)), STOPWORDS)
    ranked = summary.ranked_keywords(terms)
    return ranked.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("terms"),
        F.max("rank").cast("bigint").alias("last_rank"),
        F.sum((F.col("rank") % 1009) * (F.col("df") + F.length("term"))).cast("bigint").alias("checksum"),
    )


# Text


@query
def tokens(spark, folder):
    rows = prepare.tokenise(S.documents(spark, folder))
    return rows.select(F.col("doc_pos").alias("doc_id"), big(F.size("tokens")).alias("n_tokens"), digest(F.col("tokens")).alias("digest"))


@query
def stopword_filter(spark, folder):
    return prepared(spark, folder).select(
        F.col("doc_pos").alias("doc_id"),
        big(F.size("tokens")).alias("n_tokens"),
        big(F.size("keywords")).alias("n_keywords"),
        digest(F.col("tokens")).alias("tokens_digest"),
        digest(F.col("keywords")).alias("keywords_digest"),
    )


@query
def phrase_filter(spark, folder):
    """Drop the opening phrases of all documents, of two to four words, wherever they stand."""
    rows = materialise(prepare.tokenise(S.documents(spark, folder)), "tokens")
    spans = F.array(*[F.array_join(F.slice("tokens", a, n), "  ") for a, n in ((1, 2), (2, 2), (2, 3), (4, 4))])
    left = prepare.drop_phrase_table(rows, rows.select(F.explode(spans).alias("term")))
    return left.select(F.col("doc_pos").alias("doc_id"), big(F.size("tokens")).alias("n_tokens"), big(F.size("keywords")).alias("n_keywords"), digest(F.col("tokens")).alias("digest"))


@query
def dynamic_stopwords(spark, folder):
    return prepare.dynamic_stopwords(saved(spark, folder), DYNAMIC_SHARE)


@query
def dynamic_filter(spark, folder):
    first = saved(spark, folder)
    rows = prepare.drop_terms(first, prepare.dynamic_stopwords(first, DYNAMIC_SHARE))
    return rows.select(F.col("doc_pos").alias("doc_id"), big(F.size("tokens")).alias("n_tokens"), digest(F.col("tokens")).alias("digest"))


@query
def ngrams(spark, folder):
    rows = prepare.doc_terms(prepared(spark, folder))
    return rows.groupBy(F.col("doc_pos").alias("doc_id"), big("n").alias("n")).agg(
        big(F.sum("tf")).alias("grams"),
        F.count(F.lit(1)).alias("terms"),
        big(F.max("tf")).alias("top_tf"),
        big(F.sum(F.col("i") * F.length("term"))).alias("checksum"),
    )


@query
def sentences(spark, folder):
    rows = summary.sentence_rows(S.documents(spark, folder))
    lists = spread(S.documents(spark, folder), "doc_pos").select(F.col("doc_pos").alias("doc_id"), X.sentences(F.col("job_description")).alias("s"))
    sizes = rows.groupBy(F.col("doc_pos").alias("doc_id")).agg(big(F.max(F.length("sentence"))).alias("longest"))
    return lists.join(sizes, "doc_id").select("doc_id", big(F.size("s")).alias("n_sentences"), "longest", digest(F.col("s")).alias("digest"))


@query
def sanitize_text(spark, folder):
    docs = S.documents(spark, folder)
    clean = X.sanitize(S.dirty_text(F.col("job_description")))
    return docs.select(F.col("doc_pos").alias("doc_id"), big(F.length(clean)).alias("n_chars"), F.md5(clean.cast("binary")).alias("digest"))


@query
def preview(spark, folder):
    docs = S.documents(spark, folder)
    text = F.col("job_description")
    return docs.select(F.col("doc_pos").alias("doc_id"), X.preview(text).alias("preview"), (F.length(text) > 200).alias("shortened"))


@query
def list_normalise(spark, folder):
    turns = S.table(spark, folder, "conversations")
    words = X.normalise_list(F.split("text", r"[.,]"))
    return turns.select("conv_id", "turn", big(F.size(words)).alias("entries"), digest(words).alias("digest"))


def _lexicon(spark: SparkSession, folder: str) -> DataFrame:
    """A lexicon of the documents' own words: endings cut off, words of some lengths no nouns."""
    words = S.documents(spark, folder).select(F.explode(X.word_array(F.col("job_description"))).alias("token")).distinct()
    return words.select("token", F.regexp_replace("token", "(ing|es|ed)$", "").alias("lemma"), (F.length("token") % 3 != 0).alias("is_noun"))


@query
def lexicon_tokens(spark, folder):
    rows = prepare.tokenise(S.documents(spark, folder), lexicon=materialise(_lexicon(spark, folder), "lexicon"))
    return rows.select(
        F.col("doc_pos").alias("doc_id"), big(F.size("tokens")).alias("n_tokens"), big(F.size("keywords")).alias("n_keywords"),
        digest(F.col("tokens")).alias("tokens_digest"), digest(F.col("keywords")).alias("keywords_digest"),
    )


@query
def dynamic_default(spark, folder):
    """The default share, over the letters of each document instead of its words."""
    docs = S.documents(spark, folder).select(F.col("doc_pos"), F.split(F.lower(F.regexp_replace("job_description", r"[^A-Za-z]", "")), "").alias("keywords"))
    return prepare.dynamic_stopwords(docs.withColumn("keywords", F.filter("keywords", lambda c: c != "")))


# Addresses and search


@query
def domain_key(spark, folder):
    pages = S.table(spark, folder, "pages")
    docs = S.opportunities(spark, folder)
    urls = pages.select("url").unionByName(docs.select(F.col("source_url").alias("url")))
    return urls.select("url", C.domain_key(F.upper("url")).alias("domain"))


@query
def canonical_url(spark, folder):
    pages = S.table(spark, folder, "pages")
    tagged = F.concat(
        F.regexp_replace("url", r"#.*", ""),
        F.when(F.col("url").contains("?"), "&").otherwise("?"),
        F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("currentJobId=&currentJobId=%34"), F.col("page_id").cast("string"))).otherwise("x=1"),
    )
    rows = pages.select("page_id", tagged.alias("url"))
    return rows.select("page_id", C.canonical_url(F.col("url")).alias("canonical"), C.job_id(F.col("url")).alias("job_id"))


@query
def id_scan(spark, folder):
    pages = S.table(spark, folder, "pages")
    docs = S.documents(spark, folder)
    marked = F.concat("html", F.lit(" "), (F.col("page_id") + 10_000_000).cast("string"), F.lit(" 123456789012 1234567 "), (F.col("page_id") + 10_000_000).cast("string"))
    texts = pages.select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("key"), marked.alias("body")).unionByName(
        docs.select(F.concat(F.lit("d"), F.col("doc_pos").cast("string")).alias("key"), F.col("job_description").alias("body"))
    )
    found = C.id_numbers(F.col("body"))
    return texts.select("key", big(F.size(found)).alias("n_ids"), F.array_join(found, ",").alias("ids"))


@query
def search_predicate(spark, folder):
    docs = S.documents(spark, folder)
    hit = C.matches_search(F.col("job_description"), SCOPE, SKILLS, PLACES)
    text = C.search_query_column(*[F.array(*map(F.lit, g)) for g in (SCOPE, SKILLS, PLACES)])
    return docs.where(hit).select(F.col("doc_pos").alias("doc_id"), text.alias("query"))


# Cards


def named_cards(spark: SparkSession, folder: str) -> DataFrame:
    captured = S.cards(spark, folder).withColumn("date_text", C.date_text(F.col("spans")))
    return cards.to_opportunities(captured, now())


@query
def card_clean(spark, folder):
    return named_cards(spark, folder).select("pos", "designation", "company_name", "location", "noise")


@query
def card_dates(spark, folder):
    return named_cards(spark, folder).select("pos", "date_text", stamp(F.col("date_posted")).alias("date_posted"))


@query
def card_dedup(spark, folder):
    return cards.first_by_key(S.cards(spark, folder)).select("source", big("page_num").alias("page_num"), "pos", "key")


@query
def card_cap(spark, folder):
    kept = cards.cap_per_source(cards.first_by_key(named_cards(spark, folder)), 30, 5)
    return kept.select("source", big("page_num").alias("page_num"), "pos", big("idx").alias("idx"), "company_name")


@query
def source_lookup(spark, folder):
    pages = S.table(spark, folder, "pages").select(F.col("url").alias("source"))
    conf = S.opportunities(spark, folder).select(C.domain_key(F.col("source_url")).alias("domain")).where("domain <> ''")
    nets = S.table(spark, folder, "pages").select(C.domain_key(F.col("url")).alias("domain")).where(F.col("domain").endswith(".example.net"))
    conf = conf.unionByName(nets).distinct().withColumn("selector", F.concat(F.lit("div."), "domain"))
    known = cards.known_sources(pages, conf).select("source", "domain", "selector")
    skipped = cards.skipped_sources(pages, conf).select("source", "domain", F.lit(None).cast("string").alias("selector"))
    return cards.union_in_order(known, skipped).select(big("part").alias("part"), "source", "domain", "selector")


@query
def empty_sources(spark, folder):
    sources = S.documents(spark, folder).select(F.col("doc_pos").cast("string").alias("source"))
    rows = S.table(spark, folder, "labels").select(F.col("doc_id").cast("string").alias("source"))
    return cards.empty_sources(sources, rows)


@query
def page_cards(spark, folder):
    pages = S.table(spark, folder, "pages")
    found = raw_cards(pages, "nav", "li", text_tag="a")
    return found.select("page_id", big("pos").alias("pos"), F.get(C.card_texts(F.col("texts")), F.lit(0)).alias("first_text"))


@query
def layout_cards(spark, folder):
    """All fields of the cards of all pages, each page read by the layout of its own domain."""
    pages = S.boards(spark, folder).withColumn("domain", C.domain_key(F.col("source")))
    found = pages_.layout_cards(pages, pages_.layouts(S.board_layouts(spark, folder)))
    texts, spans = F.array_join("texts", "|"), F.array_join("spans", "|")
    return found.select("page_id", big("pos").alias("pos"), "key", texts.alias("texts"), spans.alias("spans"), big("html_length").alias("html_length"), "link")


@query
def collect_pages(spark, folder):
    """Stored pages of known domains into an empty store, at most ten opportunities a source."""
    known = cards.known_sources(S.boards(spark, folder), S.board_layouts(spark, folder).select("domain").distinct())
    table = records.SnapshotStore(spark, _folder(spark, "collected"))
    pipeline.collect_pages(table, known.drop("domain"), S.board_layouts(spark, folder), now(), jobs=10, pages=16)
    return table.read().select("designation", "company_name", "location", "source_url", stamp(F.col("date_posted")).alias("date_posted"), "applied")


@query
def page_descriptions(spark, folder):
    found = backfill.descriptions(S.table(spark, folder, "pages"), SELECTORS)
    return found.select("page_id", "url", "description")


# Store


@query
def store_upsert(spark, folder):
    merged = store.upsert(S.opportunities(spark, folder), S.incoming(spark, folder))
    return merged.select(
        "source_hash",
        "id",
        "designation",
        F.md5(F.col("job_description").cast("binary")).alias("description_digest"),
        "location",
        "company_name",
        "source_url",
        "relevant",
        stamp(F.col("date_posted")).alias("date_posted"),
        "applied",
        stamp(F.col("applied_date")).alias("applied_date"),
        "resume_version_used",
    )


@query
def store_dedup(spark, folder):
    rows = store.with_key(S.incoming(spark, folder))
    return store.distinct_records(rows.select("source_hash"))


@query
def missing_values(spark, folder):
    rows = S.incoming(spark, folder)
    fields = ["designation", "job_description", "location", "company_name", "relevant", "applied", "applied_date"]
    return rows.agg(*[big(F.count_if(store.missing(rows.schema[f]))).alias(f) for f in fields])


@query
def missing_desc_targets(spark, folder):
    return backfill.targets(S.opportunities(spark, folder), "jobs.example.com").select("doc_pos", "source_url")


def _page_store(spark: SparkSession, folder: str) -> DataFrame:
    return store.with_key(S.incoming(spark, folder).drop("pos")).dropDuplicates(["source_hash", "id"])


@query
def backfill_stats(spark, folder):
    rows = _page_store(spark, folder)
    found = backfill.descriptions(S.table(spark, folder, "pages"), SELECTORS)
    wanted = rows.where(X.is_blank(F.col("job_description"))).select("source_url")
    outcome = wanted.join(found.select(F.col("url").alias("source_url"), "description"), "source_url", "left")
    return backfill.statistics(rows, outcome, "jobs.example.com")


@query
def backfill_fill(spark, folder):
    rows = store.fold(_page_store(spark, folder).withColumn("pos", F.col("doc_pos")), "pos")
    wanted = rows.where(X.is_blank(F.col("job_description")))
    filled, _ = backfill.fill(rows, wanted, backfill.descriptions(S.table(spark, folder, "pages"), SELECTORS))
    return filled.select("source_url", F.md5(F.col("job_description").cast("binary")).alias("digest"))


@query
def verify_missing(spark, folder):
    rows = S.opportunities(spark, folder)
    wanted = backfill.targets(rows, "jobs.example.com")
    saved = store.upsert(rows, S.incoming(spark, folder))
    return backfill.unsaved(wanted, saved)


def _folder(spark: SparkSession, name: str) -> str:
    return os.path.join(scratch_dir(spark), f"{name}-{os.urandom(8).hex()}")


@query
def json_records(spark, folder):
    """Export as JSON lines and read back."""
    path = _folder(spark, "records")
    records.export_json(S.opportunities(spark, folder), path)
    kept, _ = records.import_lines(spark, path)
    return kept.select(
        "id", "designation", F.md5(F.col("job_description").cast("binary")).alias("digest"), "company_name", "source_url",
        "relevant", stamp(F.col("date_posted")).alias("date_posted"), "applied", stamp(F.col("applied_date")).alias("applied_date"),
    )


@query
def snapshot_store(spark, folder):
    """Save the store, save it again after the upsert, read the newest snapshot."""
    table = records.SnapshotStore(spark, _folder(spark, "store"))
    table.write(S.opportunities(spark, folder), "first")
    table.write(store.upsert(table.read(), S.incoming(spark, folder).drop("doc_pos")), "second")
    return table.read().select("source_hash", "id", "location", "relevant", "applied", "resume_version_used")


@query
def json_object(spark, folder):
    """Records of JSON objects keyed by hash, each with at most 1000 records of a source."""
    path = _folder(spark, "objects")
    rows = S.opportunities(spark, folder).where("source_hash IS NOT NULL")
    value = F.to_json(F.struct("id", "designation", "source_url", "applied"))
    entry = F.concat(F.lit('"'), F.col("source_hash"), F.lit('": '), value)
    each = rows.groupBy("company_name", "location", F.floor(F.col("doc_pos") / 1000)).agg(F.concat(F.lit("{"), F.array_join(F.collect_list(entry), ", "), F.lit("}")).alias("value"))
    each.select("value").write.text(path)
    kept, _ = records.import_json(spark, path, by_line=True)
    return kept.select("id", "designation", "source_url", "applied")


@query
def json_store(spark, folder):
    """All records as JSON objects of some ten thousand each, one per file, and read back by splits."""
    path = _folder(spark, "store-files")
    rows = S.opportunities(spark, folder).where("source_hash IS NOT NULL").withColumn("part", F.pmod(F.crc32(F.col("id").cast("binary")), F.lit(1 + S.table(spark, folder, "documents").count() // 10_000)))
    entry = F.concat(F.lit('  "'), "source_hash", F.lit('": '), F.to_json(F.struct("id", "designation", "job_description", "source_url", "applied")), F.lit(","))
    parts = rows.select("part").distinct()
    head = parts.select("part", F.lit(0).alias("place"), F.lit("{").alias("value"))
    tail = parts.select("part", F.lit(2).alias("place"), F.lit('  "version": 1\n}').alias("value"))
    lines = head.unionByName(rows.select("part", F.lit(1).alias("place"), entry.alias("value"))).unionByName(tail)
    lines.repartition("part").sortWithinPartitions("part", "place").select("part", "value").write.partitionBy("part").text(path)
    kept, _ = records.import_json(spark, path)
    return kept.select("id", "designation", F.md5(F.col("job_description").cast("binary")).alias("description_digest"), "source_url", "applied")


@query
def default_values(spark, folder):
    rows = store.with_defaults(S.incoming(spark, folder).withColumns({"applied": F.lit(None).cast("boolean"), "date_posted": F.when(F.col("location") == "remote", F.col("date_posted"))}), now())
    return rows.select("pos", "id", stamp(F.col("date_posted")).alias("date_posted"), "applied")


@query
def selector_table(spark, folder):
    """Configuration objects of at most 1000 domains of a market segment."""
    path = _folder(spark, "selectors")
    rows = S.table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment")
    fields = F.to_json(F.struct(F.col("c_mktsegment").alias("container"), F.array("c_mktsegment", "c_name").alias("description"), F.lit(True).alias("paged")))
    entry = F.concat(F.lit('"'), F.col("c_name"), F.lit('": '), fields)
    rows.groupBy("c_mktsegment", F.floor(F.col("c_custkey") / 1000)).agg(F.concat(F.lit("{"), F.array_join(F.collect_list(entry), ","), F.lit("}")).alias("value")).select("value").write.text(path)
    return config.selectors(spark, path, by_line=True).select("domain", "field", F.array_join("selectors", "|").alias("selectors"))


@query
def last_run(spark, folder):
    """Latest run per priority, unreadable times among them."""
    orders = S.table(spark, folder, "orders")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.lit("soon")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    at = clusters.last_generated_at(orders.select(text.alias("generated_at")))
    return orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")).withColumn("last", stamp(F.lit(at)))


@query
def stopword_table(spark, folder):
    path = _folder(spark, "stopwords")
    S.table(spark, folder, "part").select(F.concat(F.lit(" "), F.replace("p_type", F.lit(" "), F.lit(" \t ")))).write.text(path)
    return config.stopwords(spark, path)


@query
def status_table(spark, folder):
    path = _folder(spark, "sections")
    config.save_section_status(S.section_status(spark, folder), path)
    return spark.read.parquet(path).select("conv_id", "turn", "section", "status", stamp(F.col("last_updated")).alias("last_updated"))


@query
def status_files(spark, folder):
    """Section status as JSON objects of some turns each, one per file, and read back."""
    path = _folder(spark, "status-files")
    rows = S.section_status(spark, folder)
    name = F.concat_ws("-", F.col("section"), F.col("turn").cast("string"))
    file = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    entry = F.struct("status", F.date_format("last_updated", "yyyy-MM-dd HH:mm:ss").alias("last_updated"), file.alias("filename"))
    objects = rows.groupBy("conv_id", F.floor(F.col("turn") / 50).alias("part")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(name, entry)))).alias("value"))
    config.save_texts(objects, path, "conv_id", "part")
    found = config.section_status(spark, path)
    return found.select("section", "status", stamp(F.col("last_updated")).alias("last_updated"), "filename")


@query
def resume_files(spark, folder):
    """Every résumé as a markdown file, and read back."""
    path = _folder(spark, "resumes")
    config.save_texts(S.resumes(spark, folder).select("resume_id", "body"), path, "resume_id")
    found = config.resumes(spark, path).withColumn("body", F.regexp_replace("body", "\n$", ""))
    return found.select(F.regexp_extract("resume_id", "resume_id=([^/]+)/", 1).alias("resume_id"), F.md5("body").alias("digest"), F.col("source_modified").isNotNull().alias("dated"))


# Tracker


@query
def tracker_counts(spark, folder):
    return tracker.counts(S.opportunities(spark, folder))


@query
def tracker_view(spark, folder):
    rows = tracker.view(S.opportunities(spark, folder))
    placed = numbered(rows, [], tracker.list_order(), "place")
    return placed.select(big("place").alias("place"), "doc_pos", "title", "url", "company", "location", stamp(F.col("date_posted")).alias("date_posted"), "preview", "shortened", "relevant", "applied")


@query
def can_tailor(spark, folder):
    return tracker.can_tailor(S.opportunities(spark, folder)).select("doc_pos", big(F.length("job_description")).alias("n_chars"))


def _updates(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return status.updates(
        events,
        F.col("user_id").cast("string"),
        F.when(kind == "view", True).when(kind == "click", False),
        F.when(kind == "purchase", True).when(kind == "error", False),
    )


def _status(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("source_hash").alias("user_id"), "relevant", "applied", stamp(F.col("applied_date")).alias("applied_date"))


@query
def status_fold(spark, folder):
    return _status(status.fold_updates(_updates(S.table(spark, folder, "events"))))


@query
def status_stream(spark, folder):
    schema = S.table(spark, folder, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    base = os.path.join(scratch_dir(spark), f"status-{os.urandom(8).hex()}")
    log = status.ChangeLog(spark, os.path.join(base, "log"))
    run = status.start(_updates(source), log, os.path.join(base, "checkpoint"))
    run.awaitTermination()
    return _status(status.fold_updates(log.read()))


@query
def status_restart(spark, folder):
    """Clicks that arrive in three lots of files, some of them twice and not by time, the stream started anew for each lot."""
    events = S.table(spark, folder, "events")
    base = os.path.join(scratch_dir(spark), f"status-{os.urandom(8).hex()}")
    landing, log = os.path.join(base, "landing"), status.ChangeLog(spark, os.path.join(base, "log"))
    third = F.col("event_id") % 3
    for lot in (third == 1, third != 0, third == 0):
        events.where(lot).repartition(2, "user_id").write.mode("append").parquet(landing)
        source = spark.readStream.schema(events.schema).parquet(landing)
        status.start(_updates(source), log, os.path.join(base, "checkpoint")).awaitTermination()
    return _status(status.fold_updates(log.read()))


@query
def status_current(spark, folder):
    """Clicks, a fold, records collected anew, and later clicks: the store as a reader sees it."""
    clicks = S.table(spark, folder, "events")
    users = clicks.select(F.col("user_id").cast("string").alias("source_url")).distinct()
    rows = users.select(*[F.col("source_url").alias(f.name) if f.name in ("source_url", "source_hash") else F.lit(None).cast(f.dataType).alias(f.name) for f in records.OPPORTUNITY])
    rows = store.with_defaults(rows, now()).withColumn("id", F.col("source_url"))
    saved = records.SnapshotStore(spark, _folder(spark, "store"))
    saved.write(store.with_key(rows), "first")
    log = status.ChangeLog(spark, _folder(spark, "log"))
    part = lambda p: _updates(clicks.where(F.col("event_id") % 2 == p)).withColumn("source_hash", F.sha2("source_hash", 256))
    log.append(part(0), 0)
    status.compact(saved, log)
    saved.write(store.upsert(saved.read(), rows.withColumn("pos", F.lit(0))), "again")
    log.append(part(1), 1)
    seen = status.live(saved, log)
    return seen.select(F.col("source_url").alias("user_id"), "relevant", "applied", stamp(F.col("applied_date")).alias("applied_date"))


# Vectors and clusters


def _label(docs: DataFrame) -> DataFrame:
    number = F.regexp_extract("source", r"(\d+)", 1).cast("bigint")
    code = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "de", 1).when(F.col("lang") == "fr", 2).otherwise(3)
    return docs.select(F.col("doc_pos").alias("leaf"), (number * 10 + code).cast("bigint").alias("label"))


def _given(spark: SparkSession, folder: str):
    """Corpus without folding, and two ready-made labellings of it."""
    docs = S.documents(spark, folder)
    corpus = vectors.build_corpus(prepared(spark, folder), fold=False)
    fine = _label(docs)
    both = fine.select(F.lit(0).alias("grp"), "leaf", "label").unionByName(
        fine.select(F.lit(1).alias("grp"), "leaf", F.floor(F.col("label") / 10).alias("label"))
    )
    return corpus, both.join(corpus.leaves.select("leaf"), "leaf")


@query
def tfidf(spark, folder):
    weights = vectors.unit_terms(words(spark, folder))
    return weights.groupBy(F.col("doc_pos").alias("doc_id")).agg(
        F.count(F.lit(1)).alias("terms"),
        F.round(F.sum("w"), 6).alias("total"),
        F.round(F.max("w"), 6).alias("largest"),
        big(F.sum("df")).alias("df_sum"),
        F.round(F.sum(F.col("w") * F.length("term")), 5).alias("checksum"),
    )


@query
def copies(spark, folder):
    members, leaves = vectors.fold_copies(words(spark, folder))
    sizes = leaves.select(F.col("doc_pos").alias("leaf"), "copies")
    return members.join(sizes, "leaf").select(F.col("doc_pos").alias("doc_id"), "leaf", "copies")


@query
def nearest_documents(spark, folder):
    corpus = vectors.build_corpus(words(spark, folder))
    rows = sweep.whole(corpus.leaves).select(F.col("leaf").alias("seat"), F.col("leaf").alias("id"), F.lit(1.0).alias("size"), F.array(big(F.lit(0))).alias("marks"), "tids", "ws")
    found = sweep.nearest(rows, rows, 1)
    return found.where(F.size("near") > 0).select(F.col("cid").alias("leaf"), F.round(1.0 - F.get("near", F.lit(0))["sim"], 6).alias("distance"))


@query
def cosine_pairs(spark, folder):
    corpus = vectors.build_corpus(words(spark, folder))
    pairs = tiles.similar_pairs(corpus.leaves, 0.25)
    return pairs.select("a", "b", F.round(1.0 - F.col("sim"), 6).alias("distance"))


@query
def silhouette(spark, folder):
    corpus, labels = _given(spark, folder)
    rows = cuts.silhouettes(corpus, labels)
    return rows.groupBy("grp", "label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("silhouette"), 6).alias("silhouette")).withColumn("grp", big("grp"))


@query
def candidate_scores(spark, folder):
    corpus, labels = _given(spark, folder)
    profile = cuts.size_profile(corpus, labels, MIN_SIZE)
    scores = cuts.scored(profile, cuts.silhouettes(corpus, labels))
    return scores.select(big("grp").alias("grp"), big("k").alias("k"), F.round("silhouette", 6).alias("silhouette"), F.round("score", 6).alias("score"))


@query
def cluster_sizes(spark, folder):
    corpus, labels = _given(spark, folder)
    sizes = reassign.cluster_sizes(corpus, labels.where("grp = 0").select("leaf", "label"))
    return sizes.select("label", "n", (F.col("n") >= MIN_SIZE).alias("major"))


@query
def centroids(spark, folder):
    corpus, labels = _given(spark, folder)
    sums = cuts.cluster_sizes(corpus, labels, materialise(cuts.cluster_terms(corpus, labels), "terms"))
    return sums.select(big("grp").alias("grp"), "label", "n", F.round(F.sqrt("square") / F.col("n"), 6).alias("length"))


@query
def reassign_tiny(spark, folder):
    corpus, labels = _given(spark, folder)
    new, moved = reassign.reassign_tiny(corpus, labels.where("grp = 0").select("leaf", "label"), MIN_SIZE)
    return new.select(F.col("leaf").alias("doc_id"), "label", F.lit(moved).cast("bigint").alias("moved"))


@query
def merge_tree(spark, folder):
    tree = linkage.average_linkage(vectors.build_corpus(words(spark, folder)))
    return tree.select("gone", "keep", F.round("distance", 6).alias("distance"))


@query
def natural_cut(spark, folder):
    """The best scored cut of the whole tree, with the minimum size that the number of documents gives."""
    corpus = vectors.build_corpus(words(spark, folder))
    minimum = cuts.min_cluster_size(corpus.n_docs)
    found = cuts.natural_labels(corpus, linkage.average_linkage(corpus), minimum)
    threshold = F.lit(found.threshold).cast("double")
    return found.labels.select("leaf", "label", big(F.lit(found.k)).alias("k"), F.round(threshold, 6).alias("threshold"), big(F.lit(minimum)).alias("minimum"))


@query
def cluster_run(spark, folder):
    docs = S.opportunities(spark, folder, gaps=False)
    result = pipeline.cluster(docs, F.lit(NOW), STOPWORDS, 4)
    table = result["clusters"].join(result["header"].select("discovered_k", "natural_discovered_k"))
    return table.select("cluster_id", "total_opportunities", report.keyword_line(F.col("leading_keywords")).alias("keyword_line"), "discovered_k", "natural_discovered_k")


@query
def cut_distances(spark, folder):
    """Even sampling over the distinct order totals, as over merge distances."""
    totals = S.table(spark, folder, "orders").select((F.col("o_totalprice") / 1000).alias("distance")).distinct()
    return cuts.sample_evenly(totals).select(big("idx").alias("idx"), "distance")


def _order_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Order numbers as a tree in which each number hangs below its half."""
    k = F.col("o_orderkey")
    orders = S.table(spark, folder, "orders").where(k > 0)
    return orders.select(k.alias("gone"), F.floor(k / 2).alias("keep"), (1.0 / (1 + F.length(F.bin(k)))).alias("distance"))


@query
def merge_heights(spark, folder):
    """Distinct distances of a tree; 1.0 is one as long as parts stay apart."""
    tree = _order_tree(spark, folder)
    n = tree.count()
    whole, parts = cuts.merge_distances(tree, n + 1), cuts.merge_distances(tree, n + 9)
    return whole.select(F.lit("whole").alias("tree"), F.round("distance", 9).alias("distance")).unionByName(parts.select(F.lit("parts").alias("tree"), F.round("distance", 9).alias("distance")))


@query
def cut_labels(spark, folder):
    """Order numbers as leaves of a tree in which each number hangs below its half."""
    k = F.col("o_orderkey")
    orders = S.table(spark, folder, "orders")
    tree = orders.where(k > 0).select(
        k.alias("gone"), F.floor(k / 2).alias("keep"), (1.0 / (1 + F.length(F.bin(k)))).alias("distance")
    )
    labels = cuts.cut(tree, orders.select(k.alias("leaf")), [(0, 0.08), (1, 0.11), (2, 0.3), (3, 0.9)])
    return labels.select(big("grp").alias("grp"), "leaf", "label")


# Summaries and report


def _summary(spark: SparkSession, folder: str):
    docs = S.opportunities(spark, folder, gaps=False)
    assigned = S.source_label(S.documents(spark, folder)).join(docs.where(~X.is_blank(F.col("job_description"))).select("doc_pos"), "doc_pos")
    ready = prepare.drop_explicit(prepare.tokenise(docs), STOPWORDS)
    terms = materialise(summary.unblocked(summary.cluster_terms(ready, assigned), STOPWORDS), "terms")
    return docs, assigned, terms


@query
def cluster_sentences(spark, folder):
    docs, assigned, terms = _summary(spark, folder)
    top = summary.top_sentences(summary.sentence_scores(docs, assigned, terms))
    return top.select("cluster_id", big("rank").alias("rank"), "sentence", "hits")


@query
def cluster_summary(spark, folder):
    docs, assigned, terms = _summary(spark, folder)
    top = summary.top_sentences(summary.sentence_scores(docs, assigned, terms))
    table = summary.cluster_table(assigned, summary.top_keywords(terms, report.TOP_KEYWORDS), top)
    return table.select(
        "cluster_id",
        "total_opportunities",
        "first_doc",
        report.keyword_line(F.col("leading_keywords")).alias("keyword_line"),
        digest(F.col("keyword_sentences")).alias("sentences_digest"),
    )


@query
def cluster_tables(spark, folder):
    """Save a result as a dated run and once more without a date, read the dated run back."""
    docs, assigned, terms = _summary(spark, folder)
    top = summary.top_sentences(summary.sentence_scores(docs, assigned, terms))
    keywords = materialise(summary.ranked_keywords(terms), "keywords")
    leading = keywords.where(F.col("rank") <= report.TOP_KEYWORDS)
    table = materialise(summary.cluster_table(assigned, leading, top), "clusters")
    none = spark.createDataFrame([], "term string")
    result = {
        "header": summary.result_header(spark, F.lit(NOW), table, 20, None, MIN_SIZE, 0, none, STOPWORDS),
        "clusters": table,
        "keywords": keywords,
        "opportunities": summary.cluster_members(docs, assigned),
    }
    path = _folder(spark, "clusters")
    clusters.save_clusters(result, path, "20300101")
    clusters.save_clusters({**result, "keywords": keywords.limit(0)}, path)
    latest = clusters.read_clusters(spark, path, "20300101")
    people = latest["opportunities"].groupBy("cluster_id").agg(F.count_if(F.col("opportunity.url").isNotNull()).alias("with_url"))
    words = latest["keywords"].groupBy("cluster_id").agg(big(F.sum(F.col("rank") * F.length("term"))).alias("checksum"))
    rows = latest["clusters"].join(people, "cluster_id").join(words, "cluster_id").join(latest["header"])
    return rows.select("cluster_id", "total_opportunities", "with_url", "checksum", "generated_at", big("discovered_k").alias("discovered_k"), big(F.size("explicit_stopwords")).alias("n_stopwords"))


@query
def cluster_sentences_lexicon(spark, folder):
    """Keywords and sentences both by lemma."""
    docs = S.opportunities(spark, folder, gaps=False)
    words = materialise(_lexicon(spark, folder), "lexicon")
    assigned = S.source_label(S.documents(spark, folder))
    terms = materialise(summary.cluster_terms(prepare.tokenise(docs, lexicon=words), assigned), "terms")
    scores = summary.sentence_scores(docs, assigned, terms, lexicon=words)
    return scores.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("sentences"), big(F.sum("hits")).alias("hits"), big(F.max("hits")).alias("most"))


@query
def nested_members(spark, folder):
    """Whole records in report order, one row per member and keyword count."""
    docs, assigned, terms = _summary(spark, folder)
    keywords = materialise(summary.ranked_keywords(terms), "keywords")
    none = spark.createDataFrame([], "cluster_id long, rank int, sentence string")
    table = summary.cluster_table(assigned, keywords.limit(0), none)
    parts = summary.nested_parts(table, keywords, summary.cluster_members(docs, assigned), PART_ROWS)
    places = numbered(table.withColumn("all", F.lit(0)), ["all"], summary.report_order(), "place").select("place", "cluster_id")
    words = parts.where("part = 0").select("cluster_id", F.get("keywords", F.lit(0)).alias("best"))
    sizes = parts.groupBy("cluster_id").agg(F.sum(F.size("keywords")).alias("n_keywords"))
    facts = places.join(sizes, "cluster_id").join(words, "cluster_id")
    rows = parts.select("cluster_id", "part", F.posexplode("opportunities").alias("i", "o")).join(facts, "cluster_id")
    at = big("part") * PART_ROWS + F.col("i")
    return rows.select(big("place").alias("place"), "cluster_id", big("n_keywords").alias("n_keywords"), "best", at.alias("i"), F.col("o.id").alias("id"))


@query
def report_sentences(spark, folder):
    docs, assigned, terms = _summary(spark, folder)
    top = summary.top_sentences(summary.sentence_scores(docs, assigned, terms))
    table = summary.cluster_table(assigned, summary.top_keywords(terms, report.TOP_KEYWORDS), top)
    return report.sentence_lines(table).select("cluster_id", big("line_no").alias("line_no"), "line")


@query
def report_rows(spark, folder):
    docs = S.opportunities(spark, folder)
    assigned = S.source_label(S.documents(spark, folder))
    members = summary.cluster_members(docs, assigned)
    extra = S.table(spark, folder, "nation").select((F.col("n_nationkey") + 1000).cast("bigint").alias("cluster_id"))
    clusters = assigned.select("cluster_id").distinct().unionByName(extra)
    return report.opportunity_lines(clusters, members)


@query
def report_overview(spark, folder):
    return report.overview(S.source_label(S.documents(spark, folder)).select("cluster_id").distinct())


@query
def freshness(spark, folder):
    orders = S.table(spark, folder, "orders")
    at = F.lit("1998-06-01 00:00:00").cast("timestamp")
    fresh = report.is_fresh(F.col("o_orderdate").cast("timestamp"), at)
    return orders.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count_if(fresh).alias("fresh"), F.count(F.lit(1)).alias("total"))


@query
def due_outputs(spark, folder):
    runs = S.table(spark, folder, "orders").select(F.col("o_custkey").alias("output"), F.col("o_orderdate").cast("timestamp").alias("generated_at"))
    wanted = S.table(spark, folder, "customer").select(F.col("c_custkey").alias("output"))
    at = F.lit("1998-06-01 00:00:00").cast("timestamp")
    return report.due_outputs(runs, wanted, at).select("output", stamp(F.col("generated_at")).alias("generated_at"))


@query
def forced_outputs(spark, folder):
    """All outputs, fresh ones too, with their latest run."""
    runs = S.table(spark, folder, "orders").select(F.col("o_custkey").alias("output"), F.col("o_orderdate").cast("timestamp").alias("generated_at"))
    wanted = S.table(spark, folder, "customer").select(F.col("c_custkey").alias("output"))
    fresh = report.is_fresh(F.col("generated_at"), F.lit("1998-06-01 00:00:00").cast("timestamp"))
    return report.due_outputs(runs, wanted, now(), force=True).select("output", stamp(F.col("generated_at")).alias("generated_at"), fresh.alias("fresh"))


@query
def display_time(spark, folder):
    orders = S.table(spark, folder, "orders")
    k = F.col("o_orderkey")
    full = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    forms = [full, F.concat(full, F.lit("+00:00")), F.concat(full, F.lit("+05:30")), F.concat(full, F.lit("Z")), F.concat(full, F.lit(".250-0800"))]
    forms += [F.substring(full, 1, n) for n in (4, 7, 10, 16)] + [F.substring(full, 12, 5), F.date_format("o_orderdate", "yyyyMMdd"), F.col("o_orderpriority"), F.lit(None).cast("string")]
    return orders.select("o_orderkey", report.display_time(F.get(F.array(*forms), (k % len(forms)).cast("int"))).alias("shown"))


# Résumés


@query
def resume_sections(spark, folder):
    rows = resume.section_rows(S.resumes(spark, folder), SECTIONS)
    return rows.select("resume_id", big("ord").alias("ord"), "section", "body")


def _prompts(spark: SparkSession, folder: str):
    docs = S.resumes(spark, folder)
    jobs = S.opportunities(spark, folder).select(F.col("doc_pos").alias("job_id"), "job_description")
    pairs = docs.select("resume_id", F.col("conv_id").alias("job_id"))
    return docs, resume.prompt_rows(docs, jobs, pairs, SECTIONS)


def _responses(prompts: DataFrame) -> DataFrame:
    return prompts.select("prompt_id", F.when(F.length("prompt") % 13 == 0, "").otherwise(F.lower("prompt")).alias("response"))


@query
def resume_prompts(spark, folder):
    _, prompts = _prompts(spark, folder)
    return prompts.select("prompt_id", "resume_id", "job_id", "section", big("ord").alias("ord"), F.md5(F.col("prompt").cast("binary")).alias("digest"))


def _shipped_resume(turns: DataFrame, opening: Column) -> Column:
    """A résumé with the shipped headers, one turn under each, as an aggregate over turns."""
    headers = [s.header for s in resume.SECTIONS if s.header]
    said = [F.coalesce(F.max(F.when(F.col("turn") == i, F.col("text"))), F.lit("")) for i in range(len(headers))]
    return F.concat(opening, *[x for h, t in zip(headers, said) for x in (F.lit(f"\n\n# {h}\n"), t)]).alias("body")


def _tailored(spark: SparkSession, folder: str, resumes: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Prompts and the résumés put together, for all opportunities."""
    jobs = S.opportunities(spark, folder, gaps=False).select(F.col("doc_pos").alias("job_id"), "job_description")
    prompts = materialise(resume.prompt_rows(resumes, jobs, pairs), "prompts")
    whole = resume.assemble(resumes, prompts, _responses(prompts))
    sizes = whole.select("resume_id", "job_id", F.md5(F.col("resume").cast("binary")).alias("resume_digest"))
    digests = prompts.select("resume_id", "job_id", "section", big("ord").alias("ord"), F.md5(F.col("prompt").cast("binary")).alias("digest"))
    return digests.join(sizes, ["resume_id", "job_id"]).select("resume_id", "job_id", "section", "ord", "digest", "resume_digest")


@query
def resume_every_job(spark, folder):
    """One résumé with the shipped sections, made of all conversations, tailored to every description."""
    turns = S.table(spark, folder, "conversations")
    one = turns.agg(_shipped_resume(turns, F.lit("conv 0"))).select(F.lit("conv").alias("resume_id"), "body")
    return _tailored(spark, folder, one).drop("resume_id")


@query
def resume_pairs(spark, folder):
    """A résumé of each conversation, and every opportunity tailored for one of them: a table of résumés meets a table of jobs."""
    turns = S.table(spark, folder, "conversations")
    docs = turns.groupBy(F.col("conv_id").alias("resume_id")).agg(_shipped_resume(turns, F.concat(F.lit("conv "), F.col("conv_id").cast("string"))))
    last = turns.agg(F.max("conv_id")).scalar()
    pairs = S.opportunities(spark, folder, gaps=False).select((F.col("doc_pos") % (last + 1)).alias("resume_id"), F.col("doc_pos").alias("job_id"))
    return _tailored(spark, folder, docs, pairs)


@query
def header_prompts(spark, folder):
    rows = resume.header_prompts(S.resumes(spark, folder))
    return rows.select("resume_id", big(F.length("prompt")).alias("n_chars"), F.md5(F.col("prompt").cast("binary")).alias("digest"))


@query
def resume_assembly(spark, folder):
    docs, prompts = _prompts(spark, folder)
    prompts = materialise(prompts, "prompts")
    rows = resume.assemble(docs, prompts, _responses(prompts), SECTIONS)
    return rows.select("resume_id", "job_id", F.md5(F.col("resume").cast("binary")).alias("digest"), big(F.length("resume")).alias("n_chars"))


@query
def stale_sections(spark, folder):
    return resume.stale_sections(S.section_status(spark, folder)).select("conv_id", "turn", "section", "status")


@query
def section_updates(spark, folder):
    state = resume.mark_in_progress(S.section_status(spark, folder), F.lit("2024-02-01 00:00:00").cast("timestamp"))
    turns = S.table(spark, folder, "conversations")
    got = turns.select("conv_id", "turn", F.when(F.length("text") % 5 == 0, " ").otherwise(F.col("text")).alias("response"))
    new = resume.apply_responses(state, got, ["conv_id", "turn"], now())
    return new.select("conv_id", "turn", "status", stamp(F.col("last_updated")).alias("last_updated"), F.md5(F.col("content").cast("binary")).alias("digest"))


@query
def failed_sections(spark, folder):
    rows = resume.failed_sections(S.section_status(spark, folder))
    return rows.groupBy("section").agg(F.count(F.lit(1)).alias("failed"))


@query
def build_succeeded(spark, folder):
    return resume.build_succeeded(S.section_status(spark, folder))
