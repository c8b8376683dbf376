"""From descriptions to filtered token lists."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.functions import text as X
from sheaf.operators import grams as G
from sheaf.session import dealt, materialise, ship_package, spread

BLOCK_WORDS = 4 * G.SLICE_TOKENS  # words that meet a lexicon together


def usable(docs: DataFrame, text: str = "job_description") -> DataFrame:
    return docs.where(~X.is_blank(F.col(text)))


def tokenise(docs: DataFrame, text: str = "job_description", lexicon: DataFrame | None = None) -> DataFrame:
    """``(doc_pos, tokens, keywords)`` of all documents that have tokens.

    Without a lexicon every token is a keyword. ``lexicon(token, lemma, is_noun)``
    replaces words by lemmas and keeps nouns only as keywords; words it does
    not know stay as they are and count as keywords. Stop words are judged by
    the word, length and letters by its lemma.
    """
    texts = usable(spread(docs.select("doc_pos", text), "doc_pos"), text)
    if lexicon is None:
        row = F.struct(X.token_array(F.col(text)).alias("tokens"))
        rows = texts.select("doc_pos", F.explode(X.when_filled(row, "tokens")).alias("r")).select("doc_pos", "r.tokens")
        return rows.withColumn("keywords", F.col("tokens"))
    return lemmas(texts.select("doc_pos", X.word_array(F.col(text)).alias("words")), ["doc_pos"], lexicon)


def lemmas(rows: DataFrame, keys: list[str], lexicon: DataFrame) -> DataFrame:
    """``(keys.., tokens, keywords)`` from ``rows(keys.., words)`` by a lexicon; rows without a token drop out.

    Rows lie in blocks of bounded size. Each different word of a block meets the lexicon once, and what it becomes goes back to that block.
    """
    spark = rows.sparkSession
    ship_package(spark)
    texts = materialise(rows.select(*keys, "words"), "words")
    total = texts.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    block = F.pmod(F.xxhash64(*keys), F.lit(total // BLOCK_WORDS + 1)).alias("block")
    again = spark.read.schema(texts.schema).parquet(texts.scratch_path)  # the same rows as the other side of a join
    used = again.select(block, F.explode("words").alias("token")).distinct()
    texts = texts.select(*keys, "words", block)
    word, noun = X.lemma(F.coalesce("lemma", "token")), F.coalesce("is_noun", F.lit(True))
    named = used.join(lexicon.select("token", "lemma", "is_noun"), "token", "left").select("block", "token", word.alias("word"), noun.alias("noun"))
    schema = T.StructType([*(texts.schema[k] for k in keys), *(T.StructField(c, T.ArrayType(T.StringType())) for c in ("tokens", "keywords"))])

    def replaced(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by([(k, "ascending") for k in keys])
        right = right.filter(pc.is_valid(right["word"])).sort_by([("token", "ascending"), ("word", "ascending"), ("noun", "ascending")])
        first = G.first_rows(left, keys)
        lists = left["words"].combine_chunks()
        lengths = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
        owner = np.repeat(np.cumsum(first) - 1, lengths)
        i = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        words = lists.flatten().dictionary_encode()
        same = right["token"].combine_chunks().dictionary_encode()
        at = np.asarray(pc.fill_null(pc.index_in(words.dictionary, same.dictionary), -1)).astype(np.int64)
        code = at[np.asarray(words.indices)] if len(words) else np.empty(0, np.int64)
        counts = np.bincount(np.asarray(same.indices), minlength=len(same.dictionary) + 1)
        hits = np.where(code >= 0, counts[np.maximum(code, 0)], 0)
        place = np.repeat(np.arange(len(code)), hits)
        row = (np.cumsum(counts) - counts)[code[place]] + np.arange(len(place)) - np.repeat(np.cumsum(hits) - hits, hits)
        order = np.lexsort((row, i[place], owner[place]))
        row, doc = row[order], owner[place][order]
        tokens = right["word"].combine_chunks().take(pa.array(row))
        is_noun = np.asarray(right["noun"].combine_chunks())[row].astype(bool) if len(row) else np.empty(0, bool)
        n = int(first.sum())
        all_, nouns = np.bincount(doc, minlength=n), np.bincount(doc[is_noun], minlength=n)
        lists = [G.listed(tokens, all_), G.listed(tokens.filter(pa.array(is_noun)), nouns)]
        heads = left.filter(pa.array(first)).select(keys)
        return pa.table([*heads.columns, *lists], [*keys, "tokens", "keywords"]).filter(pa.array(all_ > 0))

    return texts.groupBy("block").cogroup(named.groupBy("block")).applyInArrow(replaced, schema)


def drop_explicit(prepared: DataFrame, stopwords: Iterable[str]) -> DataFrame:
    """Single stop words leave tokens and keywords, then phrases leave tokens."""
    singles, phrases = X.split_stopwords(stopwords)
    tokens = X.drop_phrases(X.drop_words(F.col("tokens"), singles), phrases)
    keywords = X.drop_words(F.col("keywords"), singles)
    return _filled(prepared, tokens, keywords)


def phrase_rows(terms: DataFrame) -> DataFrame:
    """``(phrase, words)`` of the phrases among ``terms(term)``, normalised and distinct; ``words`` is their number, two at least."""
    phrase = F.lower(X.compact(F.col("term")))
    rows = terms.select(phrase.alias("phrase")).distinct()
    return rows.withColumn("words", F.size(F.split("phrase", " "))).where("words > 1")


def drop_phrase_table(prepared: DataFrame, terms: DataFrame) -> DataFrame:
    """``drop_phrases`` with the phrases of a table ``terms(term)`` of any length, single words among them not looked at.

    Documents lie in blocks of bounded size. The windows of a block, as long as some phrase is, meet the phrases by hash, then by text. Of several phrases that begin at one
    token the longest counts, and left to right a phrase that begins inside one already dropped does not. Only matches are sorted
    and folded: those of a document that overlap, one chain of them at a time. ``doc_pos`` tells documents apart.
    Null lists of tokens and documents left without a token drop out, as they do in ``drop_explicit``.
    """
    phrases = materialise(phrase_rows(terms), "phrases")
    lengths = sorted(r.words for r in phrases.select("words").distinct().collect())  # a number per length in use
    if not lengths:
        return _filled(prepared, F.col("tokens"), F.col("keywords"))
    ship_package(prepared.sparkSession)
    size = F.size("tokens")
    total = prepared.agg(F.coalesce(F.sum(F.greatest(size, F.lit(0))), F.lit(0))).first()[0]
    block = F.pmod(F.xxhash64("doc_pos"), F.lit(total // G.SLICE_TOKENS + 1)).alias("block")
    texts = dealt(prepared.where(F.col("tokens").isNotNull()).select(block, "doc_pos", "tokens"), "block")

    def windows(table: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Row, place and text of all windows of ``n`` tokens."""
        lists = table["tokens"].combine_chunks()
        lengths = np.diff(lists.offsets.to_numpy())
        row = np.repeat(np.arange(len(lists)), lengths)
        at = np.arange(len(row))
        i = at - np.repeat(np.cumsum(lengths) - lengths, lengths)
        here = np.flatnonzero(i + n <= lengths[row])
        flat = lists.flatten()
        phrase = pc.binary_join_element_wise(*[flat.take(pa.array(here + k)) for k in range(n)], " ", null_handling="skip")
        return row[here], i[here], phrase

    def used(table: pa.Table) -> pa.Table:
        words = pc.unique(pa.concat_arrays([windows(table, n)[2] for n in lengths]))
        return pa.table([pa.array(np.full(len(words), table["block"][0].as_py())), words], ["block", "phrase"])

    def matched(left: pa.Table, right: pa.Table) -> pa.Table:
        known = right["known"].combine_chunks()
        found = []
        for n in lengths if len(left) and len(known) else []:
            row, i, phrase = windows(left, n)
            hit = np.asarray(pc.is_in(phrase, known))
            found.append((row[hit], i[hit], np.full(int(hit.sum()), n)))
        row, i, n = (np.concatenate([np.empty(0, np.int64), *c]) for c in (zip(*found) if found else ([], [], [])))
        return pa.table([left["doc_pos"].combine_chunks().take(pa.array(row)), pa.array(i, pa.int32()), pa.array(n, pa.int32())], ["doc_pos", "i", "n"])

    # Each different window of a block meets the phrases once, by its hash; the phrases found go back to that block, where texts are compared.
    met = texts.groupBy("block").applyInArrow(used, "block long, phrase string").select("block", F.xxhash64("phrase").alias("hash"))
    keyed = phrases.select(F.xxhash64("phrase").alias("hash"), F.col("phrase").alias("known"))
    known = met.join(keyed, "hash").select("block", "known")
    kind = texts.schema["doc_pos"].dataType.simpleString()
    hits = texts.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(matched, f"doc_pos {kind}, i int, n int")
    hits = hits.groupBy("doc_pos", "i").agg(F.max("n").alias("n"))

    place = Window.partitionBy("doc_pos").orderBy("i")
    reach = F.max(F.col("i") + F.col("n")).over(place.rowsBetween(Window.unboundedPreceding, -1))
    chained = hits.withColumn("new", (F.col("i") >= F.coalesce(reach, F.lit(0))).cast("long"))
    chained = chained.withColumn("chain", F.sum("new").over(place.rowsBetween(Window.unboundedPreceding, 0)))
    chains = chained.groupBy("doc_pos", "chain").agg(F.sort_array(F.collect_list(F.struct("i", "n"))).alias("hits"))

    def take(kept: Column, hit: Column) -> Column:
        last = F.element_at(kept, -1)
        free = (F.size(kept) == 0) | (hit["i"] >= last["i"] + last["n"])
        return F.when(free, F.concat(kept, F.array(hit))).otherwise(kept)

    none = F.slice("hits", 1, 0)
    kept = F.when(F.size("hits") == 1, F.col("hits")).otherwise(F.aggregate("hits", none, take))
    dropped = chains.groupBy("doc_pos").agg(F.sort_array(F.flatten(F.collect_list(kept))).alias("dropped"))
    met = prepared.join(dropped, "doc_pos", "left")
    # what stays: the stretches between one dropped phrase and the next
    opens = F.concat(F.array(F.lit(0)), F.transform("dropped", lambda d: d["i"] + d["n"]))
    closes = F.concat(F.transform("dropped", lambda d: d["i"]), F.array(size))
    left = F.flatten(F.zip_with(opens, closes, lambda a, b: F.slice("tokens", a + 1, b - a)))
    return _filled(met, F.when(F.col("dropped").isNull(), F.col("tokens")).otherwise(left), F.col("keywords"))


def _filled(prepared: DataFrame, tokens: Column, keywords: Column) -> DataFrame:
    row = F.struct(tokens.alias("tokens"), keywords.alias("keywords"))
    return prepared.select("doc_pos", F.explode(X.when_filled(row, "tokens")).alias("r")).select("doc_pos", "r.*")


def _limit(n: Column, ratio: float | None) -> Column:
    share = F.lit(float(ratio)) if ratio is not None else F.when(n >= 10, F.lit(0.6)).otherwise(F.lit(0.75))
    return F.greatest(F.lit(2).cast("bigint"), F.ceil(n * share))


def dynamic_stopwords(prepared: DataFrame, ratio: float | None = None) -> DataFrame:
    """``(term, df)`` of keywords found in at least a share of the documents.

    The default share depends on the number of documents. A term's total count
    is never below its document count, so the latter alone decides.
    """
    n = prepared.agg(F.count(F.lit(1))).scalar()
    return (
        prepared.select(F.explode(F.array_distinct("keywords")).alias("term"))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"))
        .where(F.col("df") >= _limit(n, ratio))
    )


def drop_terms(prepared: DataFrame, terms: DataFrame) -> DataFrame:
    """Remove the terms of a short list from tokens and keywords.

    Dynamic stop words are in a share of all documents, so there are at most as many as a document
    has different words on average, divided by that share. They go into the expression as a hash set.
    """
    listed = [r.term for r in terms.select("term").collect()]
    return _filled(prepared, X.drop_words(F.col("tokens"), listed), X.drop_words(F.col("keywords"), listed))


def prepare(
    docs: DataFrame,
    stopwords: Iterable[str] = (),
    text: str = "job_description",
    ratio: float | None = None,
    lexicon: DataFrame | None = None,
    phrases: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Both filter passes: ``(prepared, dynamic stopwords)``, each written once. ``phrases(term)`` is a list too long for ``stopwords``."""
    first = materialise(drop_explicit(tokenise(docs, text, lexicon), stopwords), "tokens")
    if phrases is not None:
        first = materialise(drop_phrase_table(first, phrases), "tokens")
    blocked = materialise(dynamic_stopwords(first, ratio), "dynamic")
    if blocked.isEmpty():
        return first, blocked
    return materialise(drop_terms(first, blocked), "tokens"), blocked


def doc_terms(prepared: DataFrame, column: str = "tokens", max_n: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_pos, carry.., term, n, tf, i)``: n-grams of each document with count and first place.

    Documents are dealt out and counted a slice at a time, so that a task holds the n-grams of one slice, however many documents it gets.
    """
    ship_package(prepared.sparkSession)
    keys = ["doc_pos", *carry]
    rows = dealt(prepared.select(*keys, F.col(column).alias("_list")), "doc_pos").sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in G.slices(batches, keys, "_list"):
            found = G.Postings(part, keys, "_list", max_n)
            own = pa.array(np.flatnonzero(found.first)[found.doc])
            held = [part[k].combine_chunks().take(own) for k in keys]
            numbers = [pa.array(found.n, pa.int32()), pa.array(found.tf, pa.int64()), pa.array(found.i, pa.int32())]
            yield from G.emitted(pa.table([*held, found.terms(np.arange(len(found.n))), *numbers], [*keys, "term", "n", "tf", "i"]))

    kept = [rows.schema[k] for k in keys]
    more = [T.StructField("term", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("tf", T.LongType()), T.StructField("i", T.IntegerType())]
    return rows.mapInArrow(run, T.StructType([*kept, *more]))
