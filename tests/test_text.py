import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sheaf.functions import text as X
from sheaf.operators import prepare


def column(spark, values, expr):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, v string")
    return [r.o for r in df.select("i", expr(F.col("v")).alias("o")).orderBy("i").collect()]


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_pos bigint, job_description string")


def test_sanitize(spark):
    dirty = ["\x00a\x01\x08b\x0bc\x0cd\x7f", "a\r\nb\rc", "a \t b", "a\n\n\n\nb\n\nc", "  x 　", None]
    assert column(spark, dirty, X.sanitize) == ["abcd", "a\nb\nc", "a b", "a\n\nb\n\nc", "x", None]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab \t\n\r\x00\x0b é", max_size=30), min_size=20, max_size=40))
def test_sanitize_keeps_letters_and_is_stable(spark, values):
    once = column(spark, values, X.sanitize)
    for before, after in zip(values, once):
        assert [c for c in after if c.isalpha()] == [c for c in before if c.isalpha()]
        assert not set(after) & set("\r\t\x00\x0b") and "  " not in after and "\n\n\n" not in after and after == after.strip()
    assert column(spark, once, X.sanitize) == once


def test_blank(spark):
    values = [None, "", " \t\n", "  ", "x", " . "]
    assert column(spark, values, X.is_blank) == [True, True, True, True, False, False]


def test_preview(spark):
    assert column(spark, ["x" * 200, "x" * 201], X.preview) == ["x" * 200, "x" * 200 + "..."]


def test_tokens(spark):
    text = "Data datum 2x C++ state-of-the-art café Twenty seventh ab don't WORKFLOW, workflow"
    assert column(spark, [text], X.token_array) == [["data", "data", "state", "art", "workflow", "workflow"]]


def test_tokenise_drops_blank_and_empty(spark):
    rows = prepare.tokenise(docs(spark, ["alpha beta", " ", "the of 12", None])).collect()
    assert [(r.doc_pos, r.tokens, r.keywords) for r in rows] == [(0, ["alpha", "beta"], ["alpha", "beta"])]


def test_lexicon_gives_lemmas_and_nouns(spark):
    lexicon = spark.createDataFrame(
        [("running", "run", False), ("engines", "engine", True)], "token string, lemma string, is_noun boolean"
    )
    row = prepare.tokenise(docs(spark, ["running engines zebra engines"]), lexicon=lexicon).first()
    assert row.tokens == ["run", "engine", "zebra", "engine"]
    assert row.keywords == ["engine", "zebra", "engine"]


def test_stopwords_and_phrases(spark):
    assert X.split_stopwords([" Use  Case ", "work", "", "use case study"]) == (["work"], ["use case study", "use case"])
    text = "alpha gamma delta gamma delta epsilon alpha gamma work zeta zeta"
    stop = ["work", "gamma delta", "gamma delta gamma", "alpha gamma"]
    row = prepare.drop_explicit(prepare.tokenise(docs(spark, [text])), stop).first()
    # left to right, longest first: 'alpha gamma', then 'delta', 'gamma delta', 'epsilon', 'alpha gamma', rest
    assert row.tokens == ["delta", "epsilon", "zeta", "zeta"]
    assert row.keywords == [w for w in text.split() if w != "work"]


def test_phrase_of_blocked_word_never_matches(spark):
    row = prepare.drop_explicit(prepare.tokenise(docs(spark, ["use case alpha"])), ["use", "use case"]).first()
    assert row.tokens == ["case", "alpha"]


def test_document_left_empty_is_dropped(spark):
    assert prepare.drop_explicit(prepare.tokenise(docs(spark, ["gamma delta"])), ["gamma delta"]).count() == 0


@pytest.mark.parametrize("n,common,expected", [(1, 1, set()), (9, 7, {"shared"}), (9, 6, set()), (10, 6, {"shared"}), (10, 5, set())])
def test_dynamic_stopwords_limits(spark, n, common, expected):
    texts = [f"shared unique{chr(97 + i)}" if i < common else f"unique{chr(97 + i)}" for i in range(n)]
    found = prepare.dynamic_stopwords(prepare.tokenise(docs(spark, texts)))
    assert {r.term for r in found.collect()} == expected


def test_drop_terms(spark):
    ready = prepare.tokenise(docs(spark, ["alpha beta alpha", "beta gamma", "gamma"]))
    terms = spark.createDataFrame([("beta",), ("gamma",)], "term string")
    assert [tuple(r) for r in prepare.drop_terms(ready, terms).collect()] == [(0, ["alpha", "alpha"], ["alpha", "alpha"])]
    assert prepare.drop_terms(ready, terms.limit(0)).count() == 3


def test_lexicon_judges_the_lemma(spark):
    lexicon = spark.createDataFrame([("goes", "go", False), ("data", "datum", True), ("engines", "engine", True)], "token string, lemma string, is_noun boolean")
    row = prepare.tokenise(docs(spark, ["goes data engines 12 x café the"]), lexicon=lexicon).first()
    assert row.tokens == row.keywords == ["data", "engine"]
    assert prepare.tokenise(docs(spark, ["goes", " "]), lexicon=lexicon).count() == 0


def test_stop_words_are_a_parameter(spark):
    assert column(spark, ["the cat sat"], lambda c: X.token_array(c, ["cat"])) == [["the", "sat"]]
    assert column(spark, ["the cat sat"], lambda c: X.token_array(c, [])) == [["the", "cat", "sat"]]


def test_ngrams(spark):
    ready = prepare.tokenise(docs(spark, ["alpha", "alpha beta", "alpha beta alpha beta"]))
    rows = prepare.doc_terms(ready).collect()
    found = {(r.doc_pos, r.term): (r.n, r.tf, r.i) for r in rows}
    assert {k[1] for k in found if k[0] == 0} == {"alpha"}
    assert {k[1] for k in found if k[0] == 1} == {"alpha", "beta", "alpha beta"}
    assert found[2, "alpha beta"] == (2, 2, 0)
    assert found[2, "beta alpha"] == (2, 1, 1)
    assert found[2, "beta alpha beta"] == (3, 1, 1)


def test_sentence_edges(spark):
    """Expected lists are worked out by hand."""
    w = ["lorem"] * 60
    cases = [
        ("One. Two!  Three?\nFour\n\nFive", ["One.", "Two!", "Three?", "Four", "Five"]),
        ("No break at e.g.this or 3.5 here", ["No break at e.g.this or 3.5 here"]),
        (" ".join(w[:36]), [" ".join(w[:36])]),  # as long as a sentence may be
        (" ".join(w[:37]), [" ".join(w[:28]), " ".join(w[:9])]),  # one word more: runs of 28
        (" ".join(w[:45]), [" ".join(w[:28]), " ".join(w[:17])]),
        (" ".join(w[:57]), [" ".join(w[:28]), " ".join(w[:28]), "lorem"]),
        ("x" * 280, ["x" * 280]),  # a long word cannot be cut
        (" ".join(w[:37]) + ", tail: end; more", [" ".join(w[:28]), " ".join(w[:9]) + ",", "tail:", "end;", "more"]),
        (" ".join(w[:40]) + " ; " + " ".join(w[:10]), [" ".join(w[:28]), " ".join(w[:12]), " ".join(w[:10])]),  # over 45 words: cut at the mark
        (" ".join(w[:44]) + " - end • last", [" ".join(w[:28]), " ".join(w[:16]), "end", "last"]),
        (" ".join(w[:46]) + " Big Words follow", [" ".join(w[:28]), " ".join(w[:18]), "Big Words follow"]),
        ("short - dash • stays; whole", ["short - dash • stays; whole"]),
        ("", []),
        (" \n ", []),
    ]
    assert column(spark, [t for t, _ in cases], X.sentences) == [e for _, e in cases]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.lists(st.sampled_from(["lorem", "Ipsum", "Dolor", "a)", "•", "-", ";", "x,", "end.", "\n", "Sit"]), max_size=120),
        min_size=10,
        max_size=20,
    )
)
def test_sentences_lose_no_word_and_keep_limits(spark, values):
    texts = [" ".join(v) for v in values]
    for text, found in zip(texts, column(spark, texts, X.sentences)):
        words = lambda t: re.findall(r"[A-Za-z]+", t)
        assert [w for s in found for w in words(s)] == words(text)
        assert all(s == " ".join(s.split()) and s and len(s.split()) <= 36 for s in found)


def test_list_normalise(spark):
    df = spark.createDataFrame([([" a ", "b", "", "a", None, " "],)], "v array<string>")
    assert df.select(X.normalise_list(F.col("v")).alias("o")).first().o == ["a", "b"]


def test_phrases_of_a_table_are_dropped_like_those_of_a_list(spark):
    draw = random.Random(5)
    lists = [[draw.choice("abc") for _ in range(draw.randrange(0, 40))] for _ in range(120)] + [["a"] * 300, None]
    phrases = ["a  a a", "A b", "b a c", "b c a b", "c c c", "x y", " c", "", None]
    rows = spark.createDataFrame([(i, t, t) for i, t in enumerate(lists)], "doc_pos long, tokens array<string>, keywords array<string>")
    terms = spark.createDataFrame([(p,) for p in phrases], "term string")
    _, several = X.split_stopwords([p for p in phrases if p])
    want = {r.doc_pos: r.t for r in rows.select("doc_pos", X.drop_phrases(F.col("tokens"), several).alias("t")).collect() if r.t}
    got = prepare.drop_phrase_table(rows, terms).collect()
    assert {r.doc_pos: r.tokens for r in got} == want
    assert all(r.keywords == lists[r.doc_pos] for r in got)
    assert prepare.drop_phrase_table(rows, terms.where("term = 'none'")).count() == sum(bool(t) for t in lists)
    assert prepare.drop_phrase_table(rows.limit(0), terms).count() == 0


def test_ngrams_are_counted_in_slices(spark, monkeypatch):
    """Documents of any length, given twice, without a number or with null words come out as one count each, slice by slice."""
    import pyarrow as pa

    from sheaf.operators import grams as G

    words = [f"w{chr(97 + i % 7)}{chr(97 + i % 5)}" for i in range(400)]
    rows = [(d, words[d : d + 3 + d % 40]) for d in range(60)] + [(3, words[3:9]), (None, words[:4]), (None, words[:4]), (61, []), (62, None)]
    table = spark.createDataFrame(rows, "doc_pos bigint, tokens array<string>")
    batches = [pa.RecordBatch.from_pylist([{"doc_pos": d, "tokens": t} for d, t in sorted(rows[:60])])]
    parts = list(G.slices(iter(batches), ["doc_pos"], "tokens", 100))
    assert len(parts) > 5 and sum(map(len, parts)) == 60
    plain = {}
    for d, t in rows:
        for n in (1, 2, 3):
            for i in range(len(t or []) - n + 1):
                key = d, " ".join(t[i : i + n]), n
                tf, at = plain.get(key, (0, i))
                plain[key] = tf + 1, min(at, i)
    assert {(r.doc_pos, r.term, r.n): (r.tf, r.i) for r in prepare.doc_terms(table).collect()} == plain


def test_lexicon_takes_rows_given_twice(spark):
    """Words that the lexicon has twice or not at all, rows with the same key: all of them count, in the order of their places."""
    lexicon = spark.createDataFrame([("goes", "go", False), ("goes", "going", True), ("engines", "engine", True)], "token string, lemma string, is_noun boolean")
    rows = spark.createDataFrame([(1, ["goes", "engines", "x"]), (1, ["engines"]), (None, ["plain"]), (2, ["goes"]), (3, [])], "doc_pos bigint, words array<string>")
    found = {r.doc_pos: (r.tokens, r.keywords) for r in prepare.lemmas(rows, ["doc_pos"], lexicon.where("lemma <> 'go' OR NOT is_noun")).collect()}
    assert found == {1: (["engine", "going", "engine"], ["engine", "going", "engine"]), None: (["plain"], ["plain"]), 2: (["going"], ["going"])}


def test_windows_of_a_block_meet_the_phrases_once(spark):
    lists = [["aaa", "bbb", "ccc", "ddd"]] * 40 + [["bbb", "ccc"], ["ccc", "bbb", "aaa"]]
    rows = spark.createDataFrame([(i, t, t) for i, t in enumerate(lists)], "doc_pos bigint, tokens array<string>, keywords array<string>")
    left = prepare.drop_phrase_table(rows, spark.createDataFrame([("bbb ccc",), ("aaa bbb ccc",)], "term string"))
    assert {r.doc_pos: r.tokens for r in left.collect()} == {**{i: ["ddd"] for i in range(40)}, 41: ["ccc", "bbb", "aaa"]}
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "FlatMapCoGroupsInArrow" in plan
