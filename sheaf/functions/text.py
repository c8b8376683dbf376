"""Column expressions for text: whitespace, cleanup, tokens, n-grams, sentences."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.functions.stopwords import NUMBER_WORDS, english_stop_words

# Unicode white space; Java's \s and trim() know the ASCII part only.
WS = r"[\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

_TOKEN_BREAK = r"[^\p{L}\p{N}]+"

# Sentence limits, and the patterns that sentences are split at.
RUN_ON_CHARS, RUN_ON_WORDS = 280, 45
LONG_CHARS, LONG_WORDS, CHUNK_WORDS = 220, 36, 28
_SENTENCE_BREAK = rf"(?<=[.!?]){WS}+|\n+"
_RUN_ON_BREAK = (
    r"[•●▪◦]+ ?"
    r"| [-–—] "
    r"| ?; "
    r"|(?<=[a-z0-9)]) (?=[A-Z][A-Za-z]{2,} [A-Z][A-Za-z]{2,})"
)
_CLAUSE_BREAK = r"(?<=[,;:]) "


def _bind(value: Column, use) -> Column:
    """Evaluate ``value`` once per row and hand it to ``use`` as a variable."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{WS}+|{WS}+\z", "")


def compact(c: Column) -> Column:
    """One space for every run of white space, none at the ends."""
    return F.trim(F.regexp_replace(c, rf"{WS}+", " "))


def is_blank(c: Column) -> Column:
    """Null, empty or white space only."""
    return c.isNull() | ~c.rlike(rf"[^{WS[1:-1]}]")


def sanitize(c: Column) -> Column:
    """Drop control characters, unify line ends, squeeze blanks and empty lines."""
    c = F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return strip(c)


def preview(c: Column, limit: int = 200) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("..."))).otherwise(c)


def normalise_list(c: Column) -> Column:
    """Trimmed, non-empty, distinct entries in their first order."""
    return F.array_distinct(F.filter(F.transform(c, strip), lambda x: F.length(x) > 0))


def token_array(c: Column, blocked: Iterable[str] | None = None) -> Column:
    """Lower-case words of three or more plain letters, without stop and number words (a list of one's own, if given)."""
    out = sorted(english_stop_words() | NUMBER_WORDS if blocked is None else set(blocked))
    words = F.filter(
        F.split(F.lower(c), _TOKEN_BREAK),
        lambda t: t.rlike("^[a-z]{3,}$") & ~t.isin(out) if out else t.rlike("^[a-z]{3,}$"),
    )
    return F.transform(words, lambda t: F.when(t == "datum", F.lit("data")).otherwise(t))


def word_array(c: Column, blocked: Iterable[str] | None = None) -> Column:
    """Lower-case words for a lexicon: without stop words and numbers, of any length and alphabet."""
    out = sorted(english_stop_words() | NUMBER_WORDS if blocked is None else set(blocked))
    return F.filter(F.split(F.lower(c), _TOKEN_BREAK), lambda t: (t != "") & ~t.rlike(r"^\p{N}+$") & ~t.isin(out))


def lemma(c: Column) -> Column:
    """A lemma as a token, or null where it is too short or not of plain letters."""
    low = F.lower(F.trim(c))
    return F.when(low == "datum", F.lit("data")).when(low.rlike("^[a-z][a-z-]{2,}$"), low)


def split_stopwords(terms: Iterable[str]) -> tuple[list[str], list[str]]:
    """Stopword parameters as (single words, phrases), phrases longest first."""
    cleaned = {re.sub(r"\s+", " ", str(t).strip().lower()) for t in terms} - {""}
    singles = sorted(t for t in cleaned if " " not in t)
    phrases = sorted((t for t in cleaned if " " in t), key=lambda t: (-len(t), t))
    return singles, phrases


def drop_words(tokens: Column, words: Sequence[str]) -> Column:
    """Remove every occurrence of the words; other repeats stay."""
    if not words:
        return tokens
    return F.filter(tokens, lambda t: ~t.isin(list(words)))


def drop_phrases(tokens: Column, phrases: Sequence[str]) -> Column:
    """Remove phrases left to right, the longest one first at each place."""
    if not phrases:
        return tokens
    # With two blanks between tokens every phrase has blanks of its own at both ends.
    body = "|".join("  ".join(re.escape(w) for w in p.split()) for p in phrases)
    padded = F.concat(F.lit(" "), F.array_join(tokens, "  "), F.lit(" "))
    return F.filter(F.split(F.regexp_replace(padded, f" (?:{body}) ", ""), " "), lambda t: t != "")


def windows(tokens: Column, max_n: int = 3) -> Column:
    """Each token with the ``max_n - 1`` after it, null past the end: an array to explode."""
    size = F.size(tokens)
    later = [F.slice(tokens, k + 1, F.greatest(size - k, F.lit(0))) for k in range(1, max_n)]
    named = [c.alias(f"t{k}") for k, c in enumerate([tokens, *later])]
    return F.arrays_zip(*named)


def window_terms(window: Column, max_n: int = 3) -> Column:
    """``array<struct<term, n>>`` of the n-grams that open at a window; null terms run past the end."""
    return F.array(
        *[
            F.struct(
                F.concat(*[p for k in range(n) for p in ([F.lit(" ")] if k else []) + [window[f"t{k}"]]]).alias("term"),
                F.lit(n).alias("n"),
            )
            for n in range(1, max_n + 1)
        ]
    )


def distinct_terms(tokens: Column, max_n: int = 3) -> Column:
    """The different n-grams of a short token list."""
    terms = F.transform(windows(tokens, max_n), lambda w: F.transform(window_terms(w, max_n), lambda g: g["term"]))
    return F.array_distinct(F.filter(F.flatten(terms), lambda t: t.isNotNull()))


def when_filled(row: Column, tokens: str) -> Column:
    """``row`` in an array to explode, or no row when its token list is empty.

    A filter on the computed list would be pushed down and compute it twice.
    """
    return F.filter(F.array(row), lambda r: F.size(r[tokens]) > 0)


def _word_count(c: Column) -> Column:
    return F.size(F.split(c, " "))


def _pieces(c: Column, pattern: str) -> Column:
    parts = F.transform(F.split(c, pattern), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p != "")


def _chunks(part: Column) -> Column:
    """The part itself, or runs of CHUNK_WORDS words when it has too many."""

    def cut(words: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(words) - 1, F.lit(CHUNK_WORDS))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i + 1, CHUNK_WORDS), " "))

    return F.when(_word_count(part) <= LONG_WORDS, F.array(part)).otherwise(_bind(F.split(part, " "), cut))


def _split_long(s: Column) -> Column:
    short = (F.length(s) <= LONG_CHARS) & (_word_count(s) <= LONG_WORDS)
    return F.when(short, F.array(s)).otherwise(F.flatten(F.transform(_pieces(s, _CLAUSE_BREAK), _chunks)))


def _split_run_on(s: Column) -> Column:
    run_on = (F.length(s) > RUN_ON_CHARS) | (_word_count(s) > RUN_ON_WORDS)
    parts = F.when(run_on, _pieces(s, _RUN_ON_BREAK)).otherwise(F.array(s))
    return F.flatten(F.transform(parts, _split_long))


def sentences(c: Column) -> Column:
    """Sentences of a text; run-on and over-long ones are cut further."""
    base = F.filter(F.transform(F.split(c, _SENTENCE_BREAK), compact), lambda s: s != "")
    return F.flatten(F.transform(base, _split_run_on))
