"""Language of whole texts and of their spans.

Each word gets a score per language: the log-probability of its character n-grams in the training texts. The
script of a word narrows the candidates first: a language that was never seen in that script is out of the
question for the word. Viterbi then labels the sequence of words, with a penalty for each switch of language,
so that single odd words do not break a span while longer passages in another language get their own.
"""

from __future__ import annotations

import re
import sys
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.session import ship_package

TRAIN_DOCS = 500  # labelled texts per language at most, chosen by the hash of their ids
GRAMS = (2, 3)
FEATURES = 60_000  # n-grams kept per language at most, by count
SWITCH = 12.0  # price of a change of language, in nats
SHARE = 0.005  # part of a language's letters that a script must have to count as its own
UNKNOWN = "und"
_MEMORY = 500_000  # words whose scores a worker remembers
_BATCH = 1024  # texts labelled side by side

# First and last character of the ranges that tell scripts apart.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFC)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}

# Signs that \w takes besides letters and digits, such as fractions, raised digits and numerals of their own.
_SIGNS = re.compile("[" + "".join(c for c in map(chr, range(0x80, sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal()) + "]")
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters."""
    low = text.lower()
    found = _WORD.findall(low)
    return found if "".join(found).isalpha() else _WORD.findall(_SIGNS.sub(" ", low))


@lru_cache(maxsize=1 << 16)
def _script(char: str) -> str | None:
    code = ord(char)
    return next((name for name, ranges in SCRIPTS.items() if any(lo <= code <= hi for lo, hi in ranges)), None)


def script_of(word: str) -> str:
    """Script of a word's first character in a known range, else ``other``."""
    return next((s for s in map(_script, word) if s), "other")


def grams_of(word: str) -> list[str]:
    marked = f"<{word}>"
    return [marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1)]


@dataclass
class Model:
    langs: list[str]
    grams: dict[str, int]  # n-gram: its row of scores
    scores: np.ndarray  # log-probability per n-gram and language; the last row is for n-grams never seen
    scripts: dict[str, np.ndarray]  # script: which languages use it
    switch: float = SWITCH

    def words(self, words: list[str]) -> np.ndarray:
        """Scores of words, a row each; equal for all languages where a word's script belongs to none."""
        get, unseen = self.grams.get, len(self.grams)
        rows, sizes = [], []
        for w in words:
            found = [get(g, unseen) for g in grams_of(w)]
            rows += found
            sizes.append(len(found))
        starts = np.cumsum([0, *sizes[:-1]])
        # n-grams overlap: each character is seen once per length
        total = np.add.reduceat(self.scores[rows], starts, axis=0) / len(GRAMS)
        none = np.zeros(len(self.langs), bool)
        mask = np.array([self.scripts.get(script_of(w), none) for w in words])
        known = mask.any(axis=1)
        least = np.where(mask, total, np.inf).min(axis=1, keepdims=True)
        total = np.where(mask, total, least - 2 * self.switch)
        total -= total.max(axis=1, keepdims=True, initial=-np.inf, where=np.isfinite(total))
        return np.where(known[:, None], total, 0.0).astype(np.float32)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_lang: int = TRAIN_DOCS, features: int = FEATURES, switch: float = SWITCH) -> Model:
    """Fit n-gram scores on at most ``per_lang`` labelled texts of each language, taken by the hash of their keys.

    n-grams are counted on Spark; the driver receives at most ``features`` of them per language. Rows whose text or
    label is null do not count. Without any labelled text the model has no language, and all is unknown.
    """
    ship_package(docs.sparkSession)
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.xxhash64(F.col(key).cast("string")).alias("h"), F.col(text).alias("text"))
    n = {r.lang: r["count"] for r in labelled.groupBy("lang").count().collect()}  # one row per language
    if not n:
        return Model([], {}, np.zeros((1, 0)), {}, switch)
    bound = F.create_map(*(x for k, c in n.items() for x in (F.lit(k), F.lit(min(1.0, per_lang / c)))))
    part = (F.shiftrightunsigned("h", 11).cast("double") / 2.0**53) < bound[F.col("lang")]

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)  # words by language; their n-grams are counted on sending

        def flush() -> pa.RecordBatch:
            out: Counter = Counter()
            for name, words in held.items():
                for word, k in words.items():
                    for g in grams_of(word):
                        out[name, g] += k
                    out[name, f"script {script_of(word)}"] += k * len(word)
            held.clear()
            names, grams = zip(*out, strict=True) if out else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(grams, pa.string()), pa.array(list(out.values()), pa.int64())], names=["lang", "gram", "n"])

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[name].update(words_of(content))
                if sum(map(len, held.values())) > 100_000:
                    yield flush()
        yield flush()

    counted = labelled.where(part).select("lang", "text").mapInArrow(grams, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    langs = sorted(n)
    ranked = counted.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= features)
    rows = ranked.select("lang", "gram", "n").collect()
    at = {name: i for i, name in enumerate(langs)}
    counts: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}
    for r in rows:
        table, name = (scripts, r.gram[7:]) if r.gram.startswith("script ") else (counts, r.gram)
        table.setdefault(name, np.zeros(len(langs)))[at[r.lang]] = r.n
    letters = sum(scripts.values(), np.zeros(len(langs)))
    used = {k: v >= SHARE * np.maximum(letters, 1) for k, v in scripts.items()}
    total = sum(counts.values(), np.zeros(len(langs)))
    base = np.log(total + 0.5 * max(1, len(counts)))
    table = np.array([*counts.values(), np.zeros(len(langs))])
    return Model(langs, {g: i for i, g in enumerate(counts)}, np.log(table + 0.5) - base, used, switch)


class Labeller:
    """Labels batches of texts; remembers the scores of words it has met."""

    def __init__(self, model: Model):
        self.model = model
        self.ids: dict[str, int] = {}
        self.blank: set[str] = set()  # words that speak for no language
        self.table = np.zeros((1024, len(model.langs)), dtype=np.float32)

    def _ids(self, words: list[str]) -> np.ndarray:
        get = self.ids.get
        found = [get(w) for w in words]
        missing = [i for i, k in enumerate(found) if k is None]
        if missing:
            new = list(dict.fromkeys(words[i] for i in missing))
            base = len(self.ids)
            self.ids.update(zip(new, range(base, base + len(new)), strict=True))
            while base + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            scores = self.table[base : base + len(new)] = self.model.words(new)
            self.blank.update(new[i] for i in np.flatnonzero(~scores.any(axis=1)))
            for i in missing:
                found[i] = get(words[i])
        return np.array(found, dtype=np.int64)

    def _steady(self, scores: np.ndarray) -> int | None:
        """The language that holds throughout, if no stretch of words gains more by leaving it than its part of the switches.

        Half of each switch is charged to the stretch on either side: one inside the text pays a whole switch, one at the
        start or the end of it half a switch, and one that is the whole text nothing, but then gains nothing either.
        """
        main = int(scores.sum(axis=0, dtype=np.float64).argmax())
        gain = np.vstack([np.zeros(scores.shape[1]), np.cumsum(scores - scores[:, main : main + 1], axis=0, dtype=np.float64)])
        inside, ends = (gain - np.minimum.accumulate(gain, axis=0)).max(), max(gain.max(), (gain[-1] - gain).max())
        return main if inside <= self.model.switch and ends <= self.model.switch / 2 else None

    def paths(self, texts: list[str]) -> list[tuple[list[str], np.ndarray]]:
        """Words and best language path of each text. Viterbi takes all texts that may switch side by side."""
        if len(self.ids) > _MEMORY:
            self.ids.clear()
            self.blank.clear()
        words = [words_of(t) for t in texts]
        out: list = [(w, np.zeros(len(w), np.int16)) for w in words]
        if not self.model.langs:
            return out
        emissions: dict[int, np.ndarray] = {}
        for i, w in enumerate(words):
            if w:
                ids = self._ids(w)
                scores = self.table[ids]
                main = self._steady(scores)
                if main is None:
                    emissions[i] = scores
                else:
                    out[i][1].fill(main)
        order = sorted(emissions, key=lambda i: -len(words[i]))
        lengths = np.array([len(words[i]) for i in order])
        steps = int(lengths[0]) if len(lengths) else 0
        k = self.table.shape[1]
        # texts are sorted by length, so those still running at a step are the first rows
        running = np.searchsorted(-lengths, -np.arange(steps), side="left")
        starts = np.concatenate([[0], np.cumsum(running)]).astype(np.int64)
        flat = np.empty((int(starts[-1]), k), dtype=np.float32)
        for row, i in enumerate(order):
            flat[starts[: lengths[row]] + row] = emissions[i]
        stay = np.empty(flat.shape, dtype=bool)
        jump = np.empty(len(flat), dtype=np.int16)
        best = np.zeros((len(order), k), dtype=np.float32)
        for t in range(steps):
            lo, n = int(starts[t]), int(running[t])
            prev = best[:n]
            top = prev.argmax(axis=1)
            switched = prev[np.arange(n), top][:, None] - self.model.switch
            stay[lo : lo + n] = keep = prev >= switched
            jump[lo : lo + n] = top
            best[:n] = np.where(keep, prev, switched) + flat[lo : lo + n]
        state = best.argmax(axis=1)
        path = np.empty(len(flat), dtype=np.int16)
        for t in range(steps - 1, -1, -1):
            lo, n = int(starts[t]), int(running[t])
            path[lo : lo + n] = state[:n]
            at = np.arange(n)
            state[:n] = np.where(stay[lo : lo + n][at, state[:n]], state[:n], jump[lo : lo + n])
        for row, i in enumerate(order):
            out[i] = (words[i], path[starts[: lengths[row]] + row])
        return out

    def label(self, text: str, words: list[str], path: np.ndarray) -> dict:
        """Summary of one text: the language with most letters, its share of them, and the spans.

        Letters of words that speak for no language count for all of them alike.
        """
        if not words or not self.model.langs:
            return {"lang": UNKNOWN, "score": 0.0, "spans": []}
        single = (path == path[0]).all()
        clear = self.blank.isdisjoint(words)
        if single and clear:
            return {"lang": self.model.langs[int(path[0])], "score": 1.0, "spans": []}
        k = len(self.model.langs)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        spoken = sizes if clear else np.where([w in self.blank for w in words], 0, sizes)
        n = int(sizes.sum())
        lost = n - int(spoken.sum())
        if single:
            return {"lang": self.model.langs[int(path[0])], "score": (n - lost + lost / k) / n, "spans": []}
        letters = np.bincount(path, weights=spoken, minlength=k) + lost / k
        top = int(letters.argmax())
        spans = []
        found = list(_WORD.finditer(text))
        if not "".join(m.group() for m in found).isalpha():
            found = list(_WORD.finditer(_SIGNS.sub(" ", text)))
        places = [m.span() for m in found]
        if len(places) == len(words):  # lower-casing can split a word in rare scripts; then no places are given
            ends = [*(np.flatnonzero(np.diff(path)) + 1).tolist(), len(words)]
            for a, b in zip([0, *ends[:-1]], ends, strict=True):
                spans.append({"start": places[a][0], "end": places[b - 1][1], "lang": self.model.langs[int(path[a])]})
        return {"lang": self.model.langs[top], "score": float(letters[top] / n), "spans": spans}


LABEL = "struct<lang:string,score:double,spans:array<struct<start:int,end:int,lang:string>>>"
_TYPE = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))])


def label(spark, model: Model, text: Column) -> Column:
    """A struct ``(lang, score, spans)`` for each text, by ``model`` (shipped once per executor).

    ``lang`` is the language that holds most letters of the best path, ``und`` for a null text, one without letters
    and a model without languages; ``score`` the part of all letters it holds (0 for ``und``), where words in a script of no language of the model
    go to all of its k languages in equal parts: a text of such words alone scores 1/k. ``spans`` (code points, end
    exclusive) are given where the text mixes languages. Equal scores go to the alphabetically first language. Texts
    are read whole, whatever their length.
    """
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded by `features` per language

    @F.arrow_udf(LABEL)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        labeller = Labeller(shared.value)
        for batch in batches:
            out = []
            for lo in range(0, len(batch), _BATCH):
                texts = [t or "" for t in batch.slice(lo, _BATCH).to_pylist()]
                out += [labeller.label(t, *found) for t, found in zip(texts, labeller.paths(texts), strict=True)]
            yield pa.array(out, _TYPE)

    return run(text)


def held_out(key: Column, parts: int, part: int) -> Column:
    """Rows kept out of training: those whose id, as text, has this remainder."""
    return F.crc32(key.cast("string").cast("binary")) % parts == part
