"""Secrets in texts: candidates by pattern, false positives removed by a random forest.

A candidate is described by its length, its character classes and their transitions, how well a model of ordinary words explains
its characters, how much of it dictionary words cover, the path it stands in and the words next to it. The forest learns from
labelled findings. Where no reviewed labels exist, ``silver_findings`` derives them from the corpus: values in the issued format of a
provider and assigned hexadecimal keys are true; so are values drawn at random in these formats and set in their places, and ordinary words
of the same texts set there are false.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.session import materialise, ship_package, tidy

AROUND = 500  # characters on both sides of a candidate from which decoys take their words
BINS = 64  # values of a feature at which the forest may cut
ROWS = 1 << 16  # labelled rows that a task counts
SLOTS = 1 << 16  # of first parts of paths, by hash
WORDS = 4000  # dictionary entries
TREES, DEPTH = 40, 8
THRESHOLD = 0.5
MASK = "[SECRET]"

# Formats and names by which candidates are found.
RULES = {
    "aws": re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])"),
    "github": re.compile(r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "slack": re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    "google": re.compile(r"(?<![A-Za-z0-9])AIza[A-Za-z0-9_-]{35}"),
    "jwt": re.compile(r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
    "pem": re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]{0,40}PRIVATE KEY-----)?"),
    "assigned": re.compile(
        r"(?i)(?<![a-z])(?:pass(?:word|wd|phrase)|pwd|token|secret|api[_-]?key|access[_-]?key|key|auth|credential)s?[\"']?\s{0,3}(?:=|:)\s{0,3}[\"']?(?P<v>[^\s\"'<>]{6,})"
    ),
    "long": re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}"),
}
ISSUED = ("aws", "github", "slack", "google", "jwt", "pem")
HEX = re.compile(r"[0-9a-f]{16,}")
DOUBTFUL = ("example", "sample", "test", "dummy", "fake", "placeholder", "changeme", "fixture", "docs", "xxxx")
UUID = re.compile(r"(?i)[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}")
DIGESTS = ("commit", "sha1", "sha256", "md5", "digest", "checksum", "revision", "hash", "uuid", "etag")
NAMES = ("password", "passwd", "pwd", "token", "secret", "key", "auth", "credential")
#: No candidate without one of these: issued values may be letters alone, so their heads count as well.
TRIGGER = "[0-9=:]|-----|AKIA|ASIA|gh[pousr]_|xox[abprs]-|AIza|eyJ"

WORD = re.compile(r"[^\W\d_]+")
VARIANTS = 3  # decoys and drawn values for each silver finding
_UPPER, _HEX = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789abcdef"
_ALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_NEAR = 60  # characters looked at on both sides of a candidate

FEATURES = (
    "length", "digits", "upper", "lower", "other", "entropy", "class_changes", "transitions", "dictionary", "assigned", "issued", "hex",
    "name_near", "doubtful_near", "doubtful_path", "path_depth", "path_rate", "quoted", "words_near", "doubtful_value", "digest_near", "uuid", "commonest", "steps",
)

Candidate = tuple[int, int, str]  # start, end, rule


def candidates(text: str) -> list[Candidate]:
    """Candidate values, the more specific rule first where two overlap; in order of place."""
    out: list[Candidate] = []
    for name, pattern in RULES.items():
        free = []
        for m in pattern.finditer(text):
            a, b = m.span("v") if name == "assigned" else m.span()
            while name == "assigned" and b > a and text[b - 1] in ".,;)":
                b -= 1
            at = bisect_left(out, (a,))  # candidates of earlier rules are disjoint and sorted
            if b > a and not (at and out[at - 1][1] > a) and not (at < len(out) and out[at][0] < b):
                free.append((a, b, name))
        out = sorted(out + free)
    return out


def _entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def _class(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.isupper() else 2 if c.isalpha() else 3


@dataclass
class Language:
    """What ordinary words look like, and how often texts of a path hold secrets."""

    words: set[str]
    pairs: dict[str, float]  # log-probability of a character after another
    rates: dict[int, float]  # share of true findings by slot of the first part of the path
    rate: float

    def transitions(self, value: str) -> float:
        low = value.lower()
        return sum(self.pairs.get(low[i : i + 2], -9.0) for i in range(len(low) - 1)) / max(1, len(low) - 1)

    def coverage(self, value: str) -> float:
        """Part of the characters that dictionary words of three letters and more cover, longest first from the left."""
        low, at, covered = value.lower(), 0, 0
        while at < len(low):
            size = next((n for n in range(min(12, len(low) - at), 2, -1) if low[at : at + n] in self.words), 0)
            covered += size
            at += size or 1
        return covered / max(1, len(low))


def language(texts: list[str], rates: dict[int, float], rate: float) -> Language:
    counts = Counter(w for t in texts for w in WORD.findall(t.lower()))
    pairs: Counter = Counter()
    for w, n in counts.items():
        for i in range(len(w) - 1):
            pairs[w[i : i + 2]] += n
    known = {w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:WORDS] if len(w) > 2}
    return Language(known, _logs(pairs), rates, rate)


def _logs(pairs: dict[str, int]) -> dict[str, float]:
    firsts: Counter = Counter()
    for p, n in pairs.items():
        firsts[p[0]] += n
    return {p: math.log(n / firsts[p[0]]) for p, n in pairs.items()}


def slot(path: str | None) -> int:
    return zlib.crc32((path or "").lower().split("/")[0].encode("utf-8", "replace")) % SLOTS


def describe(text: str, found: Candidate, path: str | None, known: Language) -> list[float]:
    a, b, rule = found
    value = text[a:b]
    # long values, such as whole keys, are described by their parts' sums; cost stays linear
    kinds = [_class(c) for c in value]
    n = len(value)
    before, after = text[max(0, a - _NEAR) : a].lower(), text[b : b + _NEAR].lower()
    low, where = value.lower(), (path or "").lower()
    return [
        math.log(n),
        kinds.count(0) / n,
        kinds.count(1) / n,
        kinds.count(2) / n,
        kinds.count(3) / n,
        _entropy(value),
        sum(x != y for x, y in zip(kinds, kinds[1:])) / n,
        known.transitions(value),
        known.coverage(value),
        float(rule == "assigned"),
        float(rule in ISSUED),
        float(HEX.fullmatch(value) is not None),
        float(any(x in before[-20:] for x in NAMES)),
        float(any(x in before or x in after for x in DOUBTFUL)),
        float(any(x in where for x in DOUBTFUL)),
        float(where.count("/")),
        known.rates.get(slot(path), known.rate),
        float(before[-1:] in "\"'" and before != ""),
        sum(w in known.words for w in WORD.findall(before)[-3:] + WORD.findall(after)[:3]) / 6,
        float(any(x in low for x in DOUBTFUL)),
        float(any(x in before[-20:] for x in DIGESTS)),
        float(UUID.fullmatch(value) is not None),
        max(Counter(low).values()) / n,  # fillings repeat one character,
        sum(0 <= ord(y) - ord(x) <= 1 for x, y in zip(low, low[1:])) / n,  # or count up
    ]


# The forest


@dataclass
class Forest:
    """Trees as arrays: feature (-1 at a leaf), threshold, left and right child, share of true findings."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.trees:
            return np.ones(len(x))
        total = np.zeros(len(x))
        for feature, cut, left, right, share in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH + 1):
                f = feature[at]
                down = np.where(x[np.arange(len(x)), np.maximum(f, 0)] <= cut[at], left[at], right[at])
                at = np.where(f < 0, at, down)
            total += share[at]
        return total / len(self.trees)


_COUNTED = "tree int, at array<int>, n array<long>, k array<long>"
_SPLIT = "tree int, node int, feature int, bin int, n long, k long, left_n long, left_k long"


def _drawn(keys: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often the bootstrap sample of a tree holds each row: Poisson numbers from a hash of the row, the same in every task."""
    salt = np.uint64(((tree + 1) * 0x9E3779B97F4A7C15 + seed * 0xD1B54A32D192ED03) & (2**64 - 1))
    h = keys.astype(np.int64).view(np.uint64) ^ salt
    for shift, by in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
    u = ((h ^ (h >> np.uint64(33))) >> np.uint64(11)).astype(float) / 2**53
    return np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)]), u, "right")


class _Growth:
    """A forest while it grows, a level at a time. Nodes are numbered as in a full binary tree; ``splits`` has feature and bin of those cut so far."""

    def __init__(self, width: int, trees: int, seed: int) -> None:
        self.width, self.trees, self.seed = width, trees, seed
        self.tries = min(width, int(math.sqrt(width)) + 1)
        self.splits: list[dict[int, tuple[int, int]]] = [{} for _ in range(trees)]
        self.shares: list[dict[int, float]] = [{} for _ in range(trees)]

    def tried(self, tree: int, level: int) -> np.ndarray:
        """Features that each node of a level may be cut at."""
        rng = np.random.default_rng([self.seed, tree, level])
        return rng.random((2**level, self.width)).argsort(axis=1)[:, : self.tries]

    def counted(self, x: np.ndarray, y: np.ndarray, keys: np.ndarray, level: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Rows, and true ones among them, by (node, try, bin), tree by tree; ``x`` are bins."""
        for tree in range(self.trees):
            node, alive = np.zeros(len(x), np.int64), np.ones(len(x), bool)
            feature, cut = np.full(2**level, -1), np.zeros(2**level, np.int64)
            for n, (f, c) in self.splits[tree].items():
                feature[n], cut[n] = f, c
            for _ in range(level):
                f = feature[node]
                alive &= f >= 0
                node = np.where(alive, 2 * node + 1 + (x[np.arange(len(x)), np.maximum(f, 0)] > cut[node]), 0)
            times = _drawn(keys, tree, self.seed)
            rows = np.flatnonzero(alive & (times > 0))
            here = node[rows] - (2**level - 1)
            tries = self.tried(tree, level)
            at = (here[:, None] * self.tries + np.arange(self.tries)) * BINS + x[rows[:, None], tries[here]]
            size = 2**level * self.tries * BINS
            n = np.bincount(at.ravel(), np.repeat(times[rows], self.tries), size)
            k = np.bincount(at.ravel(), np.repeat(times[rows] * y[rows], self.tries), size)
            used = np.flatnonzero(n)
            yield tree, used, n[used].astype(np.int64), k[used].astype(np.int64)

    def best(self, tree: int, at: np.ndarray, n: np.ndarray, k: np.ndarray, level: int, last: bool) -> list[tuple]:
        """The cut of each node with the least Gini impurity, from counts that may come in several parts; feature -1 where there is none."""
        size = 2**level * self.tries * BINS
        n, k = (np.bincount(at, c, size).reshape(2**level, self.tries, BINS) for c in (n, k))
        tries = self.tried(tree, level)
        out = []
        for i in np.flatnonzero(n[:, 0].sum(axis=1)).tolist():
            total, true = n[i, 0].sum(), k[i, 0].sum()
            node, share = 2**level - 1 + i, true / total
            row = (tree, node, -1, 0, int(total), int(true), 0, 0)
            if not last and total >= 4 and 0 < true < total:
                left_n, left_k = n[i].cumsum(axis=1), k[i].cumsum(axis=1)
                m, r = total - left_n, true - left_k
                with np.errstate(divide="ignore", invalid="ignore"):
                    gini = np.where((left_n > 0) & (m > 0), left_k * (1 - left_k / left_n) + r * (1 - r / m), np.inf)
                a, c = np.unravel_index(gini.argmin(), gini.shape)
                if gini[a, c] < share * (1 - share) * total - 1e-9:
                    row = (tree, node, int(tries[i, a]), int(c), int(total), int(true), int(left_n[a, c]), int(left_k[a, c]))
            out.append(row)
        return out

    def take(self, rows: list[tuple]) -> bool:
        """Keep the cuts of a level; whether there is another one."""
        for tree, node, feature, cut, n, k, *_ in rows:
            self.shares[tree][node] = k / n
            if feature >= 0:
                self.splits[tree][node] = (feature, cut)
        return any(r[2] >= 0 for r in rows)

    def forest(self, cuts: list[np.ndarray]) -> Forest:
        grown = []
        for splits, shares in zip(self.splits, self.shares, strict=True):
            place = {node: i for i, node in enumerate(sorted(shares))}
            nodes = []
            for node, i in place.items():
                f, c = splits.get(node, (-1, 0))
                ends = [place[2 * node + s] if f >= 0 else i for s in (1, 2)]
                nodes.append((f, float(cuts[f][c]) if f >= 0 else 0.0, *ends, shares[node]))
            columns = list(zip(*nodes, strict=True))
            if nodes:
                grown.append(tuple(np.array(c, t) for c, t in zip(columns, (np.int64, float, np.int64, np.int64, float), strict=True)))
        return Forest(grown)


def _cuts(values: list[float]) -> np.ndarray:
    values = np.unique(values)
    return (values[:-1] + values[1:]) / 2


def _binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Number of cuts below each value: a value is in bin b or lower where it is at most cut b."""
    return np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 3) -> Forest:
    """Trees on bootstrap samples, each split the best of a random choice of features by Gini impurity.

    Without both labels there is nothing to tell apart, and an empty forest takes every candidate for true.
    """
    if not len(y) or y.min() == y.max():
        return Forest([])
    cuts = [_cuts(np.quantile(x[:, f], np.linspace(0, 1, BINS))) for f in range(x.shape[1])]
    bins, growth = _binned(x, cuts), _Growth(x.shape[1], trees, seed)
    for level in range(depth + 1):
        counts = growth.counted(bins, y, np.arange(len(y)), level)
        if not growth.take([r for tree, at, n, k in counts for r in growth.best(tree, at, n, k, level, level == depth)]):
            break
    return growth.forest(cuts)


def grow_all(rows: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = 3) -> Forest:
    """``grow`` over ``rows(key, y, x)`` of any number: tasks count the rows of each node, Spark adds the counts up, only cuts reach the driver."""
    n, true = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not 0 < true < n:
        return Forest([])
    width = len(FEATURES)
    names = [f"x{f}" for f in range(width)]
    values = rows.select(*[F.get("x", F.lit(f)).alias(c) for f, c in enumerate(names)])
    cuts = [_cuts(v) for v in values.approxQuantile(names, np.linspace(0, 1, BINS).tolist(), 0.002)]
    growth = _Growth(width, trees, seed)

    def count(level: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            for batch in batches:
                held.append(batch)
                if sum(h.num_rows for h in held) >= ROWS:
                    yield from counts(held)
                    held = []
            if held:
                yield from counts(held)

        def counts(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            keys, y, x = (np.asarray(c) for c in (table["key"], table["y"], table["x"].combine_chunks().flatten()))
            for tree, *found in growth.counted(_binned(x.reshape(len(y), width), cuts), y, keys, level):
                lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), pa.array(c, t)) for c, t in zip(found, (pa.int32(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([tree], pa.int32()), *lists], names=["tree", "at", "n", "k"])

        return run

    def choose(level: int):
        def run(table: pa.Table) -> pa.Table:
            parts = [np.asarray(table[c].combine_chunks().flatten()) for c in ("at", "n", "k")]
            out = growth.best(table["tree"][0].as_py(), *parts, level, level == depth)
            types = [pa.int32()] * 4 + [pa.int64()] * 4
            return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], [c.split(" ")[0] for c in _SPLIT.split(", ")])

        return run

    for level in range(depth + 1):
        with tidy(rows.sparkSession):
            chosen = rows.mapInArrow(count(level), _COUNTED).groupBy("tree").applyInArrow(choose(level), _SPLIT).collect()
        if not growth.take([tuple(r) for r in sorted(chosen)]):
            break
    return growth.forest(cuts)


@dataclass
class Model:
    known: Language
    forest: Forest

    def scan(self, text: str, path: str | None) -> list[tuple[int, int, str, float]]:
        found = candidates(text)
        if not found:
            return []
        scores = self.forest.score(np.array([describe(text, c, path, self.known) for c in found]))
        return [(*c, float(s)) for c, s in zip(found, scores, strict=True)]


_HELD = ("h", "i", "near", "a", "b", "rule", "path")
_HELD_SCHEMA = pa.schema(list(zip(_HELD, (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()), strict=True)))
_LABELLED_TYPES = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32())


def silver_findings(texts: list[tuple[str, str | None]], seed: int = 5) -> list[tuple[str, Candidate, str | None, int]]:
    """Labelled findings ``(text, candidate, path, label)`` from texts alone."""
    rng = np.random.default_rng(seed)
    return [r for text, path in texts for found in candidates(text) for r in silver(text, found, path, rng)]


def silver(text: str, found: Candidate, path: str | None, rng: np.random.Generator) -> list[tuple[str, Candidate, str | None, int]]:
    """What a candidate teaches: itself, and decoys and drawn values in its place.

    A finding in an issued format teaches as true unless it is a filling by its own look: it holds a word of doubt, or few characters.
    """
    out: list[tuple[str, Candidate, str | None, int]] = []
    words = [w for w in WORD.findall(text) if len(w) >= 6]
    a, b, rule = found
    value = text[a:b]
    filled = any(x in value.lower() for x in DOUBTFUL) or len(set(value[4:])) < 6
    if rule in ISSUED and rule != "pem" and filled:
        out.append((text, (a, b, rule), path, 0))
    elif rule in ISSUED or (rule == "assigned" and HEX.fullmatch(value)):
        out.append((text, (a, b, rule), path, 1))
    elif rule == "assigned" and WORD.fullmatch(value):
        out.append((text, (a, b, rule), path, 0))
    name = rule if rule not in ISSUED else "long"
    for _ in range(VARIANTS if words else 0):
        # where the value stands, also ordinary words, joined words, words with a year and fillings,
        w, year = [str(x) for x in rng.choice(words, 3)], int(rng.integers(1990, 2030))
        decoy = str(rng.choice([w[0], "_".join(w), f"{w[0]}-{w[1]}-{year}", f"{w[0]}/{w[1]}/{w[2]}.html", "x" * len(value), f"{w[0]}{year}", "********", "changeme"]))
        out.append((text[:a] + decoy + text[b:], (a, a + len(decoy), name), path, 0))
        # and values that were never issued, in the formats of issued ones
        kind = str(rng.choice(["aws", "github", "google", "slack", name, name]))
        draw = lambda letters, n: "".join(rng.choice(list(letters), n))  # noqa: E731, B023
        key = {"aws": "AKIA" + draw(_UPPER, 16), "github": "ghp_" + draw(_ALL, 36), "google": "AIza" + draw(_ALL, 35), "slack": "xoxb-" + draw(_ALL, 24)}.get(
            kind, draw(rng.choice([_HEX, _ALL]), int(rng.integers(16, 48)))
        )
        out.append((text[:a] + key + text[b:], (a, a + len(key), kind), path, 1))
    out += _formatted(text, a, b, path, rng)
    return out


HEADS = {"aws": ("AKIA", 16, _UPPER), "github": ("ghp_", 36, _ALL), "google": ("AIza", 35, _ALL), "slack": ("xoxb-", 24, _ALL)}


def _formatted(text: str, a: int, b: int, path: str | None, rng: np.random.Generator) -> list[tuple[str, Candidate, str | None, int]]:
    """Decoys in issued formats, and digests, in the place of a finding; and drawn values in doubtful surroundings.

    Fillings and samples are no secrets wherever they stand, nor is a drawn value that the words beside it and the path both call an example; one
    of the two alone says too little. Hashes and identifiers are told by the word before them or by their form.
    """
    draw = lambda letters, n: "".join(rng.choice(list(letters), n))
    rule = str(rng.choice(list(HEADS)))
    head, size, letters = HEADS[rule]
    cycle = ("1234567890abcdefghijklmnopqrstuvwxyz" * 2)[:size]
    filling = str(rng.choice(["x" * size, draw(letters, 1) * size, cycle, (draw(letters, size) + "example")[-size:], ("your_key_here_" * 4)[:size]]))
    filling = filling.upper().replace("_", "X") if rule == "aws" else filling.replace("_", "x")
    out = []

    def put(before: str, value: str, after: str, kind: str, where: str | None, label: int) -> None:
        at = a + len(before)
        out.append((text[:a] + before + value + after + text[b:], (at, at + len(value), kind), where, label))

    doubt, place = str(rng.choice(DOUBTFUL[:8])), f"{rng.choice(['docs', 'tests', 'src/test', 'examples'])}/{rng.choice(['example', 'sample', 'test_keys', 'fixture'])}.md"
    dashed = f"xox{draw('abprs', 1)}-{draw(_ALL[52:], int(rng.integers(10, 13)))}-{draw(_ALL[52:], int(rng.integers(10, 13)))}-{draw(_ALL, int(rng.integers(12, 25)))}"
    real = dashed if rule == "slack" and rng.random() < 0.5 else head + draw(letters, size)
    lead, tail = str(rng.choice([f"{doubt} only: ", f"a {doubt} key ", f"# {doubt}\n"])), str(rng.choice(["", " "]))
    put("", head + filling, "", rule, path, 0)
    put("", head + filling, "", rule, place, 0)
    put(lead, real, tail, rule, place, 0)
    put(lead, real, tail, rule, path, 1)
    put("", real, "", rule, place, 1)
    put(f"{rng.choice(NAMES)} = ", real, "\n", rule, place, 1)
    named = str(rng.choice(NAMES))
    put(f"{named} = '", real, "'", rule, path, 1)
    put(f"{named}: ", draw(_HEX, 40), "", "assigned", path, 1)
    told = str(rng.choice(DIGESTS))
    put(f"{told} ", draw(_HEX, int(rng.choice([32, 40, 64]))), " ", "long", path, 0)
    put(f"{told}: ", draw(_HEX, int(rng.choice([32, 40, 64]))), "", "long", place, 0)
    put("", "-".join(draw(_HEX, n) for n in (8, 4, 4, 4, 12)), "", "long", path, 0)
    return out


_LABELLED = "key long, text string, a int, b int, rule string, path string, y int"


def _teach(found: Iterator[tuple[str, Candidate, str | None, int]], seed: int) -> list[tuple]:
    """Labelled findings as rows that hold what ``describe`` looks at: the value and _NEAR characters on both sides."""
    out = []
    for i, (text, (a, b, rule), path, y) in enumerate(found):
        lo = max(0, a - _NEAR)
        out.append((zlib.crc32(f"{seed}:{i}".encode()) << 16 | i & 0xFFFF, text[lo : b + _NEAR], a - lo, b - lo, rule, path, y))
    return out


def ordinary(texts: DataFrame) -> tuple[set[str], dict[str, float]]:
    """Commonest words of all ``texts(text)`` and log-probabilities of a character after another; as many as the dictionary holds and as alphabets have pairs."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{Nl}\p{No}]+"), F.lit(0))).alias("word")
    counts = materialise(texts.select(words).groupBy("word").agg(F.count(F.lit(1)).alias("n")), "words")
    top = counts.orderBy(F.desc("n"), "word").limit(WORDS).collect()
    size = F.length("word")
    pairs = counts.where(size > 1).select("n", F.explode(F.transform(F.sequence(F.lit(1), size - 1), lambda i: F.col("word").substr(i, F.lit(2)))).alias("p"))
    found = {r.p: r.n for r in pairs.groupBy("p").agg(F.sum("n").alias("n")).collect()}
    return {r.word for r in top if len(r.word) > 2}, _logs(found)


def train(docs: DataFrame, text: str = "text", path: str = "source", findings: list | None = None) -> Model:
    """A forest from labelled findings, silver ones where none are given.

    All candidates of all texts teach, and the words of all texts give the dictionary and the character transitions; copies of a text count once
    among the findings. Of the rows only counts reach the driver. Without candidates every later one is taken for true.
    """
    spark = docs.sparkSession
    ship_package(spark)

    def holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, t, p in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = candidates(t)
                if found:
                    near = [(h, i, t[max(0, a - AROUND) : b + AROUND], min(a, AROUND), min(a, AROUND) + b - a, rule, p) for i, (a, b, rule) in enumerate(found)]
                    yield pa.RecordBatch.from_pylist([dict(zip(_HELD, r, strict=True)) for r in near], _HELD_SCHEMA)

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split(" ")[0] for c in _LABELLED.split(", ")]
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                seed = zlib.crc32(f"{r['h']}:{r['i']}".encode())
                rows += _teach(silver(r["near"], (r["a"], r["b"], r["rule"]), r["path"], np.random.default_rng(seed)), seed)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _LABELLED_TYPES, strict=True)], names=names)

    if findings is None:
        own = docs.where(F.col(text).rlike(TRIGGER)).select(F.xxhash64(text).alias("h"), F.col(text).alias("near"), F.col(path).cast("string").alias("path"))
        held = own.mapInArrow(holding, "h long, i int, near string, a int, b int, rule string, path string")
        once = held.groupBy("h", "i").agg(F.min(F.struct("near", "a", "b", "rule")).alias("c"), F.min("path").alias("path")).select("h", "i", "c.*", "path")
        rows = once.mapInArrow(labelled, _LABELLED)
    else:
        rows = spark.createDataFrame(_teach(findings, 0), _LABELLED)
    rows = materialise(rows, "findings")
    words, pairs = ordinary(docs.select(F.col(text).alias("text")))
    place = F.pmod(F.crc32(F.encode(F.split(F.lower(F.coalesce("path", F.lit(""))), "/")[0], "UTF-8")), F.lit(SLOTS)).alias("slot")
    seen = {r.slot: (r.n, r.k) for r in rows.groupBy(place).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("k")).collect()}
    total = sum(n for n, _ in seen.values())
    rate = sum(k for _, k in seen.values()) / max(1, total)
    known = Language(words, pairs, {s: (k + 5 * rate) / (n + 5) for s, (n, k) in seen.items()}, rate)
    shared = spark.sparkContext.broadcast(known)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [describe(r["text"], (r["a"], r["b"], r["rule"]), r["path"], shared.value) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(batch.num_columns - 1), pa.array(x, pa.list_(pa.float64()))], names=["key", "y", "x"])

    x = materialise(rows.mapInArrow(described, "key long, y int, x array<double>").repartition(total // ROWS + 1), "features")
    return Model(known, grow_all(x))


FINDINGS = "array<struct<start:int,end:int,rule:string,score:double>>"
_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("rule", pa.string()), ("score", pa.float64())]))


def scan(spark, model: Model, text: Column, path: Column) -> Column:
    """All candidates of each text with the forest's score (code points, end exclusive), in order of place.

    A null or empty text has none; a null path is an unknown one. Texts are read whole, whatever their length.
    """
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)  # some thousand words and a few dozen small trees

    @F.arrow_udf(FINDINGS)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, paths in batches:
            out = [shared.value.scan(t, p) if t else [] for t, p in zip(texts.to_pylist(), paths.to_pylist(), strict=True)]
            yield pa.array([[dict(zip(("start", "end", "rule", "score"), f, strict=True)) for f in found] for found in out], _TYPE)

    return run(F.when(text.rlike(TRIGGER), text), path.cast("string"))


def redact(spark, model: Model, text: Column, path: Column, threshold: float = THRESHOLD) -> Column:
    """Each text with its secrets replaced by a mask; null stays null, texts without secrets stay as they are."""
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, paths in batches:
            out = []
            for t, p in zip(texts.to_pylist(), paths.to_pylist(), strict=True):
                for a, b, _, score in reversed(shared.value.scan(t, p) if t else []):
                    if score >= threshold:
                        t = t[:a] + MASK + t[b:]
                out.append(t)
            yield pa.array(out, pa.string())

    return F.when(text.rlike(TRIGGER), run(F.when(text.rlike(TRIGGER), text), path.cast("string"))).otherwise(text)
