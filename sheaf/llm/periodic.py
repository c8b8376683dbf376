"""Periodic runs of words by maximal-pair enumeration.

A run with period q from word s, n words long, is the pair of equal stretches that start at s and s + q and are n - q words
long: they differ in the word before and in the word behind, so they are a maximal pair, at distance q. Of a maximal pair of
equal stretches of l words at distance d with l >= (e - 1) d, the l + d words from the first start on are a stretch with period
d, e times as long as d at least, that can't be extended. So maximal pairs whose distance satisfies the length constraints are exactly the runs;
pairs at a multiple of the smallest period give the same stretch again, and the smallest distance is kept.

Maximal pairs come from the LCP-interval tree, built bottom-up over the sorted suffixes: an interval of depth l holds, by the
word on their left, the sorted starts of its suffixes. Suffixes of two children of an interval agree in exactly l words, and with
different left words they are a maximal pair; the smaller child's starts are looked up in the larger child's other classes, within
the distance that l allows.

Only stretches in which every few words recur get suffixes, and of these only those where the gaps of recurrence leave room
for a run. Both tests are necessary conditions, so nothing is lost; a text without repeats is hashed and left.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from sheaf.session import ship_package

MIN_LENGTH = 6
MIN_EXPONENT = 4
_CHUNK_BYTES = 4_000_000  # texts worked off together; a longer text is a chunk of its own

FOUND = "struct<n_words:bigint,runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _depth(min_length: int, min_exponent: int) -> int:
    """Words in a row whose recurrence is looked at: the pair of a run shares as many at least, and the places where they recur leave no gap in it."""
    if min_length < 2 or min_exponent < 2:
        raise ValueError("a run has two words and two periods at least")
    shared = -(-min_length * (min_exponent - 1) // min_exponent)
    return min(shared, *(max(min_length, min_exponent * q) - 2 * q + 1 for q in range(1, min_length + 1)))


def _dense(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1].astype(np.int64)


def _suffixes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted suffixes and ranks of a text whose every repeat ends at a word of its own, by prefix doubling."""
    rank, step = _dense(text), 1
    while True:
        top = int(rank.max()) + 1
        behind = np.zeros(len(rank), np.int64)
        behind[:-step] = rank[step:] + 1
        if top == len(rank):
            order = np.empty(len(rank), np.int64)
            order[rank] = np.arange(len(rank))
            return order, rank
        rank = _dense(rank * (top + 1) + behind)
        step *= 2


def _common(text: list[int], order: list[int], rank: list[int]) -> list[int]:
    """Words that each sorted suffix shares with the one before it."""
    lcp, h = [0] * len(text), 0
    for i, r in enumerate(rank):
        if r == 0:
            h = 0
            continue
        j = order[r - 1]
        while text[i + h] == text[j + h]:
            h += 1
        lcp[r] = h
        if h:
            h -= 1
    return lcp


def _maximal_pairs(text: np.ndarray, left: np.ndarray, depth: int, min_exponent: int) -> Iterator[tuple[int, int, int]]:
    """``(start, distance, shared words)`` of maximal pairs of at least ``depth`` words, near enough for a run.

    ``left`` is the word before each position, -1 where there is none.
    """
    order, rank = _suffixes(text)
    order_of, lefts = order.tolist(), left.tolist()
    lcp = _common(text.tolist(), order_of, rank.tolist())
    found: list[tuple[int, int, int]] = []

    def join(a: tuple[int, dict[int, list[int]]], b: tuple[int, dict[int, list[int]]], shared: int) -> tuple[int, dict[int, list[int]]]:
        """Pairs between two children of an interval; their classes together."""
        if a[0] < b[0]:
            a, b = b, a
        reach = shared // (min_exponent - 1)
        classes = a[1]
        for word, starts in b[1].items():
            for other, there in classes.items():
                if other == word or there[-1] < starts[0] - reach or there[0] > starts[-1] + reach:
                    continue
                for p in starts:
                    at = bisect_left(there, p - reach)
                    while at < len(there) and there[at] <= p + reach:
                        found.append((min(p, there[at]), abs(p - there[at]), shared))
                        at += 1
        for word, starts in b[1].items():
            mine = classes.get(word)
            if mine is None:
                classes[word] = starts
            elif mine[-1] < starts[0]:
                mine += starts
            else:
                for p in starts:
                    insort(mine, p)
        return a[0] + b[0], classes

    stack: list[tuple[int, tuple[int, dict[int, list[int]]]]] = []
    here = (0, {})
    for place, start in enumerate(order_of):
        shared = lcp[place]
        if place:
            while stack and stack[-1][0] > shared:
                here = join(stack[-1][1], here, stack.pop()[0])
            if shared >= depth:
                if stack and stack[-1][0] == shared:
                    stack[-1] = (shared, join(stack[-1][1], here, shared))
                else:
                    stack.append((shared, here))
        here = (1, {lefts[start]: [start]})
        if len(found) > 4096:
            yield from found
            found.clear()
    while stack:
        here = join(stack[-1][1], here, stack.pop()[0])
    yield from found


def _repeating(words: np.ndarray, ends: np.ndarray, depth: int, min_exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last+1 position of stretches that may hold a run, with the words behind that end their repeats.

    ``words`` are texts in a row, ``ends`` their ends. Every ``depth`` words of a run recur inside it at its period or nearer, for
    ``(e - 1) q - depth + 1`` starts in a row at least.
    """
    n = len(words)
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    valid = np.arange(n) + depth <= ends[text] if n else np.zeros(0, bool)
    mixed = words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    key = np.zeros(n, np.uint64)
    for i in range(depth):  # clashes only keep a stretch too many
        key *= np.uint64(0xBF58476D1CE4E5B9)
        key[: max(0, n - i)] += mixed[i:]
    key += text.astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    at = np.flatnonzero(valid)
    order = at[np.argsort(key[at], kind="stable")]
    same = key[order[1:]] == key[order[:-1]]
    gap = np.zeros(n, np.int64)  # to the next place with the same words; 0: none
    gap[order[:-1][same]] = (order[1:] - order[:-1])[same]
    recurs = gap > 0
    recurs[order[1:][same]] = True
    stop = np.where(gap > 0, n, np.arange(n))
    room = np.minimum.accumulate(stop[::-1])[::-1] - np.arange(n)
    hopeful = (gap > 0) & (room >= np.maximum(1, (min_exponent - 1) * gap - depth + 1))
    edges = np.diff(np.concatenate([[0], recurs.astype(np.int8), [0]]))
    first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    hopes = np.concatenate([[0], np.cumsum(hopeful)])
    kept = hopes[last] > hopes[first]
    first, last = first[kept], last[kept]
    return first, np.minimum(last + depth, ends[text[first]] if len(first) else last)


def find_runs(words: np.ndarray, ends: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and smallest periods of all runs of several texts, by start and period.

    ``words`` are the word numbers of the texts in a row, ``ends`` the ends of the texts; starts count from the first text on.
    """
    depth = _depth(min_length, min_exponent)
    first, last = _repeating(words, ends, depth, min_exponent)
    none = np.empty(0, np.int64)
    if not len(first):
        return none, none, none
    begins = np.concatenate([[0], ends])
    sizes = last - first + 1  # with a word of its own at the end
    stretch = np.repeat(np.arange(len(first)), sizes)
    inside = np.arange(len(stretch)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = first[stretch] + inside
    closing = inside == sizes[stretch] - 1
    known = int(words.max()) + 1
    text = stretch * (known + 1) + np.where(closing, known, words[np.minimum(place, len(words) - 1)])
    left = np.where(np.isin(place, begins), -1, words[np.maximum(place, 1) - 1])
    runs: dict[tuple[int, int], int] = {}
    for start, distance, shared in _maximal_pairs(_dense(text), left, depth, min_exponent):
        if distance * (min_exponent - 1) <= shared and shared + distance >= min_length:
            key = (int(place[start]), shared + distance)
            runs[key] = min(distance, runs.get(key, distance))
    rows = sorted((s, q, n) for (s, n), q in runs.items())
    s, q, n = np.array(rows, np.int64).reshape(-1, 3).T
    return s, n, q


def _scan(texts: list[bytes], min_length: int, min_exponent: int) -> pa.StructArray:
    split = [t.split() for t in texts]  # bytes split at space and at 9 to 13
    numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    ends = np.cumsum(sizes)
    words = np.fromiter((numbers[w] for ws in split for w in ws), np.int64, int(ends[-1]) if len(ends) else 0)
    start, length, period = find_runs(words, ends, min_length, min_exponent) if len(words) else (np.empty(0, np.int64),) * 3
    owner = np.searchsorted(ends, start, "right")
    edge = np.searchsorted(owner, np.arange(len(split) + 1))
    collapsed = []
    for i, ws in enumerate(split):
        lo, hi = edge[i], edge[i + 1]
        if lo < hi:
            begin = int(ends[i] - sizes[i])
            change = np.zeros(len(ws) + 1, np.int64)
            np.add.at(change, start[lo:hi] + period[lo:hi] - begin, 1)
            np.add.at(change, start[lo:hi] + length[lo:hi] - begin, -1)
            ws = [ws[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
        collapsed.append(b" ".join(ws))
    inner = start - (ends - sizes)[owner] if len(start) else start
    runs = pa.StructArray.from_arrays([pa.array(inner), pa.array(length), pa.array(period)], fields=list(_RUN))
    lists = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), runs)
    out = [pa.array(sizes), lists, pa.array(collapsed, pa.binary()).cast(pa.string())]
    return pa.StructArray.from_arrays(out, names=["n_words", "runs", "collapsed"])


def scan(spark: SparkSession, text: Column, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> Column:
    """A struct ``(n_words, runs, collapsed)`` for each text.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. ``runs (start, length, period)``, by start and then period, are all stretches with
    smallest period q of at least ``min_length`` words and ``min_exponent`` periods that no neighbouring word extends.
    ``collapsed`` holds the words that no run contains behind its first period, joined by one space.

    A null text counts as empty, one without words gives no run and an empty ``collapsed``. Texts are read whole, whatever their length, and row by
    row: repeated rows give repeated results, other columns aren't looked at, an empty table gives no rows. A task holds
    a few MB of texts at a time, or one text that is longer, with its suffixes.
    """
    ship_package(spark)
    _depth(min_length, min_exponent)

    @F.arrow_udf(FOUND)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out, held, size = [], [], 0
            for t in batch.cast(pa.binary()):
                held.append(t.as_py() or b"")
                size += len(held[-1])
                if size > _CHUNK_BYTES:
                    out.append(_scan(held, min_length, min_exponent))
                    held, size = [], 0
            if held or not out:
                out.append(_scan(held, min_length, min_exponent))
            yield pa.concat_arrays(out)

    return run(text)
