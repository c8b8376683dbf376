"""n-grams of token lists, counted document by document in slices of bounded size.

A slice is a few documents with all their tokens. What it says of a term is one row, however many of its documents have the term, so
that a common term takes as many rows as there are slices, and no task keeps the terms of more than one slice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_TOKENS = 1 << 18


class Postings:
    """Different n-grams of each document of a slice, with count and first place; in the same order for the same documents.

    ``doc`` numbers documents from 0 (rows with the same keys are one document, whose lists are counted side by side), ``code``
    numbers the n-grams of the slice, ``tf`` and ``i`` are count and first place within a list, ``n`` is the length.
    """

    def __init__(self, table: pa.Table, keys: Sequence[str], tokens: str, max_n: int) -> None:
        self.first = first_rows(table, keys)
        owner = np.cumsum(self.first) - 1
        lists = table[tokens].combine_chunks()
        lengths = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
        words = lists.flatten().dictionary_encode()
        order = pc.array_sort_indices(words.dictionary)
        self._words = words.dictionary.take(order)
        rank = np.empty(len(order), np.int64)
        rank[np.asarray(order)] = np.arange(len(order))
        known = np.asarray(words.indices.is_valid())
        self._at = rank[np.asarray(pc.fill_null(words.indices, 0))] if len(rank) else np.zeros(len(words), np.int64)
        doc = np.repeat(owner, lengths)
        ends = np.repeat(np.cumsum(lengths), lengths)
        place = np.arange(len(doc))
        begins = np.repeat(np.cumsum(lengths) - lengths, lengths)
        parts, codes, base = [], None, 0
        for n in range(1, max_n + 1):
            here = place[place + n <= ends]
            for k in range(n if not known.all() else 0):
                here = here[known[here + k]]
            if n == 1:
                code = self._at[here]
                size = len(rank)
            else:
                code, size = _dense(codes[here] * max(len(rank), 1) + self._at[here + n - 1])
            codes = np.zeros(len(doc), np.int64)
            codes[here] = code
            key, at, tf = np.unique(doc[here] * max(size, 1) + code, return_index=True, return_counts=True)
            pos = here[at]
            parts.append((key // max(size, 1), key % max(size, 1) + base, tf, pos - begins[pos], pos, np.full(len(pos), n)))
            base += size
        self.doc, self.code, self.tf, self.i, self._pos, self.n = (np.concatenate(c) for c in zip(*parts, strict=True))
        self.codes = base

    def terms(self, at: np.ndarray) -> pa.Array:
        """The n-grams at some places of the postings, whose ``n`` does not fall."""
        out = []
        for n in np.unique(self.n[at]).tolist():
            pos = self._pos[at[self.n[at] == n]]
            words = [self._words.take(pa.array(self._at[pos + k])) for k in range(n)]
            out.append(pc.binary_join_element_wise(*words, " ") if n > 1 else words[0])
        return pa.concat_arrays(out) if out else pa.array([], pa.string())

    def hashes(self, at: np.ndarray) -> np.ndarray:
        """64 bits for each of the n-grams at some places of the postings, the same in all processes."""
        each = [int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little") for w in self._words.to_pylist()]
        word = np.array(each, np.uint64)
        out, pos, n = np.zeros(len(at), np.uint64), self._pos[at], self.n[at]
        for k in range(int(n.max(initial=0))):
            here = n > k
            h = (out[here] + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9) + word[self._at[pos[here] + k]]
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
            out[here] = h ^ (h >> np.uint64(31))
        return out

    def grouped(self, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Postings by (group of the document, n-gram): their order, where each of them begins in it, and how many they are."""
        key = self.code if group is None else self.code * (int(group.max(initial=0)) + 1) + group[self.doc]
        order = np.argsort(key, kind="stable")
        _, begin, size = np.unique(key[order], return_index=True, return_counts=True)
        return order, begin, size


def _dense(keys: np.ndarray) -> tuple[np.ndarray, int]:
    values, code = np.unique(keys, return_inverse=True)
    return code, len(values)


def first_rows(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Which rows of a sorted table differ from the row before by one of the keys."""
    new = np.ones(len(table), bool)
    if len(table) > 1:
        differs = np.zeros(len(table) - 1, bool)
        for k in keys:
            c = table[k].combine_chunks()
            a, b = c[:-1], c[1:]
            same = pc.or_kleene(pc.equal(a, b), pc.and_(a.is_null(), b.is_null()))
            differs |= ~np.asarray(pc.fill_null(same, False))
        new[1:] = differs
    return new


def slices(batches: Iterator[pa.RecordBatch], keys: Sequence[str], tokens: str, bound: int = SLICE_TOKENS) -> Iterator[pa.Table]:
    """Tables of whole documents, sorted by ``keys``, that end with the document in which ``bound`` tokens are reached."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        while True:
            upto = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(held[tokens].combine_chunks()), 0)))
            if not len(upto) or upto[-1] < bound:
                break
            later = np.flatnonzero(first_rows(held, keys))
            later = later[later > np.searchsorted(upto, bound)]
            if not len(later):
                break
            yield held.slice(0, later[0])
            held = held.slice(later[0])
    if held is not None and len(held):
        yield held


def listed(values: pa.Array, sizes: np.ndarray) -> pa.Array:
    """Neighbouring values as lists of the given sizes."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


def emitted(table: pa.Table, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """A table as batches of bounded size."""
    yield from table.combine_chunks().to_batches(max_chunksize=rows)
