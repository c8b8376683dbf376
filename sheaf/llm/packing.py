"""Hierarchical packing of documents into windows of several lengths.

A document is tokenised and cut into full windows of the longest tier; what is left over is routed
to the shortest tier that holds it. Each tier packs its own pieces: a piece opens a window of the
tier's length, and the gap behind it is filled from shorter tiers, the largest piece that fits
first, with a cut only where no whole piece fits. Closed windows are dealt to step groups so that
all groups of a block carry about the same attention cost.

Packing needs no order across documents, so each task packs the documents of its own split in one
pass: nothing is shuffled, ids are never stored, and a lost task is simply run again on the same
split. A task holds at most ``pool`` left-over pieces per tier and one document.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.session import ship_package

TIERS = (256, 512, 1024, 2048)
POOL = 512  # left-over pieces that a tier keeps before it packs them
STEP_GROUPS = 8  # groups that a block of closed windows is dealt to
STEP_WINDOWS = 64  # closed windows per block
SPECIAL = {"<|endoftext|>": 50256}  # fixed values: the special tokens of the vocabulary
END_OF_TEXT = 1  # fixed value: the id behind each document
_WORDS = 400_000  # chunks whose ids a worker remembers
_WIDE_GAP = re.compile(r" (?:\s|\Z)")
_ID = np.dtype("<u4")

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long, ids binary"


class Encoder(dict):
    """Ids of space-separated chunks, as little-endian bytes, remembered per worker.

    The byte-level pattern never lets a piece run across a single space that stands before a
    non-space character, so such chunks can be encoded one by one and joined. Texts with other
    spacing, and those that hold the name of a special token, are encoded whole.
    """

    def __init__(self, ranks_name: str, special: dict[str, int]):
        import base64

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(ranks_name), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.model = tiktoken.Encoding("pack", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")

    def plain(self, text: str) -> bytes:
        return np.asarray(self.model.encode_ordinary(text), dtype=_ID).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        ids = self.plain(" " + chunk)
        if len(chunk) <= 40:
            if len(self) >= _WORDS:
                self.clear()
            self[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if self.special.search(text):
            return np.asarray(self.model.encode(text, allowed_special="all"), dtype=_ID).tobytes()
        if _WIDE_GAP.search(text):
            return self.plain(text)
        first, *rest = text.split(" ")
        return self.plain(first) + b"".join(map(self.__getitem__, rest))


_ENCODERS: dict[str, Encoder] = {}


def encoder(ranks_name: str) -> Encoder:
    if ranks_name not in _ENCODERS:
        _ENCODERS[ranks_name] = Encoder(ranks_name, SPECIAL)
    return _ENCODERS[ranks_name]


@dataclass(slots=True)
class Piece:
    doc_id: int | None
    start: int
    ids: bytes | memoryview  # a view, so that cutting copies nothing
    doc_tokens: int

    def __len__(self) -> int:
        return len(self.ids) // 4

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return (
            Piece(self.doc_id, self.start, self.ids[: 4 * n], self.doc_tokens),
            Piece(self.doc_id, self.start + n, self.ids[4 * n :], self.doc_tokens),
        )


@dataclass
class Packer:
    tiers: tuple[int, ...] = TIERS
    pool: int = POOL
    waiting: list[list[Piece]] = field(default_factory=list)  # by tier, shortest first
    closed: list[tuple[int, list[Piece]]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.waiting = [[] for _ in self.tiers]

    def tier_of(self, n: int) -> int:
        return next(t for t, cap in enumerate(self.tiers) if n <= cap)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        longest = self.tiers[-1]
        rest = Piece(doc_id, 0, memoryview(ids), len(ids) // 4)
        while len(rest) >= longest:
            full, rest = rest.cut(longest)
            self.closed.append((longest, [full]))
        if len(rest):
            rest.ids = bytes(rest.ids)  # what waits holds no whole document
            self.route(rest)

    def route(self, piece: Piece) -> None:
        t = self.tier_of(len(piece))
        self.waiting[t].append(piece)
        if len(self.waiting[t]) >= self.pool:
            self.pack(t)

    def pack(self, t: int) -> None:
        """Windows of tier ``t`` from all its pieces, gaps filled from the shorter tiers."""
        own = sorted(self.waiting[t], key=len)
        self.waiting[t] = []
        shorter = [sorted(pieces, key=len) for pieces in self.waiting[:t]]
        while own:
            window = [own.pop()]
            gap = self.tiers[t] - len(window[0])
            while gap:
                piece = self.filler(shorter, own, gap)
                if piece is None:
                    break
                if len(piece) > gap:
                    piece, rest = piece.cut(gap)
                    home = self.tier_of(len(rest))
                    insort(own if home == t else shorter[home], rest, key=len)
                window.append(piece)
                gap -= len(piece)
            if gap:  # nothing is left to fill with: it waits for later pieces
                self.waiting[t].extend(window)
                break
            self.closed.append((self.tiers[t], window))
        self.waiting[t].extend(own)
        for k, pieces in enumerate(shorter):
            self.waiting[k] = pieces

    @staticmethod
    def filler(shorter: list[list[Piece]], own: list[Piece], gap: int) -> Piece | None:
        """The largest piece that fits, from the highest shorter tier that has one; else one to cut."""
        for pieces in (*reversed(shorter), own):
            fitting = bisect_right(pieces, gap, key=len)
            if fitting:
                return pieces.pop(fitting - 1)
        for pieces in (*shorter, own):
            if pieces:
                return pieces.pop(0)
        return None

    def finish(self) -> None:
        """Close what still waits: its ids fill whole windows, then windows at powers of two."""
        rest = [p for pieces in reversed(self.waiting) for p in pieces]
        self.waiting = [[] for _ in self.tiers]
        total, size = sum(map(len, rest)), self.tiers[-1]
        while total:
            while size > total:
                size //= 2
            window, gap = [], size
            while gap:
                piece = rest.pop()
                if len(piece) > gap:
                    piece, tail = piece.cut(gap)
                    rest.append(tail)
                window.append(piece)
                gap -= len(piece)
            self.closed.append((size, window))
            total -= size


def step_groups(windows: list[tuple[int, list[Piece]]], groups: int) -> list[int]:
    """A group for each window: dearest first, always to the group with the least attention cost so far."""
    load = [0] * groups
    chosen = [0] * len(windows)
    for i in sorted(range(len(windows)), key=lambda i: (-sum(len(p) ** 2 for p in windows[i][1]), i)):
        chosen[i] = min(range(groups), key=lambda g: (load[g], g))
        load[chosen[i]] += sum(len(p) ** 2 for p in windows[i][1])
    return chosen


def pack(
    docs: DataFrame,
    tiers: tuple[int, ...] = TIERS,
    pool: int = POOL,
    groups: int = STEP_GROUPS,
    ranks: str = "byte_bpe_50k.tiktoken",
    with_ids: bool = True,
) -> DataFrame:
    """Pieces of all documents ``(doc_id, text)``, packed into windows of the given tiers.

    One row per piece: ``doc_id``, ``start`` and ``length`` in the document's ids, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id``, ``offset`` in the window, ``tier`` (the window's length), ``step_group`` and, if ``with_ids``, the
    ids (little-endian, 4 bytes each). Tiers are powers of two; each window is full, and what is left over at the end of
    a split becomes windows at smaller powers of two, so nothing is padded. ``ranks`` names the vocabulary, in the
    tokenizers' package.

    The name of a special token in a text is that token, as the tokenizer's own call has it.
    A null or empty text is a document of one id, the closing one. A null ``doc_id`` is kept as null. Repeated rows
    are packed each for itself. Other columns are not looked at. An empty table gives no rows.
    """
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers)):
        raise ValueError("tiers must be rising powers of two")
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks).encode
        packer = Packer(tiers, pool)
        base, number, block = TaskContext.get().partitionId() << 40, 0, 0
        end = np.asarray([END_OF_TEXT], dtype=_ID).tobytes()

        def rows(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal number, block
            while len(packer.closed) >= max(least, 1):
                windows, packer.closed = packer.closed[:STEP_WINDOWS], packer.closed[STEP_WINDOWS:]
                out: list[tuple] = []
                for (size, pieces), group in zip(windows, step_groups(windows, groups), strict=True):
                    offset = 0
                    for p in pieces:
                        ids = bytes(p.ids) if with_ids else None
                        out.append((p.doc_id, p.start, len(p), zlib.crc32(p.ids), p.doc_tokens, base + number, offset, size, base + block * groups + group, ids))
                        offset += len(p)
                    number += 1
                block += 1
                names = [x.split()[0] for x in SCHEMA.split(", ")]
                types = [pa.int64()] * 7 + [pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(doc_id, encode(text.as_py() or "") + end)
                yield from rows(STEP_WINDOWS)
        packer.finish()
        yield from rows(1)

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
    return found if with_ids else found.drop("ids")
