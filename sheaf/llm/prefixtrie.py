"""Prefix trie of conversations by time-forward processing.

A node is a distinct sequence of first turns. Its totals need those of the nodes below, which are sent forward to it: nodes are
sorted by reverse level order, deepest first, and each passes its subtree's totals to its parent through a priority queue that
hands them out when the parent's turn comes. Both the sort and the queue spill, so a task's memory is bounded.

The trie is dealt to shards. A node's weight is the number of turns at or below it over all different conversations, an upper bound of
its subtree's nodes that one grouped count gives. Whole subtrees of at most ``shard_rows`` are shards ("light"). What lies above
is cut into paths: the nodes with one smallest member are a path, and every ``BAND`` levels of it are a shard. Light
shards run first; their roots' totals go to their parents. Then the paths, each summed up to one node, run as a trie of shard
roots, and last each path runs with what its lower ends have got. Equal conversations are folded before all that, and a hot
turn or conversation is one node with partial counts.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.ordered import running
from sheaf.session import materialise, ship_package

BAND = 256  # levels of a path above the light subtrees that one shard holds
MOST_ROWS = 50_000  # nodes of a light subtree
LEAST_ROWS = 64
QUEUE_ROWS = 100_000  # messages that a queue keeps in memory
IDS_PER_CHUNK = 4096
_TOP = -(1 << 62)

_ROWS = "p1 long, p2 long, level long, a long, b long, up_level long, up_a long, up_b long, own long, children long, leaves long, saved long"
_DONE = "a long, b long, n_children long, n_leaves long, saved_tokens long"


class SpillingQueue:
    """Smallest item first; beyond ``limit`` items the larger half goes to a sorted run in a file of this task, gone with it."""

    def __init__(self, limit: int = QUEUE_ROWS) -> None:
        self.limit, self.heap, self.runs = max(2, limit), [], []

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.limit:
            rows = sorted(self.heap)
            self.heap, rest = rows[: self.limit // 2], rows[self.limit // 2 :]
            out = tempfile.TemporaryFile()
            for lo in range(0, len(rest), 1024):
                pickle.dump(rest[lo : lo + 1024], out)
            out.seek(0)
            self._next(self._read(out))

    @staticmethod
    def _read(file) -> Iterator[tuple]:
        with file:
            while True:
                try:
                    block = pickle.load(file)
                except EOFError:
                    return
                yield from block

    def _next(self, run: Iterator[tuple]) -> None:
        item = next(run, None)
        if item is not None:
            heapq.heappush(self.runs, (item, id(run), run))

    def head(self) -> tuple | None:
        low = [x for x in (self.heap[:1], [r[0] for r in self.runs[:1]]) if x]
        return min(x[0] for x in low) if low else None

    def pop(self) -> tuple:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            item, _, run = heapq.heappop(self.runs)
            self._next(run)
            return item
        return heapq.heappop(self.heap)


def forward(queue_rows: int = QUEUE_ROWS):
    """Totals of sorted shards ``(p1, p2, level descending, a, b)``; what leaves a shard is dropped, its root's row tells it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = SpillingQueue(queue_rows)
        for batch in batches:
            out = []
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            for p1, p2, level, a, b, up_level, up_a, up_b, own, children, leaves, saved in rows:
                here = (p1, p2, -level, a, b)
                while (head := queue.head()) is not None and head[:5] <= here:
                    message = queue.pop()
                    if message[:5] == here:
                        children += 1
                        leaves += message[5]
                        saved += message[6]
                if not children:
                    leaves = 1
                saved += own
                out.append((a, b, children, leaves, saved))
                if up_a is not None:
                    queue.push((p1, p2, -up_level, up_a, up_b, leaves, saved))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "n_children", "n_leaves", "saved_tokens"])

    return run


def _run(rows: DataFrame, queue_rows: int, label: str, one: bool = False) -> DataFrame:
    rows = rows.select(*(c.split()[0] for c in _ROWS.split(", ")))
    dealt = rows.coalesce(1) if one else rows.repartition("p1", "p2")
    dealt = dealt.sortWithinPartitions("p1", "p2", F.desc("level"), "a", "b")
    return materialise(dealt.mapInArrow(forward(queue_rows), _DONE), label)


def digests(turns: DataFrame, order: str = "turn") -> DataFrame:
    """``(conv_id, <order>, hi, lo, words)`` of turns ``(conv_id, <order>, role, text)``: 128 bits of SHA-256 in place of role and text.

    A null role or text counts as empty. Rows without conv_id belong to no conversation and are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    sha = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    part = lambda at: F.conv(F.substring("sha", at, 16), 16, -10).cast("long")
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words")
    found = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), order, words, sha.alias("sha"))
    return found.select("conv_id", order, part(1).alias("hi"), part(17).alias("lo"), "words")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ``(a, b, conv_id)`` to rows of up to IDS_PER_CHUNK ids, joined by commas."""
    for batch in batches:
        a, b, ids = (batch.column(c).to_numpy() for c in ("a", "b", "conv_id"))
        if not len(ids):
            continue
        edge = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
        firsts = [range(lo, hi, IDS_PER_CHUNK) for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), len(ids)], strict=True)]
        cuts = [*chain.from_iterable(firsts), len(ids)]
        at, text = np.array(cuts[:-1]), list(map(str, ids.tolist()))
        joined = [",".join(text[lo:hi]) for lo, hi in zip(cuts, cuts[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([pa.array(a[at]), pa.array(b[at]), pa.array(ids[at]), pa.array(joined)], names=["a", "b", "conv_id", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash for each ``(a, b)`` of sorted chunks, fed chunk by chunk."""
    last, sha = None, None
    for batch in batches:
        out = []
        for a, b, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (a, b) != last:
                if last is not None:
                    out.append((*last, sha.hexdigest()))
                last, sha = (a, b), hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        yield _ends(out)
    if last is not None:
        yield _ends([(*last, sha.hexdigest())])


def _ends(rows: list[tuple]) -> pa.RecordBatch:
    a, b, sha = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sha, pa.string())], names=["a", "b", "ends_sha256"])


def _end_hashes(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ids ``conv_id`` that end at each node, ascending. A hash goes over its ids in one task, as chunks that many tasks have made."""
    dealt = ends.repartitionByRange("a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id")
    chunks = dealt.mapInArrow(_chunks, "a long, b long, conv_id long, ids string")
    return chunks.repartition("a", "b").sortWithinPartitions("a", "b", "conv_id").mapInArrow(_hashed, "a long, b long, ends_sha256 string")


def nodes(turns: DataFrame, members: DataFrame, shard_rows: int | None = None, band: int = BAND, queue_rows: int = QUEUE_ROWS) -> DataFrame:
    """One row for each node of the trie of conversations ``turns (conv_id, place, hi, lo, words)``, ordered by ``place``.

    ``members (conv_id)`` names all conversations once, turnless ones included. Columns of the result:
    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null for the root), ``n_convs`` (members), ``n_children``,
    ``n_leaves`` (childless nodes of the subtree), ``saved_tokens`` (over the subtree, members but one times words of the last turn) and
    ``ends_sha256`` (of the members that end here, ascending, comma-joined). The last turn of a node is turn ``depth`` of its ``conv_id``. No
    members give no node, not even a root.

    ``shard_rows`` bounds the nodes of a light shard; by default a quarter of a partition's share, within bounds.
    """
    spark = turns.sparkSession
    ship_package(spark)
    zero = F.lit(0).cast("long")
    roots = members.select("conv_id", F.lit(_TOP).cast("long").alias("place"), zero.alias("hi"), zero.alias("lo"), zero.alias("words"))
    rows = running(turns.select(*roots.columns).unionByName(roots), "conv_id", ["place", "hi", "lo"], ("hi", "lo"))
    rows = rows.select("conv_id", "n", "words", F.col("at_hi").alias("a"), F.col("at_lo").alias("b"), F.col("to_hi").alias("up_a"), F.col("to_lo").alias("up_b"))
    rows = materialise(rows, "trie-rows")
    ends = rows.groupBy("conv_id").agg(F.max("n").alias("length"), F.max_by("a", "n").alias("a"), F.max_by("b", "n").alias("b"))
    ends = materialise(ends, "trie-ends")
    whole = ends.groupBy("a", "b").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"), F.max("length").alias("length"))
    whole = materialise(whole.select("conv_id", "copies", "length"), "trie-folded")
    different = materialise(rows.join(whole, "conv_id"), "trie-different")
    below = F.col("length") - F.col("n") + 1
    every = different.groupBy("a", "b").agg(
        F.max("n").alias("depth"),
        F.max("up_a").alias("up_a"),
        F.max("up_b").alias("up_b"),
        F.max("words").alias("words"),
        F.min("conv_id").alias("conv_id"),
        F.sum("copies").alias("n_convs"),
        F.sum(below).alias("weight"),
    )
    root = F.col("depth") == 0
    every = every.withColumns({"up_a": F.when(~root, F.col("up_a")), "up_b": F.when(~root, F.col("up_b")), "own": (F.col("n_convs") - 1) * F.col("words")})
    every = materialise(every, "trie-nodes")
    if shard_rows is None:
        total = whole.agg(F.coalesce(F.sum(F.col("length") + 1), F.lit(0))).first()[0]
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        shard_rows = max(LEAST_ROWS, min(MOST_ROWS, total // (4 * parts)))

    # Weights only fall along a conversation, so its heavy nodes are the first ones.
    heavy = materialise(every.where(F.col("weight") > shard_rows), "trie-heavy")
    climbed = different.join(heavy.select("a", "b"), ["a", "b"], "left_semi").groupBy("conv_id").agg(F.count(F.lit(1)).alias("heavy"))
    tops = different.select("conv_id", "n", "a", "b").join(climbed, "conv_id", "left").where(F.col("n") == F.coalesce("heavy", F.lit(0)))
    tops = tops.select("conv_id", F.col("a").alias("p1"), F.col("b").alias("p2"))
    level = [F.col("depth").alias("level"), "a", "b", (F.col("depth") - 1).alias("up_level"), "up_a", "up_b", "own"]
    none = [zero.alias(c) for c in ("children", "leaves", "saved")]
    light = every.where(F.col("weight") <= shard_rows).join(tops, "conv_id").select("p1", "p2", *level, *none)
    light_done = _run(light, queue_rows, "trie-light")

    # Messages to the nodes above.
    from_below = lambda at: [F.col(at + "up_a").alias("a"), F.col(at + "up_b").alias("b")]
    light_roots = tops.select(F.col("p1").alias("a"), F.col("p2").alias("b")).distinct()
    sent = light_done.join(light_roots, ["a", "b"]).join(every.select("a", "b", "up_a", "up_b"), ["a", "b"])
    sent = sent.where(F.col("up_a").isNotNull()).select(*from_below(""), F.lit(1).alias("children"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    sums = [F.sum(c).alias(c) for c in ("children", "leaves", "saved")]
    sent = materialise(sent.groupBy("a", "b").agg(*sums), "trie-sent")

    # Paths above the light subtrees, each as one node of a trie of shard roots.
    paths = heavy.withColumns({"p1": F.col("conv_id"), "p2": F.floor(F.col("depth") / band)})
    hung = paths.join(sent, ["a", "b"], "left").fillna(0, ["children", "leaves", "saved"])
    folded = hung.groupBy("p1", "p2").agg(
        F.min("depth").alias("level"), F.min_by("up_a", "depth").alias("up_a"), F.min_by("up_b", "depth").alias("up_b"), F.sum("own").alias("own"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")
    )
    folded = materialise(folded, "trie-paths")
    owner = paths.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("p1").alias("q1"), F.col("p2").alias("q2"))
    owner = owner.join(folded.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("level").alias("up_level")), ["q1", "q2"])
    upper = folded.join(owner, ["up_a", "up_b"], "left").select(
        zero.alias("p1"), zero.alias("p2"), "level", F.col("p1").alias("a"), F.col("p2").alias("b"), "up_level", F.col("q1").alias("up_a"), F.col("q2").alias("up_b"), "own", F.lit(1).cast("long").alias("children"), "leaves", "saved"
    )
    upper_done = _run(upper, queue_rows, "trie-roots", one=True).select(F.col("a").alias("p1"), F.col("b").alias("p2"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    handed = folded.select("p1", "p2", "up_a", "up_b").join(upper_done, ["p1", "p2"]).where(F.col("up_a").isNotNull())
    handed = handed.select(*from_below(""), F.lit(1).alias("children"), "leaves", "saved")
    got = sent.unionByName(handed).groupBy("a", "b").agg(*sums)
    last = paths.join(got, ["a", "b"], "left").fillna(0, ["children", "leaves", "saved"]).select("p1", "p2", *level, "children", "leaves", "saved")
    heavy_done = _run(last, queue_rows, "trie-heavy-done")

    parents = every.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"))
    found = every.join(light_done.unionByName(heavy_done), ["a", "b"]).join(_end_hashes(ends.select("a", "b", "conv_id")), ["a", "b"], "left")
    return found.join(parents, ["up_a", "up_b"], "left").select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def trie(conversations: DataFrame, **settings: int) -> DataFrame:
    """``nodes`` of conversations ``(conv_id, turn, role, text)`` as they are, by turn (null first; ties by content).

    Null roles and texts count as empty, rows without conv_id are left out, repeated rows are turns of their own. Extra
    columns aren't looked at. An empty table gives no node.
    """
    turns = running(digests(conversations), "conv_id", ["turn", "hi", "lo"]).withColumnRenamed("n", "place")
    turns = materialise(turns, "trie-turns")
    return nodes(turns, turns.where("place = 0").select("conv_id"), **settings)
