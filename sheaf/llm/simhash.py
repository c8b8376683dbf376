"""SimHash fingerprints and their near-duplicates by a binary trie self-join.

The distinct fingerprints form a binary trie. Two nodes of equal depth are traversed together: the bits
in which they differ add up, and a pair of nodes is dropped as soon as the sum is above the budget.

Spark deals the trie out. Of ``budget + 1`` blocks of bits, two fingerprints within the budget agree in one at
least, so the trie is taken once per block with that block's bits first and no error spent in them: its
nodes at that depth are the keys of the shuffle, and a fingerprint is copied ``budget + 1`` times, not to
all neighbouring prefixes. A node with more fingerprints than a task should hold is opened on Spark's side:
pairs of its children, and theirs, are formed by equi-joins on the parent with the same pruning, until
both nodes are small enough. Distinct fingerprints within the budget of one another are few, so opened
pairs stay in proportion to the fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.llm.components import connected, local_forest
from sheaf.session import materialise, ship_package

SHINGLE = 3
MAX_BITS = 2
NODE_ROWS = 4096  # fingerprints of a trie node that one task traverses
OPEN_BITS = 6  # depth that one round of opening adds
_LEAF = 64  # nodes below this are compared directly
_CHUNK = 1 << 16  # shingles hashed at a time, so that a very long text takes no more memory than its words
SEED = 42


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of one text as an unsigned 64-bit number; zero without any word."""
    words = (text or b"").lower().split()  # bytes: lowers A-Z alone, splits at blanks, tabs and line ends
    if not words:
        return 0
    size = min(shingle, len(words))
    joined, n = b" ".join(words), len(words) - size + 1
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[size - 1 :].tolist()
    counts = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, n, _CHUNK):
        part = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[i : i + _CHUNK], stops[i : i + _CHUNK], strict=True)], dtype="<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, text_hash, fp)`` for every row; ``fp`` holds the 64 bits as a signed number."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"), _text_hash().alias("text_hash"))
    return plain.mapInArrow(run, "doc_id long, text_hash long, fp long")


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def trie_pairs(left: np.ndarray, right: np.ndarray, depth: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of two sorted arrays (one node each, equal up to the given errors) within ``budget`` bits.

    ``depth`` is the number of leading bits the rows of each array share. Node pairs are halved bit by bit
    while they hold many rows; the bits in which the two nodes' prefixes differ count against the budget.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    same = left is right
    stack = [(0, len(left), 0, len(right), depth)]
    while stack:
        a0, a1, b0, b1, d = stack.pop()
        if a0 == a1 or b0 == b1:
            continue
        if d and (int(left[a0] ^ right[b0]) >> (64 - d)).bit_count() > budget:
            continue
        if d == 64 or (a1 - a0) * (b1 - b0) <= _LEAF * _LEAF:
            i, j = np.nonzero(np.bitwise_count(left[a0:a1, None] ^ right[None, b0:b1]) <= budget)
            found.append((i + a0, j + b0))
            continue
        bit = np.uint64(1 << (63 - d))
        a = a0 + int(np.searchsorted(left[a0:a1] & bit, bit))
        b = b0 + int(np.searchsorted(right[b0:b1] & bit, bit))
        stack += [(a0, a, b0, b, d + 1), (a, a1, b, b1, d + 1), (a0, a, b, b1, d + 1)]
        if not (same and (a0, a1) == (b0, b1)):
            stack.append((a, a1, b0, b, d + 1))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _rotation(part: int, parts: int) -> int:
    return part * 64 // parts


def _unturn(rows: np.ndarray, by: int) -> np.ndarray:
    return rows if by == 0 else (rows >> np.uint64(by)) | (rows << np.uint64(64 - by))


def _task_links(parts: int, budget: int):
    """Links of the node pairs in a sorted partition, as forests ``(a, b)`` of fingerprints."""

    def links(rows: np.ndarray, side: np.ndarray, part: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
        if side.any():  # two nodes
            a, b = rows[side == 0], rows[side == 1]
            i, j = trie_pairs(a, b, depth, budget)
            rows, j = np.concatenate([a, b]), j + len(a)
        else:
            i, j = trie_pairs(rows, rows, depth, budget)
        root = local_forest(len(rows), i, j)
        some = np.flatnonzero(root != np.arange(len(rows)))
        plain = _unturn(rows, _rotation(part, parts)).view(np.int64)
        return plain[some], plain[root[some]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            part, depth, a, b, side, turned = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(6))
            rows = np.rec.fromarrays([part, depth, a, b, side, turned], names="part,depth,a,b,side,turned")
            held.append(rows)
            rows = np.concatenate(held) if len(held) > 1 else rows
            keys = ["part", "depth", "a", "b"]
            ends = np.flatnonzero(np.any([rows[k][1:] != rows[k][:-1] for k in keys], axis=0)) + 1
            if not len(ends):
                held = [rows]
                continue
            yield from emit(rows[: ends[-1]], ends[:-1])
            held = [rows[ends[-1] :]]
        if held:
            rows = np.concatenate(held)
            yield from emit(rows, np.empty(0, np.int64))

    def emit(rows: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        left, right = [], []
        bounds = [0, *ends.tolist(), len(rows)]
        for lo, hi in zip(bounds, bounds[1:]):
            if hi - lo > 1:
                turned = np.ascontiguousarray(rows["turned"][lo:hi]).view(np.uint64)
                side = np.ascontiguousarray(rows["side"][lo:hi])
                order = np.lexsort((turned, side))
                x, y = links(turned[order], side[order], int(rows["part"][lo]), int(rows["depth"][lo]))
                left.append(x)
                right.append(y)
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])

    return run


def _prefix(depth: int):
    """The leading ``depth`` bits of the turned fingerprint, the rest zero."""
    return F.shiftleft(F.shiftrightunsigned("turned", 64 - depth), 64 - depth) if depth < 64 else F.col("turned")


def trie_links(prints: DataFrame, budget: int = MAX_BITS, node_rows: int = NODE_ROWS) -> DataFrame:
    """Links ``(a, b)`` between the distinct fingerprints ``prints (fp)`` that join all within ``budget`` bits.

    A forest per node pair: the links of all tasks together have the same components as all pairs.
    """
    spark = prints.sparkSession
    ship_package(spark)
    parts = budget + 1
    turns = [_rotation(p, parts) for p in range(parts + 1)]
    turned = F.array(
        *(
            F.struct(
                F.lit(p).alias("part"),
                F.lit(turns[p + 1] - turns[p]).alias("depth"),
                (F.shiftleft("fp", turns[p]).bitwiseOR(F.shiftrightunsigned("fp", 64 - turns[p])) if p else F.col("fp")).alias("turned"),
            )
            for p in range(parts)
        )
    )
    rows = prints.select(F.explode(turned).alias("r")).select("r.*")
    key = F.expr("CASE part " + " ".join(f"WHEN {p} THEN shiftright(turned, {64 - (turns[p + 1] - turns[p])})" for p in range(parts)) + " END")
    rows = materialise(rows.withColumn("key", key), "trie-rows")
    sizes = rows.groupBy("part", "key").agg(F.count("*").alias("n")).where("n > 1")
    sizes = materialise(sizes, "trie-nodes")
    plain = rows.join(sizes.where(F.col("n") <= node_rows).select("part", "key"), ["part", "key"]).select(
        "part", "depth", F.col("key").alias("a"), F.col("key").alias("b"), F.lit(0).alias("side"), "turned"
    )
    busy = sizes.where(F.col("n") > node_rows)
    opened = _opened(rows.join(busy.select("part", "key"), ["part", "key"]), budget, node_rows) if busy.take(1) else None
    tasks = plain if opened is None else plain.union(opened)
    dealt = tasks.repartition("part", "depth", "a", "b").sortWithinPartitions("part", "depth", "a", "b")
    return dealt.mapInArrow(_task_links(parts, budget), "a long, b long")


def _opened(rows: DataFrame, budget: int, node_rows: int) -> DataFrame:
    """Rows of crowded nodes, dealt to pairs of descendants that are small enough."""
    rows = materialise(rows, "trie-crowded")
    depths = sorted(r[0] for r in rows.select("depth").distinct().collect())
    out = None
    for first in depths:  # at most as many as there are blocks
        own = rows.where(F.col("depth") == first).select("part", "turned")
        pairs = own.select("part", _prefix(first).alias("a")).distinct().select("part", "a", F.col("a").alias("b"))
        depth = first
        while True:
            below = min(64, depth + OPEN_BITS)
            nodes = own.groupBy("part", _prefix(below).alias("node")).agg(F.count("*").alias("n"))
            nodes = nodes.withColumn("up", F.shiftleft(F.shiftrightunsigned("node", 64 - depth), 64 - depth))
            left = nodes.select("part", F.col("up").alias("a"), F.col("node").alias("x"), F.col("n").alias("nx"))
            right = nodes.select("part", F.col("up").alias("b"), F.col("node").alias("y"), F.col("n").alias("ny"))
            grown = (
                pairs.join(left, ["part", "a"])
                .join(right, ["part", "b"])
                .where((F.col("a") != F.col("b")) | (F.col("x") <= F.col("y")))
                .where(F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= budget)
                .select("part", F.col("x").alias("a"), F.col("y").alias("b"), (F.col("nx") + F.col("ny")).alias("n"))
            )
            grown = materialise(grown, "trie-pairs")
            done = grown if below == 64 else grown.where(F.col("n") <= 2 * node_rows)
            sides = done.select("part", "a", "b", F.lit(0).alias("side"), F.col("a").alias("node")).union(
                done.where("a <> b").select("part", "a", "b", F.lit(1).alias("side"), F.col("b").alias("node"))
            )
            dealt = own.withColumn("node", _prefix(below)).join(sides, ["part", "node"]).select("part", F.lit(below).alias("depth"), "a", "b", "side", "turned")
            out = dealt if out is None else out.union(dealt)
            pairs = grown.where(F.col("n") > 2 * node_rows).select("part", "a", "b")
            depth = below
            if depth == 64 or not pairs.take(1):
                break
    return out


def classes(docs: DataFrame, shingle: int = SHINGLE, budget: int = MAX_BITS, node_rows: int = NODE_ROWS) -> DataFrame:
    """``(doc_id, text_hash, fp, root, component_id)`` for every row of ``docs (doc_id, text)``: ``near_duplicates`` with the
    fingerprint as a number, and the fingerprint ``root`` that names the row's group, whatever its ids."""
    marked = materialise(fingerprints(docs, shingle), "fingerprints")
    prints = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-prints")
    roots = connected(trie_links(prints.select("fp"), budget, node_rows))
    found = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    found = materialise(found, "print-classes")
    least = found.groupBy("root").agg(F.min("first").alias("component_id"))
    named = found.join(least, "root").select("fp", "root", "component_id")
    return marked.join(named, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, budget: int = MAX_BITS, node_rows: int = NODE_ROWS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs (doc_id, text)``.

    ``fingerprint``: 16 hex digits. ``component_id``: the smallest doc_id reachable over links of at most ``budget``
    differing bits, the row's own included. Copies share a fingerprint and are folded before the join, so a
    group of any size costs one trie leaf.

    A null, empty or blank text has fingerprint zero and is linked like any other. A row without doc_id gets a
    fingerprint and the component of its group (null where no row of the group has an id). Repeated rows are returned
    each. Other columns are not looked at. An empty table gives no rows.
    """
    found = classes(docs, shingle, budget, node_rows)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One row of ``docs`` for each group of ``found``, the ``classes`` of the same rows, with all its columns.

    The row with the smallest doc_id stays, one without an id only if the group has no other; of rows that share that id and differ
    in text, the one whose text has the smallest hash; of rows alike in both, any with the smallest hash of all columns. Rows that share an id
    and lie in different groups stay, one for each group. Copies are cut down where they lie, before rows are shuffled.
    """
    none = F.col("doc_id").isNull().alias("__none")
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("__id")
    keys = ["__none", "__id", "__text"]
    first = found.select("root", none, number, F.col("text_hash").alias("__text")).groupBy("root").agg(F.min(F.struct(*keys)).alias("k"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64(*docs.columns)))
    rows = docs.select("*", none, number, _text_hash().alias("__text"))
    one = rows.withColumn("__n", place).where("__n = 1")
    return one.join(first.select("k.*"), keys, "left_semi").select(*docs.columns)
