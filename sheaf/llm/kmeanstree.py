"""Nearest vectors by a hierarchical k-means tree with best-bin-first search.

Largest inner product is nearest distance once every vector x of norm at most M gets one more component sqrt(M^2 - |x|^2) and a
query gets 0 there. A tree of k-means splits is fitted in that space on a bounded sample, and every vector goes to a leaf.

A query walks the tree through a priority queue: the nearest unopened node is opened next, wherever it hangs, and leaves are visited
in the order they come out. How many is calibrated: for a set of queries the true neighbours are found among all vectors, and visits are
widened until the wanted share of them lies in visited leaves. All queries then take as many. A leaf is visited whole.

Leaves are packed into blocks of bounded rows, a crowded leaf into several. Each query goes once to every block
that holds a leaf it visits, and a task multiplies one block with a bounded set of queries at a time. Equal vectors are one vector with its
smallest ids: no more of them than neighbours are asked for, plus the query's own, can be in any answer.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.llm.ordered import running
from sheaf.session import materialise, ship_package

NEIGHBOURS = 20
SAMPLE = 16_384  # vectors the tree is fitted on
SAMPLE_BYTES = 64_000_000  # ... fewer where vectors are very long
BRANCH = 8
LEAF_SAMPLE = 24  # vectors of the sample that a leaf holds at most
ROUNDS = 12  # of Lloyd's iteration
CALIBRATION = 256  # queries whose true neighbours are found
RECALL = 0.97  # wanted share of them in visited leaves
BLOCK = 4096  # vectors that a task multiplies at a time
TILE_QUERIES = 4096  # ... with so many queries
_SLICE = 256  # queries multiplied at once


@dataclass
class Tree:
    """Centroids of all nodes; ``children[i]`` is a range of nodes, or empty for a leaf, whose number is ``leaf[i]``."""

    centroids: np.ndarray
    squares: np.ndarray
    children: list[tuple[int, int]]
    leaf: list[int]
    leaves: int
    reach: float  # largest norm

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """Leaf of each row, down the nearest centroids."""
        out = np.zeros(len(rows), np.int64)
        stack = [(0, np.arange(len(rows)))]
        while stack:
            node, at = stack.pop()
            lo, hi = self.children[node]
            if lo == hi:
                out[at] = self.leaf[node]
                continue
            near = (self.squares[lo:hi] - 2 * rows[at] @ self.centroids[lo:hi].T).argmin(axis=1)
            stack += [(lo + k, at[near == k]) for k in range(hi - lo) if (near == k).any()]
        return out

    def visits(self, query: np.ndarray, most: int) -> list[int]:
        """Leaves in best-bin-first order."""
        queue, out = [(0.0, 0)], []
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            lo, hi = self.children[node]
            if lo == hi:
                out.append(self.leaf[node])
                continue
            gaps = (self.squares[lo:hi] - 2 * (self.centroids[lo:hi] @ query)).tolist()
            for k, gap in enumerate(gaps):
                heapq.heappush(queue, (gap, lo + k))
        return out


def _raised(rows: np.ndarray, reach: float) -> np.ndarray:
    rest = np.maximum(0.0, reach * reach - (rows * rows).sum(axis=1))
    return np.hstack([rows, np.sqrt(rest)[:, None]])


def _split(rows: np.ndarray, branch: int, rng: np.random.Generator) -> np.ndarray | None:
    """Cluster of each row by k-means, seeded far apart; None if all rows are one point."""
    squares = (rows * rows).sum(axis=1)
    centres = rows[rng.integers(len(rows))][None]
    gap = np.maximum(0, squares - 2 * rows @ centres[0] + centres[0] @ centres[0])
    while len(centres) < branch and gap.sum() > 1e-12 * max(1.0, squares.max()):
        pick = rows[rng.choice(len(rows), p=gap / gap.sum())]
        centres = np.vstack([centres, pick])
        gap = np.minimum(gap, np.maximum(0, squares - 2 * rows @ pick + pick @ pick))
    if len(centres) < 2:
        return None
    label = None
    for _ in range(ROUNDS):
        now = ((centres * centres).sum(axis=1) - 2 * rows @ centres.T).argmin(axis=1)
        if label is not None and (now == label).all():
            break
        label = now
        used = np.unique(label)
        centres = np.vstack([rows[label == k].mean(axis=0) for k in used])
        label = np.searchsorted(used, label)
    return label if label.max() else None


def fit(sample: np.ndarray, reach: float, branch: int = BRANCH, leaf_sample: int = LEAF_SAMPLE, seed: int = 0) -> Tree:
    """A tree over sample vectors; the nodes are bounded by the sample."""
    rows, rng = _raised(sample, reach), np.random.default_rng(seed)
    centroids, children, leaf, leaves = [rows.mean(axis=0)], [(0, 0)], [-1], 0
    stack = [(0, np.arange(len(rows)))]
    while stack:
        node, at = stack.pop()
        label = _split(rows[at], branch, rng) if len(at) > leaf_sample else None
        if label is None:
            leaf[node] = leaves
            leaves += 1
            continue
        lo, k = len(centroids), int(label.max()) + 1
        children[node] = (lo, lo + k)
        for c in range(k):
            own = at[label == c]
            centroids.append(rows[own].mean(axis=0))
            children.append((0, 0))
            leaf.append(-1)
            stack.append((lo + c, own))
    matrix = np.vstack(centroids)
    return Tree(matrix, (matrix * matrix).sum(axis=1), children, leaf, leaves, reach)


def _sound(vector: str) -> Column:
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def _best(scores: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` largest scores, ties to smaller ids."""
    some = np.arange(len(scores))
    if len(scores) > most:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - most)[len(scores) - most])
    return some[np.lexsort((ids[some], -scores[some]))][:most]


def _near(query: np.ndarray, vectors: np.ndarray, norm: float, rough: np.ndarray, ids: np.ndarray, at: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows out of ``at`` nearest to the query, and their scores.

    Matrix products may differ in their last digits from block to block, so the score of a pair is summed anew, always in the
    same order, for all rows that rounding could bring in. ``norm`` is the largest of the vectors.
    """
    rough = rough[at]
    if len(at) > most:
        room = 1e-15 * len(query) * norm * np.sqrt(query @ query)
        at = at[rough >= np.partition(rough, len(rough) - most)[len(rough) - most] - room]
    exact = (vectors[at] * query).sum(axis=1)
    top = _best(exact, ids[at], most)
    return at[top], exact[top]


def _norm(rows: np.ndarray) -> float:
    return float(np.sqrt((rows * rows).sum(axis=1).max()))


_LONGS = T.ArrayType(T.LongType())
_FOUND = T.StructType(
    [T.StructField("key", T.LongType()), T.StructField("scores", T.ArrayType(T.DoubleType())), T.StructField("firsts", _LONGS), T.StructField("nodes", _LONGS), T.StructField("leaves", _LONGS)]
)


def _found(rows: list[tuple]) -> pa.RecordBatch:
    """A query's node, and of its nearest vectors so far the scores, smallest ids, nodes and leaves."""
    kinds = [pa.int64(), pa.list_(pa.float64()), *[pa.list_(pa.int64())] * 3]
    columns = zip(*rows, strict=True) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=[f.name for f in _FOUND.fields])


def _rows_of(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    return tuple(batch.column(c).to_numpy() for c in ("first", "node", "leaf"))


def _exhaustive(queries: np.ndarray, keys: np.ndarray, most: int):
    """Nearest of a bounded set of queries among all rows of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0), *[np.zeros(0, np.int64)] * 3)] * len(keys)
        for batch in batches:
            if not batch.num_rows or not len(keys):
                continue
            vectors, named = _matrix(batch.column("vector")), _rows_of(batch)
            norm, every = _norm(vectors), np.arange(len(vectors))
            for i, rough in enumerate(queries @ vectors.T):
                at, score = _near(queries[i], vectors, norm, rough, named[0], every, most)
                both = [np.concatenate(x) for x in zip(best[i], (score, *(c[at] for c in named)), strict=True)]
                top = _best(both[0], both[1], most)
                best[i] = tuple(c[top] for c in both)
        yield _found([(k, *(x.tolist() for x in b)) for k, b in zip(keys.tolist(), best, strict=True) if len(b[0])])

    return run


def _merge(most: int):
    """The best of each query over its rows, which lie together; no more than a few lists are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, near = None, []
        for batch in batches:
            out = []
            for key, scores, firsts, nodes, leaves in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != last:
                    if near:
                        out.append(_listed(last, near, most))
                    last, near = key, []
                near += zip([-s for s in scores], firsts, nodes, leaves, strict=True)
                if len(near) > 64 * most:
                    near = sorted(near)[:most]
            yield _found(out)
        if near:
            yield _found([_listed(last, near, most)])

    return run


def _listed(key: int, near: list[tuple], most: int) -> tuple:
    away, *named = zip(*sorted(near)[:most], strict=True)
    return key, [-s for s in away], *named


def _merged(found: DataFrame, most: int) -> DataFrame:
    return found.repartition("key").sortWithinPartitions("key").mapInArrow(_merge(most), _FOUND)


def calibrated(tree: Tree, queries: np.ndarray, truth: list[np.ndarray], goal: float) -> int:
    """Leaf visits, doubled and then narrowed down, after which the wanted share of true neighbours has been met."""
    ranks = []
    for query, leaves in zip(queries, truth, strict=True):
        place = np.empty(tree.leaves, np.int64)
        place[tree.visits(np.append(query, 0.0), tree.leaves)] = np.arange(tree.leaves)
        ranks.append(place[leaves])
    ranks = np.concatenate(ranks) if ranks else np.zeros(0, np.int64)
    if not len(ranks):
        return 1
    met = lambda m: (ranks < m).mean()
    wide = 1
    while met(wide) < goal:
        wide *= 2
    least = wide // 2 + 1
    while least < wide:
        middle = (least + wide) // 2
        least, wide = (least, middle) if met(middle) >= goal else (middle + 1, wide)
    return min(wide, tree.leaves)


def _visiting(tree: Tree, visits: int, blocks: list[tuple[int, int]]):
    """Rows for the blocks that each query goes to, with the leaves it visits there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, block, leaves = [], [], []
            for i, row in enumerate(_matrix(batch.column("vector")) if batch.num_rows else []):
                here: dict[int, list[int]] = {}
                for leaf in tree.visits(np.append(row, 0.0), visits):
                    for b in range(*blocks[leaf]):
                        here.setdefault(b, []).append(leaf)
                at += [i] * len(here)
                block += here
                leaves += here.values()
            rows = pa.array(at, pa.int64())
            columns = [pa.array(block, pa.int64()), pa.array(leaves, pa.list_(pa.int64())), batch.column("node").take(rows), batch.column("vector").take(rows)]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "leaves", "node", "vector"])

    return run


def _multiply(most: int):
    """Each sorted run of rows ``(block, tile, side)``: a block's vectors first, then the queries that visit it."""

    def met(loaded: tuple, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        (first, node, leaf), vectors, norm = loaded
        queries = _matrix(part.column("vector"))
        out = []
        for key, query, rough, leaves in zip(part.column("node").to_pylist(), queries, queries @ vectors.T, part.column("leaves").to_pylist(), strict=True):
            lo, hi = np.searchsorted(leaf, leaves), np.searchsorted(leaf, leaves, "right")
            at = np.concatenate([np.arange(a, b) for a, b in zip(lo, hi, strict=True)])
            if len(at):
                at, score = _near(query, vectors, norm, rough, first, at, most)
                out.append((key, score.tolist(), first[at].tolist(), node[at].tolist(), leaf[at].tolist()))
        yield _found(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, loaded = None, [], None
        for batch in batches:
            block, tile, side = (batch.column(c).to_numpy() for c in ("block", "tile", "side"))
            edge = np.flatnonzero((block[1:] != block[:-1]) | (tile[1:] != tile[:-1]) | (side[1:] != side[:-1])) + 1
            for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), batch.num_rows], strict=True):
                if lo == hi:
                    continue
                if (block[lo], tile[lo]) != current:
                    current, held, loaded = (block[lo], tile[lo]), [], None
                part = batch.slice(lo, hi - lo)
                if side[lo] == 0:
                    held.append(part)
                elif held or loaded:
                    if loaded is None:
                        own = pa.Table.from_batches(held).sort_by("leaf").combine_chunks().to_batches()[0]
                        vectors = _matrix(own.column("vector"))
                        loaded, held = (_rows_of(own), vectors, _norm(vectors)), []
                    for k in range(0, part.num_rows, _SLICE):
                        yield from met(loaded, part.slice(k, _SLICE))

    return run


def _packed(counts: dict[int, int], leaves: int, block: int) -> tuple[list[tuple[int, int]], int]:
    """Range of blocks for each leaf: neighbouring small leaves share one, a crowded leaf has several."""
    out, at, room = [], 0, block
    for leaf in range(leaves):
        n = counts.get(leaf, 0)
        if n > block:
            at += room < block
            own = -(-n // block)
            out.append((at, at + own))
            at, room = at + own, block
        else:
            if n > room:
                at, room = at + 1, block
            out.append((at, at + 1))
            room -= n
    return out, at + 1


def _search(points: DataFrame, queries: DataFrame, most: int, goal: float, block: int | None) -> DataFrame:
    """Nearest ``points (node, first, vector)`` of each of ``queries (node, vector)``, all of one length, as ``_found`` rows."""
    spark = points.sparkSession
    facts = points.agg(F.count(F.lit(1)), F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))), F.max(F.size("vector"))).first()
    n, reach, length = facts
    size = max(2, min(SAMPLE, SAMPLE_BYTES // (4 * length)))
    picked = lambda df, most: df.orderBy(F.xxhash64("vector"), "node").limit(most).select("node", "vector").toArrow()
    sample = picked(points, size)
    tree = fit(_matrix(sample.column("vector").combine_chunks()), float(reach))
    shared = spark.sparkContext.broadcast(tree)  # no more nodes than the sample has rows

    def leafed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        for batch in batches:
            leaf = tree.assign(_raised(_matrix(batch.column("vector")), tree.reach)) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=[*batch.schema.names, "leaf"])

    schema = T.StructType([*points.schema.fields, T.StructField("leaf", T.LongType())])
    placed = materialise(points.mapInArrow(leafed, schema), "tree-rows")
    some = picked(queries, max(2, min(CALIBRATION, SAMPLE_BYTES // (4 * length))))
    keys, vectors = some.column("node").to_numpy(), _matrix(some.column("vector").combine_chunks()) if some.num_rows else np.zeros((0, length))
    truth = _merged(placed.mapInArrow(_exhaustive(vectors, keys, most), _FOUND), most).collect()
    near = {r.key: np.array([leaf for node, leaf in zip(r.nodes, r.leaves) if node != r.key], np.int64) for r in truth}
    visits = calibrated(tree, vectors, [near[k] for k in keys.tolist()], goal)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if block is None:  # at least a few blocks for each task
        block = max(64, min(BLOCK, n // (2 * parts)))
    counts = {r.leaf: r["count"] for r in placed.groupBy("leaf").count().collect()}  # no more than the tree's leaves
    blocks, _ = _packed(counts, tree.leaves, block)
    places = spark.createDataFrame([(leaf, lo, hi - lo) for leaf, (lo, hi) in enumerate(blocks)], "leaf long, lo long, own long")
    dealt = placed.join(F.broadcast(places), "leaf").select("node", "first", "vector", "leaf", (F.col("lo") + F.pmod(F.xxhash64("node"), "own")).alias("block"))
    fields = [T.StructField("block", T.LongType()), T.StructField("leaves", _LONGS), points.schema["node"], points.schema["vector"]]

    def visiting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _visiting(shared.value, visits, blocks)(batches)

    visitors = materialise(queries.select("node", "vector").mapInArrow(visiting, T.StructType(fields)), "tree-visits")
    share = max(64, min(TILE_QUERIES, 4 * block))  # a block meets so many queries at a time, and is copied for the next ones
    tiles = materialise(visitors.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / share).alias("tiles")), "tree-tiles")
    own = dealt.join(tiles, "block").withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    other = visitors.join(tiles, "block").withColumn("tile", F.pmod(F.xxhash64("node", F.lit(0)), "tiles"))
    columns = ["block", "tile", "side", "leaf", "leaves", "node", "first", "vector"]
    own = own.withColumns({"side": F.lit(0), "leaves": F.lit(None).cast("array<bigint>")}).select(columns)
    other = other.withColumns({"side": F.lit(1), "leaf": F.lit(0).cast("long"), "first": F.col("node")}).select(columns)
    met = own.unionByName(other).repartition("block", "tile").sortWithinPartitions("block", "tile", "side")
    return _merged(met.mapInArrow(_multiply(most), _FOUND), most)


def nearest(vectors: DataFrame, asking: Column, neighbours: int = NEIGHBOURS, recall: float = RECALL, block: int | None = None) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the nearest rows found for each row of ``vectors (vec_id, embedding)`` that ``asking`` picks.

    Nearness is the inner product in double precision, largest first, ties to smaller vec_id; a row is not its own
    neighbour. Where fewer rows are left, all are returned that were found. ``asking`` is a condition on ``vec_id``.

    Vectors that are null, empty, zero or hold a null or non-finite component take no part, nor do rows without vec_id; vectors meet those of
    their own length only. Rows that repeat id and vector count once. An id with several vectors can be found by each of them; it asks by
    one of them (that of the smallest hash), and never finds itself. Other columns are not looked at. No queries or no vectors give no rows.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"))
    sound = plain.where(F.col("vec_id").isNotNull() & _sound("vector"))
    keyed = sound.select("vec_id", "vector", F.xxhash64("vector").alias("k1"), F.xxhash64(F.lit(1), "vector").alias("k2")).distinct()
    rows = running(keyed, "k1", ["k2", "vec_id"])
    rows = materialise(rows, "tree-sorted")
    starts = rows.groupBy("k1", "k2").agg(F.min("n").alias("least"), F.min("vec_id").alias("first"), F.count_if(asking).alias("asks"))
    most = neighbours + 1
    heads = materialise(starts.withColumn("node", F.monotonically_increasing_id()), "tree-heads")
    kept = rows.join(heads, ["k1", "k2"]).where(F.col("n") - F.col("least") < most)
    kept = materialise(kept.select("node", "first", "vec_id", "asks", F.when(F.col("n") == F.col("least"), F.col("vector")).alias("vector")), "tree-copies")
    points = kept.where("vector IS NOT NULL").select("node", "first", "asks", "vector")
    found = None
    for length in [r[0] for r in points.select(F.size("vector")).distinct().collect()]:  # one per model in use
        own = materialise(points.where(F.size("vector") == length), "tree-points")
        asked = own.where("asks > 0")
        if asked.isEmpty():
            continue
        here = _search(own.drop("asks"), asked.select("node", "vector"), most, recall, block)
        found = here if found is None else found.unionByName(here)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = materialise(found, "tree-found")
    # A vector's smallest ids stand in for it; of all of them together no answer holds more than is asked for.
    copies = kept.groupBy("node").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    pairs = found.select("key", F.explode(F.arrays_zip("nodes", "scores")).alias("x")).select("key", F.col("x.nodes").alias("node"), (-F.col("x.scores")).alias("away"))
    pairs = pairs.join(copies, "node").select("key", F.transform("ids", lambda i: F.struct("away", i.alias("vec_id"))).alias("near"))
    lists = pairs.groupBy("key").agg(F.array_sort(F.flatten(F.collect_list("near"))).alias("near"))
    queries = rows.where(asking).join(heads.select("k1", "k2", "node"), ["k1", "k2"])
    queries = queries.groupBy("vec_id").agg(F.min_by("node", F.struct("k1", "k2")).alias("key"))
    answered = queries.join(lists, "key").select(F.col("vec_id").alias("query_id"), F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("vec_id")), 1, neighbours).alias("near"))
    out = answered.select("query_id", F.posexplode("near").alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.away")).alias("score"))
