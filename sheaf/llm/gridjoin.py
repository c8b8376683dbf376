"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors whose cosine is at least ``c`` are at most ``eps = sqrt(2 - 2c)`` apart, and no further apart in any
projection. Vectors are projected on a few leading principal axes, laid on a grid of width ``eps`` there,
sorted by grid cell and cut into blocks. The sequence of blocks is joined with itself recursively: a pair of
intervals whose bounding boxes are further apart than ``eps`` is skipped as a whole, else its parts are
paired. The upper levels of the recursion are joins of interval tables, the last ones run inside the tasks.
Any orthonormal axes give exact results; the principal ones only skip more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.functions.ranking import numbered
from sheaf.llm.components import connected, local_forest
from sheaf.session import materialise, ship_package

COSINE = 0.9
AXES = 8
AXIS_SAMPLE = 4096  # vectors the axes are fitted on; they decide about speed alone
BLOCK = 2048  # vectors per block
FANOUT = 8  # intervals that one interval of the next level covers
PARTNERS = 16  # blocks that a task compares with one block
_LEAF = 256  # rows compared without looking at boxes first
_SLACK = 1e-9  # room for rounding in projections


def _sound(vector: str) -> Column:
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def _axes(distinct: DataFrame, count: int) -> np.ndarray:
    """Leading principal axes of a sample fixed by the vectors' hashes; one column each."""
    sample = distinct.orderBy(F.xxhash64("vector"), "first").limit(AXIS_SAMPLE).select("vector").toArrow()
    rows = np.asarray(sample.column(0).combine_chunks().flatten(), dtype=np.float64).reshape(sample.num_rows, -1)
    rows = _units(rows)
    rows -= rows.mean(axis=0)
    _, _, found = np.linalg.svd(rows, full_matrices=True)
    return np.ascontiguousarray(found[: min(count, rows.shape[1])].T)


def _units(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # keeps squares of very large or small components finite
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def _projected(distinct: DataFrame, axes: np.ndarray, eps: float) -> DataFrame:
    """Adds the projection ``z`` and the grid order ``cell``: coarse cells first, then cells of an eighth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            z = _units(_matrix(batch.column("vector"))) @ axes
            cell = np.hstack([np.floor(z / eps), np.floor(8 * z / eps)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(list(z), pa.list_(pa.float64())), pa.array(list(cell), pa.list_(pa.int32()))], names=[*batch.schema.names, "z", "cell"]
            )

    schema = T.StructType([*distinct.schema.fields, T.StructField("z", T.ArrayType(T.DoubleType())), T.StructField("cell", T.ArrayType(T.IntegerType()))])
    return distinct.mapInArrow(run, schema)


def _blocks(placed: DataFrame, block: int) -> DataFrame:
    """Sorted rows with ``block`` and ``node``, both rising in grid order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, base = 0, TaskContext.get().partitionId() << 40
        for batch in batches:
            node = base + at + np.arange(batch.num_rows)
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node), pa.array(node // block)], names=[*batch.schema.names, "node", "block"])

    fields = [f for f in placed.schema.fields if f.name != "cell"]
    schema = T.StructType([*fields, T.StructField("node", T.LongType()), T.StructField("block", T.LongType())])
    dealt = placed.repartitionByRange("cell").sortWithinPartitions("cell", F.xxhash64("vector"), "vector")
    return dealt.drop("cell").mapInArrow(run, schema)


def _near(axes: int, reach: float) -> Column:
    """Boxes ``lo/hi`` of x and y are within ``reach``."""
    gaps = [F.greatest(F.lit(0.0), F.col(f"xlo{i}") - F.col(f"yhi{i}"), F.col(f"ylo{i}") - F.col(f"xhi{i}")) for i in range(axes)]
    return sum((g * g for g in gaps[1:]), gaps[0] * gaps[0]) <= reach * reach


def _block_pairs(rows: DataFrame, axes: int, reach: float) -> DataFrame:
    """Pairs ``a <= b`` of blocks whose boxes are within reach, found from the whole sequence downwards."""
    sides = [F.min(F.col("z")[i]).alias(f"lo{i}") for i in range(axes)] + [F.max(F.col("z")[i]).alias(f"hi{i}") for i in range(axes)]
    boxes = rows.groupBy("block").agg(*sides)
    boxes = materialise(numbered(boxes.withColumn("all", F.lit(0)), ["all"], [F.col("block")], "seq").drop("all"), "grid-boxes")
    count = boxes.count()
    levels = 0
    while FANOUT**levels < count:
        levels += 1
    pairs = rows.sparkSession.createDataFrame([(0, 0)], "a long, b long")
    merged = [F.min(f"lo{i}").alias(f"lo{i}") for i in range(axes)] + [F.max(f"hi{i}").alias(f"hi{i}") for i in range(axes)]
    for level in range(levels - 1, -1, -1):
        here = boxes.withColumn("id", F.floor((F.col("seq") - 1) / FANOUT**level)).groupBy("id").agg(*merged) if level else boxes.withColumn("id", F.col("seq") - 1)
        sides = [f"{s}{i}" for s in ("lo", "hi") for i in range(axes)]
        x = here.select(F.col("id").alias("a"), *(F.col(s).alias(f"x{s}") for s in sides))
        y = here.select(F.col("id").alias("b"), *(F.col(s).alias(f"y{s}") for s in sides))
        child = lambda up: F.explode(F.transform(F.sequence(F.lit(0), F.lit(FANOUT - 1)), lambda k: F.col(up) * FANOUT + k))
        grown = pairs.select(child("a").alias("a"), "b").select("a", child("b").alias("b")).where("a <= b")
        pairs = materialise(grown.join(x, "a").join(y, "b").where(_near(axes, reach)).select("a", "b"), "grid-pairs")
    seq = boxes.select((F.col("seq") - 1).alias("seq"), "block")
    named = pairs.join(seq.withColumnRenamed("seq", "a").withColumnRenamed("block", "left"), "a")
    return named.join(seq.withColumnRenamed("seq", "b").withColumnRenamed("block", "right"), "b").select("a", "b", "left", "right")


def _compare(axes: np.ndarray, cosine: float, reach: float):
    """Counts and forests of one block against its partners, which follow it in the partition."""

    def leaves(za: np.ndarray, zb: np.ndarray, same: bool) -> Iterator[tuple[int, int, int, int]]:
        stack = [(0, len(za), 0, len(zb))]
        while stack:
            a0, a1, b0, b1 = stack.pop()
            if a0 == a1 or b0 == b1 or (same and b1 <= a0):
                continue
            gap = np.maximum(0, np.maximum(za[a0:a1].min(0) - zb[b0:b1].max(0), zb[b0:b1].min(0) - za[a0:a1].max(0)))
            if gap @ gap > reach * reach:
                continue
            if a1 - a0 <= _LEAF and b1 - b0 <= _LEAF:
                yield a0, a1, b0, b1
                continue
            am, bm = (a0 + a1) // 2, (b0 + b1) // 2
            stack += [(a0, am, b0, bm), (a0, am, bm, b1), (am, a1, b0, bm), (am, a1, bm, b1)]

    def join(left: tuple, right: tuple, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        (va, ua, wa), (vb, ub, wb) = left, right
        za, zb = ua @ axes, ub @ axes
        na, nb = np.sqrt((va * va).sum(1)), np.sqrt((vb * vb).sum(1))
        ca, cb = np.zeros(len(va), np.int64), np.zeros(len(vb), np.int64)
        li, lj = [], []
        for a0, a1, b0, b1 in leaves(za, zb, same):
            i, j = np.nonzero(ua[a0:a1] @ ub[b0:b1].T >= cosine - _SLACK)
            i, j = i + a0, j + b0
            exact = np.einsum("ij,ij->i", va[i], vb[j]) / (na[i] * nb[j]) >= cosine
            if same:
                exact &= i < j
            i, j = i[exact], j[exact]
            if len(i):
                np.add.at(ca, i, wb[j])
                np.add.at(cb, j, wa[i])
                li.append(i)
                lj.append(j)
        i, j = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (li, lj))
        return ca, cb, i, j

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, left, held = None, [], []

        def load(parts: list[pa.RecordBatch]) -> tuple:
            rows = pa.Table.from_batches(parts)
            vectors = _matrix(rows.column("vector").combine_chunks())
            scale = np.abs(vectors).max(axis=1, keepdims=True)
            vectors = vectors / np.exp2(np.frexp(scale)[1])  # a power of two: exact
            return rows.column("node").to_numpy(), vectors, _units(vectors), rows.column("weight").to_numpy()

        def result(nodes: np.ndarray, others: np.ndarray | None, n: np.ndarray) -> pa.RecordBatch:
            other = pa.nulls(len(nodes), pa.int64()) if others is None else pa.array(others)
            return pa.RecordBatch.from_arrays([pa.array(nodes), other, pa.array(n)], names=["node", "other", "n"])

        def flush(block: tuple | None, parts: list[pa.RecordBatch], same: bool) -> Iterator[pa.RecordBatch]:
            right = load(parts)
            block = right if same else block
            ca, cb, i, j = join(block[1:], right[1:], same)
            if not len(i):
                return
            if same:
                nodes, n, root = right[0], ca + cb, local_forest(len(right[0]), i, j)
            else:
                nodes, n = np.concatenate([block[0], right[0]]), np.concatenate([ca, cb])
                root = local_forest(len(nodes), i, j + len(block[0]))
            yield result(nodes[n > 0], None, n[n > 0])
            some = np.flatnonzero(root != np.arange(len(nodes)))
            yield result(nodes[some], nodes[root[some]], np.zeros(len(some), np.int64))

        current, block = None, None
        for batch in batches:
            marks = [batch.column(c).to_numpy() for c in ("a", "part", "side", "b")]
            ends = np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0)) + 1
            for lo, hi in zip([0, *ends.tolist()], [*ends.tolist(), batch.num_rows], strict=True):
                if hi == lo:
                    continue
                here = tuple(int(m[lo]) for m in marks)
                if here != current:
                    if held:
                        if current[2] == 0:
                            block = load(held)
                        else:
                            yield from flush(block, held, current[0] == current[3])
                    current, held = here, []
                held.append(batch.slice(lo, hi - lo))
        if held and current[2] == 1:
            yield from flush(block, held, current[0] == current[3])

    return run


def _linked(distinct: DataFrame, cosine: float, axes: int, block: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Numbered distinct vectors of one length, their link counts and forest links."""
    eps = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    basis = _axes(distinct, axes)
    reach = eps + _SLACK
    rows = materialise(_blocks(_projected(distinct, basis, max(eps, 1e-6)), block), "grid-rows")
    pairs = _block_pairs(rows, basis.shape[1], reach)
    pairs = materialise(pairs.withColumn("part", F.floor(F.col("b") / PARTNERS)), "grid-tasks")
    own = pairs.select("a", "part", F.lit(0).alias("side"), F.col("a").alias("b"), F.col("left").alias("block")).distinct()
    other = pairs.select("a", "part", F.lit(1).alias("side"), "b", F.col("right").alias("block"))
    sent = own.union(other).join(rows.select("block", "node", "weight", "vector"), "block")
    sent = sent.repartition("a", "part").sortWithinPartitions("a", "part", "side", "b", "node")
    found = materialise(sent.mapInArrow(_compare(basis, cosine, reach), "node long, other long, n long"), "grid-links")
    counts = found.where(F.col("other").isNull()).groupBy("node").agg(F.sum("n").alias("n"))
    return rows, counts, found.where(F.col("other").isNotNull()).select(F.col("node").alias("a"), F.col("other").alias("b"))


def near_vectors(vectors: DataFrame, cosine: float = COSINE, axes: int = AXES, block: int = BLOCK) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors (vec_id, embedding)``.

    Two rows are linked when their cosine, in double precision, is at least ``cosine``; ``n_links`` counts the other
    rows linked directly, ``component_id`` is the smallest vec_id reachable (its own included), ``kept`` marks the row that
    bears it. Equal vectors are folded first and counted by weight, so a group of copies of any size is one vector.

    A vector that is null, empty, zero or holds a null or non-finite component links with nothing. Vectors of different
    length are not linked. A row without vec_id takes part; its component is null where no row of it has an id, and only then
    is it kept. Repeated rows are returned each and link with one another. Other columns, labels too, are not looked at.
    An empty table gives no rows.
    """
    if not 0 < cosine <= 1:
        raise ValueError("cosine must be above 0 and at most 1")
    ship_package(vectors.sparkSession)
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"))
    sound = plain.where(_sound("vector"))
    distinct = materialise(sound.groupBy("vector").agg(F.min("vec_id").alias("first"), F.count("*").alias("weight")), "grid-vectors")
    lengths = [r[0] for r in distinct.select(F.size("vector")).distinct().collect()]  # one per model in use
    rows = counts = links = None
    for n in lengths:
        own = _linked(distinct.where(F.size("vector") == n) if len(lengths) > 1 else distinct, cosine, axes, block)
        shift = F.lit(lengths.index(n)).cast("long") * (1 << 56)
        own = (
            own[0].select("vector", "first", "weight", (F.col("node") + shift).alias("node")),
            own[1].select((F.col("node") + shift).alias("node"), "n"),
            own[2].select((F.col("a") + shift).alias("a"), (F.col("b") + shift).alias("b")),
        )
        rows, counts, links = own if rows is None else (rows.union(own[0]), counts.union(own[1]), links.union(own[2]))
    if rows is None:
        return plain.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    marked = rows.join(connected(links), "node", "left").select("vector", "first", "weight", "node", F.coalesce("root", "node").alias("root"))
    marked = materialise(marked.join(counts, "node", "left").fillna(0, ["n"]), "grid-classes")
    least = marked.groupBy("root").agg(F.min("first").alias("component_id"))
    named = marked.join(least, "root").select("vector", (F.col("n") + F.col("weight") - 1).alias("n_links"), "component_id", F.lit(True).alias("found"))
    out = plain.join(named, "vector", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("found"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
