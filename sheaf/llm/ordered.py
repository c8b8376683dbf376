"""Running numbers and sequence hashes of groups of any size, over ranges of their sorted rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.session import materialise, ship_package

#: Odd multipliers of the two sequence hashes; one less has a single factor 2.
BASES = (0x9E3779B97F4A7C17, 0xD6E8FEB86659FD93)
_WORD = 1 << 64


def powers(base: int, exponents: np.ndarray) -> np.ndarray:
    """``base ** exponents`` modulo 2**64."""
    out, square, left = np.ones(len(exponents), np.uint64), np.uint64(base), exponents.astype(np.uint64)
    while left.any():
        out[(left & np.uint64(1)).astype(bool)] *= square
        square = np.uint64(int(square) * int(square) % _WORD)
        left >>= np.uint64(1)
    return out


def _local(group: str, marks: Sequence[str]):
    """Adds number and sequence hashes inside this partition, whose rows are sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, n_last, sums = None, 0, [0] * len(marks)
        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column(group).to_numpy()
            first = np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1])
            seg = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(g))))
            n = np.arange(len(g)) - first[seg]
            if g[0] != last:
                n_last, sums = 0, [0] * len(marks)
            n[seg == 0] += n_last
            out = []
            for i, mark in enumerate(marks):
                each = batch.column(mark).to_numpy().view(np.uint64) * powers(BASES[i], n)
                total = np.cumsum(each, dtype=np.uint64)
                before = np.concatenate([np.zeros(1, np.uint64), total])[first]
                total -= before[seg]
                total[seg == 0] += np.uint64(sums[i])
                out.append(total)
            last, n_last, sums = g[-1], int(n[-1]) + 1, [int(t[-1]) for t in out]
            columns = [pa.array(np.full(len(g), part)), pa.array(n), *(pa.array(t.view(np.int64)) for t in out)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "part", "n", *_names(marks)])

    return run


def _names(marks: Sequence[str]) -> list[str]:
    return [f"at_{m}" for m in marks]


def _shifts(local: DataFrame, group: str, marks: Sequence[str]) -> dict[int, tuple[int, int, list[int]]]:
    """By partition: the group it goes on with, the group's rows in earlier partitions and their hashes.

    A partition goes on with one group at most, so there are no more rows than twice the partitions.
    """
    names = _names(marks)
    pieces = local.groupBy(group, "part").agg(F.max("n").alias("n"), *(F.max_by(c, "n").alias(c) for c in names))
    over = F.count(F.lit(1)).over(Window.partitionBy(group)) > 1
    found = pieces.withColumn("spans", over).where("spans").orderBy(group, "part").collect()
    out, before = {}, None
    for r in found:
        if before is not None and before[0] == r[group]:
            _, n, sums = before
            out[r.part] = (r[group], n, sums)
        else:
            n, sums = 0, [0] * len(marks)
        sums = [(s + pow(b, n, _WORD) * r[c]) % _WORD for s, b, c in zip(sums, BASES, names)]
        before = (r[group], n + r.n + 1, sums)
    return out


def running(rows: DataFrame, group: str, order: Sequence[str], marks: Sequence[str] = ()) -> DataFrame:
    """Adds ``n``, the number of each row in its group from 0, and for each of ``marks`` two hashes of the sequence of its values.

    ``at_<mark>`` hashes the values up to the row, ``to_<mark>`` those before it; equal sequences from the start of a group on give equal
    hashes. ``group`` and ``marks`` are longs without nulls. Rows are dealt by range of group and order, so a group of any
    size is spread; what a partition must know of earlier ones is one row for each partition.
    """
    spark = rows.sparkSession
    ship_package(spark)
    long = lambda names: [T.StructField(c, T.LongType()) for c in names]
    dealt = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    schema = T.StructType([*rows.schema.fields, *long(["part", "n", *_names(marks)])])
    local = materialise(dealt.mapInArrow(_local(group, marks), schema), "ranges")
    shifts, kept = _shifts(local, group, marks), rows.columns

    def shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy().copy()
            g, part = batch.column(group).to_numpy(), batch.column("part").to_numpy()
            at = [batch.column(c).to_numpy().view(np.uint64).copy() for c in _names(marks)]
            for p in np.unique(part).tolist():
                if p in shifts:
                    key, more, sums = shifts[p]
                    on = (part == p) & (g == key)
                    n[on] += more
                    for i, total in enumerate(at):
                        total[on] = total[on] * np.uint64(pow(BASES[i], more, _WORD)) + np.uint64(sums[i])
            to = [t - batch.column(m).to_numpy().view(np.uint64) * powers(BASES[i], n) for i, (t, m) in enumerate(zip(at, marks))]
            columns = [batch.column(c) for c in kept]
            columns += [pa.array(n), *(pa.array(t.view(np.int64)) for t in [*at, *to])]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "n", *_names(marks), *(f"to_{m}" for m in marks)])

    schema = T.StructType([*rows.schema.fields, *long(["n", *_names(marks), *(f"to_{m}" for m in marks)])])
    return local.mapInArrow(shifted, schema)
