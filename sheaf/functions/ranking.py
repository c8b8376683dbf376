"""Row numbers over groups too large for one task."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.session import materialise, ship_package


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """Number the rows of each group from 1 in the given order.

    A plain window would sort a whole group in one task. Here rows are spread by
    range of (group, order) and numbered as they lie there; only a group that began in an earlier range
    is shifted, so there is at most one shift per range. The order must have no ties.
    """
    ship_package(df.sparkSession)
    group = list(group)
    keys = [F.col(g).asc() for g in group]
    placed = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_i", T.LongType())])
    spread = materialise(placed.mapInArrow(_counter(group), schema), "ranges")
    for g in group:
        spread = spread.where(F.col(g).isNotNull())
    sizes = spread.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(*group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    shifted = spread.join(F.broadcast(shifts.where("_shift > 0")), [*group, "_part"], "left")
    number = F.col("_i") + F.coalesce("_shift", F.lit(0))
    return shifted.select(*df.columns, number.alias(name))


def numbered_plainly(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """``numbered`` by column expressions alone, for operators that run no Python; it shuffles the rows once more.

    Rows are spread by range of (group, order), numbered inside each range by a window, and shifted by the sizes of the
    group's earlier ranges, so no task holds more than a range. The order must have no ties, nor the group nulls.
    """
    keys = [F.col(g).asc() for g in group]
    spread = materialise(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = spread.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(*group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy(*group, "_part").orderBy(*order)
    shifted = spread.withColumn("_i", F.row_number().over(inside)).join(shifts, [*group, "_part"])
    return shifted.select(*df.columns, (F.col("_i") + F.col("_shift")).alias(name))


def _counter(group: Sequence[str]):
    """Partition and number within its group of each row, the rows of a partition being sorted by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            for g in group:
                c = batch.column(batch.schema.get_field_index(g))
                new[1:] |= ~np.asarray(pc.fill_null(pc.equal(c[1:], c[:-1]), False))
            at = [batch.column(batch.schema.get_field_index(g)) for g in group]
            new[0] = last is not None and last != [c[0].as_py() for c in at]
            begins = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            i = np.where(begins < 0, seen + np.arange(n), np.arange(n) - begins) + 1
            last, seen = [c[n - 1].as_py() for c in at], int(i[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part), pa.int32()), pa.array(i, pa.int64())], names=[*batch.schema.names, "_part", "_i"])

    return run


def top_rows(df: DataFrame, group: Sequence[str], order: Sequence[Column], limit: int, name: str = "rank") -> DataFrame:
    """First ``limit`` rows of each group; Spark cuts each partition before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= limit)
