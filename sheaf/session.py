"""Session settings and durable intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession

_SHIPPED: set[str] = set()
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "sheaf", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tested under.

    ``master`` is left to spark-submit unless given.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a folder in the warehouse stands in, which all executors share as well.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return folder or os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_sheaf_scratch")


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Jobs that begin here leave no shuffle files once they have ended; for results that are taken once."""
    former = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if former is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, former)


def materialise(df: DataFrame, label: str, *more: DataFrame) -> DataFrame:
    """Write ``df`` once to the scratch folder and read it back, with the rows of ``more`` behind it, a job each.

    Used where a result is read several times, and to cut the lineage of loops:
    the files outlive a lost executor. The schema is handed over, so reading
    back starts no job. Shuffle files of the job go when it ends, not only when the driver collects garbage.
    """
    spark = df.sparkSession
    path = os.path.join(scratch_dir(spark), f"{label}-{uuid.uuid4().hex}")
    for part in (df, *more):
        with tidy(spark):
            part.write.mode("append").option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete materialised tables that nothing will read again, as a loop does with those of past rounds."""
    for table in tables:
        path = getattr(table, "scratch_path", None)
        if path:
            spark = table.sparkSession
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt out by ``key`` ahead of heavy row-wise work, however the files were cut.

    Adaptive execution joins small partitions again.
    """
    return df.repartition(key)


def dealt(df: DataFrame, *keys: Column | str) -> DataFrame:
    """Rows dealt out by ``keys`` to all partitions of the session, ahead of work that makes much more of each row.

    Adaptive execution judges partitions by what comes in, so it would join too many of them here.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application.

    Needed before any step that runs in Python workers.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="sheaf-code-"), "sheaf.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)
