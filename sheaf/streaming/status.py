"""Status clicks as a stream of field updates.

Every micro-batch is appended to a change log; nothing else is rewritten.
Readers fold the log by event time, so the result does not depend on how events
were cut into batches. ``compact`` folds the log into a new snapshot from time to time, and
always before the store itself is written (``pipeline.collect``).
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sheaf.operators.store import fold
from sheaf.sources.records import SnapshotStore, _exists, _fs, delete

UPDATE = (
    "source_hash string, relevant boolean, applied boolean, applied_date timestamp, "
    "at struct<ts: timestamp, event_id: bigint>"
)


def updates(events: DataFrame, key: Column, relevant: Column, applied: Column) -> DataFrame:
    """Events ``(ts, event_id, ..)`` as rows of UPDATE; null means unchanged.

    Marking as applied sets the date; taking the mark back leaves the stored one.
    """
    return events.select(
        key.alias("source_hash"),
        relevant.alias("relevant"),
        applied.alias("applied"),
        F.when(applied, F.col("ts").cast("timestamp")).alias("applied_date"),
        F.struct(F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("bigint").alias("event_id")).alias("at"),
    ).where("relevant is not null or applied is not null")


def fold_updates(rows: DataFrame) -> DataFrame:
    """One row per key: the last value given for each field."""
    return fold(rows, "at")


class ChangeLog:
    """Appended update rows, one folder per micro-batch.

    Writing a batch again replaces its folder, so a repeated batch does no harm.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def append(self, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(self._batch(batch_id))

    def _batch(self, batch_id: int) -> str:
        return os.path.join(self.path, f"batch={batch_id}")

    def batches(self) -> list[int]:
        """Ids of the batches that are there, in order."""
        fs, root = _fs(self.spark, self.path)
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(int(n[6:]) for n in names if n.startswith("batch=") and _exists(self.spark, os.path.join(self.path, n, "_SUCCESS")))

    def read(self, after: int = -1) -> DataFrame:
        """Rows of all batches with an id above ``after``."""
        if not any(b > after for b in self.batches()):
            return self.spark.createDataFrame([], UPDATE)
        rows = self.spark.read.schema(UPDATE + ", batch bigint").parquet(self.path)
        return rows.where(F.col("batch") > after).drop("batch")

    def trim(self, upto: int) -> None:
        """Delete the batches up to an id, once a snapshot holds them."""
        for batch in self.batches():
            if batch <= upto:
                delete(self.spark, self._batch(batch))


def start(events: DataFrame, log: ChangeLog, checkpoint: str, **trigger) -> StreamingQuery:
    """Run a stream of UPDATE rows into the log."""
    return (
        events.writeStream.foreachBatch(log.append)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def current(store: DataFrame, log: DataFrame) -> DataFrame:
    """The store with all logged updates applied; updates of unknown keys are left out."""
    last = fold_updates(log).select(
        "source_hash",
        F.col("relevant").alias("new_relevant"),
        F.col("applied").alias("new_applied"),
        F.col("applied_date").alias("new_date"),
    )
    return (
        store.join(last, "source_hash", "left")
        .withColumns(
            {
                "relevant": F.coalesce("new_relevant", "relevant"),
                "applied": F.coalesce("new_applied", "applied"),
                "applied_date": F.coalesce("new_date", "applied_date"),
            }
        )
        .select(store.columns)
    )


def folded(store: SnapshotStore) -> int:
    """Id of the last batch that some snapshot has folded; later writes of the store do not undo that."""
    tags = [t for _, t, _ in store._complete() if t and t.startswith("log-")]
    return max((int(t[4:]) for t in tags), default=-1)


def live(store: SnapshotStore, log: ChangeLog) -> DataFrame:
    """The newest snapshot with the updates that came after the last fold.

    A batch that was folded counts no more: what the store has been told since, such as a record collected
    anew, stands.
    """
    return current(store.read(), log.read(folded(store)))


def compact(store: SnapshotStore, log: ChangeLog) -> str | None:
    """Fold the log into a new snapshot and delete what was folded; None where there is nothing to fold.

    The snapshot's tag names the last batch, so a run that died between both steps is finished by the next.
    """
    done = folded(store)
    last = max(log.batches(), default=-1)
    if last <= done:
        log.trim(done)
        return None
    path = store.write(live(store, log), f"log-{last}")
    log.trim(last)
    return path
