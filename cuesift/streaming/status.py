"""The newest state of every job target, kept current from a stream of events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.status import ACTIVE
from ..sources.changes import read_stamps, write_stamp

# Newest state per job; a job's later event overrides its earlier one.
JOB_STATES = "job_id long, type string, status string, target_id long, event_id long"


def newest_states(events: DataFrame) -> DataFrame:
    """``events(job_id, type, status, target_id, event_id)`` to one row per job."""
    newest = F.max_by(F.struct("type", "status", "target_id", "event_id"), F.col("event_id"))
    return events.groupBy("job_id").agg(newest.alias("s")).select("job_id", "s.*")


def stream_job_states(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Add the newest state of each job of every micro-batch to the folder ``path``.

    Nothing stored is read or rewritten; ``job_states`` takes the newest event of
    each job, which makes a repeated or late batch harmless.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        write_stamp(newest_states(batch), path, batch_id)

    return (
        events.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


_STATE = "type string, status string, target_id long, event_id long"

# The store that keeps keyed state between micro-batches.
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Newest(StatefulProcessor):
    """The newest event of one job; only an event that is newer changes it and is passed on."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", _STATE)

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        last = self.newest.get()[3] if self.newest.exists() else None
        best = None
        for part in rows:
            row = part.loc[part["event_id"].idxmax()]
            if best is None or row["event_id"] > best["event_id"]:
                best = row
        if best is not None and (last is None or best["event_id"] > last):
            state = (best["type"], best["status"], int(best["target_id"]), int(best["event_id"]))
            self.newest.update(state)
            yield pd.DataFrame([(key[0], *state)], columns=["job_id", "type", "status", "target_id", "event_id"])

    def close(self) -> None:
        pass


def job_changes(events: DataFrame) -> DataFrame:
    """The stream of ``events(job_id, type, status, target_id, event_id)`` cut down to what changes a job.

    Each job's newest event is kept as state. Events that come late or again
    leave it as it is and go no further, so what follows handles changes alone.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    return events.groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=_Newest(), outputStructType=JOB_STATES, outputMode="Update", timeMode="None"
    )


def stream_job_changes(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Store the changes of every micro-batch, one row for each job it changes."""

    def store(batch: DataFrame, batch_id: int) -> None:
        write_stamp(batch, path, batch_id)

    return (
        job_changes(events)
        .writeStream.foreachBatch(store)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def job_states(spark: SparkSession, path: str) -> DataFrame:
    """The newest state of every job in the folder ``path``."""
    return newest_states(read_stamps(spark, path, JOB_STATES).drop("stamp"))


def compact_job_states(spark: SparkSession, path: str, to: str) -> None:
    """One row per job as a new folder, which a stream may go on with."""
    write_stamp(job_states(spark, path), to, -1)


def active_status(states: DataFrame) -> DataFrame:
    """``asset_id, active_status`` of the newest active extraction per asset."""
    active = states.where((F.col("type") == "extract") & F.col("status").isin(ACTIVE))
    return active.groupBy(F.col("target_id").alias("asset_id")).agg(
        F.max_by("status", "job_id").alias("active_status")
    )
