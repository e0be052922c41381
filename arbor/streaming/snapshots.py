"""Snapshots that arrive as a stream of node rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.snapshots import SnapshotIndex, normalized_nodes


def follow(stream: DataFrame, changes_path: str, checkpoint: str) -> StreamingQuery:
    """Appends the changes of every snapshot of the stream to ``changes_path``.

    A micro-batch must hold whole snapshots (one delivery is one file of the source); within it they are taken
    in order of their id. Each snapshot's changes go to a folder of its own that is overwritten if it is taken again.

    The index of the last snapshot lives below the checkpoint, so a later run goes on from it. It is swapped when a
    snapshot's changes are written; a repeated batch goes on behind the last snapshot that was swapped. A
    snapshot that is older than the index, or the same again in a later batch, is an error: no change is dropped silently.
    """
    spark = stream.sparkSession
    index = SnapshotIndex(spark, f"{checkpoint}/arbor-index")

    def take(batch: DataFrame, number: int) -> None:
        rows = normalized_nodes(batch).persist()
        for r in rows.select("snapshot_id").distinct().orderBy("snapshot_id").collect():  # one row per snapshot
            state = index.state
            if state and r.snapshot_id <= state["snapshot"]:
                if state["note"] == number:
                    continue  # written before the batch was repeated
                raise ValueError(f"snapshot {r.snapshot_id} comes after {state['snapshot']}")
            changes = index.probe(rows.where(F.col("snapshot_id") == r.snapshot_id).select("path", "hash", "is_file"))
            if changes is not None:
                changes.withColumn("snapshot_id", F.lit(r.snapshot_id)).write.mode("overwrite").parquet(f"{changes_path}/batch={number}/snapshot={r.snapshot_id}")
            index.swap(r.snapshot_id, number)
        rows.unpersist()

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_rows(stream: DataFrame, delay: str = "30 days") -> DataFrame:
    """Streaming count and last delivery per snapshot and hour, with late rows up to ``delay``."""
    return stream.withWatermark("loaded_at", delay).groupBy("snapshot_id", F.window("loaded_at", "1 hour")).agg(F.count("*").alias("n"), F.max("loaded_at").alias("last"))
