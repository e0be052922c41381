"""Problem 6: what changed between full snapshots.

A bucketed index (key -> hash) of the last snapshot is kept in shared storage, under a pointer that
names it and its snapshot. A new snapshot is brought to one row per key, bucketed alike and probes
the index, both in one merge of equal buckets without a shuffle: keys that miss are added, keys whose
hash differs are modified, index keys that were not probed are deleted. When the changes
are written, the pointer is swapped and the index before the last is dropped. Index entries hold the
key and a 128-bit digest; old values are looked up for changed keys only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import one_spelling
from ..storage import children, current, drop_path, publish, scratch_path

#: Buckets of an index: at least BUCKETS, and no more than about BUCKET_ROWS keys in each.
BUCKETS, BUCKET_ROWS = 32, 4_000_000
_CHANGES = "snapshot_id int, path string, status string"


def normalized_nodes(nodes: DataFrame) -> DataFrame:
    """One row per (snapshot_id, path): the latest loaded_at, paths and hashes in one spelling. Among equal
    loaded_at the largest (hash, is_file) counts; a null loaded_at is the earliest. Null snapshots or paths are dropped."""
    rows = nodes.select(
        F.col("snapshot_id").cast("int").alias("snapshot_id"), one_spelling(F.col("path").cast("string")).alias("path"),
        F.struct(F.col("loaded_at"), F.lower("hash").alias("hash"), F.col("is_file").cast("boolean").alias("is_file")).alias("row"),
    ).where("snapshot_id is not null and path is not null")
    return rows.groupBy("snapshot_id", "path").agg(F.max("row").alias("row")).select("snapshot_id", "path", "row.hash", "row.is_file")


class SnapshotIndex:
    """The index of the last snapshot, bucketed by key, in a folder that any later session can open."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets, self.fresh = spark, folder, buckets, None

    @property
    def state(self) -> dict | None:
        """{snapshot, name, buckets, before, note} of the last swap."""
        return current(self.spark, self.folder)

    def _table(self, name: str, buckets: int) -> DataFrame:
        """The index of that name; its files are registered anew in a session that doesn't know them."""
        self.spark.sql(f"create table if not exists arbor_index_{name} (path string, digest string) using parquet clustered by (path) sorted by (path) into {buckets} buckets location '{self.folder}/{name}'")
        return self.spark.table(f"arbor_index_{name}")

    def _drop(self, name: str) -> None:
        self.spark.sql(f"drop table if exists arbor_index_{name}")
        drop_path(self.spark, f"{self.folder}/{name}")

    def probe(self, snapshot: DataFrame) -> DataFrame | None:
        """Takes (path, hash, is_file), one row per path; the changes (path, status) against the
        current index, or None for the first snapshot. Nothing is swapped."""
        state, name = self.state, uuid.uuid4().hex
        buckets = state["buckets"] if state else self.buckets
        digest = F.md5(F.concat_ws("|", F.coalesce("hash", F.lit("?")), F.coalesce(F.col("is_file").cast("string"), F.lit("?"))))
        (snapshot.select("path", digest.alias("digest")).repartition(buckets, "path").write.bucketBy(buckets, "path").sortBy("path")
            .format("parquet").option("path", f"{self.folder}/{name}").saveAsTable(f"arbor_index_{name}"))
        self.fresh = name, buckets
        if not state:
            return None
        old = self._table(state["name"], buckets).withColumnRenamed("digest", "was")
        both = old.join(self._table(name, buckets), "path", "full_outer")
        status = F.when(F.col("was").isNull(), "added").when(F.col("digest").isNull(), "deleted").when(F.col("was") != F.col("digest"), "modified")
        return both.select("path", status.alias("status")).where("status is not null")

    def swap(self, snapshot_id: int, note: int | None = None) -> None:
        """Makes the index of the last probe the current one; call it when that probe's changes are written."""
        state, (name, buckets) = self.state, self.fresh
        publish(self.spark, self.folder, {"snapshot": snapshot_id, "name": name, "buckets": buckets, "before": state and state["name"], "note": note})
        for old in children(self.spark, self.folder):  # the one before the last, and those of runs that ended before their swap
            if old not in (name, state and state["name"], "current"):
                self._drop(old)


def _stored(nodes: DataFrame) -> DataFrame:
    """The rows of all snapshots, stored by snapshot, so that one of them is read alone."""
    path = scratch_path(nodes.sparkSession, "snapshot-rows")
    rows = normalized_nodes(nodes)
    rows.write.partitionBy("snapshot_id").parquet(path)
    return nodes.sparkSession.read.schema("path string, hash string, is_file boolean, snapshot_id int").parquet(path)


def _changes(rows: DataFrame, ids: list[int]) -> DataFrame:
    spark = rows.sparkSession
    out = scratch_path(spark, "snapshot-changes")
    index = SnapshotIndex(spark, scratch_path(spark, "snapshot-index"), max(BUCKETS, rows.count() // (BUCKET_ROWS * max(1, len(ids)))))
    for snapshot in ids:
        changes = index.probe(rows.where(F.col("snapshot_id") == snapshot).select("path", "hash", "is_file"))
        if changes is not None:
            changes.write.parquet(f"{out}/snapshot_id={snapshot}")
        index.swap(snapshot)
    if len(ids) < 2:
        return spark.createDataFrame([], _CHANGES)
    return spark.read.schema("path string, status string, snapshot_id int").parquet(out).select("snapshot_id", "path", "status")


def _ids(rows: DataFrame) -> list[int]:
    return [r.snapshot_id for r in rows.select("snapshot_id").distinct().orderBy("snapshot_id").collect()]  # one row per snapshot


def snapshot_changes(nodes: DataFrame) -> DataFrame:
    """``(snapshot_id, path, status)`` for every snapshot after the first; status is added, modified or deleted.

    Snapshots are neighbours in order of their id, gaps or not. One snapshot, or an empty table, has no changes.
    """
    rows = _stored(nodes)
    return _changes(rows, _ids(rows))


def changed_values(nodes: DataFrame) -> DataFrame:
    """The changes with old and new hash; values are fetched for changed paths only, in one pass over the rows."""
    rows = _stored(nodes)
    ids = _ids(rows)
    changes = _changes(rows, ids)
    before = F.element_at(F.create_map(*[F.lit(x) for pair in zip(ids[1:], ids) for x in pair]), F.col("snapshot_id")) if len(ids) > 1 else F.lit(None).cast("int")
    sides = F.array(*[F.struct(F.lit(side).alias("side"), at.alias("at")) for side, at in (("new", F.when(F.col("status") != "deleted", F.col("snapshot_id"))), ("old", F.when(F.col("status") != "added", before)))])
    wanted = changes.select("snapshot_id", "path", "status", F.explode(sides).alias("s")).select("snapshot_id", "path", "status", "s.*").where("at is not null")
    found = wanted.join(rows.select(F.col("snapshot_id").alias("at"), "path", "hash"), ["at", "path"])
    own = lambda side: F.max(F.when(F.col("side") == side, F.col("hash"))).alias(f"{side}_hash")
    return found.groupBy("snapshot_id", "path", "status").agg(own("old"), own("new"))
