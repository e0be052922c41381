"""Shared storage: where intermediate tables live and how lineage is cut.

Everything that has to outlive an executor is written below the folder that the
cluster names in ``spark.checkpoint.dir``; a private one is set only where the
setting is missing (tests, single machine).
"""

from __future__ import annotations

import json
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one where the session has none."""
    known = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{_SETTING} must name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="arbor-")
    spark.conf.set(_SETTING, made)
    return made


_WITHIN: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the application's own part of the shared folder."""
    within = "".join(f"/{x}" for x in _WITHIN)
    return f"{shared_dir(spark)}/arbor/{spark.sparkContext.applicationId}{within}/{label}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession):
    """Intermediate tables that are made within are deleted at the end; write results before."""
    _WITHIN.append(f"scope-{uuid.uuid4().hex}")
    path = f"{shared_dir(spark)}/arbor/{spark.sparkContext.applicationId}/" + "/".join(_WITHIN)
    try:
        yield
    finally:
        _WITHIN.pop()
        drop_path(spark, path)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` once to shared storage and reads it back: lineage ends here
    and a lost executor costs nothing that was finished."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_counted(df: DataFrame, label: str, *counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """The same, with named aggregates of the rows that were written, taken in the same job."""
    seen = Observation(f"arbor-{uuid.uuid4().hex}")
    path = scratch_path(df.sparkSession, label)
    df.observe(seen, *counts).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get


def _at(spark: SparkSession, path: str):
    """(Hadoop's file system of a path, the path)."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder."""
    files, target = _at(spark, path)
    files.delete(target, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where there is no folder."""
    files, target = _at(spark, path)
    return [x.getPath().getName() for x in files.listStatus(target)] if files.exists(target) else []


def _published(spark: SparkSession, folder: str) -> list[int]:
    return sorted(int(name.removesuffix(".json")) for name in children(spark, f"{folder}/current") if name.endswith(".json") and name[:1] != ".")


def publish(spark: SparkSession, folder: str, record: dict) -> None:
    """Makes ``record`` the current one of a folder. It is written aside and renamed to the next number, so
    readers see the one before or this one, on every file system; older ones than the last two are deleted."""
    known = _published(spark, folder)
    number = (known[-1] if known else 0) + 1
    files, aside = _at(spark, f"{folder}/current/.{uuid.uuid4().hex}")
    out = files.create(aside)
    out.writeBytes(json.dumps(record))  # plain ASCII
    out.close()
    if not files.rename(aside, _at(spark, f"{folder}/current/{number}.json")[1]):
        raise OSError(f"can't publish {number} in {folder}")
    for old in known[:-1]:
        files.delete(_at(spark, f"{folder}/current/{old}.json")[1], False)


def current(spark: SparkSession, folder: str) -> dict | None:
    """The current record of a folder, None where nothing was published."""
    known = _published(spark, folder)
    if not known:
        return None
    files, target = _at(spark, f"{folder}/current/{known[-1]}.json")
    stream = files.open(target)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def release_scratch(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this application; results that weren't written yet can't be computed afterwards."""
    drop_path(spark, f"{shared_dir(spark)}/arbor/{spark.sparkContext.applicationId}")
