"""Session settings that the operators rely on. They are per session, not per query."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

from .storage import shared_dir

#: Rows and bytes a Python worker gets at once; texts may be long, so a batch stays small.
ARROW_ROWS, ARROW_BYTES = 256, 64 << 20


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable in every Python worker, wherever the driver was started."""
    context = spark.sparkContext
    if getattr(context, "_arbor_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    handle, made = tempfile.mkstemp(suffix=".zip")
    os.close(handle)
    try:
        with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(home):
                for name in sorted(names):
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.relpath(full, os.path.dirname(home)))
        jvm, shared = context._jvm, f"{shared_dir(spark)}/arbor/{context.applicationId}/package-{uuid.uuid4().hex}.zip"
        target = jvm.org.apache.hadoop.fs.Path(shared)
        target.getFileSystem(context._jsc.hadoopConfiguration()).copyFromLocalFile(jvm.org.apache.hadoop.fs.Path("file://" + made), target)
    finally:
        os.remove(made)
    context.addPyFile(shared)
    context._arbor_shipped = True


def tuned(spark: SparkSession) -> SparkSession:
    ship_package(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def local_session(cores: str = "8", memory: str = "12g", partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    return tuned(
        SparkSession.builder.master(f"local[{cores}]").appName("arbor")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
