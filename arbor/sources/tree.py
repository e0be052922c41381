"""A directory tree as a table: a Python data source over os.walk.

Spark's own file source hides names that start with '_' or '.'. The driver lists
paths only and prunes ignored directories before it enters them; executors read the files.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, content binary, size long, mtime double"
#: Bytes of files per partition.
CHUNK = 32 << 20


class _Chunk(InputPartition):
    def __init__(self, root: str, paths: list[str]):
        self.root, self.paths = root, paths


class _TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.all = options["path"], options.get("all", "false") == "true"

    def partitions(self):
        from ..functions.languages import is_ignored_directory, is_tracked

        chunks, paths, size = [], [], 0
        for folder, directories, names in os.walk(self.root, onerror=lambda e: None):
            if not self.all:
                directories[:] = [d for d in directories if not is_ignored_directory(d)]
            directories.sort()
            for name in sorted(names):
                path = os.path.relpath(os.path.join(folder, name), self.root).replace(os.sep, "/")
                if self.all or is_tracked(path):
                    paths.append(path)
                    try:
                        size += os.path.getsize(os.path.join(folder, name))
                    except OSError:
                        pass
                    if size >= CHUNK or len(paths) >= 10_000:
                        chunks.append(_Chunk(self.root, paths))
                        paths, size = [], 0
        return chunks + [_Chunk(self.root, paths)]

    def read(self, partition):
        for path in partition.paths:
            full = os.path.join(partition.root, path)
            try:
                if not os.path.isfile(full):
                    continue
                with open(full, "rb") as f:
                    content = f.read()
                yield (path, content, len(content), os.stat(full).st_mtime)
            except OSError:  # an unreadable file is skipped
                continue


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(self.options)


def scan_tree(spark: SparkSession, root: str, everything: bool = False) -> DataFrame:
    """``(path, content, size, mtime)`` of the tracked files below ``root`` (of all with ``everything``), paths relative to it."""
    spark.dataSource.register(TreeSource)
    return spark.read.format("source_tree").option("all", str(everything).lower()).load(root)
