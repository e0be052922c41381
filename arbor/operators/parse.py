"""Files to entities and calls, both from one pass over the contents."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.extract import PARSERS, extract, probed
from ..functions.languages import LANGUAGES, language

_SCHEMA = "file_path string, kind string, name string, type string, start_line int, end_line int, parent_class string, caller string, callee string, ordinal int"


def parsed(files: DataFrame) -> DataFrame:
    """One row per definition and per call (``kind``); paths without a language never reach Python. A file that
    fails gives no rows and doesn't fail the job."""
    def run(batches):
        for b in batches:
            out = [[] for _ in range(10)]
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found, calls = extract(path, content)
                for n, d in enumerate(found):
                    for column, x in zip(out, (path, "entity", d.name, d.type, d.start, d.end, d.parent, None, None, n)):
                        column.append(x)
                for n, c in enumerate(calls):
                    for column, x in zip(out, (path, "call", None, None, c.line, None, None, c.caller, c.callee, n)):
                        column.append(x)
            types = [pa.string()] * 4 + [pa.int32()] * 2 + [pa.string()] * 3 + [pa.int32()]
            names = [part.split()[0] for part in _SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names=names)

    rows = files.select("path", "content").where(language(F.col("path")).isNotNull() & F.col("content").isNotNull())
    return rows.mapInArrow(run, _SCHEMA)


def entities_of(rows: DataFrame) -> DataFrame:
    """``(id, name, type, file_path, start_line, end_line, signature, parent_class, docstring, seq)`` of parsed rows."""
    null = F.lit(None).cast("string")
    seq = F.xxhash64("file_path").bitwiseAND(F.lit((1 << 43) - 1)) * F.lit(1 << 20) + F.col("ordinal")
    return rows.where("kind = 'entity'").select(
        F.concat_ws("::", "file_path", "name").alias("id"), "name", "type", "file_path", "start_line", "end_line",
        null.alias("signature"), "parent_class", null.alias("docstring"), seq.alias("seq")).distinct()


def calls_of(rows: DataFrame) -> DataFrame:
    """``(caller, callee, file_path, line_number, seq)`` of parsed rows."""
    seq = F.xxhash64("file_path").bitwiseAND(F.lit((1 << 43) - 1)) * F.lit(1 << 20) + F.col("ordinal")
    return rows.where("kind = 'call'").select("caller", "callee", "file_path", F.col("start_line").alias("line_number"), seq.alias("seq")).distinct()


def availability(spark) -> DataFrame:
    """``(language, available)``: 1 if the language's parser, in a worker, reads a small probe as it should. Of the
    languages that are asked for, TypeScript has no parser of its own; its files are read as JavaScript."""
    def probe(batches):
        for b in batches:
            names = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([int(probed(x)) for x in names], pa.int32())], names=["language", "available"])

    asked = spark.createDataFrame([(x,) for x in sorted({*PARSERS, *LANGUAGES.values(), "typescript"})], "language string")
    return asked.mapInArrow(probe, "language string, available int")
