"""Definitions as rows: identity, keep-last, text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import text_of

COLUMNS = ("id", "name", "type", "file_path", "start_line", "end_line", "signature", "parent_class", "docstring", "seq")


def entity_id(entities: DataFrame) -> DataFrame:
    """``(seq, id)``: 'file::name' of every row; null if either is."""
    return entities.select("seq", F.concat("file_path", F.lit("::"), "name").alias("id"))


def keep_last(entities: DataFrame) -> DataFrame:
    """One row per id, that of the largest seq; of equal seq the row that sorts last. Combined before the
    shuffle, so an id with a third of all rows costs one row per task."""
    own = F.struct("seq", *[c for c in COLUMNS if c not in ("id", "seq")])
    return entities.where("id is not null").groupBy("id").agg(F.max(own).alias("r")).select("id", *[f"r.{c}" for c in COLUMNS if c != "id"])


def keep_first(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, that of the smallest order."""
    own = F.struct(order, *[c for c in rows.columns if c not in (key, order)])
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(own).alias("r")).select(key, "r.*")


def first_matches(entities: DataFrame) -> DataFrame:
    """``(name, id, seq)``: for every name the entity that was indexed first."""
    return entities.where("name is not null and seq is not null").groupBy("name").agg(F.min(F.struct("seq", "id")).alias("r")).select("name", "r.id", "r.seq")


def per_file(entities: DataFrame) -> DataFrame:
    """``(file_path, n_entities, names)``: distinct names, sorted and joined with commas."""
    return keep_last(entities).where("file_path is not null").groupBy("file_path").agg(F.count("*").alias("n_entities"), F.array_join(F.sort_array(F.collect_set("name")), ",").alias("names"))


def count_by_type(entities: DataFrame) -> DataFrame:
    return keep_last(entities).groupBy("type").agg(F.count("*").alias("n"))


def _lines(files: DataFrame) -> DataFrame:
    body = text_of(F.col("content"))
    return files.where(body.isNotNull()).select("path", F.split(body, "\n", -1).alias("lines")).groupBy("path").agg(F.max("lines").alias("lines"))


def line_slices(entities: DataFrame, files: DataFrame) -> DataFrame:
    """``(id, code)``: lines start_line to end_line of the entity's file, clamped to it. Null or
    reversed spans and missing files have no row."""
    spans = keep_last(entities).where("start_line is not null and end_line >= start_line").select("id", "file_path", F.greatest("start_line", F.lit(1)).alias("s"), F.col("end_line").alias("e"))
    joined = spans.join(_lines(files), F.col("file_path") == F.col("path"))
    return joined.select("id", F.array_join(F.expr("slice(lines, s, greatest(e - s + 1, 0))"), "\n").alias("code"))


def entity_text(entities: DataFrame, files: DataFrame) -> DataFrame:
    """``(id, document)``: what is embedded for an entity; empty class and documentation leave no line."""
    code = line_slices(entities, files).select(F.col("id").alias("cid"), "code")
    rows = keep_last(entities).join(code, F.col("id") == F.col("cid"))
    filled = lambda c: F.when(F.length(c) > 0, F.col(c))
    return rows.select("id", F.concat_ws(
        "\n", F.concat(F.lit("# "), "type", F.lit(": "), "name"), F.concat(F.lit("# File: "), "file_path"),
        F.concat(F.lit("# Class: "), filled("parent_class")), F.concat(F.lit("# Documentation: "), filled("docstring")), "code").alias("document"))
