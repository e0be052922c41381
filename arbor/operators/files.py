"""Files as rows: language, text, hashes. Rows that come twice count once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import languages


def text_of(content: Column) -> Column:
    """UTF-8 text with '\\n' line ends; null where the bytes are not UTF-8."""
    raw = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string"))
    return F.regexp_replace(F.regexp_replace(raw, "\r\n", "\n"), "\r", "\n")


def with_language(files: DataFrame) -> DataFrame:
    return files.select("path", languages.language(F.col("path")).alias("language")).where("path is not null").distinct()


def scanned(files: DataFrame) -> DataFrame:
    """Paths of the extensions that a full index scans."""
    return files.select("path").where(languages.extension(F.col("path")).isin(list(languages.SCANNED))).distinct()


def tracked_paths(files: DataFrame) -> DataFrame:
    return files.select("path").where(languages.tracked(F.col("path"))).distinct()


def unskipped_paths(files: DataFrame) -> DataFrame:
    return files.select("path").where(~languages.skipped(F.col("path"))).distinct()


def content_hashes(files: DataFrame) -> DataFrame:
    """``(path, hash, size)``; hashed where it is scanned, so contents aren't shuffled. Null contents have a null hash."""
    return files.select("path", F.sha2("content", 256).alias("hash"), F.octet_length("content").cast("long").alias("size")).distinct()


def text_lengths(files: DataFrame) -> DataFrame:
    """``(path, n_chars, n_lines)``; a file that isn't UTF-8 counts as empty."""
    text = F.coalesce(text_of(F.col("content")), F.lit(""))
    return files.select("path", F.length(text).cast("long").alias("n_chars"), F.size(F.split(text, "\n", -1)).cast("long").alias("n_lines")).distinct()


def verify(files: DataFrame, expected: DataFrame) -> DataFrame:
    """``(path, verified)`` for each expected (path, hash); a missing file compares unequal."""
    own = content_hashes(files).where("hash is not null").select("path", F.col("hash").alias("own"))
    return expected.join(own, "path", "left").select("path", F.coalesce(F.lower("hash") == F.col("own"), F.lit(False)).alias("verified"))


def file_text(files: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """``(path, document, has_summary)``: what is embedded for a file. ``summaries`` has (path, summary), of several for one
    path the one that sorts last counts; an empty summary leaves no line but is one, a null summary is none."""
    body = text_of(F.col("content"))
    rows = files.where(body.isNotNull()).select("path", body.alias("body"))
    if summaries is None:
        rows = rows.withColumn("summary", F.lit(None).cast("string"))
    else:
        known = summaries.where("summary is not null").groupBy(F.col("path").alias("spath")).agg(F.max("summary").alias("summary"))
        rows = rows.join(known, F.col("path") == F.col("spath"), "left")
    line = F.when(F.length("summary") > 0, F.concat(F.lit("# Summary: "), F.col("summary")))
    return rows.select("path", F.concat_ws("\n", F.concat(F.lit("# File: "), F.col("path")), line, F.col("body")).alias("document"), F.col("summary").isNotNull().alias("has_summary")).distinct()


def strip_hash_lines(text: Column) -> Column:
    """Without lines that start with '#', then without white space at both ends."""
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda x: ~x.startswith("#")), "\n")
    return F.regexp_replace(kept, r"^\s+|\s+$", "")


def code_without_comments(files: DataFrame) -> DataFrame:
    body = text_of(F.col("content"))
    return files.where(body.isNotNull()).select("path", strip_hash_lines(body).alias("code")).distinct()


def tokens(chars: Column) -> Column:
    """The estimate of four characters per token."""
    return F.floor(chars / 4).cast("long")
