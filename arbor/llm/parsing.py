"""Problem 3: source files that do not parse."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .syntax.check import EXTENSIONS, decode, language, syntax_errors

_REPORT = "path string, repo string, lang string, accepted boolean, n_errors int, first_line int, first_cause string, errors array<struct<line:int,cause:string>>"


def _sources(files: DataFrame) -> DataFrame:
    rows = files.select(F.col("path").cast("string").alias("path"), F.col("repo").cast("string").alias("repo"), F.col("content").cast("binary").alias("content"))
    return rows.where(F.lower(F.regexp_extract("path", r"[^/\\]\.([A-Za-z]+)$", 1)).isin(sorted(EXTENSIONS)) & F.col("content").isNotNull())


def parse_report(files: DataFrame, positions: bool = True) -> DataFrame:
    """``(path, repo, lang, accepted, n_errors, first_line, first_cause, errors)``, one row per
    input row with content whose extension has a language; every error is kept.

    The language is that of the extension. Null contents and unknown extensions have no row;
    an empty file is valid but for Go, which wants a package clause, and Java, C and JavaScript accept
    it. With ``positions`` off, lines are 0 (cheaper). Rows are independent: no shuffle, no row limit.
    """
    kind = pa.list_(pa.struct([("line", pa.int32()), ("cause", pa.string())]))

    def run(batches):
        for b in batches:
            langs = [language(p) for p in b.column(0).to_pylist()]
            found = [syntax_errors(lang, decode(c), positions) for lang, c in zip(langs, b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([
                b.column(0), b.column(1), pa.array(langs, pa.string()), pa.array([not e for e in found], pa.bool_()), pa.array([len(e) for e in found], pa.int32()),
                pa.array([e[0][0] if e else None for e in found], pa.int32()), pa.array([e[0][1] if e else None for e in found], pa.string()),
                pa.array([[{"line": n, "cause": why} for n, why in e] for e in found], kind),
            ], names=["path", "repo", "lang", "accepted", "n_errors", "first_line", "first_cause", "errors"])

    return _sources(files).mapInArrow(run, _REPORT)


def invalid_files(files: DataFrame) -> DataFrame:
    """``(path)``, distinct: files that don't parse."""
    return parse_report(files, positions=False).where("not accepted").select("path").distinct()


def rates(files: DataFrame) -> DataFrame:
    """``(repo, lang, files, invalid, rate)``: a path that comes twice counts once, and as invalid if one of its rows is."""
    per_path = parse_report(files, positions=False).groupBy("path").agg(F.max("repo").alias("repo"), F.max("lang").alias("lang"), F.min("accepted").alias("accepted"))
    return per_path.groupBy("repo", "lang").agg(F.count("*").alias("files"), F.count_if(~F.col("accepted")).alias("invalid")).withColumn("rate", F.round(F.col("invalid") / F.col("files"), 6))


#: Ways in which a valid file is changed: kept, cut off before its last bracket, left with the mark of a merge, given another language's extension.
BROKEN = ("whole", "cut", "merge", "extension")


def broken(files: DataFrame) -> DataFrame:
    """``(path, content)`` of files ``(path, content)`` of UTF-8 text in each way of BROKEN; the way leads the path."""
    text = F.col("content").cast("string")
    other = F.when(F.col("path").endswith(".py"), "py.js").otherwise("x.py")
    ways = {"whole": (F.col("path"), text), "cut": (F.col("path"), F.regexp_replace(text, r"[)}][^)}]*$", "")),
            "merge": (F.col("path"), F.concat(F.lit("<<<<<<< ours\n"), text)), "extension": (F.concat("path", F.lit("."), other), text)}
    made = F.array(*[F.struct(F.concat(F.lit(way + "/"), path).alias("path"), F.encode(content, "UTF-8").alias("content")) for way, (path, content) in ways.items()])
    return files.select(F.explode(made).alias("m")).select("m.path", "m.content")
