"""Indexing a tree: scan, compare with the last snapshot, parse what changed, swap the tables."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.languages import language
from ..functions.rows import side_by_side
from ..operators import graph, parse, vectors
from ..operators.entities import entity_text
from ..operators.files import content_hashes, file_text, text_of
from ..sources.tree import scan_tree
from ..storage import children, current, drop_path, materialize, publish

TABLES = {
    "snapshot": "path string, hash string, size long",
    "entities": "id string, name string, type string, file_path string, start_line int, end_line int, signature string, parent_class string, docstring string, seq long",
    "calls": "caller string, callee string, file_path string, line_number int, seq long",
    "entity_vectors": "id string, embedding array<float>, document string, name string, type string, file_path string, start_line int, end_line int, parent_class string",
    "file_vectors": "id string, embedding array<float>, document string, file_path string, has_summary boolean",
    "edges": "src string, dst string, line int",
    "metadata": "last_indexed string, total_files long, total_entities long, total_calls long",
}


def tables(spark: SparkSession, store: str) -> dict[str, DataFrame]:
    """The tables of the store's current version, all of one run; empty ones where there is none."""
    state = current(spark, store)
    if state is None:
        return {name: spark.createDataFrame([], schema) for name, schema in TABLES.items()}
    return {name: spark.read.schema(schema).parquet(f"{store}/{state['version']}/{name}") for name, schema in TABLES.items()}


def embedder_of(spark: SparkSession, store: str):
    """The fitted model that made the store's vectors; None where they were made by a given one, or where there are none."""
    state = current(spark, store)
    return PipelineModel.load(f"{store}/{state['model']}") if state and state["model"] else None


def _replace(spark: SparkSession, store: str, new: dict[str, DataFrame], model: str | None) -> None:
    """All tables go into a folder of their own, which then becomes the current version. The version before is kept for
    readers that hold it; what else lies there (older versions, runs that ended early) is deleted."""
    before, version = current(spark, store), f"version-{uuid.uuid4().hex}"
    for name, df in new.items():
        df.write.parquet(f"{store}/{version}/{name}")
    publish(spark, store, {"version": version, "model": model})
    kept = {version, model, "current", *(before or {}).values()}
    for old in children(spark, store):
        if old not in kept:
            drop_path(spark, f"{store}/{old}")


def reset(spark: SparkSession, store: str) -> None:
    """Empties every table and forgets the model."""
    _replace(spark, store, {name: spark.createDataFrame([], schema) for name, schema in TABLES.items()}, None)


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(path, status)`` between two (path, hash) tables, unchanged ones included."""
    a, b = old.select("path", F.col("hash").alias("was")), new.select("path", F.col("hash").alias("now"))
    both = a.join(b, "path", "full_outer")
    status = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("was") == F.col("now"), "unchanged").otherwise("modified")
    return both.select("path", status.alias("status"))


def entity_vector_rows(entities: DataFrame, files: DataFrame, model) -> DataFrame:
    documents = entity_text(entities, files).select(F.col("id").alias("did"), "document")
    rows = entities.join(documents, F.col("id") == F.col("did")).dropDuplicates(["id"])
    return vectors.embed(model, rows).select("id", "embedding", "document", "name", "type", "file_path", "start_line", "end_line", F.coalesce("parent_class", F.lit("")).alias("parent_class"))


def file_vector_rows(files: DataFrame, model, summaries: DataFrame | None = None) -> DataFrame:
    rows = vectors.embed(model, file_text(files, summaries))
    return rows.select(F.md5("path").alias("id"), "embedding", "document", F.col("path").alias("file_path"), "has_summary")


def index_codebase(spark: SparkSession, root: str, store: str, force: bool = False, embedder=None, summaries: DataFrame | None = None) -> dict:
    """Brings the tables below ``store`` up to date with the tree at ``root`` and returns counts.

    The difference to the last snapshot is taken before that is replaced. Rows of changed and
    deleted files are replaced in every table, other rows are kept as they are. Without a change
    nothing is written. All tables are swapped at once: after a failure the version before is in force, and
    the next run does the work again.
    ``embedder`` is a fitted model; by default one is fitted on the first run's files and kept in the store, so that
    vectors of all runs and of questions can be compared. ``force`` indexes every file again and fits a new one, and
    so does a run without the embedder that earlier vectors were made by. ``summaries`` (path, summary) of files that
    are indexed in this run go into their documents.
    """
    files = materialize(scan_tree(spark, root), "index-files")
    fresh = content_hashes(files)
    old = tables(spark, store)
    diff = materialize(changes(old["snapshot"], fresh), "index-changes")
    counts = {r.status: r["count"] for r in diff.groupBy("status").count().collect()}
    stats = {name: counts.get(name, 0) for name in ("added", "modified", "deleted", "unchanged")}
    if not force and not (stats["added"] or stats["modified"] or stats["deleted"]):
        return stats | {"entities_updated": 0, "calls_updated": 0}
    state = current(spark, store)
    kept = None if force or embedder else embedder_of(spark, store)
    todo = diff.select("path") if force or not (embedder or kept) else diff.where("status <> 'unchanged'").select("path")
    changed = files.join(todo, "path", "left_semi")
    rows = materialize(parse.parsed(changed), "index-parsed")
    stale = todo.select(F.col("path").alias("file_path"))
    entities = parse.entities_of(rows)
    calls = parse.calls_of(rows)
    model, name = embedder or kept, state["model"] if kept else None
    if model is None:
        model, name = vectors.fit_embedder(file_text(files)), f"model-{uuid.uuid4().hex}"
        model.save(f"{store}/{name}")
    keep = lambda table: old[table].join(stale, "file_path", "left_anti").select(*old[table].columns)
    new = {
        "entities": keep("entities").unionByName(entities), "calls": keep("calls").unionByName(calls),
        "entity_vectors": keep("entity_vectors").unionByName(entity_vector_rows(entities, changed, model)),
        "file_vectors": keep("file_vectors").unionByName(file_vector_rows(changed, model, summaries)),
    }
    new = {table: materialize(df, f"index-{table}") for table, df in new.items()}
    new["edges"] = graph.build_edges(new["calls"], new["entities"])
    totals = side_by_side(new["entities"].agg(F.count_distinct("id").alias("total_entities")), fresh.agg(F.count("*").alias("total_files")), new["calls"].agg(F.count("*").alias("total_calls")))
    new["metadata"] = totals.select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("last_indexed"), "total_files", "total_entities", "total_calls")
    new["snapshot"] = fresh
    _replace(spark, store, new, name)
    return stats | {"entities_updated": entities.count(), "calls_updated": calls.count()}


def changed_entities(files: DataFrame, status: DataFrame) -> DataFrame:
    """Entities of the files that ``(path, status)`` names as added or modified: the set-at-a-time incremental step."""
    paths = status.where(F.col("status").isin("added", "modified")).select("path").distinct()
    source = files.where(language(F.col("path")).isNotNull() & text_of(F.col("content")).isNotNull()).join(paths, "path", "left_semi")
    return parse.entities_of(parse.parsed(source))
