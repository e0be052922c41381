"""One object for a code base: index it, ask about it."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import context, entities, files, graph, merkle, parse, vectors
from ..session import tuned
from ..sources.tree import scan_tree
from . import pipeline


class Codebase:
    """Tables of the tree at ``root``, kept below ``store``. Methods that return a DataFrame are lazy."""

    def __init__(self, spark: SparkSession, root: str, store: str, embedder=None, llm: Callable[[str, str], str] | None = None):
        self.spark, self.root, self.store, self.embedder, self.llm = tuned(spark), root, store, embedder, llm

    def table(self, name: str) -> DataFrame:
        return pipeline.tables(self.spark, self.store)[name]

    def index(self, force: bool = False, summaries: DataFrame | None = None) -> dict:
        return pipeline.index_codebase(self.spark, self.root, self.store, force, self.embedder, summaries)

    def reset(self) -> None:
        """Empties every table."""
        pipeline.reset(self.spark, self.store)

    # snapshots
    def changed_files(self) -> DataFrame:
        """``(path, status)`` of the tree against the stored snapshot."""
        return pipeline.changes(self.table("snapshot"), files.content_hashes(scan_tree(self.spark, self.root)))

    def file_hash(self, path: str) -> str | None:
        row = self.table("snapshot").where(F.col("path") == path).select("hash").first()
        return row and row.hash

    def verify_file(self, path: str, expected: str) -> bool:
        return self.file_hash(path) == expected

    def root_hash(self) -> str | None:
        rows = self.table("snapshot").select(F.lit(1).alias("snapshot_id"), "path", "hash")
        found = merkle.directory_hashes(rows).where("path = '.'").first()
        return found and found.hash

    def snapshot_json(self) -> str:
        """The snapshot as one nested document, for exchange; it is as large as the list of files."""
        rows = [r.asDict() for r in self.table("snapshot").select("path", "hash", F.lit(True).alias("is_file"), "size").collect()]
        nested = merkle.to_nested(rows)
        for r in merkle.directory_hashes(self.table("snapshot").select(F.lit(1).alias("snapshot_id"), "path", "hash")).collect():
            node = nested
            for part in [] if r.path == merkle.ROOT else r.path.split("/"):
                node = node["children"][part]
            node["hash"] = r.hash
        return json.dumps({"root": nested, "metadata": {"root_path": self.root, "file_count": len(rows)}})

    def load_snapshot_json(self, document: str) -> DataFrame:
        """``(path, hash, is_file, size, mtime)`` of a nested document, with or without metadata."""
        rows = [(n["path"], n["hash"], n["is_file"], n["size"], n["mtime"]) for n in merkle.from_nested(document)]
        return self.spark.createDataFrame(rows, "path string, hash string, is_file boolean, size long, mtime double")

    # graph
    def edges(self, resolve: str = "file") -> DataFrame:
        """``resolve='global'`` adds calls whose callee name is unique in the code base."""
        return self.table("edges") if resolve == "file" else graph.build_global_edges(self.table("calls"), self.table("entities"))

    def dependencies(self, entity: str) -> DataFrame:
        return graph.neighbours(self.edges(), entity)

    def file_dependencies(self, path: str) -> DataFrame:
        found = graph.file_dependencies(self.edges("global"))
        return found.where((F.col("from_file") == path) | (F.col("to_file") == path))

    def call_chain(self, start: str, goal: str) -> DataFrame:
        return graph.call_chains(self.edges(), self.spark.createDataFrame([(start, goal)], "start string, goal string"))

    def components(self) -> DataFrame:
        return graph.components(self.edges(), self.table("entities"))

    def impacted_entities(self, entity: str, depth: int = graph.IMPACT_DEPTH) -> DataFrame:
        return graph.impact(self.edges(), self.spark.createDataFrame([(entity,)], "seed string"), depth).select("id")

    def impacted_by_change(self, path: str, resolve: str = "file") -> DataFrame:
        """``(changed_file, file_path, n_entities, names)``."""
        return graph.impact_by_file(self.edges(resolve), graph.IMPACT_DEPTH, path)

    def change_report(self, path: str, resolve: str = "file") -> DataFrame:
        """Totals and the first names of the first files, one row; none if nothing is reached."""
        return context.change_report(self.edges(resolve), path)

    def entity_context(self, name: str, path: str | None = None) -> DataFrame:
        """Context of the first entity of that name (and file); empty if there is none."""
        rows = self.table("entities").where(F.col("name") == name)
        if path is not None:
            rows = rows.where(F.col("file_path") == path)
        first = rows.orderBy("seq", "id").select("id").limit(1)
        return graph.entity_context(self.edges(), self.table("entities"), first)

    def export_graph(self, path: str) -> None:
        own = self.edges("global")
        graph.export(self.edges(), self.table("entities"), graph.file_dependencies(own)).write.mode("overwrite").json(path)

    def statistics(self) -> dict:
        row = graph.statistics(self.edges(), self.table("entities")).first().asDict()
        row |= vectors.statistics(self.table("entity_vectors"), self.table("file_vectors")).withColumnsRenamed({"total_entities": "entity_vectors", "total_files": "file_vectors"}).first().asDict()
        row["by_type"] = {r.type: r.n for r in entities.count_by_type(self.table("entities")).collect()}
        return row

    # vectors
    def model(self):
        """The model of the stored vectors; before the first run, one of no texts."""
        return self.embedder or pipeline.embedder_of(self.spark, self.store) or vectors.fit_embedder(self.table("file_vectors"))

    def _search(self, rows: DataFrame, question: str, k: int) -> DataFrame:
        asked = vectors.embed(self.model(), self.spark.createDataFrame([(question,)], "document string"))
        return vectors.search(rows, asked.select(F.lit(0).alias("query_id"), F.col("embedding").alias("vector")), k).select("id", "distance")

    def search_code(self, question: str, k: int = 5, kind: str | None = None) -> DataFrame:
        """``(id, name, type, file_path, start_line, end_line, distance, document)``, nearest first; ``kind`` filters before the search."""
        rows = self.table("entity_vectors")
        rows = rows if kind is None else rows.where(F.col("type") == kind)
        hits = F.broadcast(self._search(rows, question, k))  # k rows
        return rows.join(hits, "id").orderBy("distance", "id").select("id", "name", "type", "file_path", "start_line", "end_line", "distance", "document")

    def search_files(self, question: str, k: int = 3) -> DataFrame:
        rows = self.table("file_vectors")
        hits = F.broadcast(self._search(rows, question, k))  # k rows
        return rows.join(hits, "id").orderBy("distance", "id").select("id", "file_path", "has_summary", "distance", "document")

    # reports
    def answer(self, question: str, k: int = 5, use_llm: bool = False) -> dict:
        return context.answer(question, self.table("entity_vectors"), self.edges(), self.table("entities"), self.model(), k, self.llm if use_llm else None, self.naive_tokens())

    def naive_tokens(self) -> int:
        """Tokens of all tracked files, from the stored documents without their headings."""
        body = F.when(F.col("has_summary"), F.regexp_replace("document", r"^# File: [^\n]*\n(# Summary: [^\n]*\n)?", "")).otherwise(F.regexp_replace("document", r"^# File: [^\n]*\n", ""))
        row = self.table("file_vectors").agg(F.sum(F.length(body)).alias("n")).first()
        return (row.n or 0) // 4

    def token_report(self, questions: Sequence[str]) -> dict:
        """Totals, means, percent and money saved over several questions; zeros without questions."""
        stats = [self.answer(q)["token_stats"] for q in questions]
        naive, used = sum(s["naive_approach"] for s in stats), sum(s["optimized_approach"] for s in stats)
        saved, n = naive - used, max(1, len(questions))
        return {
            "questions": len(questions), "naive_tokens": naive, "optimized_tokens": used, "savings": saved, "mean_savings": saved / n,
            "savings_percentage": saved / naive * 100 if naive else 0.0, "naive_dollars": naive / 1e6 * context.PRICE,
            "optimized_dollars": used / 1e6 * context.PRICE, "dollars_saved": saved / 1e6 * context.PRICE,
        }

    def summary(self) -> str:
        """Figures and the upper levels of the tree, as text."""
        return context.summary_text(self.table("snapshot"), self.table("entities"), self.edges())

    def languages(self) -> DataFrame:
        return parse.availability(self.spark)
