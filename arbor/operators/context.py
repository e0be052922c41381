"""Contexts, token estimates and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rows import side_by_side
from ..storage import materialize
from .entities import keep_last
from .files import strip_hash_lines, text_lengths, tokens
from .graph import entity_neighbours, lines_of
from .vectors import keep_last_vector

#: US dollars per million input tokens.
PRICE = 0.150
TYPES = ("function", "class", "method", "constructor", "struct", "interface")


NOTHING = "No relevant code found for this question."
SKIPPED = "No language model was asked; the context holds the relevant code."
HEADING = "# Relevant Code Context\n"


def minimal_context(hits: DataFrame, edges: DataFrame, entities: DataFrame, most: int = 3) -> DataFrame:
    """``(id, context)`` for hits (id, document): a heading, place, the first ``most`` callees and callers, and the code without
    '#' lines. Of more neighbours than that none is gathered."""
    from pyspark.sql import Window

    own = keep_last(entities).select("id", "name", "type", "file_path", "start_line", "end_line")
    near = entity_neighbours(edges, entities, hits)
    few = near.withColumn("r", F.row_number().over(Window.partitionBy("id", "direction").orderBy("name", "file", "other"))).where(F.col("r") <= most)
    side = lambda d: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("direction") == d, F.struct("r", "name")))), lambda x: F.concat(F.lit("- "), x["name"])), ", ").alias(d)
    lists = few.groupBy(F.col("id").alias("k")).agg(side("calls"), side("called_by"))
    rows = hits.select("id", F.col("document").alias("doc")).join(own, "id").join(lists, F.col("id") == F.col("k"), "left")
    named = lambda label, c: F.when(F.length(c) > 0, F.concat(F.lit(label), F.col(c)))
    fence = "`" * 3
    return rows.where("doc is not null and name is not null").select("id", F.concat_ws(
        "\n", F.concat(F.lit("\n## "), F.initcap("type"), F.lit(": "), "name"), F.concat(F.lit("File: "), "file_path", F.lit(" (lines "), lines_of(), F.lit(")")),
        named("Calls: ", "calls"), named("Called by: ", "called_by"), F.lit("\n" + fence + "python"), strip_hash_lines(F.col("doc")), F.lit(fence + "\n")).alias("context"))


def question_contexts(questions: DataFrame, vectors: DataFrame, edges: DataFrame, entities: DataFrame, k: int = 5) -> DataFrame:
    """``(query_id, n_hits, context, tokens)`` for questions (query_id, vector): the contexts of the k nearest entities, nearest first,
    under one heading, and its token estimate. Questions without a hit have no row; hits that are no entity leave no part."""
    from .vectors import search

    rows = materialize(keep_last_vector(vectors.select("id", "embedding", "document")), "context-vectors")
    hits = materialize(search(rows, questions, k), "context-hits")
    parts = minimal_context(rows.select("id", "document").join(hits.select("id").distinct(), "id", "left_semi"), edges, entities)
    found = hits.join(parts, "id", "left").groupBy("query_id").agg(F.count("*").alias("n_hits"), F.array_sort(F.collect_list(F.struct("distance", "id", "context"))).alias("parts"))  # k parts
    text = F.concat_ws("\n", F.lit(HEADING), F.transform("parts", lambda p: p["context"]))
    return found.select("query_id", "n_hits", text.alias("context"), tokens(F.length(text)).alias("tokens"))


def token_estimates(vectors: DataFrame) -> DataFrame:
    """``(id, tokens)`` of each stored document."""
    return keep_last_vector(vectors.select("id", "document")).where("document is not null").select("id", tokens(F.length("document")).alias("tokens"))


def token_totals(contexts: DataFrame, files: DataFrame) -> DataFrame:
    """One row over several questions ``(query_id, tokens)``: each would need the tokens of all files, and needs those of its context.
    Totals, the mean saved per question, what is saved in percent and in money; zeros without questions or files."""
    naive = text_lengths(files).agg(tokens(F.coalesce(F.sum("n_chars"), F.lit(0))).alias("naive"))
    used = contexts.agg(F.count("*").alias("questions"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("optimized_tokens"))
    row = side_by_side(naive, used).withColumn("naive_tokens", F.col("naive") * F.col("questions"))
    saved = F.col("naive_tokens") - F.col("optimized_tokens")
    share = lambda part, whole, digits: F.coalesce(F.round(F.try_divide(part.cast("double"), whole.cast("double")), digits), F.lit(0.0))
    return row.select("questions", "naive_tokens", "optimized_tokens", saved.alias("savings"), share(saved, F.col("questions"), 4).alias("mean_savings"),
                      share(saved * 100, F.col("naive_tokens"), 4).alias("savings_percentage"), F.round(saved.cast("double") / 1e6 * PRICE, 6).alias("dollars_saved"))


def file_tree(files: DataFrame, most: int = 5, depth: int = 2) -> DataFrame:
    """``(directory, n_files, listing)`` of directories whose files have at most ``depth`` parts: the first names in order, then '... and N more'."""
    from .merkle import parent
    from pyspark.sql import Window

    rows = files.select("path").where("path is not null").distinct().where(F.size(F.split("path", "/")) <= depth)
    rows = rows.select(parent(F.col("path")).alias("directory"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name"))
    counts = rows.groupBy("directory").agg(F.count("*").alias("n_files"))
    # top names by bounded rank: the rank's limit is pushed into each task before the shuffle
    few = rows.withColumn("r", F.row_number().over(Window.partitionBy("directory").orderBy("name"))).where(F.col("r") <= most)
    listed = few.groupBy("directory").agg(F.array_join(F.sort_array(F.collect_list("name")), ", ").alias("names"))
    more = F.when(F.col("n_files") > most, F.concat(F.lit(", ... and "), (F.col("n_files") - most).cast("string"), F.lit(" more"))).otherwise(F.lit(""))
    return counts.join(listed, "directory").select("directory", "n_files", F.concat("names", more).alias("listing"))


def summary(files: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of project figures: files, entities by type, calls, calls per entity, cycles of more than one entity."""
    from .graph import statistics

    own = keep_last(entities)
    a = files.agg(F.count_distinct("path").alias("files"))
    b = own.agg(*[F.count_if(F.col("type") == t).alias(f"n_{t}") for t in TYPES])
    c = statistics(edges, entities).select(F.col("total_entities").alias("entities"), F.col("total_calls").alias("calls"), "avg_calls", "cycles")
    return side_by_side(a, b, c)


def summary_text(files: DataFrame, entities: DataFrame, edges: DataFrame, row=None) -> str:
    """The figures and the two upper levels of the tree, as text. Types without an entity have no line."""
    r = row or summary(files, entities, edges).first()
    lines = ["# Codebase Summary\n", f"Total Files: {r.files}", f"Total Entities: {r.entities}", "\n## Entity Distribution:"]
    lines += [f"- {t.title()}s: {r[f'n_{t}']}" for t in TYPES if r[f"n_{t}"]]
    lines += ["\n## Key Statistics:", f"- Average calls per entity: {r.avg_calls or 0:.2f}", f"- Circular dependencies: {r.cycles}", "\n## File Structure:"]
    for d in file_tree(files).orderBy("directory").collect():  # directories of the upper two levels
        *names, last = d.listing.split(", ")
        lines += [f"{d.directory}/", *(f"  - {n}" for n in names), f"  {last}" if last.startswith("... and ") else f"  - {last}"]
    return "\n".join(lines)


def change_report(edges: DataFrame, path: str | None = None, files: int = 5, names: int = 3) -> DataFrame:
    """``(changed_file, total_impacted_entities, impacted_files, listing)`` of a change of ``path``, or of each file: totals, and the first
    names of the first files in order, 'file: name, name' per line."""
    from pyspark.sql import Window

    from .graph import IMPACT_DEPTH, impact_by_file

    by_file = impact_by_file(edges, IMPACT_DEPTH, path)
    shown = F.concat("file_path", F.lit(": "), F.array_join(F.slice(F.split("names", ","), 1, names), ", "))
    first = Window.partitionBy("changed_file").orderBy("file_path")
    ranked = by_file.withColumn("line", F.when(F.row_number().over(first) <= files, F.struct("file_path", shown.alias("text"))))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list("line")), lambda x: x["text"]), "\n")  # ``files`` lines
    return ranked.groupBy("changed_file").agg(F.sum("n_entities").alias("total_impacted_entities"), F.count("*").alias("impacted_files"), lines.alias("listing"))


def answer(question: str, vectors: DataFrame, edges: DataFrame, entities: DataFrame, model, k: int = 5, llm=None, naive_tokens: int = 0) -> dict:
    """The whole path from a question to a context, the relevant entities, token figures and, with ``llm`` (a callable), an answer. An
    error of the callable becomes the answer's text. Without hits: a note, no entities and figures of no context."""
    from .vectors import embed

    spark = vectors.sparkSession
    asked = embed(model, spark.createDataFrame([(question,)], "document string")).select(F.lit(0).alias("query_id"), F.col("embedding").alias("vector"))
    from .vectors import search

    hits = search(vectors, asked, k).select("id", "distance").collect()  # k rows
    if not hits:
        return {"answer": NOTHING, "relevant_entities": [], "token_stats": token_stats(0, naive_tokens)}
    order = {h.id: n for n, h in enumerate(sorted(hits, key=lambda h: (h.distance, h.id)))}
    chosen = F.broadcast(spark.createDataFrame([(i,) for i in order], "id string"))  # k rows
    own = keep_last_vector(vectors.select("id", "document", "name", "type", "file_path", "start_line", "end_line")).join(chosen, "id")
    about = {r.id: r for r in own.select("id", "name", "type", "file_path", lines_of().alias("lines")).collect()}
    parts = {r.id: r.context for r in minimal_context(own.select("id", "document"), edges, entities).collect()}
    context = "\n".join([HEADING, *(parts[i] for i in order if i in parts)])
    out = {
        "question": question, "context": context, "token_stats": token_stats(len(context) // 4, naive_tokens),
        "relevant_entities": [{"name": about[i].name, "type": about[i].type, "file": about[i].file_path, "lines": about[i].lines} for i in order],
    }
    try:
        out["answer"] = llm(question, context) if llm else SKIPPED
    except Exception as e:  # whatever a given callable raises
        out["answer"] = f"Error querying LLM: {e}"
    return out


def token_stats(used: int, naive: int) -> dict:
    return {"naive_approach": naive, "optimized_approach": used, "savings": naive - used, "savings_percentage": (naive - used) / naive * 100 if naive else 0.0}
