"""The call graph: resolution, edges, neighbours, impact, paths, components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rows import side_by_side
from ..storage import materialize, materialize_counted
from .entities import keep_last

#: Defaults of impact depth and path length in edges.
IMPACT_DEPTH, PATH_EDGES = 3, 10
#: Joins between two written tables where a spread over the graph is repeated until it settles.
HOPS = 2


def _last_per_site(calls: DataFrame) -> DataFrame:
    """Calls of one caller to one callee in one file, reduced to the last line (by seq). This comes before
    any join: a file or callee with a third of all calls shrinks to its distinct pairs."""
    rows = calls.where("caller is not null and callee is not null and file_path is not null")
    return rows.groupBy("file_path", "caller", "callee").agg(F.max(F.struct("seq", "line_number")).alias("last"))


def resolve_calls(calls: DataFrame, entities: DataFrame) -> DataFrame:
    """``(src, dst, seq, line)``: the callee's full text, else its last dotted part, found among the names of the same file."""
    names = keep_last(entities).select(F.col("file_path").alias("f"), F.col("name").alias("n")).distinct()
    sites = _last_per_site(calls).withColumn("simple", F.element_at(F.split("callee", r"\."), -1))
    full = names.select(F.col("f").alias("f1"), F.col("n").alias("n1"))
    part = names.select(F.col("f").alias("f2"), F.col("n").alias("n2"))
    found = sites.join(full, (F.col("file_path") == F.col("f1")) & (F.col("callee") == F.col("n1")), "left")
    found = found.join(part, (F.col("file_path") == F.col("f2")) & (F.col("simple") == F.col("n2")), "left")
    name = F.coalesce("n1", "n2")
    return found.where(name.isNotNull()).select(F.concat("file_path", F.lit("::"), "caller").alias("src"), F.concat("file_path", F.lit("::"), name).alias("dst"), F.col("last.seq").alias("seq"), F.col("last.line_number").alias("line"))


def build_edges(calls: DataFrame, entities: DataFrame) -> DataFrame:
    """``(src, dst, line)``: resolved calls whose both ends are entities; one edge per pair, its last line."""
    ids = keep_last(entities).select("id")
    rows = resolve_calls(calls, entities)
    rows = rows.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return rows.groupBy("src", "dst").agg(F.max(F.struct("seq", "line")).alias("last")).select("src", "dst", F.col("last.line").alias("line"))


def build_global_edges(calls: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges as above, and beyond the file where the callee's name (full, else last part) is unique in the whole code base."""
    own = keep_last(entities).select("id", "name", "file_path")
    unique = own.groupBy("name").agg(F.count("*").alias("n"), F.max("id").alias("target")).where("n = 1 and name is not null").select(F.col("name").alias("un"), "target")
    sites = _last_per_site(calls).withColumn("src", F.concat("file_path", F.lit("::"), "caller")).withColumn("simple", F.element_at(F.split("callee", r"\."), -1))
    sites = sites.join(own.select(F.col("id").alias("src")), "src", "left_semi")
    a, b = unique.select(F.col("un").alias("u1"), F.col("target").alias("t1")), unique.select(F.col("un").alias("u2"), F.col("target").alias("t2"))
    # one row per callee text first, so that a callee with most calls isn't joined call by call
    texts = sites.select("callee", "simple").distinct().join(a, F.col("callee") == F.col("u1"), "left").join(b, F.col("simple") == F.col("u2"), "left")
    texts = texts.select("callee", F.coalesce("t1", "t2").alias("dst")).where("dst is not null")
    wide = sites.join(texts, "callee").select("src", "dst", F.col("last.line_number").alias("line"), F.col("last.seq").alias("seq"))
    wide = wide.groupBy("src", "dst").agg(F.max(F.struct("seq", "line")).alias("last")).select("src", "dst", F.col("last.line").alias("line"))
    near = build_edges(calls, entities)
    return near.unionByName(wide.join(near, ["src", "dst"], "left_anti"))


def file_of(node):
    return F.regexp_extract(node, r"^(.*)::[^:]*$", 1)


def file_dependencies(edges: DataFrame) -> DataFrame:
    """``(from_file, to_file, type, n)`` of edges that leave their file."""
    pairs = edges.select(file_of(F.col("src")).alias("from_file"), file_of(F.col("dst")).alias("to_file")).where("from_file <> to_file")
    return pairs.groupBy("from_file", "to_file").agg(F.count("*").alias("n")).select("from_file", "to_file", F.lit("call").alias("type"), "n")


def degrees(edges: DataFrame) -> DataFrame:
    """``(id, n_calls, n_called_by)``."""
    both = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return both.groupBy("id").agg(F.sum("o").alias("n_calls"), F.sum("i").alias("n_called_by"))


def neighbours(edges: DataFrame, node: str) -> DataFrame:
    """``(direction, id)`` of one node; an unknown node has none."""
    out = edges.where(F.col("src") == node).select(F.lit("calls").alias("direction"), F.col("dst").alias("id"))
    return out.unionAll(edges.where(F.col("dst") == node).select(F.lit("called_by").alias("direction"), F.col("src").alias("id")))


def entity_neighbours(edges: DataFrame, entities: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``(id, direction, other, name, file)``: one row per callee ('calls') and caller ('called_by') of every entity, or of those in
    ``nodes`` (id). Neighbours that are no entity are left out, unknown nodes have no row."""
    own = keep_last(entities).select(F.col("id").alias("other"), "name", F.col("file_path").alias("file"))
    both = edges.select(F.col("src").alias("id"), F.lit("calls").alias("direction"), F.col("dst").alias("other")).unionAll(
        edges.select(F.col("dst").alias("id"), F.lit("called_by").alias("direction"), F.col("src").alias("other")))
    if nodes is not None:
        both = both.join(nodes.select("id").distinct(), "id", "left_semi")
    return both.join(own, "other").select("id", "direction", "other", "name", "file").distinct()


def entity_context(edges: DataFrame, entities: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``(id, name, type, file_path, lines, parent_class, calls, called_by)``: neighbours as arrays of {name, file}, sorted. An
    entity's row holds all its neighbours; ``entity_neighbours`` has them row by row."""
    own = keep_last(entities).select("id", "name", "type", "file_path", "start_line", "end_line", "parent_class")
    if nodes is not None:
        own = own.join(nodes.select("id").distinct(), "id", "left_semi")
    near = entity_neighbours(edges, entities, nodes)
    side = lambda d: F.array_sort(F.collect_list(F.when(F.col("direction") == d, F.struct("name", "file")))).alias(d)
    lists = near.groupBy(F.col("id").alias("k")).agg(side("calls"), side("called_by"))
    none = F.array().cast("array<struct<name:string,file:string>>")
    return own.join(lists, F.col("id") == F.col("k"), "left").select("id", "name", "type", "file_path", lines_of().alias("lines"), "parent_class", F.coalesce("calls", none).alias("calls"), F.coalesce("called_by", none).alias("called_by"))


def lines_of():
    """'start-end', with '?' for what is not known."""
    return F.concat(F.coalesce(F.col("start_line").cast("string"), F.lit("?")), F.lit("-"), F.coalesce(F.col("end_line").cast("string"), F.lit("?")))


def impact(edges: DataFrame, seeds: DataFrame | None = None, depth: int = IMPACT_DEPTH) -> DataFrame:
    """``(seed, id)``: who reaches a seed in at most ``depth`` calls, without the seed. All seeds at once; pairs that were
    reached before are not followed again. Without ``seeds`` every callee is one."""
    edges = materialize(edges.select("src", "dst").distinct(), "impact-edges")
    start = edges.select(F.col("dst").alias("seed")).distinct() if seeds is None else seeds.select("seed").distinct()
    front = start.select("seed", F.col("seed").alias("id"))
    seen = front
    for step in range(depth):
        near = front.join(edges, F.col("id") == F.col("dst")).select("seed", F.col("src").alias("id")).distinct()
        front = near.join(seen, ["seed", "id"], "left_anti")
        if step + 1 < depth:
            front = materialize(front, "impact-front")
        seen = seen.unionByName(front)
    return seen.where("id <> seed")


def impact_by_file(edges: DataFrame, depth: int = IMPACT_DEPTH, path: str | None = None) -> DataFrame:
    """``(changed_file, file_path, n_entities, names)``: what a change of a file (of ``path``, or of each) reaches, by file. A file's
    own entities count if another one of its entities reaches them."""
    seeds = None if path is None else edges.select(F.col("dst").alias("seed")).where(file_of(F.col("seed")) == path)
    pairs = impact(edges, seeds, depth).select(file_of(F.col("seed")).alias("changed_file"), "id").distinct()
    named = pairs.select("changed_file", file_of(F.col("id")).alias("file_path"), F.regexp_extract("id", r"([^:]*)$", 1).alias("name"))
    return named.groupBy("changed_file", "file_path").agg(F.count("*").alias("n_entities"), F.array_join(F.sort_array(F.collect_set("name")), ",").alias("names"))


def call_chains(edges: DataFrame, pairs: DataFrame, most: int = PATH_EDGES) -> DataFrame:
    """``(start, goal, chain)``: all simple paths of at most ``most`` edges for each (start, goal); a path to itself is none. Their number
    can grow exponentially with the graph's density, so ask for pairs of sparse graphs."""
    edges = materialize(edges.select("src", "dst").where("src <> dst").distinct(), "chain-edges")
    front = pairs.select("start", "goal").distinct().where("start <> goal").select("start", "goal", F.array("start").alias("path"))
    done = None
    for step in range(most):
        last = F.element_at("path", -1)
        near = front.join(edges, last == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        near = materialize(near.select("start", "goal", F.array_append("path", F.col("dst")).alias("path")), "chain-front")
        hits = near.where(F.element_at("path", -1) == F.col("goal"))
        done = hits if done is None else done.unionByName(hits)
        front = near.where(F.element_at("path", -1) != F.col("goal"))
        if step + 1 < most and front.isEmpty():
            break
    return done.select("start", "goal", F.array_join("path", " -> ").alias("chain"))


def _settled(start: DataFrame, step, label: str) -> DataFrame:
    """Repeats a step on a frame whose rows only get fewer until their number stays. HOPS steps make one written
    table; a step names its frame once, so plans stay in proportion to the steps."""
    now, size = start, -1
    while size:
        for _ in range(HOPS):
            now = step(now)
        before, (now, counts) = size, materialize_counted(now, label, F.count(F.lit(1)).alias("rows"))
        size = counts["rows"]
        if size == before:
            break
    return now


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(id, component)``: strongly connected components, named by their smallest id; nodes on no cycle are alone.

    Nodes are kept that paths of any length lead to, and from. Each takes the smallest id that reaches it and the
    smallest that it reaches. Where both are one, that id's component is found, whole. Members of a component agree in both,
    so of the other edges only those between nodes that agree are looked at again. Both directions spread in
    one frame, HOPS joins per written table, until nothing changes.
    """
    rest = materialize(edges.select("src", "dst").where("src <> dst").distinct(), "scc-edges")
    found = None
    while not rest.isEmpty():
        two = _both_ways(rest)
        live = _settled(two.select("way", F.col("b").alias("id")).distinct(), lambda x, e=two: e.join(x.withColumnRenamed("id", "a"), ["way", "a"], "left_semi").select("way", F.col("b").alias("id")).distinct(), "scc-live")
        both = live.groupBy("id").agg(F.count("*").alias("ways")).where("ways = 2").select("id")
        rest = rest.join(both.withColumnRenamed("id", "src"), "src", "left_semi").join(both.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")
        rest = materialize(rest, "scc-edges")
        if rest.isEmpty():
            break
        met = _met(rest)
        ends = met.groupBy("id").agg(*[F.max(F.when(F.col("way") == way, F.col("c"))).alias(name) for way, name in ((0, "by"), (1, "to"))])
        ends = materialize(ends, "scc-ends")
        whole = ends.where("by = to").select("id", F.col("by").alias("component"))
        found = whole if found is None else found.union(whole)
        open_ = ends.where("by <> to")
        rest = rest.join(open_.select(F.col("id").alias("src"), "by", "to"), "src").join(open_.withColumnRenamed("id", "dst"), ["dst", "by", "to"]).select("src", "dst")
        rest = materialize(rest, "scc-edges")
    alone = nodes.select("id").distinct()
    if found is None:
        return alone.select("id", F.col("id").alias("component"))
    named = found.withColumnRenamed("id", "fid")
    return alone.join(named, F.col("id") == F.col("fid"), "left").select("id", F.coalesce("component", "id").alias("component"))


def _both_ways(edges: DataFrame) -> DataFrame:
    """``(way, a, b)``: every edge along (0) and against (1) its direction."""
    return edges.select(F.lit(0).alias("way"), F.col("src").alias("a"), F.col("dst").alias("b")).unionAll(edges.select(F.lit(1).alias("way"), F.col("dst").alias("a"), F.col("src").alias("b")))


def _met(edges: DataFrame) -> DataFrame:
    """``(way, id, c)``: the smallest id that reaches a node (way 0) and that it reaches (way 1), itself included."""
    two = _both_ways(edges)
    ends = two.select("way", F.col("a").alias("id")).unionAll(two.select("way", F.col("b").alias("id"))).distinct()
    loops = materialize(two.unionAll(ends.select("way", F.col("id").alias("a"), F.col("id").alias("b"))), "scc-loops")
    now = materialize(ends.select("way", "id", F.col("id").alias("c")), "scc-met")
    while True:
        for _ in range(HOPS):  # a node's edge to itself brings what it had before
            moved = loops.join(now.select("way", F.col("id").alias("a"), "c"), ["way", "a"])
            now = moved.groupBy("way", F.col("b").alias("id")).agg(F.min("c").alias("c"), F.max(F.when(F.col("a") == F.col("b"), F.col("c"))).alias("was"))
        now, counts = materialize_counted(now, "scc-met", F.count_if(F.col("c") != F.col("was")).alias("moved"))
        if not counts["moved"]:  # the last of the joins moved nothing
            return now.select("way", "id", "c")


def statistics(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """One row: entities, calls, files, average calls per entity (0 if there are none), cycles of more than one node."""
    own = keep_last(entities)
    counts = own.agg(F.count("*").alias("total_entities"), F.count_distinct("file_path").alias("total_files"))
    calls = edges.agg(F.count("*").alias("total_calls"))
    cycles = components(edges, own).groupBy("component").count().where("count > 1").agg(F.count("*").alias("cycles"))
    row = side_by_side(counts, calls, cycles)
    average = F.coalesce(F.round(F.try_divide(F.col("total_calls").cast("double"), F.col("total_entities").cast("double")), 6), F.lit(0.0))
    return row.select("total_entities", "total_calls", "total_files", average.alias("avg_calls"), "cycles")


def export(edges: DataFrame, entities: DataFrame, dependencies: DataFrame) -> DataFrame:
    """``(section, json)`` lines: entities, calls and file dependencies of the graph, for df.write.text or json."""
    own = keep_last(entities).select(F.lit("entities").alias("section"), F.to_json(F.struct("id", "name", "type", F.col("file_path").alias("file"), "start_line", "end_line", "parent_class"), {"ignoreNullFields": "false"}).alias("json"))
    calls = edges.select(F.lit("calls").alias("section"), F.to_json(F.struct(F.col("src").alias("from"), F.col("dst").alias("to"), "line"), {"ignoreNullFields": "false"}).alias("json"))
    files = dependencies.select(F.lit("file_dependencies").alias("section"), F.to_json(F.struct(F.col("from_file").alias("from"), F.col("to_file").alias("to"), "type")).alias("json"))
    return own.unionAll(calls).unionAll(files)
