import itertools
import random

from arbor.operators import entities as ent
from arbor.operators import graph


def _edges(spark, pairs):
    return spark.createDataFrame([(a, b, 1, "extra") for a, b in pairs], "src string, dst string, line int, id string")


def _entities(spark, items):
    return spark.createDataFrame([(f"{f}::{n}", n, "function", f, s, s + 1, None, None, None, q, "x") for q, (f, n, s) in enumerate(items)],
                                 "id string, name string, type string, file_path string, start_line int, end_line int, signature string, parent_class string, docstring string, seq long, kind string")


def test_edges_from_calls(spark, rows):
    entities = _entities(spark, [("m.c", "add", 1), ("m.c", "mul", 5), ("m.c", "fac", 12), ("main.c", "main", 1), ("m.c", "add", 30)])
    calls = spark.createDataFrame([
        ("mul", "add", "m.c", 7, 1), ("fac", "self.mul", "m.c", 15, 2), ("fac", "self.mul", "m.c", 16, 3), ("main", "fac", "main.c", 3, 4), (None, "add", "m.c", 1, 5), ("mul", None, "m.c", 1, 6), ("mul", "printf", "m.c", 2, 7),
    ], "caller string, callee string, file_path string, line_number int, seq long")
    assert rows(graph.build_edges(calls, entities).select("src", "dst", "line")) == [("m.c::fac", "m.c::mul", 16), ("m.c::mul", "m.c::add", 7)]
    wide = rows(graph.build_global_edges(calls, entities).select("src", "dst"))
    assert ("main.c::main", "m.c::fac") in wide and len(wide) == 3
    assert rows(ent.keep_last(entities).where("name = 'add'").select("start_line")) == [(30,)]
    assert rows(graph.file_dependencies(graph.build_global_edges(calls, entities))) == [("main.c", "m.c", "call", 1)]
    stats = graph.statistics(graph.build_edges(calls, entities), entities).first()
    assert (stats.total_entities, stats.total_calls, stats.total_files, stats.cycles, stats.avg_calls) == (4, 2, 2, 0, 0.5)


def _brute_scc(pairs, nodes):
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in pairs:
            for n in nodes:
                if a in reach[n]:
                    reach[n].add(b)
    return {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}


def test_components_equal_closure(spark):
    rng = random.Random(4)
    nodes = [f"n{i:02}" for i in range(24)]
    pairs = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(34)]
    got = {r.id: r.component for r in graph.components(_edges(spark, pairs), spark.createDataFrame([(n,) for n in nodes], "id string")).collect()}
    assert got == _brute_scc(pairs, nodes)


def test_impact_grows_with_depth_and_leaves_out_the_seed(spark):
    pairs = [("b", "a"), ("c", "b"), ("d", "c"), ("e", "d"), ("a", "c"), ("x", "x")]
    sizes = []
    for depth in (1, 2, 3):
        got = {(r.seed, r.id) for r in graph.impact(_edges(spark, pairs), depth=depth).collect()}
        assert all(s != i for s, i in got)
        sizes.append(got)
    assert sizes[0] <= sizes[1] <= sizes[2] and ("a", "d") in sizes[2] and ("a", "e") not in sizes[2]
    assert graph.impact(_edges(spark, pairs), spark.createDataFrame([("nobody",)], "seed string")).count() == 0


def test_chains_equal_brute_force(spark):
    rng = random.Random(2)
    nodes = list("abcdefg")
    pairs = {(rng.choice(nodes), rng.choice(nodes)) for _ in range(16)}
    expected = set()
    for n in range(len(nodes) - 1):
        for middle in itertools.permutations([x for x in nodes if x not in "ag"], n):
            path = ["a", *middle, "g"]
            if all(p in pairs for p in zip(path, path[1:])):
                expected.add(" -> ".join(path))
    asked = spark.createDataFrame([("a", "g"), ("a", "a"), ("a", "zz")], "start string, goal string")
    got = graph.call_chains(_edges(spark, pairs), asked)
    assert {r.chain for r in got.where("goal = 'g'").collect()} == expected and got.where("goal <> 'g'").count() == 0


def test_empty(spark, rows):
    none = spark.createDataFrame([], "src string, dst string, line int")
    assert rows(graph.impact(none)) == [] and graph.degrees(none).count() == 0
    assert rows(graph.components(none, spark.createDataFrame([("a",)], "id string"))) == [("a", "a")]


def test_scratch_is_released(spark):
    import os

    from arbor.storage import materialize, materialize_counted, scratch, shared_dir
    from pyspark.sql import functions as F

    root = shared_dir(spark).removeprefix("file://") + f"/arbor/{spark.sparkContext.applicationId}"
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    with scratch(spark):
        assert materialize(spark.range(3), "x").count() == 3
        table, counts = materialize_counted(spark.range(5), "y", F.count(F.lit(1)).alias("rows"))
        assert table.count() == counts["rows"] == 5 and len(os.listdir(root)) == len(before) + 1
    assert set(os.listdir(root)) == before
