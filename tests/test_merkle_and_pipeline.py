import hashlib
import os

from arbor.operators import graph, merkle
from arbor.plans import pipeline
from arbor.sources.tree import scan_tree


def _root(tree):
    """Nested dict of bytes -> hash, by the rule."""
    if isinstance(tree, bytes):
        return hashlib.sha256(tree).hexdigest()
    return hashlib.sha256("".join(sorted(_root(x) for x in tree.values())).encode()).hexdigest()


def _flat(tree, at=""):
    for name, x in tree.items():
        if isinstance(x, bytes):
            yield at + name, hashlib.sha256(x).hexdigest()
        else:
            yield from _flat(x, f"{at}{name}/")


TREE = {"a.py": b"x", "pkg": {"b.py": b"y", "deep": {"er": {"c.go": b"z"}}}, "lone": {"d.c": b"w"}}


def test_directory_hashes(spark, rows):
    files = spark.createDataFrame([(1, p, h, "extra") for p, h in _flat(TREE)] + [(1, "none", None, "")], "snapshot_id int, path string, hash string, level string")
    got = {r.path: r.hash for r in merkle.directory_hashes(files).collect()}
    assert got["."] == _root(TREE) and got["pkg"] == _root(TREE["pkg"]) and got["pkg/deep/er"] == _root(TREE["pkg"]["deep"]["er"])
    shuffled = files.repartition(3)
    assert rows(merkle.directory_hashes(shuffled)) == rows(merkle.directory_hashes(files))
    assert rows(merkle.directory_hashes(files.limit(0))) == []


def test_nested_documents_round_trip():
    flat = [{"path": p, "hash": h, "is_file": True, "size": 1, "mtime": 0.5} for p, h in _flat(TREE)]
    nested = merkle.to_nested(flat)
    again = [n for n in merkle.from_nested({"root": nested, "metadata": {}}) if n["is_file"]]
    assert again == sorted(flat, key=lambda n: n["path"])
    assert merkle.from_nested(nested) == merkle.from_nested({"root": nested})


def _write(root, path, text):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "w") as f:
        f.write(text)


C_FILES = {
    "math_ops.c": '#include "math_ops.h"\n\nint add(int a, int b) {\n    return a + b;\n}\n\nint multiply(int a, int b) {\n    int r = 0;\n    r = add(r, a);\n    return r;\n}\n\nint factorial(int n) {\n    return n < 2 ? 1 : multiply(n, factorial(n - 1));\n}\n',
    "math_ops.h": "int add(int a, int b);\nint multiply(int a, int b);\n",
    "util/__init__.py": "class A:\n    def run(self):\n        return helper()\n\n    def twin(self):\n        pass\n\n\ndef helper():\n    return 1\n",
    "node_modules/skip.js": "function no() { return 1; }\n",
    "notes.md": "text\n",
}


def test_index_and_increments(spark, tmp_path, rows):
    root, store = str(tmp_path / "src"), str(tmp_path / "store")
    for p, text in C_FILES.items():
        _write(root, p, text)
    assert {r.path for r in scan_tree(spark, root).collect()} == {"math_ops.c", "math_ops.h", "util/__init__.py"}
    first = pipeline.index_codebase(spark, root, store)
    assert (first["added"], first["modified"], first["deleted"]) == (3, 0, 0)
    tables = pipeline.tables(spark, store)
    assert rows(tables["edges"]) == [
        ("math_ops.c::factorial", "math_ops.c::factorial", 14), ("math_ops.c::factorial", "math_ops.c::multiply", 14), ("math_ops.c::multiply", "math_ops.c::add", 9),
        ("util/__init__.py::run", "util/__init__.py::helper", 3),
    ]
    assert {r.id for r in graph.impact(tables["edges"]).where("seed = 'math_ops.c::add'").collect()} == {"math_ops.c::multiply", "math_ops.c::factorial"}
    assert pipeline.index_codebase(spark, root, store)["unchanged"] == 3
    _write(root, "math_ops.c", "int add(int a, int b) {\n    return a;\n}\n")
    os.remove(os.path.join(root, "math_ops.h"))
    _write(root, "new.go", "package a\n\nfunc Run() int {\n\treturn 1\n}\n")
    third = pipeline.index_codebase(spark, root, store)
    assert (third["added"], third["modified"], third["deleted"], third["unchanged"]) == (1, 1, 1, 1)
    tables = pipeline.tables(spark, store)
    assert {r.id for r in tables["entities"].collect()} == {"math_ops.c::add", "new.go::Run", "util/__init__.py::A", "util/__init__.py::run", "util/__init__.py::twin", "util/__init__.py::helper"}
    assert {r.id for r in tables["entity_vectors"].collect()} == {r.id for r in tables["entities"].collect()}
    assert all(len(r.embedding) == 384 for r in tables["file_vectors"].collect()) and tables["file_vectors"].count() == 3
    forced = pipeline.index_codebase(spark, root, store, force=True)
    assert forced["entities_updated"] == 6


def test_a_run_that_ends_between_two_tables_changes_nothing(spark, tmp_path, rows, monkeypatch):
    root, store = str(tmp_path / "src"), str(tmp_path / "store")
    for p, text in C_FILES.items():
        _write(root, p, text)
    pipeline.index_codebase(spark, root, store)
    before = {name: rows(df.drop("embedding")) for name, df in pipeline.tables(spark, store).items()}
    _write(root, "math_ops.c", "int sub(int a) {\n    return a;\n}\n")

    def fail(*_):
        raise OSError("lost")

    publish = pipeline.publish
    monkeypatch.setattr(pipeline, "publish", fail)
    try:
        pipeline.index_codebase(spark, root, store)
    except OSError:
        pass
    assert {name: rows(df.drop("embedding")) for name, df in pipeline.tables(spark, store).items()} == before
    monkeypatch.setattr(pipeline, "publish", publish)
    assert pipeline.index_codebase(spark, root, store)["modified"] == 1
    tables = pipeline.tables(spark, store)
    assert {r.id for r in tables["entities"].collect()} == {"math_ops.c::sub", "util/__init__.py::A", "util/__init__.py::run", "util/__init__.py::twin", "util/__init__.py::helper"}
    assert len([d for d in os.listdir(store) if d.startswith("version-")]) == 2


def test_vectors_of_later_runs_are_of_the_first_runs_model(spark, tmp_path):
    from arbor.plans.codebase import Codebase

    root, store = str(tmp_path / "src"), str(tmp_path / "store")
    for p, text in C_FILES.items():
        _write(root, p, text)
    code = Codebase(spark, root, store)
    code.index()
    kept = {r.id: list(r.embedding) for r in code.table("entity_vectors").collect()}
    _write(root, "other.py", "def walk(tree):\n    return [walk(x) for x in tree]\n" * 20)
    code.index()
    again = {r.id: list(r.embedding) for r in code.table("entity_vectors").collect()}
    assert all(again[i] == v for i, v in kept.items()) and "other.py::walk" in again
    found = code.search_code(code.table("entity_vectors").where("id = 'util/__init__.py::helper'").first().document, 1).first()
    assert found.id == "util/__init__.py::helper" and found.distance == 0
    found = code.search_code(code.table("entity_vectors").where("id = 'other.py::walk'").first().document, 1).first()
    assert found.id == "other.py::walk" and found.distance == 0


def test_summaries(spark, tmp_path):
    root, store = str(tmp_path / "src"), str(tmp_path / "store")
    _write(root, "main.c", "int main(void) {\n    return 0;\n}\n")
    _write(root, "utils.c", "int f(void) {\n    return 0;\n}\n")
    pipeline.index_codebase(spark, root, store, summaries=spark.createDataFrame([("main.c", "Starts all"), ("none.c", "x"), ("utils.c", None)], "path string, summary string"))
    got = {r.file_path: (r.has_summary, r.document.split("\n")[1]) for r in pipeline.tables(spark, store)["file_vectors"].collect()}
    assert got == {"main.c": (True, "# Summary: Starts all"), "utils.c": (False, "int f(void) {")}


def test_saved_snapshots_are_swapped_whole(spark, tmp_path, rows, monkeypatch):
    path = str(tmp_path / "snap")
    at = lambda *data: spark.createDataFrame(list(data), "path string, hash string")
    for n in range(4):
        merkle.save_snapshot(at(("a", str(n))), path)
        assert rows(merkle.load_snapshot(spark, path)) == [("a", str(n))]
    monkeypatch.setattr(merkle, "publish", lambda *_: 1 / 0)
    try:
        merkle.save_snapshot(at(("b", "1")), path)
    except ZeroDivisionError:
        pass
    assert rows(merkle.load_snapshot(spark, path)) == [("a", "3")]
