import pytest

from arbor.functions import languages
from arbor.functions.extract import extract
from arbor.operators import context, files, vectors

SOURCES = {
    "a.py": ("class A:\n    def m(self):\n        return f(1)\n\ndef f(x):\n    def g():\n        return x.y.z()\n    return g()\n",
             {("A", "class", 1, 3, None), ("m", "method", 2, 3, "A"), ("f", "function", 5, 8, None), ("g", "function", 6, 7, None)}, {("m", "f", 3), ("g", "x.y.z", 7), ("f", "g", 8)}),
    "a.c": ("struct s { int x; };\nint proto(int a);\nstatic int *f(int a) {\n  /* g( */ return g(a, h(\")\"));\n}\n",
            {("s", "struct", 1, 1, None), ("f", "function", 3, 5, None)}, {("f", "g", 4), ("f", "h", 4)}),
    "A.java": ("package a;\nclass B {\n  B(int x) { this.x = x; }\n  int run() { if (x > 0) { go(); } return new C().y(); }\n}\n",
               {("B", "class", 2, 5, None), ("B", "constructor", 3, 3, "B"), ("run", "method", 4, 4, "B")}, {("run", "go", 4)}),
    "a.js": ("class K {\n  go(a) { return this.b(a); }\n}\nfunction top(x) {\n  if (x) { return k.go(x); }\n}\n",
             {("K", "class", 1, 3, None), ("go", "method", 2, 2, "K"), ("top", "function", 4, 6, None)}, {("go", "this.b", 2), ("top", "k.go", 5)}),
    "a.go": ("package a\n\ntype S struct {\n\tx int\n}\n\nfunc (s *S) Run() int {\n\treturn help(s.x)\n}\n\nfunc help(x int) int {\n\treturn x\n}\n",
             {("S", "struct", 3, 5, None), ("Run", "method", 7, 9, "S"), ("help", "function", 11, 13, None)}, {("Run", "help", 8)}),
}


@pytest.mark.parametrize("path", sorted(SOURCES))
def test_extract(path):
    text, entities, calls = SOURCES[path]
    found, called = extract(path, text.encode())
    assert {tuple(d) for d in found} == entities and calls <= {tuple(c) for c in called}


def test_unreadable_files_give_nothing():
    assert extract("a.py", b"def f(:") == ([], []) and extract("a.py", b"\xff\xfe") == ([], []) and extract("a.txt", b"x") == ([], []) and extract("a.py", None) == ([], [])


BROKEN = """import os
class A(B):
    x = [1, 2
    def m(self):
        print "text", f(1)
        return g(self)
    def n(self)
        if h(x) then:
            k.run()
        s = '''def no():
  pass'''

<<<<<<< HEAD
def open_(a, b=0:
    return a.b(c)[0].d()
=======
@deco
def after(a):
    def inner():
        return z()
    return inner
>>>>>>> x
"""


def test_python_with_errors_keeps_what_stands_around_them():
    found, calls = extract("a.py", BROKEN.encode())
    assert {tuple(d) for d in found} == {("A", "class", 2, 11, None), ("m", "method", 4, 6, "A"), ("n", "method", 7, 11, "A"), ("open_", "function", 14, 15, None), ("after", "function", 18, 21, None), ("inner", "function", 19, 20, None)}
    assert {tuple(c) for c in calls} == {("m", "f", 5), ("m", "g", 6), ("n", "h", 8), ("n", "k.run", 9), ("open_", "a.b", 15), ("open_", "d", 15), ("inner", "z", 20)}
    text = SOURCES["a.py"][0]
    assert extract("a.py", (text + "x = = 1\n").encode()) == extract("a.py", text.encode())


def test_tracking(spark):
    cases = {"src/a.py": True, "build/a.py": False, "README.md": False, "Makefile": True, "x/go.sum": False, "a/__init__.py": True, ".gitignore": True, "x.min.js": False, "a.PY": True, "noext": False, "vendor/x.go": False, "x/.eslintrc.json": True}
    df = spark.createDataFrame([(p,) for p in cases], "path string")
    got = {r.path: r.t for r in df.select("path", languages.tracked(df.path).alias("t")).collect()}
    assert got == cases == {p: languages.is_tracked(p) for p in cases}


def test_text_functions(spark, rows):
    table = spark.createDataFrame([("a.c", b"#x\r\ncode\n#y\n  z \n"), ("bad.c", b"\xff\xfe\xfa"), ("e.c", b""), ("n.c", None)], "path string, content binary")
    assert rows(files.code_without_comments(table)) == [("a.c", "code\n  z"), ("e.c", "")]
    assert ("bad.c", 0, 1) in rows(files.text_lengths(table)) and rows(files.verify(table, spark.createDataFrame([("zz", "1")], "path string, hash string"))) == [("zz", False)]


def test_search_ties_nulls_and_lengths(spark, rows):
    data = [(i, [float(i % 3), 0.0], "x") for i in range(9)] + [(20, None, "x"), (21, [1.0], "x"), (22, [float("nan"), 0.0], "x")]
    table = spark.createDataFrame(data, "id long, embedding array<float>, distance string")
    asked = spark.createDataFrame([(7, [0.0, 0.0]), (8, None)], "query_id long, vector array<float>")
    assert rows(vectors.search(table, asked, 4)) == [(7, 0, 0.0), (7, 1, 1.0), (7, 3, 0.0), (7, 6, 0.0)]
    assert vectors.search(table.limit(0), asked, 3).count() == 0 and vectors.search(table, asked.limit(0), 3).count() == 0


LARGE = {
    "a.c": "static int f{n}(int a, struct s *b) {{\n    if (a > 0) {{ return g(a, h(b)); }}\n    return f{n}(a - 1, b);\n}}\n",
    "a.go": "func f{n}(a int, b interface{{}}) error {{\n\tif a > 0 {{ return g(a, h(b)) }}\n\treturn f{n}(a - 1, b)\n}}\n",
    "a.js": "function f{n}(a, b) {{\n    if (a > 0) {{ return g(a, h(b)); }}\n    return f{n}(a - 1, b);\n}}\n",
}


@pytest.mark.parametrize("path", LARGE)
def test_large_files_take_time_in_proportion(path):
    import time

    def seconds(n):
        text = "".join(LARGE[path].format(n=k) for k in range(n)).encode()
        began = time.process_time()
        found, calls = extract(path, text)
        took = time.process_time() - began
        assert [d.name for d in found] == [f"f{k}" for k in range(n)] and len(calls) == 3 * n and {c.caller for c in calls} == {d.name for d in found}
        return took

    assert seconds(16_000) < 60 * max(0.02, seconds(1000))  # 1.7 MB


@pytest.mark.parametrize("path", ("a.c", "a.java", "a.js", "a.go"))
@pytest.mark.parametrize("junk", (b"int ", b"( ", b"a . ", b"/* ", b"{ ", b"x = {", b"static ", b"class A ", b"func (a ", b"func f(", b"List<a> ", b"class A { m() {"))
def test_odd_text_takes_no_longer(path, junk):
    import time

    began = time.process_time()
    extract(path, junk * 20_000 + b"f() {}\n")
    assert time.process_time() - began < 5


def test_upsert_delete_and_totals(spark, rows):
    table = spark.createDataFrame([("a", "f1", "12345678"), ("b", "f2", None), ("a", "f1", "12345678")], "id string, file_path string, document string")
    one = vectors.keep_last_vector(table)
    assert rows(vectors.upsert(one, spark.createDataFrame([("a", "f1", "new")], table.schema))) == [("a", "f1", "new"), ("b", "f2", None)]
    assert [r.id for r in vectors.delete_files(one, spark.createDataFrame([("f1",)], "path string")).collect()] == ["b"]
    none = spark.createDataFrame([], "path string, content binary")
    contexts = spark.createDataFrame([("q1", 10), ("q2", 5)], "query_id string, tokens long")
    total = context.token_totals(contexts, none).first()
    assert (total.questions, total.naive_tokens, total.optimized_tokens, total.mean_savings, total.savings_percentage) == (2, 0, 15, -7.5, 0.0)
    some = spark.createDataFrame([("a.py", b"x" * 400), ("a.py", b"x" * 400), ("b.py", None)], none.schema)
    total = context.token_totals(contexts, some).first()
    assert (total.naive_tokens, total.savings, total.mean_savings, total.savings_percentage) == (200, 185, 92.5, 92.5)
    total = context.token_totals(contexts.limit(0), some).first()
    assert (total.questions, total.naive_tokens, total.mean_savings, total.savings_percentage) == (0, 0, 0.0, 0.0)


def test_answer(spark):
    from arbor.operators import graph

    docs = spark.createDataFrame([("f.py::add", "# function: add\nreturn the sum", "add", "function", "f.py", 1, 2), ("f.py::cut", "# function: cut\nremove the tail", "cut", "function", "f.py", 4, None)],
                                 "id string, document string, name string, type string, file_path string, start_line int, end_line int")
    entities = spark.createDataFrame([("f.py::add", "add", "function", "f.py", 1, 2, None, None, None, 1), ("f.py::cut", "cut", "function", "f.py", 4, 5, None, None, None, 2)],
                                     "id string, name string, type string, file_path string, start_line int, end_line int, signature string, parent_class string, docstring string, seq long")
    edges = spark.createDataFrame([("f.py::cut", "f.py::add", 5)], "src string, dst string, line int")
    model = vectors.fit_embedder(docs)
    out = context.answer("where is the sum", vectors.embed(model, docs), edges, entities, model, k=1)
    assert out["relevant_entities"] == [{"name": "add", "type": "function", "file": "f.py", "lines": "1-2"}] and "Called by: - cut" in out["context"] and out["token_stats"]["optimized_approach"] > 0
    assert context.answer("x", vectors.embed(model, docs).limit(0), edges, entities, model)["relevant_entities"] == []
    assert graph.impact_by_file(edges, path="f.py").first().names == "cut"
