import json
import os

from arbor.plans.codebase import Codebase


def _write(root, path, text):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "w") as f:
        f.write(text)


def test_everything_about_a_small_tree(spark, tmp_path, rows):
    root = str(tmp_path / "src")
    _write(root, "math.c", "int add(int a, int b) {\n    return a + b;\n}\n\nint multiply(int a, int b) {\n    return add(a, b);\n}\n\nint factorial(int n) {\n    return multiply(n, 1);\n}\n")
    _write(root, "main.c", "int main(void) {\n    return factorial(3);\n}\n")
    _write(root, "app/loop.py", "def even(n):\n    return odd(n - 1)\n\n\ndef odd(n):\n    return even(n - 1)\n")
    code = Codebase(spark, root, str(tmp_path / "store"))
    assert code.index()["added"] == 3
    assert rows(code.dependencies("math.c::multiply")) == [("called_by", "math.c::factorial"), ("calls", "math.c::add")]
    assert rows(code.dependencies("nobody")) == []
    assert rows(code.call_chain("math.c::factorial", "math.c::add").select("chain")) == [("math.c::factorial -> math.c::multiply -> math.c::add",)]
    assert rows(code.impacted_entities("math.c::add")) == [("math.c::factorial",), ("math.c::multiply",)]
    assert {r.file_path for r in code.impacted_by_change("math.c", resolve="global").collect()} == {"math.c", "main.c"}
    assert rows(code.file_dependencies("main.c")) == [("main.c", "math.c", "call", 1)]
    assert [tuple(x) for x in code.entity_context("multiply").first().called_by] == [("factorial", "math.c")] and code.entity_context("multiply", "main.c").count() == 0
    stats = code.statistics()
    assert (stats["total_entities"], stats["total_calls"], stats["cycles"], stats["entity_vectors"], stats["by_type"]) == (6, 4, 1, 6, {"function": 6})
    assert rows(code.components().groupBy("component").count().where("count > 1").select("count")) == [(2,)]
    first = code.search_code("int factorial multiply", k=2).collect()
    assert first[0].id == "math.c::factorial" and first[0].distance <= first[1].distance
    assert code.search_code("x", kind="class").count() == 0 and code.search_files("even odd", 1).first().file_path == "app/loop.py"
    told = code.answer("factorial", use_llm=True)
    assert told["question"] == "factorial" and told["relevant_entities"][0].keys() == {"name", "type", "file", "lines"}
    top = next(x for x in told["relevant_entities"] if x["name"] == "factorial")
    assert top == {"name": "factorial", "type": "function", "file": "math.c", "lines": "9-11"}
    assert told["context"].startswith("# Relevant Code Context\n\n\n## Function: ") and "\nCalls: - multiply\n\n```python\nint factorial" in told["context"]
    stats = told["token_stats"]
    assert stats["naive_approach"] == code.naive_tokens() == sum(os.path.getsize(os.path.join(root, p)) for p in ("math.c", "main.c", "app/loop.py")) // 4
    assert stats["optimized_approach"] == len(told["context"]) // 4 and stats["savings"] == stats["naive_approach"] - stats["optimized_approach"]
    asked = Codebase(spark, root, str(tmp_path / "store"), llm=lambda question, text: f"{question} in {len(text)}")
    assert asked.answer("factorial", use_llm=True)["answer"] == f"factorial in {len(told['context'])}"
    broken = Codebase(spark, root, str(tmp_path / "store"), llm=lambda question, text: {}["key"])
    assert broken.answer("factorial", use_llm=True)["answer"].startswith("Error querying LLM: ")
    report = code.change_report("math.c").first()
    assert (report.total_impacted_entities, report.impacted_files, report.listing) == (2, 1, "math.c: factorial, multiply") and code.change_report("none").count() == 0
    report = code.token_report(["factorial", "even"])
    assert report["questions"] == 2 and report["savings"] == report["naive_tokens"] - report["optimized_tokens"]
    assert code.token_report([])["savings_percentage"] == 0.0
    text = code.summary()
    assert "Total Entities: 6" in text and "- Functions: 6" in text and "- Average calls per entity: 0.67" in text and "- Circular dependencies: 1" in text
    assert text.endswith("## File Structure:\n./\n  - main.c\n  - math.c\napp/\n  - loop.py")
    document = code.snapshot_json()
    assert json.loads(document)["root"]["hash"] == code.root_hash() and {r.path for r in code.load_snapshot_json(document).where("is_file").collect()} == {"math.c", "main.c", "app/loop.py"}
    assert code.verify_file("main.c", code.file_hash("main.c")) and not code.verify_file("main.c", "0") and code.file_hash("none") is None
    _write(root, "main.c", "int main(void) {\n    return 0;\n}\n")
    assert ("main.c", "modified") in rows(code.changed_files())
    code.export_graph(str(tmp_path / "graph"))
    assert spark.read.json(str(tmp_path / "graph")).where("section = 'calls'").count() == 4
    code.reset()
    assert code.table("entities").count() == 0 and "Total Files: 0" in code.summary()
    nothing = code.answer("factorial")
    assert nothing["relevant_entities"] == [] and "question" not in nothing and nothing["token_stats"]["optimized_approach"] == 0
