import random

import numpy as np

from arbor.llm import handwritten as H

WORDS = "load parse shard count merge window total level offset width gain bucket frame route".split()


def _hand(rng):
    out = ["import os", ""]
    for _ in range(rng.randint(3, 7)):
        a, b = rng.sample(WORDS, 2)
        out += [f"def {a}_{b}({a}, {b}=0):", f"    total = {a} * {rng.randrange(99)}"] + [f"    total += {rng.choice(WORDS)} % {rng.randrange(99)}" for _ in range(rng.randint(2, 6))] + [f"    if {b} > {rng.randrange(99)}:", "        total -= 1", "    return total", ""]
    return "\n".join(out)


def _made(rng, notice):
    head = "# Code generated by gen. DO NOT EDIT.\n" if notice else ""
    return head + "\n".join(f"def get_{rng.choice(WORDS)}_{n}(msg):\n    return msg.fields[{n}]\n" for n in range(rng.randint(8, 30)))


def _table():
    rng = random.Random(1)
    rows, truth = [], set()
    libs = [_hand(rng) for _ in range(3)]
    for n in range(600):
        repo = f"repo{n % 20}"
        path, kind = f"{repo}/pkg_{n:03}/{rng.choice(['io', 'core', 'vendors'])}/{rng.choice(WORDS)}_{n}.py", rng.random()
        if kind < 0.06:
            text = _made(rng, True)
        elif kind < 0.10:
            text = _made(rng, False)
        elif kind < 0.14:
            k = rng.randrange(3)
            text, path = libs[k], f"{repo}/pkg_{n:03}/vendor/lib{k}/lib{k}.py"
        elif kind < 0.17:
            k = rng.randrange(3)
            text, path = "# patched\n" + libs[k], f"{repo}/pkg_{n:03}/io/lib{k}_{n}.py"
        else:
            text = _hand(rng) + ("\nprint('DO NOT EDIT in prose')\n" if rng.random() < 0.1 else "")
        if kind < 0.17:
            truth.add(path)
        rows.append((path, repo, text.encode()))
    return rows, truth


def test_finds_what_nothing_gives_away(spark):
    rows, truth = _table()
    files = spark.createDataFrame([(p, r, c, 1.0) for p, r, c in rows + rows[:30]], "path string, repo string, content binary, score double")
    found = {r.path for r in H.scored(files).where("flagged").select("path").collect()}
    assert len(found & truth) / len(truth) >= 0.95 and len(found & truth) / len(found) >= 0.95
    v = H.validation(files).first()
    assert v.given_found >= 0.8 * v.given and v.files > 0


def test_a_notice_adds_nothing_to_the_score():
    body = "def f(x):\n    return x\n"
    with_, without = (H.split_text("r/a.py", head + body) for head in ("# Code generated by gen. DO NOT EDIT.\n", "\n"))
    assert with_.made and not without.made
    for a, b in zip(H.features("r/a.py", with_, H.body_lines(with_.body)), H.features("r/a.py", without, H.body_lines(without.body))):
        assert a.tolist() == b.tolist()


def test_planted_files(spark):
    rows, _ = _table()
    got = {r.kind: r for r in H.planted(spark.createDataFrame(rows, "path string, repo string, content binary")).collect()}
    assert set(got) == {"hand-written", "data"} and got["hand-written"].files == got["data"].files > 50
    assert got["hand-written"].flagged <= 0.05 * got["hand-written"].files
    assert H.minified("int a = 1; // one\nf( a );\n") == "int a=1;f(a);" and H.tabulated("a b").startswith("values = [\n    ")


def test_odd_tables(spark):
    schema = "path string, repo string, content binary, given string"
    odd = spark.createDataFrame([("a/b.py", "a", None, "x"), (None, "a", b"x", "x"), ("a/c.py", None, b"", "x"), ("a/c.py", None, b"", "x"), ("x.md", "a", b"zz", "x"), ("a/big.js", "a", b"a=1;" * 100_000, "x")], schema)
    assert {(r.path, r.flagged) for r in H.scored(odd).collect()} >= {("a/b.py", False), ("a/c.py", False)} and H.scored(odd).count() == 3
    assert H.scored(odd.limit(0)).count() == 0


def test_giveaways_are_masked():
    parts = H.split_text("r/p/vendor/lib/x.min.js", "/*! lib 1.2.3 */\n// Code generated. DO NOT EDIT\nvar a = 1;\n")
    assert parts.made and parts.foreign and parts.body.strip() == "var a = 1;"
    assert not H.split_text("r/p/vendors/x.py", "x = 'DO NOT EDIT in prose'\n").made
    a, b = (H.features(p, H.split_text(p, "x = 1\n"), ["x = 1"])[0] for p in ("r/p/vendor/x.py", "r/p/x.py"))
    assert set(a.tolist()) == set(b.tolist())


def test_svm_separates():
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for n in range(200):
        y = 1 if n % 2 else -1
        rows.append((np.array([10 if y > 0 else 11, int(rng.integers(20, 60))]), np.array([1.0, 1.0])))
        labels.append(y)
    w = H.fit(rows, np.array(labels))
    assert all((w[s] @ v + w[-1] > 0) == (y > 0) for (s, v), y in zip(rows, labels))
