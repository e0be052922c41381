import random

from hypothesis import given, settings
from hypothesis import strategies as st

from arbor.llm import chunking as C


def _text(n, seed=0):
    rng = random.Random(seed)
    return "".join(rng.choice(["word ", "longer", "x", ". ", "\n", "\n\n", "é", " "]) for _ in range(n))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 4000), st.integers(0, 99))
def test_pieces_cover_the_text(n, seed):
    text = _text(n, seed)
    parts = C.pieces(text)
    assert all(b - a <= C.LIMIT for a, b in parts) and parts[0][0] == 0 and parts[-1][1] == len(text)
    for (_, b), (c, d) in zip(parts, parts[1:]):
        assert c == b - C.OVERLAP and d > b
    assert (len(parts) == 1) == (len(text) <= C.LIMIT)


def test_no_boundary_and_boundaries():
    assert [b - a for a, b in C.pieces("x" * 10_000)][:1] and all(b - a <= C.LIMIT for a, b in C.pieces("x" * 10_000))
    text = ("line of words\n" * 400)
    assert all(text[b - 1] == "\n" for _, b in C.pieces(text))


def test_edits_change_neighbouring_pieces_only():
    text = _text(30_000, 5)
    at = len(text) // 2
    edited = text[:at] + "an edit " + text[at:]
    a, b = C.cut_points(text), C.cut_points(edited)
    assert [x for x in a if x < at - C.LIMIT] == [x for x in b if x < at - C.LIMIT]
    back = {x + 8 for x in a if x > at + 6 * C.LIMIT}
    assert len(back & set(b)) >= 0.9 * len(back)


def test_entities_and_files(spark, rows):
    line = "y" * 99
    body = "\n".join([line] * 60)
    files = spark.createDataFrame([("a.py", body.encode(), "r", "clash"), ("a.py", body.encode(), "r", "clash"), ("n.py", None, "r", "c"), ("u.py", ("é" * 2999).encode(), "r", "c"), ("latin.py", b"\xe9" * 3001, "r", "c")],
                                  "path string, content binary, id string, text string")
    ents = [("long", "a.py", 1, 31), ("long", "a.py", 1, 31), ("edge", "a.py", 1, 30), ("tail", "a.py", 20, 900), ("rev", "a.py", 40, 2), ("null", "a.py", 1, None), ("gone", "zz.py", 1, 99), ("nofile", "n.py", 1, 99),
            ("behind", "a.py", 61, 99), ("zero", "a.py", -3, 31), ("u", "u.py", 1, 1), ("latin", "latin.py", 1, 5), (None, "a.py", 1, 60)]
    entities = spark.createDataFrame([(i, p, s, e, "x") for i, p, s, e in ents], "id string, file_path string, start_line int, end_line int, content string")
    vectors = spark.createDataFrame([("f1", "z" * 3001, "p"), ("f1", "z" * 3001, "p"), ("f2", "z" * 3000, "p"), ("f3", None, "p"), ("f4", "", "p"), (None, "z" * 4000, "p")], "id string, document string, file_path string")
    assert rows(C.oversized_ids(vectors, entities, files)) == [("entity", "latin"), ("entity", "long"), ("entity", "tail"), ("entity", "zero"), ("file", "f1")]
    pieces = C.oversized_pieces(vectors, entities, files).where("item_id = 'long'").orderBy("piece").collect()
    assert "".join([pieces[0].text] + [p.text[C.OVERLAP:] for p in pieces[1:]]) == "\n".join([line] * 31)
    assert {(r.item_id, r.n_chars, r.fits, r.overlaps) for r in C.round_trip(vectors, entities, files).collect()} == {("latin", 3001, True, True), ("long", 3099, True, True), ("tail", 4099, True, True), ("zero", 3099, True, True), ("f1", 3001, True, True)}
    none = C.oversized_ids(vectors.limit(0), entities.limit(0), files.limit(0))
    assert rows(none) == []
