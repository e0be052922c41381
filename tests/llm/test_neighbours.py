import numpy as np

from arbor.llm import neighbours as N

DIM = 32


def _frame(spark, data):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "c", 1) for i, v in data], "id string, embedding array<float>, other_id string, similarity int")


def _clustered(n, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, DIM))
    return (centres[rng.integers(0, 20, n)] + 0.8 * rng.normal(size=(n, DIM))).astype(np.float32)


def _exact(ids, x, k):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    return {ids[i]: [ids[j] for j in np.argsort(-s[i], kind="stable")[:k]] for i in range(len(ids))}, s


def test_packing_keeps_directions():
    x = _clustered(50)
    y = N.unpack([r.tobytes() for r in N.pack(x)], DIM)
    assert np.allclose((y * (x / np.linalg.norm(x, axis=1, keepdims=True))).sum(1), 1, atol=1e-5)


def test_recall(spark):
    x = _clustered(1500)
    ids = [f"v{i:04}" for i in range(len(x))]
    best, _ = _exact(ids, x, 5)
    got = {}
    for r in N.nearest(_frame(spark, zip(ids, x)), 5, DIM).collect():
        got.setdefault(r.id, set()).add(r.other_id)
    assert all(len(v) == 5 for v in got.values()) and len(got) == len(ids)
    assert sum(len(got[i] & set(best[i])) for i in ids) / (5 * len(ids)) >= 0.9


def _recall(table, n, best):
    got = {}
    for r in N.nearest(table, 5, DIM).collect():
        got.setdefault(r.id, set()).add(r.other_id)
    assert all(len(v) == 5 for v in got.values()) and len(got) == n
    return sum(len(got[i] & set(best[i])) for i in best) / (5 * n)


def test_recall_where_the_footrule_leaves_out_candidates(spark, monkeypatch):
    x = _clustered(6000, 5)
    ids = [f"v{i:04}" for i in range(len(x))]
    best, _ = _exact(ids, x, 5)
    pivots = x[:N.pivot_count(len(x))]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    homes = N.nearest_pivots(unit, pivots / np.linalg.norm(pivots, axis=1, keepdims=True))
    monkeypatch.setattr(N, "RERANK", 16)
    own = np.flatnonzero((homes == 3).any(axis=1))
    codes = N.order_codes(unit[own], pivots)
    *_, cosines = N._search_block(np.arange(len(own)), np.arange(len(own)), own.astype(np.int64), unit[own], codes, homes[own], 3, 5)
    assert 0 < cosines <= 0.6 * len(own) ** 2
    assert _recall(_frame(spark, zip(ids, x)), len(ids), best) >= 0.9


def test_blocks_find_what_whole_lists_find(spark, monkeypatch):
    x = _clustered(2000, 3)
    table = _frame(spark, [(f"v{i:04}", v) for i, v in enumerate(x)])
    best, _ = _exact([f"v{i:04}" for i in range(len(x))], x, 5)
    every = lambda: {tuple(r) for r in N.nearest(table, 5, DIM, share=1.0).select("id", "other_id").collect()}
    whole = every()  # no candidate is left out, so both must agree
    monkeypatch.setattr(N, "LIST_ROWS", 40)
    assert every() == whole
    assert _recall(table, len(x), best) >= 0.9


def test_recall_against_exact_search(spark):
    x = _clustered(1200, 7)
    row = N.recall(_frame(spark, [(f"v{i:04}", v) for i, v in enumerate(x)]), 0.9, 5, DIM).first()
    assert row.queries > 30 and row.wanted == 5 * row.queries and row.reached and row.recall >= 0.9
    assert N.recall(_frame(spark, [("a", x[0])]).limit(0), 0.9, 5, DIM).first().reached


def test_unusable_copies_and_repeats(spark, rows):
    base = [1.0] + [0.0] * (DIM - 1)
    near = [1.0, 0.3] + [0.0] * (DIM - 2)
    far = [0.0, 0.0, 1.0] + [0.0] * (DIM - 3)
    data = [("a", base), ("a", base), ("b", near), ("far", far), ("none", None), ("zero", [0.0] * DIM), ("short", [1.0]), ("nan", [float("nan")] * DIM), ("gap", [None] + base[1:]), (None, base), ("scaled", [3 * v for v in base])]
    assert rows(N.similar_pairs(_frame(spark, data), dim=DIM)) == [("a", "b"), ("a", "scaled"), ("b", "scaled")]
    assert rows(N.similar_pairs(_frame(spark, data).limit(0), dim=DIM)) == []
    assert rows(N.similar_pairs(_frame(spark, [("a", base)]), dim=DIM)) == []


def test_many_copies_answer_with_their_smallest_ids(spark):
    base = [1.0] + [0.0] * (DIM - 1)
    near = [1.0, 0.3] + [0.0] * (DIM - 2)
    data = [(f"c{i:03}", base) for i in range(300)] + [("near", near)]
    got = {}
    for r in N.nearest(_frame(spark, data), 5, DIM).collect():
        got.setdefault(r.id, set()).add(r.other_id)
    first = [f"c{i:03}" for i in range(6)]
    assert got["c000"] == set(first[1:]) and got["c200"] == set(first[:5]) and got["near"] == set(first[:5]) and len(got) == 301


def test_footrule_of_codes_is_the_footrule_of_quarters():
    rng = np.random.default_rng(1)
    x, pivots = rng.normal(size=(40, DIM)).astype(np.float32), rng.normal(size=(20, DIM)).astype(np.float32)
    codes = N.order_codes(x, pivots)
    place = np.argsort(np.argsort(-(x @ pivots.T), axis=1), axis=1)
    quarter = np.digitize(place, [5, 10, 15])
    for i in range(40):
        assert (N.footrule(codes[i], codes) == np.abs(quarter - quarter[i]).sum(axis=1)).all()
