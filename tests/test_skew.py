import math
import random
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from arbor.operators import skew

SCHEMA = "callee string, file_path string, seq long, line_number int, k string, n long, v long"


def _frame(spark, data):
    return spark.createDataFrame([(a, b, c, d, "clash", 1, 2) for a, b, c, d in data], SCHEMA)


def _brute(data, column, fractions):
    once = {}
    for row in data:
        key, seq, value = row[column], row[2], row[3]
        if seq is not None and value is not None:
            once[key, seq] = min(value, once.get((key, seq), value))
    by = defaultdict(list)
    for (key, _), value in once.items():
        by[key].append(value)
    return sorted(((k, len(v), q, sorted(v)[max(1, math.ceil(round(q * len(v), 9))) - 1]) for k, v in by.items() for q in fractions), key=str)


def test_quantiles_equal_sorting_with_a_hot_key(spark):
    rng = random.Random(1)
    data = [("hot" if rng.random() < 0.4 else f"k{rng.randrange(30)}", "f", n, rng.choice([rng.randrange(-5, 5), rng.randrange(-2**31, 2**31)])) for n in range(3000)]
    data += data[:700] + [(None, "f", 9001, 4), ("nulls", "f", 9002, None), ("x", "f", None, 3)]
    got = skew.key_quantiles(_frame(spark, data), "callee", "line_number", (0.01, 0.5, 0.99), "seq", hot=5)
    assert sorted((tuple(r) for r in got.select("k", "n", "q", "v").collect()), key=str) == _brute(data, 0, (0.01, 0.5, 0.99))


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.just("f"), st.integers(0, 40), st.one_of(st.none(), st.integers(-2**31, 2**31 - 1))), min_size=1, max_size=60))
def test_quantiles_property(spark, data):
    got = skew.key_quantiles(_frame(spark, data), "callee", "line_number", (0.5,), "seq", hot=2)
    out = [] if got is None else [tuple(r) for r in got.select("k", "n", "q", "v").collect()]
    assert sorted(out, key=str) == _brute(data, 0, (0.5,))


def test_heavy_keys_count_distinct_events_and_the_null_key_in_the_total(spark, rows):
    data = [("big", "f1", n, 1) for n in range(49)] + [("big", "f1", 0, 1)] * 100 + [("one", "f2", 49, 1)] + [(None, "f3", n, 1) for n in range(50, 100)]
    got = rows(skew.heavy_keys(_frame(spark, data), ("callee", "file_path"), "seq", 0.02))
    assert got == [("callee", "big", 49), ("file_path", "f1", 49), ("file_path", "f3", 50)]


def test_heavy_keys_are_found_in_ranges_that_hold_several_keys(spark, monkeypatch):
    rng = random.Random(4)
    data = [(f"k{int(rng.paretovariate(0.7)) % 40}", f"f{n % 3}", n, 1) for n in range(1500)]
    monkeypatch.setattr(skew, "KEY_DIGIT", 2)  # 4 ranges in the first round
    got = {tuple(r) for r in skew.heavy_keys(_frame(spark, data), ("callee", "file_path"), "seq", 0.03).collect()}
    counts = defaultdict(set)
    for callee, path, seq, _ in data:
        counts["callee", callee].add(seq)
        counts["file_path", path].add(seq)
    assert got == {(*k, len(v)) for k, v in counts.items() if len(v) >= 45} and len(got) > 4


def test_empty_table(spark, rows):
    empty = spark.createDataFrame([], SCHEMA)
    assert rows(skew.heavy_keys(empty, ("callee",), "seq")) == []
    assert rows(skew.key_profile(empty, ("callee", "file_path"), "seq", "line_number")) == []


def test_doubles_are_refused(spark):
    with pytest.raises(TypeError):
        skew.key_quantiles(spark.createDataFrame([("a", 1.5)], "k string, v double"), "k", "v", (0.5,))
