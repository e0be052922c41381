import datetime as dt

from arbor.operators import merkle, snapshots

SCHEMA = "snapshot_id int, path string, is_file boolean, hash string, loaded_at timestamp, was string, digest string, status string"
T = dt.datetime(2024, 1, 1)


def _nodes(spark, data):
    return spark.createDataFrame([(s, p, f, h, t, "a", "b", "c") for s, p, f, h, t in data], SCHEMA)


CASES = [
    (1, "./a\\b.py", True, "AA", T), (2, "a/b.py", True, "aa", T),                    # spelling only
    (1, "c.py", True, "11", T), (2, "c.py", True, "22", T),                             # changed
    (1, "gone.py", True, "11", T), (4, "new.py", True, "11", T), (2, "new2", False, "1", T),
    (1, "turn", True, "5", T), (2, "turn", False, "5", T),                              # file to directory
    (1, "late", True, "1", T), (1, "late", True, "2", T + dt.timedelta(1)), (2, "late", True, "2", T),
    (1, "re\u0301.py", True, "1", T), (2, "r\u00e9.py", True, "1", T),                  # composed
    (2, "none", True, None, T), (4, "none", True, None, T),                             # null hash stays equal
    (2, "twice", True, "1", T), (2, "twice", True, "1", T), (4, "twice", True, "1", T),
    (None, "x", True, "1", T), (1, None, True, "1", T),
]


def test_changes_between_neighbours(spark, rows):
    got = {tuple(r) for r in snapshots.snapshot_changes(_nodes(spark, CASES)).select("snapshot_id", "path", "status").collect()}
    first = {x for x in got if x[0] == 2}
    assert first == {(2, "c.py", "modified"), (2, "gone.py", "deleted"), (2, "new2", "added"), (2, "turn", "modified"), (2, "none", "added"), (2, "twice", "added")}
    second = {x for x in got if x[0] == 4}
    assert (4, "new.py", "added") in second and (4, "none", "modified") not in second and (4, "twice", "added") not in second
    assert (4, "c.py", "deleted") in second


def test_values_are_fetched_for_changes(spark):
    got = {(r.snapshot_id, r.path): (r.old_hash, r.new_hash) for r in snapshots.changed_values(_nodes(spark, CASES)).collect()}
    assert got[2, "c.py"] == ("11", "22") and got[2, "gone.py"] == ("11", None) and got[4, "new.py"] == (None, "11")


def test_empty_and_single_snapshot(spark, rows):
    assert rows(snapshots.snapshot_changes(spark.createDataFrame([], SCHEMA))) == []
    assert rows(snapshots.snapshot_changes(_nodes(spark, [c for c in CASES if c[0] == 1]))) == []


def test_statuses_cover_both_snapshots(spark):
    nodes = _nodes(spark, CASES)
    counts = {r.snapshot_id: r for r in merkle.change_counts(nodes).collect()}
    sizes = {r.snapshot_id: {x.path for x in merkle.snapshot_files(nodes).where(f"snapshot_id = {r.snapshot_id}").collect()} for r in nodes.select("snapshot_id").where("snapshot_id is not null").distinct().collect()}
    for old, new in ((1, 2), (2, 4)):
        r = counts[new]
        assert r.added + r.modified + r.deleted + r.unchanged == len(sizes[old] | sizes[new])


def test_stream_equals_batch(spark, tmp_path, rows):
    from arbor.streaming.snapshots import follow

    nodes = _nodes(spark, [c for c in CASES if c[0] is not None])
    for s in (1, 2, 4):
        nodes.where(f"snapshot_id = {s}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(nodes.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = follow(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("snapshot_id", "path", "status")
    assert rows(got) == rows(snapshots.snapshot_changes(nodes))


def test_stream_goes_on_after_a_restart_and_a_repeated_batch(spark, tmp_path, rows):
    from arbor.streaming.snapshots import follow

    (tmp_path / "in").mkdir()
    nodes = _nodes(spark, [c for c in CASES if c[0] is not None])
    stream = spark.readStream.schema(nodes.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def run(*ids):
        for s in ids:
            nodes.where(f"snapshot_id = {s}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        follow(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
        return rows(spark.read.parquet(str(tmp_path / "out")).select("snapshot_id", "path", "status"))

    run(1, 2)
    whole = rows(snapshots.snapshot_changes(nodes))
    assert run(4) == whole
    last = max((tmp_path / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()  # as if the run had ended before the batch was noted
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    assert run() == whole


def test_index_outlives_its_object_and_keeps_two_tables(spark, tmp_path, rows):
    folder = str(tmp_path / "index")
    at = lambda *data: spark.createDataFrame([(p, h, True) for p, h in data], "path string, hash string, is_file boolean")
    first = snapshots.SnapshotIndex(spark, folder, 4)
    assert first.probe(at(("a", "1"), ("b", "1"), ("c", "1"))) is None
    first.swap(1)
    name = first.state["name"]
    spark.sql(f"drop table arbor_index_{name}")  # as in a new session
    again = snapshots.SnapshotIndex(spark, folder, 99)
    changes = again.probe(at(("a", "1"), ("b", "2"), ("d", "1")))
    assert rows(changes) == [("b", "modified"), ("c", "deleted"), ("d", "added")]
    # the run ends before the swap: the next one starts from the same index
    changes = snapshots.SnapshotIndex(spark, folder).probe(at(("a", "1"), ("b", "2"), ("d", "1")))
    assert rows(changes) == [("b", "modified"), ("c", "deleted"), ("d", "added")]
    again.swap(2)
    assert again.state["before"] == name and (tmp_path / "index" / name).exists()
    assert rows(again.probe(at(("a", "9")))) == [("a", "modified"), ("b", "deleted"), ("d", "deleted")]
    again.swap(3)
    assert not (tmp_path / "index" / name).exists() and again.state["snapshot"] == 3


def test_stream_refuses_an_older_snapshot(spark, tmp_path):
    import pytest
    from pyspark.errors import StreamingQueryException

    from arbor.streaming.snapshots import follow

    (tmp_path / "in").mkdir()
    nodes = _nodes(spark, [c for c in CASES if c[0] is not None])
    stream = spark.readStream.schema(nodes.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for s in (4, 2):
        nodes.where(f"snapshot_id = {s}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = follow(stream, str(tmp_path / "out"), str(tmp_path / "state"))
        if s == 4:
            query.awaitTermination(120)
        else:
            with pytest.raises(StreamingQueryException):
                query.awaitTermination(120)
