"""Directory hashes, snapshot differences and snapshot input and output.

A directory's hash is sha256 over the sorted hex hashes of its children, joined
without a separator; it doesn't depend on names. Directories without a file below them
don't exist. Levels are hashed from the deepest up, one shuffle each; a level holds
its directories only, so the work falls with every step.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import children, current, drop_path, materialize, publish
from .snapshots import normalized_nodes

ROOT = "."


def parent(path):
    return F.when(F.instr(path, "/") > 0, F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(F.lit(ROOT))


def directory_hashes(files: DataFrame) -> DataFrame:
    """``(snapshot_id, path, hash)`` of every directory above ``(snapshot_id, path, hash)`` files; the root is '.'.

    Files without a hash don't count. The number of levels is the depth of the deepest path.
    """
    level = F.size(F.split("path", "/"))
    leaves = files.where("hash is not null and path is not null").select("snapshot_id", "path", "hash", level.alias("level"))
    leaves = materialize(leaves, "merkle-leaves")
    deepest = leaves.agg(F.max("level")).first()[0] or 0
    made, out = None, None
    for depth in range(deepest, 0, -1):
        here = leaves.where(F.col("level") == depth).select("snapshot_id", "path", "hash")
        if made is not None:
            here = here.unionByName(made)
        made = here.groupBy("snapshot_id", parent(F.col("path")).alias("path")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("hash")), ""), 256).alias("hash"))
        if depth > 1:
            made = materialize(made, "merkle-level")
        out = made if out is None else out.unionByName(made)
    return out if out is not None else files.sparkSession.createDataFrame([], "snapshot_id int, path string, hash string")


def snapshot_files(nodes: DataFrame) -> DataFrame:
    return normalized_nodes(nodes).where("is_file").select("snapshot_id", "path", "hash")


def file_changes(nodes: DataFrame, unchanged: bool = True) -> DataFrame:
    """``(snapshot_id, path, status)`` of files between neighbouring snapshots, with 'unchanged'. A file that
    became a directory is deleted. One pass: each row meets its successor by a shift of the snapshot number."""
    from pyspark.sql import Window

    rows = snapshot_files(nodes)
    ids = nodes.select("snapshot_id").where("snapshot_id is not null").distinct().withColumn("newer", F.lead("snapshot_id").over(Window.orderBy("snapshot_id")))  # a row per snapshot
    old = rows.join(F.broadcast(ids), "snapshot_id").where("newer is not null").select(F.col("newer").alias("snapshot_id"), "path", F.col("hash").alias("was"), F.lit(1).alias("a"))
    first = ids.agg(F.min("snapshot_id").alias("first"))
    new = rows.join(F.broadcast(first), F.col("snapshot_id") > F.col("first")).select("snapshot_id", "path", "hash", F.lit(1).alias("b"))
    both = old.join(new, ["snapshot_id", "path"], "full_outer")
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deleted").when(F.col("was").eqNullSafe(F.col("hash")), "unchanged").otherwise("modified")
    out = both.select("snapshot_id", "path", status.alias("status"))
    return out if unchanged else out.where("status <> 'unchanged'")


def change_counts(nodes: DataFrame) -> DataFrame:
    """``(snapshot_id, added, modified, deleted, unchanged)``."""
    names = ("added", "modified", "deleted", "unchanged")
    return file_changes(nodes).groupBy("snapshot_id").agg(*[F.count_if(F.col("status") == n).alias(n) for n in names])


def subtree_files(nodes: DataFrame) -> DataFrame:
    """``(snapshot_id, directory, n_files)``: files below each directory, however deep."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    rows = snapshot_files(nodes).where("instr(path, '/') > 0")
    return rows.select("snapshot_id", F.explode(above).alias("directory")).groupBy("snapshot_id", "directory").agg(F.count("*").alias("n_files"))


def file_counts(nodes: DataFrame) -> DataFrame:
    return snapshot_files(nodes).groupBy("snapshot_id").agg(F.count("*").alias("n_files"))


def save_snapshot(rows: DataFrame, path: str) -> None:
    """Parquet in a folder of its own below ``path``; it becomes the current one when it is complete, and the one
    before is kept until then. A run that ends early leaves the old one in force."""
    spark, name, before = rows.sparkSession, uuid.uuid4().hex, current(rows.sparkSession, path)
    rows.write.parquet(f"{path}/{name}")
    publish(spark, path, {"name": name})
    for old in children(spark, path):
        if old not in (name, before and before["name"], "current"):
            drop_path(spark, f"{path}/{old}")


def load_snapshot(spark: SparkSession, path: str) -> DataFrame:
    state = current(spark, path)
    if state is None:
        raise FileNotFoundError(f"no snapshot at {path}")
    return spark.read.parquet(f"{path}/{state['name']}")


def to_nested(rows: list[dict]) -> dict:
    """One tree document from flat nodes (path, hash, is_file, size, mtime); for exports of one snapshot."""
    root = {"path": ROOT, "hash": "", "is_file": False, "children": {}}
    for r in sorted(rows, key=lambda r: r["path"].count("/") if r["path"] != ROOT else -1):
        node = {"path": r["path"], "hash": r["hash"], "is_file": r["is_file"], "children": None if r["is_file"] else {}}
        node |= {k: r[k] for k in ("size", "mtime") if r.get(k) is not None}
        if r["path"] == ROOT:
            root |= {"hash": r["hash"]}
            continue
        at = root
        *above, name = r["path"].split("/")
        for n, part in enumerate(above):
            at = at["children"].setdefault(part, {"path": "/".join(above[: n + 1]), "hash": "", "is_file": False, "children": {}})
        if name in at["children"] and not r["is_file"]:
            at["children"][name]["hash"] = r["hash"]
        else:
            at["children"][name] = node
    return root


def from_nested(document: dict | str) -> list[dict]:
    """Flat nodes of a tree document; takes the bare tree and {'root': tree, 'metadata': ...}."""
    node = json.loads(document) if isinstance(document, str) else document
    node = node.get("root", node)
    out, stack = [], [node]
    while stack:
        n = stack.pop()
        out.append({k: n.get(k) for k in ("path", "hash", "is_file", "size", "mtime")})
        stack += (n.get("children") or {}).values()
    return sorted(out, key=lambda n: n["path"])
