"""Vector tables: exact search, upsert, delete, a hashing embedder."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rows import side_by_side
from ..storage import materialize

#: Queries that are searched in one pass over the collection.
BLOCK = 512
DIM = 384


def search(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vec_col: str = "embedding", group_col: str | None = None) -> DataFrame:
    """``(query_id, id, distance)``: for every query its k nearest rows by squared L2 distance, ascending, ties to the smaller id.

    ``queries`` has (query_id, vector[, group]); with ``group_col`` only rows of the query's group
    compete. Queries are taken in blocks of about BLOCK; one block at a time is on the driver and
    shipped to a scan, and a task keeps k rows per query, so k rows per query and task are
    shuffled. Several blocks are searched one after the other when this is called. Null vectors and vectors of another length than the query's have no distance.
    """
    spark = vectors.sparkSession
    asked = queries.where("vector is not null").select("query_id", "vector", *(["group"] if group_col else []))
    asked = materialize(asked, "search-queries")
    blocks = -(-asked.count() // BLOCK)
    kind = vectors.schema[id_col].dataType.simpleString()
    out = None
    for number in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == number).collect()
        by_size: dict[int, list] = {}
        for r in block:
            by_size.setdefault(len(r.vector), []).append(r)
        packed = [(np.array([r.vector for r in rows], np.float64), [r.query_id for r in rows], [r.group for r in rows] if group_col else None) for rows in by_size.values()]
        shared = spark.sparkContext.broadcast(packed)

        def scan(batches, shared=shared):
            best: dict = {}  # query -> its nearest rows so far, sorted
            for b in batches:
                ids, lists = b.column(0).to_pylist(), b.column(1)
                sizes = np.array([-1 if v is None else v for v in pa.compute.list_value_length(lists).to_pylist()])
                known = np.array([i is not None for i in ids], bool)
                groups = np.array(b.column(2).to_pylist(), object) if group_col else None
                for q, names, wanted in shared.value:
                    at = np.flatnonzero((sizes == q.shape[1]) & known)
                    if not len(at):
                        continue
                    x = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), -1)
                    # a matrix product shows which rows may be near; its rounding is allowed for
                    squares = (q ** 2).sum(axis=1)[:, None] + (x ** 2).sum(axis=1)[None, :]
                    rough, slack = squares - 2 * (q @ x.T), 1e-9 * squares
                    rough[~np.isfinite(rough)] = np.inf
                    if wanted is not None:
                        rough[np.array([groups[at] == w for w in wanted]) == 0] = np.inf
                    edge = np.array([best[n][-1][0] if len(best.get(n, ())) == k else np.inf for n in names])
                    if rough.shape[1] > k:
                        edge = np.minimum(edge, np.partition(rough + slack, k - 1, axis=1)[:, k - 1])
                    near = (rough - slack <= edge[:, None]) & np.isfinite(rough)
                    for n in np.flatnonzero(near.any(axis=1)).tolist():
                        few = np.flatnonzero(near[n])
                        # differences, not the expanded square: equal vectors get 0 exactly
                        d = ((x[few] - q[n]) ** 2).sum(axis=1)
                        best[names[n]] = sorted(best.get(names[n], []) + [(float(v), ids[at[i]]) for v, i in zip(d, few) if np.isfinite(v)])[:k]
            rows = [(name, i, d) for name, mine in best.items() for d, i in mine]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], types[0]), pa.array([r[1] for r in rows], types[1]), pa.array([r[2] for r in rows], pa.float64())], names=["query_id", "id", "distance"])

        qkind = queries.schema["query_id"].dataType.simpleString()
        arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
        types = (arrow[qkind], arrow[kind])
        picked = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), *([F.col(group_col).alias("grp")] if group_col else []))
        part = picked.mapInArrow(scan, f"query_id {qkind}, id {kind}, distance double")
        if blocks > 1:  # the next block takes this one's place on the driver
            part = materialize(part, "search-block")
            shared.destroy()
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {kind}, distance double")
    best = out.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "id"))), 1, k).alias("best"))
    return best.select("query_id", F.explode("best").alias("b")).select("query_id", F.col("b.id").alias("id"), F.round("b.distance", 6).alias("distance"))


def keep_last_vector(vectors: DataFrame) -> DataFrame:
    """One row per id; rows that come twice are the same, of different ones the row that sorts last counts."""
    own = F.struct(*[c for c in vectors.columns if c != "id"])
    return vectors.where("id is not null").groupBy("id").agg(F.max(own).alias("r")).select("id", "r.*")


def upsert(vectors: DataFrame, updates: DataFrame) -> DataFrame:
    """Rows of ``updates`` take the place of rows with their id; other rows stay."""
    return vectors.join(updates.select("id"), "id", "left_anti").unionByName(updates)


def delete_files(vectors: DataFrame, paths: DataFrame) -> DataFrame:
    """Without the rows of the given ``(path)``."""
    return vectors.join(paths.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_anti")


def statistics(entity_vectors: DataFrame, file_vectors: DataFrame) -> DataFrame:
    """One row: distinct ids of both collections, and the usual dimension."""
    both = side_by_side(entity_vectors.agg(F.count_distinct("id").alias("total_entities")), file_vectors.agg(F.count_distinct("id").alias("total_files")))
    return both.withColumn("dimension", F.lit(DIM))


def fit_embedder(texts: DataFrame, text_col: str = "document"):
    """Hashing TF-IDF of DIM dimensions, normalised. Texts stay distributed; only DIM weights reach the driver. Without
    texts all weights are equal."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer

    known = texts.where(F.col(text_col).isNotNull()).select(text_col)
    if known.isEmpty():
        known = texts.sparkSession.createDataFrame([("",)], f"{text_col} string")
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text_col, outputCol="_w", pattern=r"[^\p{L}\p{N}]+", minTokenLength=1),
        HashingTF(inputCol="_w", outputCol="_tf", numFeatures=DIM), IDF(inputCol="_tf", outputCol="_idf"), Normalizer(inputCol="_idf", outputCol="_v"),
    ]).fit(known)


def embed(model, texts: DataFrame, text_col: str = "document") -> DataFrame:
    """The rows with a float array ``embedding``; rows without text are left out."""
    from pyspark.ml.functions import vector_to_array

    rows = texts.where(F.col(text_col).isNotNull())
    return model.transform(rows).withColumn("embedding", vector_to_array("_v", "float32")).drop("_w", "_tf", "_idf", "_v")


def approximate(vectors: DataFrame, k: int, vec: list[float], vec_col: str = "embedding", bucket: float = 0.5, tables: int = 8) -> DataFrame:
    """Approximate search of one vector by random projections (Spark ML)."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    rows = vectors.where(F.size(vec_col) == len(vec)).withColumn("_x", array_to_vector(vec_col))
    model = BucketedRandomProjectionLSH(inputCol="_x", outputCol="_h", bucketLength=bucket, numHashTables=tables, seed=7).fit(rows)
    return model.approxNearestNeighbors(rows, Vectors.dense(vec), k).drop("_x", "_h")
