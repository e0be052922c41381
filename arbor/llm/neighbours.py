"""Problem 5: the most similar vectors of every vector, by a permutation index.

* Vectors are normalised and held in 12 bits a value (cosines stay right to
  about 1e-4); equal ones collapse into one class, so copies cost nothing.
* A bounded random sample of the classes serves as pivots: ``PIVOT_RATE * sqrt(n)`` of
  them, at least MIN_PIVOTS, but no more than a quarter of the classes. Sampling by mass
  gives dense regions more pivots, which keeps the inverted files even.
* Every class is posted in the inverted files of its nearest pivots: POSTINGS, or more where the files are
  short, so that a class meets about CANDIDATES others at least.
* A class is looked up in its own inverted files. It is represented by the order of the first
  RANKED pivots by nearness, each rank reduced to its quarter. The footrule distance of two
  such orders is the number of bits in which their codes differ (one bit per pivot and
  border between quarters: nearer than the border or not). Candidates are ranked by
  it, and cosines are taken of the best ``max(RERANK, RERANK_SHARE * candidates)`` only. A pair
  that shares several inverted files is looked at in the first of them.

An inverted file longer than LIST_ROWS is cut into blocks, and each pair of blocks is a
task of its own; no task holds more than two blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize

DIM, K = 384, 5
PIVOT_RATE, MIN_PIVOTS = 0.6, 384
POSTINGS, CANDIDATES, RANKED = 3, 500, 384
#: Borders between the classes of rank, as shares of the ranked pivots.
BORDERS = (0.25, 0.5, 0.75)
RERANK, RERANK_SHARE = 16, 0.5
LIST_ROWS = 16_384


def pack(x: np.ndarray) -> np.ndarray:
    """Rows of floats -> rows of bytes, 12 bits a value, scaled to the row's largest."""
    top = np.abs(x).max(axis=1, keepdims=True)
    v = np.rint(x / top * 2047).astype(np.int16)
    low = (v & 15).astype(np.uint8)
    return np.concatenate([(v >> 4).astype(np.int8).view(np.uint8), low[:, ::2] | (low[:, 1::2] << 4)], axis=1)


def unpack(rows: list[bytes], dim: int) -> np.ndarray:
    """The unit vectors of packed rows, float32."""
    raw = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), dim + dim // 2)
    v = raw[:, :dim].view(np.int8).astype(np.float32) * 16
    v[:, ::2] += raw[:, dim:] & 15
    v[:, 1::2] += raw[:, dim:] >> 4
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _usable(vectors: DataFrame, dim: int) -> DataFrame:
    """``(id, vec)``: packed vectors of ``dim`` finite values, not all zero."""
    def run(batches):
        for b in batches:
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            ok = np.isfinite(flat).all(axis=1) & (np.abs(flat).max(axis=1, initial=0) > 0)
            packed = pack(flat[ok])
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), pa.array([r.tobytes() for r in packed], pa.binary())], names=["id", "vec"])

    rows = vectors.select(F.col("id").cast("string").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"))
    rows = rows.where(f"id is not null and size(embedding) = {dim} and not exists(embedding, x -> x is null)")
    return rows.mapInArrow(run, "id string, vec binary")


def pivot_count(n: int, rate: float = PIVOT_RATE) -> int:
    return max(1, min(n // 4, max(MIN_PIVOTS, round(rate * math.sqrt(n)))))


def posting_count(n: int, pivots: int) -> int:
    """A file has about postings * n / pivots classes, and a class is in ``postings`` files."""
    return min(pivots, max(POSTINGS, math.ceil(math.sqrt(CANDIDATES * pivots / max(n, 1)))))


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, postings: int = POSTINGS) -> np.ndarray:
    """Numbers of the nearest pivots of each row, nearest first."""
    near = x @ pivots.T
    best = np.argpartition(-near, postings - 1, axis=1)[:, :postings]
    return np.take_along_axis(best, np.argsort(-np.take_along_axis(near, best, 1), axis=1, kind="stable"), 1).astype(np.int32)


def order_codes(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The quartered order of the pivots for each row, as bits in 64-bit words."""
    near = x @ pivots.T
    m = pivots.shape[0]
    ranks = sorted({max(1, round(m * b)) for b in BORDERS})
    edges = np.partition(near, [m - r for r in ranks], axis=1)
    bits = np.packbits(np.concatenate([near >= edges[:, m - r, None] for r in ranks], axis=1), axis=1)
    return np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8))).view(np.uint64)


def footrule(code: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Distances of one order to others: the sum over all pivots of the difference of their quarters."""
    return np.bitwise_count(codes ^ code).sum(axis=1, dtype=np.uint16)


def _search_block(q: np.ndarray, c: np.ndarray, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, homes: np.ndarray, own_list: int, k: int, share: float = RERANK_SHARE) -> tuple[list, list, list, int]:
    """(queries, neighbours, cosines, number of cosines taken) for rows ``q`` against rows ``c`` of one inverted file."""
    a, b, sims, taken = [], [], [], 0
    c_ids, c_homes, c_codes = ids[c], homes[c], codes[c]
    for i in q:
        mine = homes[i]
        there = c_ids != ids[i]
        for earlier in mine[:int(np.flatnonzero(mine == own_list)[0])]:
            there &= (c_homes != earlier).all(axis=1)
        at = np.flatnonzero(there)
        if not len(at):
            continue
        keep = max(RERANK, math.ceil(share * len(at)))
        if keep < len(at):
            at = at[np.argpartition(footrule(codes[i], c_codes[at]), keep - 1)[:keep]]
        near = x[c[at]] @ x[i]
        taken += len(at)
        if len(at) > k:
            best = np.argpartition(-near, k - 1)[:k]
            at, near = at[best], near[best]
        a.append(np.full(len(at), ids[i])), b.append(c_ids[at]), sims.append(near)
    return a, b, sims, taken


def class_neighbours(classes: DataFrame, dim: int = DIM, k: int = K, pivot_rate: float = PIVOT_RATE, share: float = RERANK_SHARE) -> DataFrame:
    """``(cid, other, sim)``: up to k nearest classes of each class; ``classes`` is a stored table of (cid, vec)."""
    spark = classes.sparkSession
    n = classes.count()
    m = pivot_count(n, pivot_rate)
    sample = classes.orderBy(F.xxhash64("cid", F.lit(7)), "cid").select("vec").limit(m).collect()
    if not sample:
        return spark.createDataFrame([], "cid long, other long, sim float")
    shared = spark.sparkContext.broadcast(unpack([bytes(r.vec) for r in sample], dim))
    m = len(sample)
    postings = posting_count(n, m)

    def homes(batch):
        return nearest_pivots(unpack([v.as_py() for v in batch.column(1)], dim), shared.value, postings)

    def lengths(batches):
        total = np.zeros(m, np.int64)
        for b in batches:
            if b.num_rows:
                total += np.bincount(homes(b).ravel(), minlength=m)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(m, dtype=np.int32)), pa.array(total)], names=["list", "n"])

    picked = classes.select("cid", "vec")
    long_lists = {r.list: -(-r.n // LIST_ROWS) for r in picked.mapInArrow(lengths, "list int, n long").groupBy("list").agg(F.sum("n").alias("n")).where(F.col("n") > LIST_ROWS).collect()}

    def post(batches):
        for b in batches:
            if not b.num_rows:
                continue
            own, ids, vecs = homes(b), b.column(0).to_numpy(), b.column(1).to_pylist()
            row, lst, part, role = [], [], [], []
            for j in range(own.shape[1]):
                for r, p in enumerate(own[:, j].tolist()):
                    blocks = long_lists.get(p, 1)
                    if blocks == 1:
                        spots = ((0, 2),)
                    else:
                        mine = (int(ids[r]) * 0x9E3779B97F4A7C15 >> 32) % blocks
                        spots = [(mine * blocks + o, 0) for o in range(blocks) if o != mine] + [(o * blocks + mine, 1) for o in range(blocks) if o != mine] + [(mine * blocks + mine, 2)]
                    for at, as_ in spots:
                        row.append(r), lst.append(p), part.append(at), role.append(as_)
            take = np.array(row)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.array(lst, np.int32)), pa.array(np.array(part, np.int32)), pa.array(np.array(role, np.int8)), pa.array(ids[take]),
                pa.array([vecs[r] for r in row], pa.binary()), pa.array([o.tobytes() for o in own[take]], pa.binary()),
            ], names=["list", "part", "role", "cid", "vec", "homes"])

    def search(table):
        role, ids = table.column("role").to_numpy(), table.column("cid").to_numpy()
        x = unpack(table.column("vec").to_pylist(), dim)
        own = np.frombuffer(b"".join(table.column("homes").to_pylist()), np.int32).reshape(len(ids), -1)
        codes = order_codes(x, shared.value[:RANKED])
        a, b, sims, _ = _search_block(np.flatnonzero(role != 1), np.flatnonzero(role != 0), ids, x, codes, own, table.column("list")[0].as_py(), k, share)
        flat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        return pa.table({"cid": pa.array(flat(a, np.int64), pa.int64()), "other": pa.array(flat(b, np.int64), pa.int64()), "sim": pa.array(flat(sims, np.float32), pa.float32())})

    posted = picked.mapInArrow(post, "list int, part int, role tinyint, cid long, vec binary, homes binary")
    hits = posted.groupBy("list", "part").applyInArrow(search, "cid long, other long, sim float")
    # the copies of a pair that block pairs make are one; k rows per class and list reach this shuffle
    best = hits.groupBy("cid").agg(F.slice(F.sort_array(F.collect_set(F.struct("sim", (-F.col("other")).alias("neg"))), asc=False), 1, k).alias("best"))
    return best.select("cid", F.explode("best").alias("b")).select("cid", (-F.col("b.neg")).alias("other"), F.col("b.sim").alias("sim"))


def nearest(vectors: DataFrame, k: int = K, dim: int = DIM, at_least: float = -1.0, pivot_rate: float = PIVOT_RATE, share: float = RERANK_SHARE) -> DataFrame:
    """``(id, other_id, similarity)``: for each usable id its k most similar other ids.

    Null, all-zero, non-finite and wrong-length vectors have no row. Ids that come
    twice with one vector count once; of several vectors for one id the packed form that sorts last
    counts. Ties go to the smaller id. Copies: a class of more than k members
    answers with its own k+1 smallest ids. ``at_least`` keeps only neighbours of that cosine;
    ``share`` of an inverted file's candidates are reranked.
    """
    rows = _usable(vectors, dim).select("id", "vec", F.md5("vec").alias("digest"))
    own = rows.groupBy("id").agg(F.max("digest").alias("digest"))
    members = materialize(own, "knn-members")
    vecs = rows.select("digest", "vec").dropDuplicates(["digest"]).join(members.select("digest").distinct(), "digest", "left_semi")
    classes = materialize(vecs.select(F.monotonically_increasing_id().alias("cid"), "digest", "vec"), "knn-classes")
    # the k+1 smallest ids of each class; a first cut within salts keeps any class from being gathered
    salted = members.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    from pyspark.sql import Window

    few = salted.withColumn("r", F.row_number().over(Window.partitionBy("digest", "salt").orderBy("id"))).where(F.col("r") <= k + 1)
    named = few.groupBy("digest").agg(F.slice(F.sort_array(F.collect_list("id")), 1, k + 1).alias("ids"))
    sizes = members.groupBy("digest").agg(F.count("*").alias("n"))
    named = materialize(named.join(sizes, "digest").join(classes.select("digest", "cid"), "digest").select("cid", "digest", "ids", "n"), "knn-names")

    pairs = class_neighbours(classes, dim, k, pivot_rate, share).where(F.col("sim") >= at_least)
    apart = pairs.join(named.select(F.col("cid").alias("other"), "ids"), "other").select("cid", "sim", F.explode("ids").alias("id"))
    same = named.where("n > 1").select("cid", F.lit(1.0).cast("float").alias("sim"), F.explode("ids").alias("id"))
    ranked = apart.unionByName(same).groupBy("cid").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("neg"), "id"))), 1, k + 1).alias("best"))
    small = named.where(F.col("n") <= k + 1).join(ranked, "cid").select(F.explode("ids").alias("me"), "best")
    big = named.where(F.col("n") > k + 1).select("digest", F.transform("ids", lambda i: F.struct(F.lit(-1.0).cast("float").alias("neg"), i.alias("id"))).alias("best"))
    big = big.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(63)))).withColumn("salt", F.col("salt").cast("long"))
    crowd = salted.join(big, ["digest", "salt"]).select(F.col("id").alias("me"), "best")
    every = small.unionByName(crowd).select("me", F.slice(F.expr("filter(best, b -> b.id <> me)"), 1, k).alias("best"))
    return every.select(F.col("me").alias("id"), F.explode("best").alias("b")).select("id", F.col("b.id").alias("other_id"), (-F.col("b.neg")).alias("similarity"))


def similar_pairs(vectors: DataFrame, at_least: float = 0.90, k: int = K, dim: int = DIM) -> DataFrame:
    """``(id_a, id_b)`` with id_a < id_b: one is among the k most similar of the other and the cosine is at least ``at_least``."""
    near = nearest(vectors, k, dim, at_least - 1e-4)
    near = near.where(F.col("similarity") >= at_least - 5e-5)
    return near.select(F.least("id", "other_id").alias("id_a"), F.greatest("id", "other_id").alias("id_b")).distinct()


def recall(vectors: DataFrame, at_least: float = 0.9, k: int = K, dim: int = DIM) -> DataFrame:
    """One row ``(k, queries, wanted, found, recall, reached)``: neighbours of every id whose digest is divisible by 20
    against an exact search of all vectors. An empty table reaches any recall."""
    from ..operators.vectors import search

    def unit(batches):
        for b in batches:
            x = unpack([v.as_py() for v in b.column(1)], dim) if b.num_rows else np.zeros((0, dim), np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(x), pa.list_(pa.float32()))], names=["id", "embedding"])

    rows = _usable(vectors, dim).select("id", F.struct(F.md5("vec").alias("digest"), "vec").alias("own")).groupBy("id").agg(F.max("own.digest").alias("digest"), F.max_by("own.vec", "own.digest").alias("vec"))
    rows = materialize(rows.select("id", "vec").mapInArrow(unit, "id string, embedding array<float>"), "knn-recall")
    asked = rows.where("conv(substring(md5(id), 1, 8), 16, 10) % 20 = 0")
    near = search(rows, asked.select(F.col("id").alias("query_id"), F.col("embedding").alias("vector")), k + 1).where("id <> query_id")
    exact = near.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "id"))), 1, k).alias("best")).select(F.col("query_id").alias("id"), F.explode("best").alias("b"))
    exact = exact.select("id", F.col("b.id").alias("other_id"))
    found = exact.join(nearest(vectors, k, dim).select("id", "other_id", F.lit(1).alias("hit")), ["id", "other_id"], "left")
    sums = found.agg(F.count_distinct("id").alias("queries"), F.count("*").alias("wanted"), F.count("hit").alias("found"))
    share = F.coalesce(F.try_divide(F.col("found").cast("double"), F.col("wanted").cast("double")), F.lit(1.0))
    return sums.select(F.lit(k).alias("k"), "queries", "wanted", "found", share.alias("recall"), (share >= at_least).alias("reached"))
