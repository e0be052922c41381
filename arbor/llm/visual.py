"""Problem 9: visually identical text with different characters."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def normalized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text_norm, n_special, n_mixed, n_whole)``, one row per input row.

    A null text stays null with null counts; empty and blank texts are kept
    (blanks unified). Rows are independent: no shuffle.
    """
    from . import glyphs

    classes = glyphs.look_alikes(docs.sparkSession)

    def run(batches):
        known = glyphs.of(classes)
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            norm = [None if t is None else known.canonical(t) for t in texts]
            seen = [(None, None, None) if t is None else known.findings(t) for t in texts]
            cols = [ids, pa.array(norm, pa.string())] + [pa.array([x[k] for x in seen], pa.int32()) for k in range(3)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "text_norm", "n_special", "n_mixed", "n_whole"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, text_norm string, n_special int, n_mixed int, n_whole int")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, canon, raw)``: 128-bit digests of the consistent form and of the
    text as it is. Null, empty and blank texts (also those of unseen characters
    only) have no row. Only digests leave the scan, never texts."""
    from . import glyphs

    classes = glyphs.look_alikes(docs.sparkSession)

    def run(batches):
        known = glyphs.of(classes)
        for b in batches:
            ids, canon, raw = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                form = known.canonical(t)
                if form.strip():
                    ids.append(i)
                    canon.append(_digest(form))
                    raw.append(canon[-1] if form == t else _digest(t))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(canon, pa.binary()), pa.array(raw, pa.binary())], names=["doc_id", "canon", "raw"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.where("text is not null and text <> '' and doc_id is not null").mapInArrow(run, "doc_id long, canon binary, raw binary")


def visual_classes(docs: DataFrame) -> DataFrame:
    """``(doc_id, class_id, n_spellings)`` for every text that has a visual twin of
    another spelling; class_id is the smallest doc_id of the class. The per-class
    figures are mergeable (combined before the shuffle), so a class that holds a
    third of all rows costs one row per task."""
    prints = materialize(fingerprints(docs), "visual-prints")
    spelled = prints.groupBy("canon", "raw").agg(F.min("doc_id").alias("first"))
    classes = spelled.groupBy("canon").agg(F.min("first").alias("class_id"), F.count("*").alias("n_spellings")).where("n_spellings > 1")
    return prints.join(classes, "canon").select("doc_id", "class_id", "n_spellings")


def visual_pairs(docs: DataFrame) -> DataFrame:
    """``(doc_a, doc_b)`` with doc_a < doc_b: texts that read the same but differ in
    their code points. Exact copies form no pair, repeated doc_ids with one text
    neither. Classes with one spelling never reach the join."""
    prints = materialize(fingerprints(docs), "visual-prints").dropDuplicates(["doc_id", "raw"])
    shared = prints.groupBy("canon", "raw").agg(F.lit(1).alias("one")).groupBy("canon").agg(F.count("*").alias("n")).where("n > 1").select("canon")
    left = prints.join(shared, "canon", "left_semi")
    a = left.select(F.col("doc_id").alias("doc_a"), "canon", F.col("raw").alias("raw_a"))
    b = left.select(F.col("doc_id").alias("doc_b"), "canon", F.col("raw").alias("raw_b"))
    return a.join(b, "canon").where("doc_a < doc_b and raw_a <> raw_b").select("doc_a", "doc_b").distinct()
