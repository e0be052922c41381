"""Problem 4: cutting oversized items at natural boundaries.

A rolling hash over the last WINDOW characters marks landmarks that depend on the
text around them only. Each piece ends at the natural boundary nearest to the
first landmark behind the minimum size, so an edit moves the cuts next to it and no others. A
piece starts with the last ``overlap`` characters of the piece before.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP, MINIMUM = 3000, 200, 1000
WINDOW, MASK, NEAR = 24, 0x1FF, 400
#: Natural boundaries, best first: behind a blank line, behind a line, behind a sentence, behind a word.
_BOUNDARIES = (re.compile(r"\n[ \t\r]*\n+"), re.compile(r"\n"), re.compile(r"[.!?;][\"')\]]*\s"), re.compile(r"\s"))


def landmarks(text: str) -> np.ndarray:
    """Positions behind which the hash of the last WINDOW characters ends in zeros."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(codes) < WINDOW:
        return np.zeros(0, np.int64)
    mixed = codes * np.uint32(0x9E3779B1)
    mixed ^= mixed >> 15
    n = len(codes) - WINDOW + 1
    h = np.zeros(n, np.uint32)
    for k in range(WINDOW):
        h = h * np.uint32(31) + mixed[k:k + n]
    h ^= h >> 13
    return np.flatnonzero((h & np.uint32(MASK)) == 0) + WINDOW


def cut_points(text: str, limit: int = LIMIT, overlap: int = OVERLAP, minimum: int = MINIMUM) -> list[int]:
    """Where pieces end; new text per piece is at most ``limit - overlap``."""
    most = limit - overlap
    if len(text) <= limit:
        return [len(text)]
    marks, cuts, at = landmarks(text), [], 0
    while len(text) - at > most:
        low, high = at + min(minimum, most), at + most
        k = int(np.searchsorted(marks, low))
        wish = int(marks[k]) if k < len(marks) and marks[k] <= high else high
        best = None
        for rank, pattern in enumerate(_BOUNDARIES):
            near = (NEAR, NEAR, NEAR, most)[rank]
            ends = [m.end() for m in pattern.finditer(text, max(low, wish - near), min(high, wish + near))]
            ends = [e for e in ends if low <= e <= high]
            if ends:
                best = min(ends, key=lambda e: (abs(e - wish), e))
                break
        at = best or wish
        cuts.append(at)
    return [*cuts, len(text)]


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP, minimum: int = MINIMUM) -> list[tuple[int, int]]:
    """(start, end) of each piece; each but the first starts ``overlap`` characters before the end of the one before."""
    cuts = cut_points(text, limit, overlap, minimum)
    return [(max(0, a - overlap) if k else 0, b) for k, (a, b) in enumerate(zip([0, *cuts], cuts))]


def split_items(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``(item_kind, item_id, source, piece, n_pieces, start, text, text_id)`` for items ``(item_kind, item_id, source, text)``
    longer than ``limit`` characters; shorter, empty and null ones have no row. ``text_id`` tells several texts of one id apart."""
    def run(batches):
        for b in batches:
            out = [[] for _ in range(8)]
            for kind, item, source, text in zip(*(c.to_pylist() for c in b.columns)):
                spans, digest = pieces(text, limit, overlap), hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()
                for n, (s, e) in enumerate(spans):
                    for column, x in zip(out, (kind, item, source, n, len(spans), s, text[s:e], digest)):
                        column.append(x)
            types = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names=["item_kind", "item_id", "source", "piece", "n_pieces", "start", "text", "text_id"])

    rows = items.select("item_kind", "item_id", "source", "text").where(f"length(text) > {int(limit)}")
    return rows.mapInArrow(run, "item_kind string, item_id string, source string, piece int, n_pieces int, start int, text string, text_id string")


def _decoded(content: bytes) -> str:
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        return content.decode("latin-1")


def entity_items(entities: DataFrame, files: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``(item_kind, item_id, source, text)`` of entities whose lines have more than ``limit`` characters.

    Only line offsets are joined to all spans; contents are joined to the long spans
    alone. Null or reversed spans and files without content don't count; a start before
    line 1 counts as 1; lines behind the end of the file are cut off.
    """
    spans = entities.select(F.col("id").cast("string").alias("id"), F.col("file_path").cast("string").alias("path"), F.col("start_line").cast("int").alias("s"), F.col("end_line").cast("int").alias("e"))
    spans = spans.where("id is not null and path is not null and s <= e").select("id", "path", F.greatest("s", F.lit(1)).alias("s"), "e").distinct()
    texts = files.select(F.col("path").cast("string").alias("path"), F.col("content").cast("binary").alias("content")).where(f"path is not null and octet_length(content) > {int(limit)}")

    def ends(batches):
        for b in batches:
            paths, offsets = [], []
            for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                text = _decoded(c)
                if len(text) > limit:
                    paths.append(p)
                    offsets.append(np.cumsum([len(x) + 1 for x in text.split("\n")]).astype(np.int32))
            values = pa.array(offsets, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), values], names=["path", "ends"])

    lines = texts.mapInArrow(ends, "path string, ends array<int>").distinct()
    size = F.expr("if(s > size(ends), 0, element_at(ends, least(e, size(ends))) - if(s = 1, 0, element_at(ends, least(s, size(ends)) - 1)) - 1)")
    long_ = spans.join(lines, "path").where(size > limit).select("id", "path", "s", "e").distinct()

    def slices(batches):
        for b in batches:
            rows = [(i, p, "\n".join(_decoded(c).split("\n")[s - 1:e])) for i, p, s, e, c in zip(*(b.column(k).to_pylist() for k in range(5)))]
            yield pa.RecordBatch.from_arrays([pa.array(["entity"] * len(rows), pa.string())] + [pa.array([r[k] for r in rows], pa.string()) for k in range(3)], names=["item_kind", "item_id", "source", "text"])

    joined = long_.join(texts, "path").select("id", "path", "s", "e", "content")
    return joined.mapInArrow(slices, "item_kind string, item_id string, source string, text string")


def file_items(file_vectors: DataFrame) -> DataFrame:
    """``(item_kind, item_id, source, text)`` of the documents of files."""
    return file_vectors.select(F.lit("file").alias("item_kind"), F.col("id").cast("string").alias("item_id"), F.col("file_path").cast("string").alias("source"), F.col("document").cast("string").alias("text")).where("item_id is not null")


def oversized_pieces(file_vectors: DataFrame, entities: DataFrame, files: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of all oversized documents and entities. Rows that come twice with one text are cut once; an id with
    several long spans or texts has the pieces of each."""
    documents = file_items(file_vectors).where(f"length(text) > {int(limit)}").dropDuplicates(["item_id", "text"])
    return split_items(documents.unionByName(entity_items(entities, files, limit).dropDuplicates(["item_id", "text"])), limit, overlap)


def oversized_ids(file_vectors: DataFrame, entities: DataFrame, files: DataFrame) -> DataFrame:
    """``(item_kind, item_id)``, distinct: what had to be cut."""
    return oversized_pieces(file_vectors, entities, files).where("n_pieces > 1").select("item_kind", "item_id").distinct()


def round_trip(file_vectors: DataFrame, entities: DataFrame, files: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``(item_kind, item_id, n_chars, text_md5, fits, overlaps)``, distinct: each oversized item put together again from its pieces, whether
    they keep the limit, and whether each starts with the end of the one before."""
    def join(batches):
        for b in batches:
            out = [[] for _ in range(6)]
            for kind, item, pieces in zip(*(c.to_pylist() for c in b.columns)):
                texts = [p["text"] for p in sorted(pieces, key=lambda p: p["piece"])]
                whole = texts[0] + "".join(t[overlap:] for t in texts[1:])
                shared = all(a[-overlap:] == t[:overlap] for a, t in zip(texts, texts[1:]))
                for column, x in zip(out, (kind, item, len(whole), hashlib.md5(whole.encode("utf-8", "surrogatepass")).hexdigest(), max(map(len, texts)) <= limit, shared)):
                    column.append(x)
            types = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names=["item_kind", "item_id", "n_chars", "text_md5", "fits", "overlaps"])

    rows = oversized_pieces(file_vectors, entities, files, limit, overlap)
    # the pieces of one item, which is one row of the input
    items = rows.groupBy("item_kind", "item_id", "source", "text_id").agg(F.collect_list(F.struct("piece", "text")).alias("pieces")).select("item_kind", "item_id", "pieces")
    return items.mapInArrow(join, "item_kind string, item_id string, n_chars long, text_md5 string, fits boolean, overlaps boolean").distinct()
