"""Problem 7: encoding a whole corpus with a public byte-level BPE.

Ordinary texts are encoded where they are scanned. A text of more than
``long_chars`` characters is cut in half again and again, its leaves are encoded
by different tasks, and neighbours are joined up a tree:

* *between pieces* (the tokenizer first splits text into pieces by a pattern
  without look-behind): from the last two pieces of the left part on, the
  pattern is run again until one of its boundaries meets a boundary of the right
  part; from there on both readings are the same;
* *inside a piece* that spans the cut: a window of tokens around the join is
  re-encoded and doubled until its outermost tokens agree with both sides. A
  sequence of BPE tokens is the encoding of its bytes exactly if every adjacent
  pair is, so agreement at both edges proves the whole.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_DIR = "/opt/tokenizers"
#: Texts longer than this are encoded as a tree of leaves of at most LEAF_CHARS.
LONG_CHARS, LEAF_CHARS = 12_000, 6_000
# Fixed value: the published splitting pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoder(folder: str = DEFAULT_DIR, name: str = "byte_bpe_50k"):
    import tiktoken

    with open(os.path.join(folder, name + ".tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _splitter():
    import regex

    return regex.compile(PATTERN)


Piece = tuple[str, list[int]]


def encode_pieces(text: str, enc) -> list[Piece]:
    return [(p, enc._encode_single_piece(p.encode())) for p in _splitter().findall(text)]


def join_tokens(left: list[int], right: list[int], enc, window: int = 4) -> list[int]:
    """The encoding of the bytes of ``left`` + ``right``, both encodings of one unsplit text's parts."""
    if not left or not right:
        return left or right
    while True:
        a, b = left[-window:], right[:window]
        mid = enc._encode_single_piece(enc.decode_bytes(a + b))
        if (len(a) == len(left) or mid[0] == a[0]) and (len(b) == len(right) or mid[-1] == b[-1]):
            return left[: len(left) - len(a)] + mid + right[len(b):]
        window *= 2


def join_pieces(left: list[Piece], right: list[Piece], enc) -> list[Piece]:
    """The pieces of the joined text, exactly as if it had been encoded at once."""
    if not left or not right:
        return left or right
    keep, tail = left[:-2], left[-2:]
    tail_text = "".join(p for p, _ in tail)
    starts_left = {}
    at = 0
    for k, (p, _) in enumerate(tail):
        starts_left[at] = k
        at += len(p)
    cut, ends = at, {}
    for k, (p, _) in enumerate(right):
        at += len(p)
        ends[at] = k
    made: list[Piece] = []
    for m in _splitter().finditer(tail_text + "".join(p for p, _ in right)):
        s, e = m.span()
        k = starts_left.get(s)
        if k is not None and tail[k][0] == m.group():
            made.append(tail[k])
        elif s < cut < e and k is not None and s + len(tail[k][0]) == cut and e in ends:
            inner = [i for p in right[: ends[e] + 1] for i in p[1]] if ends[e] == 0 else None
            made.append((m.group(), join_tokens(tail[k][1], inner, enc) if inner is not None else enc._encode_single_piece(m.group().encode())))
        else:
            made.append((m.group(), enc._encode_single_piece(m.group().encode())))
        if e >= cut and (e == cut or e in ends):
            return keep + made + (right[ends[e] + 1:] if e != cut else right)
    return keep + made


def join_tree(parts: list[list[Piece]], enc) -> list[Piece]:
    while len(parts) > 1:
        parts = [join_pieces(parts[k], parts[k + 1], enc) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0] if parts else []


def cuts(length: int, leaf: int) -> list[int]:
    """Bounds of the leaves that repeated halving gives."""
    if length <= leaf:
        return [0, length]
    half = length // 2
    return cuts(half, leaf) + [half + c for c in cuts(length - half, leaf)[1:]]


_SCHEMA = "doc_id long, ids array<int>"


def _id_batch(doc_ids, rows: list[np.ndarray]) -> pa.RecordBatch:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    values = np.concatenate(rows).astype(np.int32) if rows else np.zeros(0, np.int32)
    ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))
    return pa.RecordBatch.from_arrays([doc_ids, ids], names=["doc_id", "ids"])


def token_ids(docs: DataFrame, tokenizer_dir: str = DEFAULT_DIR, id_col: str = "doc_id", text_col: str = "text",
              long_chars: int = LONG_CHARS, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """``(doc_id, ids)``: one row per input row, without special tokens.

    A null or empty text has the empty list. Text is taken as it is. Repeated rows
    stay repeated. Long texts (rare) are spread over tasks leaf by leaf; their rows
    are numbered so that repeated ids don't mix.
    """
    def whole(batches):
        enc = encoder(tokenizer_dir)
        empty = np.zeros(0, np.uint32)
        for b in batches:
            yield _id_batch(b.column(0), [enc.encode_to_numpy(t, disallowed_special=()) if t else empty for t in b.column(1).to_pylist()])

    def leaves(batches):
        for b in batches:
            out = {"row": [], "doc_id": [], "leaf": [], "part": []}
            for row, doc, text in zip(*(c.to_pylist() for c in b.columns)):
                at = cuts(len(text), leaf_chars)
                for k, (s, e) in enumerate(zip(at, at[1:])):
                    for name, x in zip(out, (row, doc, k, text[s:e])):
                        out[name].append(x)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("row", pa.string()), ("doc_id", pa.int64()), ("leaf", pa.int32()), ("part", pa.string())]))

    def encode_leaf(batches):
        enc = encoder(tokenizer_dir)
        for b in batches:
            sizes, ids = [], []
            for text in b.column(3).to_pylist():
                pieces = encode_pieces(text, enc)
                sizes.append([len(i) for _, i in pieces])
                ids.append([t for _, i in pieces for t in i])
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(sizes, pa.list_(pa.int32())), pa.array(ids, pa.list_(pa.int32()))], names=["row", "doc_id", "leaf", "sizes", "ids"])

    def join_leaves(batches):
        enc = encoder(tokenizer_dir)
        for b in batches:
            rows = []
            for parts in b.column(1).to_pylist():
                built = []
                for part in sorted(parts, key=lambda x: x["leaf"]):
                    at, pieces = 0, []
                    for n in part["sizes"]:
                        own = part["ids"][at:at + n]
                        pieces.append((enc.decode_bytes(own).decode(), own))
                        at += n
                    built.append(pieces)
                rows.append(np.array([t for _, i in join_tree(built, enc) for t in i], np.uint32))
            yield _id_batch(b.column(0), rows)

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    short = picked.where(f"text is null or length(text) <= {int(long_chars)}").mapInArrow(whole, _SCHEMA)
    # a retried task may number its rows differently; a digest of the content plus a rank can't
    long_ = picked.where(f"length(text) > {int(long_chars)}").groupBy("doc_id", "text").count()
    long_ = long_.select(F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("copy"), "doc_id", "text")
    numbered = long_.select(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.sha2("text", 256), F.col("copy")).alias("row"), "doc_id", "text")
    spread = numbered.mapInArrow(leaves, "row string, doc_id long, leaf int, part string").repartition("row", "leaf")
    coded = spread.mapInArrow(encode_leaf, "row string, doc_id long, leaf int, sizes array<int>, ids array<int>")
    grouped = coded.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.collect_list(F.struct("leaf", "sizes", "ids")).alias("parts")).select("doc_id", "parts")
    return short.unionByName(grouped.mapInArrow(join_leaves, _SCHEMA))


def decoded(ids: DataFrame, tokenizer_dir: str = DEFAULT_DIR) -> DataFrame:
    """``(doc_id, n_tokens, text_md5)``: a digest of the text that a list of ids stands for."""
    import hashlib

    def run(batches):
        enc = encoder(tokenizer_dir)
        for b in batches:
            lists = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in lists], pa.int32()), pa.array([hashlib.md5(enc.decode_bytes(x)).hexdigest() for x in lists], pa.string())], names=["doc_id", "n_tokens", "text_md5"])

    return ids.mapInArrow(run, "doc_id long, n_tokens int, text_md5 string")
