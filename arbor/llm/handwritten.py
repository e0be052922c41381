"""Problem 2: generated, minified, vendored and data files among source files.

No file is labelled, so labels are derived: *giveaways* (a generator's or another
project's notice in the leading comment, directory and file names that tools and
package managers use, a body of literals only) mark examples. Notices and names that gave a file away are masked, and a linear
support-vector classifier learns from the rest: hashed character n-grams of the
body, hashed path components, and bins of a few measures of the body (line length,
share of literals, repetition, in how many repositories the same body occurs). So
it also finds files without a giveaway. Validation is split by repository.

The classifier is fitted on a bounded sample (``SAMPLE`` rows); everything else,
also the count of repositories per body, covers all rows.
"""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from .syntax.check import decode, language

BITS, NGRAM = 16, 5
#: Rows the classifier is fitted on: at most this many with a giveaway, and twice as many without.
SAMPLE = 2000
EPOCHS, C, SEED = 12, 1.0, 7
#: Rounds of fitting. Rows without a giveaway that score above 0 count as examples in
#: the next round, those between UNSURE and 0 are left out of it.
ROUNDS, UNSURE = 4, -0.6
HOLDOUT = 5  # every fifth repository validates
#: A file is flagged above this score. It is below 0, as the files that nothing gives away count as hand-written when
#: the classifier is fitted, though some are not.
THRESHOLD = -0.2
#: A body of so many lines of which so much is in lines of literals gives a file of data away.
DATA_LINES, DATA_SHARE = 4, 0.7

# Names that package managers and generators use.
_FOREIGN_DIRS = frozenset(("vendor", "vendored", "third_party", "third-party", "thirdparty", "node_modules", "bower_components", "external", "deps"))
_MADE_DIRS = frozenset(("generated", "__generated__", "gen-src", "gen_src", "autogen", "dist"))
_MADE_NAME = re.compile(r"(?:\.|-|_)(?:min|bundle|chunk|generated|pb|g)\.[a-z]+$|_pb2(?:_grpc)?\.py$|\.pb\.\w+$|^zz_generated", re.I)
_MADE_NOTICE = re.compile(r"@generated|(?:auto-?|machine[- ])generated|generated (?:by|from|code|file)|do(?:es)? not (?:edit|modify)|produced by", re.I)
_FOREIGN_NOTICE = re.compile(r"upstream|copied from|released under|\b(?:MIT|BSD|Apache|ISC)\b|contributors|\bv?\d+\.\d+(?:\.\d+)+\b|^/\*!", re.I)
_LEAD = re.compile(r"""\s*(?:/\*[\s\S]*?\*/|//[^\n]*|\#(?!include|define|if|pragma|ifndef)[^\n]*|'use strict';|"use strict";)""")
_COMMENT = re.compile(r"/\*[\s\S]*?\*/|(?<![:\"'])//[^\n]*|^[ \t]*#(?!include|define|if|endif|else|pragma)[^\n]*", re.M)
_LITERAL_LINE = re.compile(r"""\s*+(?>(?:-?(?:\d[\w.]*+|\.\d++)|[bru]?"(?:[^"\\]|\\.)*+"|[bru]?'(?:[^'\\]|\\.)*+'|[\[\](){}]|true|false|null|None|nil)\s*+[,;:]?+\s*+)++$""")
_WORD = re.compile(r"[A-Za-z_]\w*|\d[\w.]*")
_PARTS = re.compile(r"[/\\]+")
_SUBWORD = re.compile(r"[A-Za-z][a-z]*|\d+")


class Parts(NamedTuple):
    made: bool       # a giveaway of a tool
    foreign: bool    # a giveaway of another project
    lead: str        # leading comments
    body: str        # the rest


def split_text(path: str, text: str) -> Parts:
    at = 0
    while m := _LEAD.match(text, at):
        at = m.end()
    lead, body = text[:at], text[at:]
    *dirs, name = _PARTS.split(path.lower())
    made = bool(_MADE_DIRS.intersection(dirs)) or bool(_MADE_NAME.search(name)) or bool(_MADE_NOTICE.search(lead))
    return Parts(made, bool(_FOREIGN_DIRS.intersection(dirs)) or bool(_FOREIGN_NOTICE.search(lead)), lead, body)


def body_lines(body: str) -> list[str]:
    return [x for line in _COMMENT.sub("", body).split("\n") if (x := line.strip())]


def body_print(lines: list[str]) -> bytes | None:
    """Digest of a body without comments and layout; None if it is too short to tell copies."""
    joined = "\n".join(lines)
    return hashlib.blake2b(joined.encode("utf-8", "surrogatepass"), digest_size=12).digest() if len(joined) >= 200 and len(lines) > 1 else None


def literal_share(lines: list[str]) -> float:
    """Characters in lines of nothing but literals, as a share of all."""
    return sum(len(x) for x in lines if _LITERAL_LINE.match(x)) / (sum(map(len, lines)) or 1)


def is_data(lines: list[str]) -> bool:
    """Whether a body is little else than literals: a giveaway of a file of data."""
    return len(lines) >= DATA_LINES and literal_share(lines) >= DATA_SHARE


def _bin(x: float, edges) -> int:
    return sum(x >= e for e in edges)


def measures(body: str, lines: list[str]) -> list[str]:
    """Names of the bins that the body falls into."""
    size = sum(map(len, lines)) or 1
    shapes = {_WORD.sub("w", x) for x in lines}
    return [
        f"mean-line {_bin(size / max(1, len(lines)), (40, 60, 90, 140, 250, 500))}",
        f"longest-share {_bin(max(map(len, lines), default=0) / size, (.1, .3, .6, .9))}",
        f"literal {_bin(literal_share(lines), (.05, .15, .3, .5, .7, .9))}",
        f"shapes {_bin(len(shapes) / max(1, len(lines)), (.02, .05, .1, .2, .35, .5, .7))}",
        f"space {_bin(body.count(' ') / max(1, len(body)), (.02, .05, .1, .2, .3))}",
    ]


def _slot(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big") & ((1 << BITS) - 1)


_SLOTS: dict[str, int] = {}


def slot(name: str) -> int:
    if name not in _SLOTS:
        if len(_SLOTS) > 100_000:
            _SLOTS.clear()
        _SLOTS[name] = _slot(name)
    return _SLOTS[name]


_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)


def grams(text: str) -> np.ndarray:
    """Distinct hashed character n-grams, digits as one."""
    b = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    if len(b) < NGRAM:
        return np.zeros(0, np.int64)
    b = np.where((b >= 48) & (b <= 57), np.uint8(48), b).astype(np.uint32)
    h = np.zeros(len(b) - NGRAM + 1, np.uint32)
    for k in range(NGRAM):
        h ^= (b[k:len(b) - NGRAM + 1 + k] + np.uint32(1)) * _MULT[k]
    h ^= h >> 15
    h *= np.uint32(0x2C1B3C6D)
    seen = np.zeros(1 << BITS, bool)
    seen[h >> np.uint32(32 - BITS)] = True
    return np.flatnonzero(seen)


def features(path: str, parts: Parts, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values): n-grams share one unit of length, every named feature is one of its own."""
    g = grams(parts.body)
    *dirs, name = _PARTS.split(path.lower())
    stem, _, ext = name.rpartition(".")
    names = [f"dir {x}" for x in dirs[1:] if x not in _FOREIGN_DIRS and x not in _MADE_DIRS and not re.search(r"_\w{2,3}$", x)]
    names += [f"name {x}" for x in _SUBWORD.findall(_MADE_NAME.sub("", name))] + [f"ext {ext}"]
    bins = measures(parts.body, lines)
    slots = np.concatenate([g, np.array([slot(x) for x in (*bins, *names)], np.int64)])
    values = np.concatenate([np.full(len(g), 1 / max(1.0, len(g)) ** 0.5), np.full(len(bins), 0.5), np.full(len(names), 0.15)])
    return slots, values


COPIES = (2, 3)  # bins of the number of repositories with the same body


def copy_name(repos: int) -> str:
    return f"copies {_bin(repos, COPIES)}"


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weight_pos: float = 1.0) -> np.ndarray:
    """Weights of a linear support-vector machine (squared hinge, dual coordinate descent). The last one is the bias."""
    w = np.zeros((1 << BITS) + 1)
    rows = [(np.append(s, 1 << BITS), np.append(v, 1.0)) for s, v in rows]
    # a slot may come twice in a row; then its values add up, as they do when a row is scored
    norm = np.array([float((v ** 2).sum()) for _, v in rows])
    cost = np.where(labels > 0, C * weight_pos, C)
    alpha, rng = np.zeros(len(rows)), np.random.default_rng(SEED)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            s, v = rows[i]
            gradient = labels[i] * float((w[s] * v).sum()) - 1 + alpha[i] / (2 * cost[i])
            new = max(0.0, alpha[i] - gradient / (norm[i] + 1 / (2 * cost[i])))
            if new != alpha[i]:
                np.add.at(w, s, (new - alpha[i]) * labels[i] * v)
                alpha[i] = new
    return w


def fit_rounds(rows: list[tuple[np.ndarray, np.ndarray]], given: np.ndarray) -> np.ndarray:
    """Self-training: the weights after ROUNDS rounds."""
    labels, kept = np.where(given, 1, -1), np.ones(len(rows), bool)
    w = np.zeros((1 << BITS) + 1)
    for _ in range(ROUNDS):
        chosen = np.flatnonzero(kept)
        w = fit([rows[i] for i in chosen], labels[chosen])
        scores = np.array([float((w[s] * v).sum()) for s, v in rows]) + w[-1]
        labels = np.where(given | (scores > 0), 1, -1)
        kept = given | (scores > 0) | (scores < UNSURE)
    return w


def _sources(files: DataFrame) -> DataFrame:
    """(path, repo, content) of the rows whose extension has a language."""
    from .syntax.check import EXTENSIONS

    rows = files.select(F.col("path").cast("string").alias("path"), F.coalesce(F.col("repo").cast("string"), F.element_at(F.split("path", "[/\\\\]"), 1)).alias("repo"), F.col("content").cast("binary").alias("content"))
    return rows.where(F.lower(F.regexp_extract("path", r"[^/\\]\.([A-Za-z]+)$", 1)).isin(sorted(EXTENSIONS)))


def _read(batch):
    for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
        parts = split_text(path, decode(content or b"").replace("\r\n", "\n"))
        yield path, parts, body_lines(parts.body)


def marks(files: DataFrame) -> DataFrame:
    """``(path, repo, given, repos)``: whether something gives the file away, and in how
    many repositories its body occurs (1 for bodies too short to tell). One row per path."""
    def run(batches):
        for b in batches:
            rows = [(p, x.made or x.foreign or is_data(lines), body_print(lines)) for p, x, lines in _read(b)]
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("repo"), pa.array([g for _, g, _ in rows], pa.bool_()), pa.array([f for _, _, f in rows], pa.binary())], names=["path", "repo", "given", "print"])

    seen = _sources(files).mapInArrow(run, "path string, repo string, given boolean, print binary")
    seen = seen.groupBy("path").agg(F.max("repo").alias("repo"), F.max("given").alias("given"), F.max(F.hex("print")).alias("print"))
    seen = materialize(seen, "file-marks")
    spread = seen.where("print is not null").select("print", "repo").distinct().groupBy("print").agg(F.count("*").alias("repos")).where("repos > 1")
    return seen.join(spread, "print", "left").select("path", "repo", "given", F.coalesce("repos", F.lit(1)).cast("int").alias("repos"))


def _held_out(repo) -> object:
    return F.pmod(F.xxhash64(F.coalesce(repo, F.lit(""))), F.lit(HOLDOUT)) == 0


def train(files: DataFrame, marked: DataFrame) -> np.ndarray:
    """Weights fitted on a bounded sample of the repositories that don't validate."""
    pool = marked.where(~_held_out(F.col("repo")))
    order = [F.xxhash64("path", F.lit(SEED)), "path"]
    chosen = pool.where("given").orderBy(*order).limit(SAMPLE).unionByName(pool.where("not given").orderBy(*order).limit(2 * SAMPLE))
    known = {r.path: (r.given, r.repos) for r in chosen.collect()}
    if not known:
        return np.zeros((1 << BITS) + 1)
    spark = files.sparkSession
    names = spark.createDataFrame([(p,) for p in sorted(known)], "path string")

    def run(batches):
        for b in batches:
            rows = [(p, *features(p, x, lines)) for p, x, lines in _read(b)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string())] + [pa.array([r[k].astype(t).tobytes() for r in rows], pa.binary()) for k, t in ((1, np.int32), (2, np.float32))], names=["path", "slots", "vals"])

    picked = _sources(files).join(F.broadcast(names), "path")  # at most 3 * SAMPLE names
    found = {}
    for r in picked.mapInArrow(run, "path string, slots binary, vals binary").collect():
        found[r.path] = (np.append(np.frombuffer(r.slots, np.int32), slot(copy_name(known[r.path][1]))), np.append(np.frombuffer(r.vals, np.float32), 1.0))
    paths = sorted(found)
    return fit_rounds([found[p] for p in paths], np.array([known[p][0] for p in paths], bool))


def _scores(w: np.ndarray, texts) -> list[float]:
    out = []
    for path, parts, lines in texts:
        s, v = features(path, parts, lines)
        out.append(float((w[s] * v).sum() + w[-1]))
    return out


def _fitted(files: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(marks of all files, weights)."""
    marked = materialize(marks(files), "file-marks-repos")
    return marked, train(files, marked)


def _scored(files: DataFrame, marked: DataFrame, w: np.ndarray) -> DataFrame:
    shared = files.sparkSession.sparkContext.broadcast(w.astype(np.float32))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(_scores(shared.value, _read(b)), pa.float64())], names=["path", "part"])

    parts = _sources(files).select("path", "content").mapInArrow(run, "path string, part double").groupBy("path").agg(F.max("part").alias("part"))
    bins = F.when(F.col("repos") >= COPIES[1], float(w[slot(copy_name(COPIES[1]))])).when(F.col("repos") >= COPIES[0], float(w[slot(copy_name(COPIES[0]))])).otherwise(float(w[slot(copy_name(1))]))
    score = F.col("part") + bins
    learned = F.lit(bool(np.any(w)))
    return marked.join(parts, "path").select("path", "repo", "given", "repos", score.alias("score"), (learned & (score > THRESHOLD)).alias("flagged"))


def scored(files: DataFrame) -> DataFrame:
    """``(path, repo, given, repos, score, flagged)``: one row per path of a source file, by the classifier alone: what gave
    examples away is masked in every file, and adds nothing to its score.

    A null content counts as empty, so only its path can tell of such a file; rows
    that come twice count once, of different contents for one path the highest score.
    Paths without a language have no row. Without any giveaway in the table nothing can be learned and
    nothing is flagged.
    """
    return _scored(files, *_fitted(files))


def validation(files: DataFrame) -> DataFrame:
    """Agreement with the giveaways in the repositories that were not trained on, from the
    masked features alone: one row of counts."""
    rows = scored(files).where(_held_out(F.col("repo")))
    return rows.agg(
        F.count("*").alias("files"), F.count_if("given").alias("given"), F.count_if("flagged").alias("found"), F.count_if(F.col("given") & F.col("flagged")).alias("given_found"),
    )


def minified(text: str) -> str:
    """Without comments, on one line, without blanks that nothing needs."""
    return re.sub(r"\s*([^\w\s])\s*", r"\1", re.sub(r"\s+", " ", _COMMENT.sub("", text))).strip()


def tabulated(text: str) -> str:
    """The text's words as a table of numbers."""
    numbers = [str(_slot(x)) for x in _WORD.findall(text)]
    return "values = [\n" + "".join("    " + ", ".join(numbers[n:n + 10]) + ",\n" for n in range(0, len(numbers), 10)) + "]\n"


#: Files that are planted, by what they are made of: 'hand-written' is the file as it is.
PLANTS = {"hand-written": lambda text: text, "minified": minified, "data": tabulated}


def planted(files: DataFrame) -> DataFrame:
    """``(kind, files, flagged)``: the hand-written files (not flagged) of at least DATA_LINES lines in the repositories that were
    not trained on, as they are under another name and changed into each kind, nothing of which gives them away. Shares of
    'flagged' are the recall for planted kinds and the rate of false alarms for 'hand-written'. Minified are files of languages that need no line ends."""
    marked, w = _fitted(files)
    hand = _scored(files, marked, w).where(~F.col("flagged") & _held_out(F.col("repo"))).select("path")
    shared = files.sparkSession.sparkContext.broadcast(w.astype(np.float32))
    alone = float(w[slot(copy_name(1))])

    def run(batches):
        for b in batches:
            kinds, scores = [], []
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                text = decode(content or b"").replace("\r\n", "\n")
                if len(body_lines(split_text(path, text).body)) < DATA_LINES:
                    continue
                *above, name = path.rpartition("/")
                for kind, change in PLANTS.items():
                    if kind != "minified" or language(path) in ("javascript", "java"):
                        parts = split_text("".join(above) + "x_" + name, change(text))
                        kinds.append(kind)
                        scores.append(_scores(shared.value, [("".join(above) + "x_" + name, parts, body_lines(parts.body))])[0] + alone)
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(scores, pa.float64())], names=["kind", "score"])

    rows = _sources(files).join(hand, "path", "left_semi").select("path", "content").dropDuplicates(["path"]).mapInArrow(run, "kind string, score double")
    return rows.groupBy("kind").agg(F.count("*").alias("files"), F.count_if(F.col("score") > THRESHOLD).alias("flagged"))
