"""Problem 8: evaluation texts leaking into training text.

The test items are put into a BM25 inverted index: posting lists of (item, impact), with
the highest impact of each term in each of BLOCKS blocks of items. A term's impact in an item is divided by the item's own
threshold, the lowest score that any ``run`` consecutive words of the item have in it, so one
threshold, 1, holds for all items and a real leak can't score below it.

1. Every run of ``run`` words of a text is bounded by the sum of its terms' highest impacts, first over all
   items, then over each block (running sums over the text). Runs that can reach the
   threshold, joined where they overlap, are the text's *stretches*; they hold every leaked run whole.
2. Stretches are cut into passages of less than twice ``run`` words, so that every run lies whole in one of
   them. Each passage is a query: block-max WAND retrieves all items above the threshold
   from the blocks that can hold one.
3. A retrieved item is verified: the stretch must share the run of words. How much of the item's question
   and of its answers was shared is counted.

Words are compared by skeletons, which join letters that look alike or differ in case only,
whatever the text around them. Verification looks at the letters as written, so that
what only a chain of such steps joins (Latin n and v, by the Greek nu) is told apart.
"""

from __future__ import annotations

import math
import re
from array import array
from bisect import bisect_left
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .glyphs import Glyphs, look_alikes, of

RUN = 15
#: Blocks of items of an index.
BLOCKS = 50
K1, B = 1.2, 0.75
#: Words of the items of one index (about 100 bytes each in a worker). More items make several indexes, shipped one by one.
SHARD_WORDS = 1_000_000
#: Words whose numbers a worker remembers.
TERMS = 500_000
_WORD = re.compile(r"[^\W_]+")
_OPTIONS = re.compile(r"\(a\)", re.I)
_SENTENCE = re.compile(r"[.!?]\s+(?=\S)")


def _surface(text: str, glyphs: Glyphs) -> list[str]:
    """Runs of letters or digits as written, without what nobody sees."""
    return _WORD.findall(text if text.isascii() else glyphs.joined(text))


def words(text: str, glyphs: Glyphs) -> list[str]:
    """Runs of letters or digits as skeletons: without case and the same for all look-alikes."""
    return [glyphs.skeleton(w) for w in _WORD.findall(text.lower() if text.isascii() else glyphs.joined(text).lower())]


def parts(text: str) -> tuple[int, int]:
    """How many words stand before the question, its last sentence with '?' up to the answers '(a) ...', and before the
    answers. Without a question or answers they are at the end."""
    count = lambda upto: len(_WORD.findall(text[:upto]))
    options = _OPTIONS.search(text)
    end = options.start() if options else len(text)
    asked = text.rfind("?", 0, end) if not options else end
    if asked < 0:
        return count(len(text)), count(end)
    begins = [m.end() for m in _SENTENCE.finditer(text, 0, asked)]
    return count(begins[-1] if begins else 0), count(end)


class _Terms(dict):
    """Numbers of words, 0 for those that no item has; filled as words are met."""

    def __init__(self, vocab: dict[str, int], glyphs: Glyphs):
        super().__init__()
        self.vocab, self.glyphs = vocab, glyphs

    def __missing__(self, word: str) -> int:
        if len(self) > TERMS:
            self.clear()
        self[word] = number = self.vocab.get(self.glyphs.skeleton(word), 0)
        return number

    def __reduce__(self):
        return _Terms, (self.vocab, self.glyphs)


class Leak(NamedTuple):
    longest: int    # words of the longest shared run
    shared: int     # words of the item in shared runs
    question: int   # of these, in the question
    answers: int    # of these, in the answers


class BlockMaxIndex:
    """BM25 posting lists of a bounded set of items, impacts as a fraction of each item's threshold."""

    def __init__(self, items: list[tuple[int, str]], glyphs: Glyphs, run: int = RUN):
        kept = [(i, w, t) for i, t in items if t and len(w := words(t, glyphs)) >= run]
        self.run, self.glyphs, self.item_ids = run, glyphs, [i for i, _, _ in kept]
        vocab: dict[str, int] = {}
        self.ids = [array("i", [vocab.setdefault(w, len(vocab) + 1) for w in ws]) for _, ws, _ in kept]
        self.surface = [_surface(t, glyphs) for _, _, t in kept]
        self.parts = [parts(t) for _, _, t in kept]
        self.terms = _Terms(vocab, glyphs)
        n, size = len(kept), len(vocab) + 1
        df = Counter(t for x in self.ids for t in set(x))
        mean = sum(map(len, self.ids)) / max(n, 1)
        self.items, self.impacts = [array("i") for _ in range(size)], [array("f") for _ in range(size)]
        for k, x in enumerate(self.ids):
            score = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(x) / mean)) for t, c in Counter(x).items()}
            lowest = min(sum(score[t] for t in set(x[p:p + run])) for p in range(len(x) - run + 1))
            for t, s in score.items():
                self.items[t].append(k)
                self.impacts[t].append(s / lowest * (1 + 1e-4))
        self.block = size = -(-n // BLOCKS) or 1
        self.tops: list[dict[int, float]] = [{} for _ in self.items]
        self.block_max = np.zeros((len(self.items), BLOCKS), np.float32)
        for t, (own, impacts) in enumerate(zip(self.items, self.impacts)):
            for k, s in zip(own, impacts):
                self.tops[t][k // size] = max(self.tops[t].get(k // size, 0.0), s)
            for block, top in self.tops[t].items():
                self.block_max[t, block] = top

    def numbers(self, surface: list[str]) -> list[int]:
        return [self.terms[w] for w in surface]

    def live_blocks(self, ids: np.ndarray) -> np.ndarray:
        """Blocks in which the highest impacts of some run of the words can reach the threshold."""
        total = np.cumsum(self.block_max[ids], axis=0, dtype=np.float64)
        total[self.run:] -= total[:-self.run].copy()
        return np.flatnonzero(total[self.run - 1:].max(axis=0) >= 1 - 1e-6)

    def retrieve(self, terms: list[int], blocks) -> list[int]:
        """All items of the blocks in which the terms' impacts sum up to the threshold, in order, by WAND with the
        blocks' highest impacts."""
        found = []
        for block in blocks:
            end = (block + 1) * self.block
            # one cursor per list that has items in the block: [item it stands at, place, highest impact, items, impacts]
            cursors = []
            for t in terms:
                if top := self.tops[t].get(block):
                    place = bisect_left(self.items[t], block * self.block)
                    cursors.append([self.items[t][place], place, top, self.items[t], self.impacts[t]])
            while True:
                cursors.sort(key=_item)
                bound, pivot = 0.0, -1
                for at, c in enumerate(cursors):
                    bound += c[2]
                    if bound >= 1:
                        pivot = at
                        break
                if pivot < 0:
                    break
                item, score = cursors[pivot][0], 0.0
                if cursors[0][0] == item:
                    for c in cursors:
                        if c[0] != item:
                            break
                        score += c[4][c[1]]
                        c[1] += 1
                        c[0] = c[3][c[1]] if c[1] < len(c[3]) else end
                    if score >= 1:
                        found.append(item)
                else:
                    for c in cursors[:pivot]:
                        if c[0] < item:
                            c[1] = bisect_left(c[3], item, c[1])
                            c[0] = c[3][c[1]] if c[1] < len(c[3]) else end
                cursors = [c for c in cursors if c[0] < end]
        return found

    def leaks(self, stretches: list[list[str]]) -> dict[int, Leak]:
        """The items of which the stretches of one text share a run, by position."""
        covered: dict[int, set[int]] = {}
        longest: dict[int, int] = {}
        for surface in stretches:
            ids, ends = self.numbers(surface), {}
            for lo in range(0, len(ids) - self.run + 1, self.run):
                anchor = lo + self.run - 1  # in every run that begins in the passage's first ``run`` words
                passage = ids[lo:lo + 2 * self.run - 1]
                for item in self.retrieve(list(set(passage)), self.live_blocks(np.array(passage, np.int32)).tolist()):
                    for place in self._places(item, ids[anchor]):
                        if ends.get((item, place - anchor), 0) > anchor:
                            continue  # within a run that was seen
                        left, right = self._shared(ids, surface, anchor, item, place)
                        if left + right >= self.run:
                            ends[item, place - anchor] = anchor + right
                            covered.setdefault(item, set()).update(range(place - left, place + right))
                            longest[item] = max(longest.get(item, 0), left + right)
        out = {}
        for item, places in covered.items():
            asked, answers = self.parts[item]
            out[item] = Leak(longest[item], len(places), sum(asked <= p < answers for p in places), sum(p >= answers for p in places))
        return out

    def _places(self, item: int, term: int) -> list[int]:
        return [p for p, t in enumerate(self.ids[item]) if t == term] if term else []

    def _shared(self, ids: list[int], surface: list[str], at: int, item: int, place: int) -> tuple[int, int]:
        """How many words before ``at``, and from there on, are the item's around ``place``."""
        own, written, same_word = self.ids[item], self.surface[item], self.glyphs.same_word
        same = lambda a, b: 0 <= a < len(ids) and 0 <= b < len(own) and ids[a] == own[b] and same_word(surface[a], written[b])
        left = right = 0
        while same(at + right, place + right):
            right += 1
        while right and same(at - left - 1, place - left - 1):
            left += 1
        return left, right


_item = lambda c: c[0]


class Bounds:
    """The highest impact of every word in each block of items, over all of several indexes."""

    def __init__(self, glyphs: Glyphs, run: int = RUN):
        self.glyphs, self.run, self.top = glyphs, run, {}

    def add(self, index: BlockMaxIndex) -> None:
        for word, number in index.terms.vocab.items():
            self.top[word] = np.maximum(self.top.get(word, 0), index.block_max[number])

    def seal(self) -> Bounds:
        self.terms = _Terms({w: n for n, w in enumerate(self.top, 1)}, self.glyphs)
        self.block_max = np.stack([np.zeros(BLOCKS, np.float32), *self.top.values()])
        self.impact = self.block_max.max(axis=1).astype(np.float64)
        self.top = {}
        return self

    def stretches(self, text: str) -> list[list[str]]:
        text = text if text.isascii() else self.glyphs.joined(text)
        at = np.array([self.terms[w] for w in _WORD.findall(text.lower())], np.int32)
        if len(at) < self.run:
            return []
        total = np.concatenate(([0.0], np.cumsum(self.impact[at])))
        starts = np.flatnonzero(total[self.run:] - total[:-self.run] >= 1 - 1e-6)
        kept = []
        for a, b in _joined(starts):
            for lo in range(a, b + 1, 2000):  # bounded memory
                hi = min(b + 1, lo + 2000)
                total = np.cumsum(self.block_max[at[lo:hi + self.run - 1]], axis=0, dtype=np.float64)
                total[self.run:] -= total[:-self.run].copy()
                kept.append(lo + np.flatnonzero(total[self.run - 1:].max(axis=1) >= 1 - 1e-6))
        if not kept or not len(kept := np.concatenate(kept)):
            return []
        surface = _WORD.findall(text)
        return [surface[a:b + self.run] for a, b in _joined(kept)]


def _joined(starts: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of each row of consecutive numbers."""
    cut = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.concatenate(([0], cut + 1))].tolist(), starts[np.concatenate((cut, [len(starts) - 1]))].tolist())) if len(starts) else []


_REPORT = "doc_id long, item_id long, longest_run int, item_words int, shared_words int, question_words int, answer_words int"
_NAMES = [c.split()[0] for c in _REPORT.split(", ")]


def _rows(doc, index: BlockMaxIndex, stretches) -> list[tuple]:
    found = index.leaks(stretches) if stretches else {}
    return [(doc, index.item_ids[k], leak.longest, len(index.ids[k]), leak.shared, leak.question, leak.answers) for k, leak in found.items()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 2 + [pa.int32()] * 5
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=_NAMES)


def leak_report(docs: DataFrame, items: DataFrame, run: int = RUN) -> DataFrame:
    """``(doc_id, item_id, longest_run, item_words, shared_words, question_words, answer_words)``: texts with at least
    ``run`` consecutive words of an item, how long the longest such run is, how many words of the item are in such
    runs, and how many of those belong to its question and to its answers.

    Null, empty and shorter texts match nothing; an item of fewer words than ``run`` can't leak; equal items are all
    reported; of a doc_id with several texts or an item_id with several ones the largest figures count. The corpus
    is scanned once, without a shuffle of texts. Up to ``SHARD_WORDS`` words of items are one index that is shipped to
    every worker; beyond that, the scan keeps the stretches that any item could have leaked into (a
    small part of the corpus), and each of the indexes reads these.
    """
    from ..storage import materialize

    spark = docs.sparkSession
    known = of(look_alikes(spark))
    clean = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    size = clean.agg(F.sum(F.size(F.split("text", r"[^\p{L}\p{N}]+")))).first()[0] or 0
    shards = max(1, -(-size // SHARD_WORDS))
    ranked = clean.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)))
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null and doc_id is not null")

    def built(shard: int) -> BlockMaxIndex:
        rows = ranked.where(F.col("shard") == shard).select("item_id", "text").collect()
        return BlockMaxIndex([(r.item_id, r.text) for r in sorted(rows)], known, run)

    bounds = Bounds(known, run)
    if shards == 1:
        index = built(0)
        bounds.add(index)
        both = spark.sparkContext.broadcast((bounds.seal(), index))

        def scan(batches):
            bounds, index = both.value
            for b in batches:
                yield _batch([r for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in _rows(doc, index, bounds.stretches(text))])

        out = picked.mapInArrow(scan, _REPORT)
    else:
        for shard in range(shards):
            bounds.add(built(shard))
        sealed = spark.sparkContext.broadcast(bounds.seal())

        def keep(batches):
            for b in batches:
                ids, found = [], []
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if kept := sealed.value.stretches(text):
                        ids.append(doc), found.append(kept)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.list_(pa.list_(pa.string())))], names=["doc_id", "stretches"])

        kept, out = materialize(picked.mapInArrow(keep, "doc_id long, stretches array<array<string>>"), "leak-stretches"), None
        for shard in range(shards):
            one = spark.sparkContext.broadcast(built(shard))

            def look(batches, one=one):
                for b in batches:
                    yield _batch([r for doc, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in _rows(doc, one.value, found)])

            part = materialize(kept.mapInArrow(look, _REPORT), "leak-shard")
            one.destroy()
            out = part if out is None else out.unionByName(part)
    return out.groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in _NAMES[2:]])


def leaks(docs: DataFrame, items: DataFrame, run: int = RUN) -> DataFrame:
    """``(doc_id, item_id)``, distinct: texts with at least ``run`` consecutive words of an item."""
    return leak_report(docs, items, run).select("doc_id", "item_id")
