"""Benchmark decontamination: BM25 over test items, pruned by block maxima, then verified by overlap.

The test items are the index; every passage of every document is a query.  An
item's score is its share of the most it could score (all its own words), so
one threshold holds for short and long items.  Postings are in item order, and
items lie in blocks; the index keeps, for each term, its largest share of all
and in each block.  A passage opens a cursor on each of its terms.  The pivot is
the first item at which the cursors up to it could reach the threshold; if the
block maxima around the pivot cannot, all cursors skip to the next block that
can.  So all items at or above the threshold are found (block-max WAND).  A hit
counts if the passage really holds the item's question and answer: shares of
their five-word shingles.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import arrow_rows, settle

_WORD = re.compile(r"[^\W_]+")
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")
K1, B = 1.2, 0.75
#: Text in one broadcast index, which takes several times as much memory.
INDEX_BYTES = 8 << 20


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def shingles(words: list, n: int = 5) -> set[tuple]:
    """Runs of n words; of fewer words, the whole run."""
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """An item's last sentence is its answer, the rest its question; a single sentence is cut after two thirds."""
    parts = [p for p in (words_of(s) for s in _SENTENCE_END.split(text)) if p]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = parts[0] if parts else []
    cut = math.ceil(len(words) * 2 / 3)
    return words[:cut], words[cut:]


@dataclass(frozen=True)
class Statistics:
    """Figures of all test items, whatever part of them an index holds."""

    n: int
    mean: float
    longest: int
    df: dict[str, int]

    @staticmethod
    def of(texts: list[list[str]]) -> Statistics:
        return Statistics(len(texts), sum(map(len, texts)) / max(1, len(texts)), max(map(len, texts), default=0), Counter(w for ws in texts for w in set(ws)))


class BlockMaxIndex:
    """Inverted index of (item id, text) with per-block maxima; ids that repeat stay apart by position.

    ``statistics`` are those of all items when this index holds a part of them,
    so that scores and passages do not depend on the parting.
    """

    def __init__(self, items: list[tuple[int, str]], block: int = 4, statistics: Statistics | None = None):
        texts = [(i, ws, t) for i, t in items if (ws := words_of(t))]
        known = statistics or Statistics.of([ws for _, ws, _ in texts])
        df, n, mean = known.df, max(1, known.n), known.mean
        # Neighbours in a block share words if they share a language: sorting by frequent words keeps bounds tight.
        texts.sort(key=lambda t: (sorted(set(t[1]), key=lambda w: (-df[w], w))[:4], t[0], t[2]))
        self.block, self.ids, self.longest = block, [i for i, _, _ in texts], known.longest
        self.vocabulary: dict[str, int] = {}
        self.texts: list[tuple[np.ndarray, int]] = []
        postings: list[list[tuple[int, float]]] = []
        for k, (_, ws, text) in enumerate(texts):
            tf = Counter(ws)
            gain = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(ws) / mean)) for w, c in tf.items()}
            whole = math.fsum(gain.values())
            for w, g in gain.items():
                at = self.vocabulary.setdefault(w, len(postings))
                if at == len(postings):
                    postings.append([])
                postings[at].append((k, g / whole))
            q, _ = question_and_answer(text)
            self.texts.append((np.array([self.vocabulary[w] for w in ws], np.int32), len(q)))
        self.blocks = -(-len(texts) // block)
        self.items = [[k for k, _ in own] for own in postings]
        self.shares = [[s for _, s in own] for own in postings]
        self.most = [max(own) for own in self.shares]
        self.maxima = []
        for own in postings:
            top: dict[int, float] = {}
            for k, s in own:
                top[k // block] = max(top.get(k // block, 0.0), s)
            self.maxima.append((np.array(list(top), np.int64), np.array(list(top.values()))))

    def search(self, terms: set[int], threshold: float) -> list[tuple[int, float]]:
        """All (position, score) at or above the threshold; terms: the passage's distinct words that the index knows."""
        if not terms:
            return []
        least = threshold - 1e-9
        rows = [self.maxima[t] for t in terms]
        bounds = np.bincount(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), self.blocks)
        live = np.flatnonzero(bounds >= least)
        return self._wand(sorted(terms), live.tolist(), least) if len(live) else []

    def _wand(self, terms: list[int], live: list[int], least: float) -> list[tuple[int, float]]:
        """Cursors in item order over the blocks that can reach the threshold."""
        size, able = self.block, set(live)
        cursors: list[list[int]] = []  # [item, term, place in its postings]

        def seek(cursor: list[int], item: int) -> bool:
            """Moves to the first posting at ``item`` or after it; False at the end."""
            own = self.items[cursor[1]]
            at = bisect_left(own, item, cursor[2])
            if at == len(own):
                return False
            cursor[0], cursor[2] = own[at], at
            return True

        for t in terms:
            cursor = [-1, t, 0]
            if seek(cursor, live[0] * size):
                cursors.append(cursor)
        found = []
        while cursors:
            cursors.sort()
            reach = 0.0
            for p, cursor in enumerate(cursors):
                reach += self.most[cursor[1]]
                if reach >= least:
                    break
            else:
                break
            pivot = cursors[p][0]
            if pivot // size not in able:
                # No item of this block, nor of those up to the next able one, can reach it.
                nxt = bisect_left(live, pivot // size)
                if nxt == len(live):
                    break
                goal = live[nxt] * size
                cursors = [c for c in cursors if c[0] >= goal or seek(c, goal)]
            elif cursors[0][0] < pivot:
                cursors = [c for c in cursors if c[0] >= pivot or seek(c, pivot)]
            else:
                # Exact sums do not depend on the order of the terms.
                score = math.fsum(self.shares[c[1]][c[2]] for c in cursors if c[0] == pivot)
                if score >= least:
                    found.append((pivot, score))
                cursors = [c for c in cursors if c[0] > pivot or seek(c, pivot + 1)]
        return found

    def leaks(self, text: str | None, threshold: float, overlap: float, passage_words: int, part_overlap: float | None = None) -> list[tuple[int, float, float, float]]:
        """(item id, BM25 share, question overlap, answer overlap) of the items that a text holds."""
        words = [self.vocabulary.get(w, -1) for w in words_of(text)]
        parts = overlap / 2 if part_overlap is None else part_overlap
        size = max(passage_words, 2 * self.longest)
        step = size // 2
        best: dict[int, tuple[float, float, float]] = {}
        for start in range(0, max(1, len(words) - size + step), step) if words else ():
            window = words[start : start + size]
            hits = self.search(set(window) - {-1}, threshold)
            if not hits:
                continue
            grams: dict[int, set] = {}
            for k, score in hits:
                item, cut = self.texts[k]
                share = []
                for own in (item[:cut], item[cut:], item):
                    own = shingles(own.tolist())
                    held = 0
                    for g in own:
                        if len(g) not in grams:
                            grams[len(g)] = {tuple(window[i : i + len(g)]) for i in range(len(window) - len(g) + 1)}
                        held += g in grams[len(g)]
                    share.append(held / len(own) if own else 1.0)
                if share[2] >= overlap and min(share[:2]) >= parts:
                    best[k] = max(best.get(k, (0.0, 0.0, 0.0)), (score, share[0], share[1]))
        return [(self.ids[k], *v) for k, v in sorted(best.items(), key=lambda e: (self.ids[e[0]], e[0]))]


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = 0.6, overlap: float = 0.8, passage_words: int = 128, index_items: int = 20_000, part_overlap: float | None = None) -> DataFrame:
    """One row per document row and test item that it holds: id, item_id, score, question_overlap, answer_overlap.

    Passages have ``passage_words`` words, at least twice the longest item's,
    and overlap by half, so each item lies whole in some passage.  Items with a
    null id or without words hold nothing and are left out; of a repeated item
    id each text counts.  Null and empty documents hold nothing, null document
    ids stay, other columns are ignored, an empty table of either gives none.

    Question and answer must each be held to ``part_overlap``, half of ``overlap``
    unless given.  A short answer has few shingles, or one, and an edited word
    breaks them all: with 0 the overlap of the whole item decides.

    The index is broadcast in parts of at most ``index_items`` items and
    ``INDEX_BYTES`` of text, one pass over the documents for each part; word
    statistics are those of all items, so the parting changes nothing.
    """
    arrow_rows(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, item_id long, score double, question_overlap double, answer_overlap double"
    texts = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    out = None
    for shared in _indexes(items, item_id, item_text, index_items):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, found = [], []
                for row, text in enumerate(batch.column(1)):
                    for leak in shared.value.leaks(text.as_py(), threshold, overlap, passage_words, part_overlap):
                        at.append(row)
                        found.append(leak)
                cols = [pa.array([f[c] for f in found], t) for c, t in enumerate((pa.int64(), pa.float64(), pa.float64(), pa.float64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *cols], names=[id_col, "item_id", "score", "question_overlap", "answer_overlap"])

        part = texts.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def drop_leaky(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = 0.6, overlap: float = 0.8, passage_words: int = 128, index_items: int = 20_000, part_overlap: float | None = None) -> DataFrame:
    """The rows of docs that hold no test item, all columns as they are; see find_leaks.  No shuffle."""
    arrow_rows(docs.sparkSession)
    at = docs.columns.index(text_col)
    for shared in _indexes(items, item_id, item_text, index_items):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not shared.value.leaks(t.as_py(), threshold, overlap, passage_words, part_overlap) for t in batch.column(at)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def _indexes(items: DataFrame, item_id: str, item_text: str, index_items: int) -> Iterator:
    """Broadcast indexes over the test items, each of bounded size."""
    spark = items.sparkSession
    usable = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).distinct()

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(w) for w in words], pa.int64()), pa.array([sorted(set(w)) for w in words], pa.list_(pa.string()))], names=["i", "t", "n", "words"])

    usable = settle(usable.mapInArrow(tokenised, "i long, t string, n long, words array<string>").where("n > 0"), "items")
    size = usable.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("b"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("mean"), F.coalesce(F.max("n"), F.lit(0)).alias("longest")).first()
    counts = settle(usable.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("df")), "words")
    parts = max(1, -(-size["n"] // index_items), -(-size["b"] // INDEX_BYTES))
    for k in range(parts):
        own = usable.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k)
        # Both bounded by the part's size above.
        rows = own.select("i", "t").orderBy("i", "t").collect()
        df = {r["w"]: r["df"] for r in counts.join(own.select(F.explode("words").alias("w")).distinct(), "w").collect()}
        yield spark.sparkContext.broadcast(BlockMaxIndex([(r["i"], r["t"]) for r in rows], statistics=Statistics(size["n"], size["mean"], size["longest"], df)))
