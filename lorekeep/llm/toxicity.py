"""Toxicity by a weighted lexicon matched with an Aho-Corasick automaton.

Texts are folded first: lower case, accents of look-alike letters, homoglyphs
and digit substitutions to Latin letters, so that one entry finds all spellings.
The lexicon is learnt: words and word beginnings that occur far more often in
labelled toxic documents, weighted by their log-odds.  Exception phrases are
learnt too: a neighbouring word that turns an entry harmless.  A document's
score is a logistic function of its matched weight, normalised by length.
"""

from __future__ import annotations

import math
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import arrow_rows, least_by_hash, release, settle

#: Look-alikes of Latin letters and digit substitutions (fixed values).
HOMOGLYPHS = {
    "а": "a", "ɑ": "a", "α": "a", "е": "e", "ε": "e", "о": "o", "ο": "o", "р": "p", "ρ": "p", "с": "c", "ϲ": "c",
    "у": "y", "γ": "y", "х": "x", "χ": "x", "і": "i", "ι": "i", "ı": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d",
    "ԛ": "q", "ԝ": "w", "к": "k", "κ": "k", "м": "m", "т": "t", "τ": "t", "в": "b", "β": "b", "н": "h", "ν": "v",
    "υ": "u", "ո": "n", "η": "n", "ℓ": "l", "ⅼ": "l", "ӏ": "l",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
ZERO_WIDTH = "​‌‍⁠﻿­"
#: Letters whose accent is folded; other accented letters may tell words apart.
_FOLD = {ord(c): None for c in ZERO_WIDTH}
_FOLD |= {ord(k): v for k, v in HOMOGLYPHS.items()} | {ord(k.upper()): v for k, v in HOMOGLYPHS.items() if len(k.upper()) == 1}
_FOLD |= {ord(c): c.lower() for c in string.ascii_uppercase}
_FOLD |= {0xFF21 + i: c for i, c in enumerate(string.ascii_lowercase)} | {0xFF41 + i: c for i, c in enumerate(string.ascii_lowercase)}
_SUBSTITUTED = re.compile(r"[^\W_]*[0-9@$!][\w@$!]*")
_DIGIT_FOLD = str.maketrans(DIGITS)
_WORD = re.compile(r"[^\W_]+")
_MARKS = re.compile("[̀-ͯ]+")


def _substitute(match: re.Match) -> str:
    """Digits become letters only in words with two letters at least; trailing marks stay marks."""
    word = match.group()
    core = word.rstrip("!$@")
    if sum(c.isalpha() for c in core) < 2:
        return word
    return core.translate(_DIGIT_FOLD) + word[len(core) :]


def fold(text: str) -> str:
    """Lower case; homoglyphs, full-width letters, zero-width and combining marks and digit substitutions folded."""
    folded = text.lower() if text.isascii() else _MARKS.sub("", text.translate(_FOLD).lower())
    return _SUBSTITUTED.sub(_substitute, folded)


@dataclass
class Lexicon:
    """entries: words ("idiot") and beginnings ("lowei*") -> weight; exceptions: "before word" or "word after" pairs."""

    entries: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    bias: float = -4.0
    per_hit: float = 2.0
    per_rate: float = 0.5


class Matcher:
    """One automaton over all entries, anchored at word starts by a leading space."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.automaton = ahocorasick.Automaton()
        for entry, weight in lexicon.entries.items():
            pattern = " " + entry[:-1] if entry.endswith("*") else f" {entry} "
            self.automaton.add_word(pattern, (len(pattern), weight, entry))
        if lexicon.entries:
            self.automaton.make_automaton()

    def weigh(self, text: str) -> tuple[float, int, int]:
        """(matched weight, matches, words) of a text; a word counts once, by its best entry."""
        return self.weigh_words(_WORD.findall(fold(text)))

    def weigh_words(self, words: list[str]) -> tuple[float, int, int]:
        """weigh() of a text that is folded and cut into words."""
        if not words or not self.lexicon.entries:
            return 0.0, 0, len(words)
        line = f" {' '.join(words)} "
        best: dict[int, tuple[float, str]] = {}
        for end, (n, weight, entry) in self.automaton.iter(line):
            start = end - n + 1
            if start not in best or weight > best[start][0]:
                best[start] = (weight, entry)
        total, hits = 0.0, 0
        for start, (weight, _) in best.items():
            if self.lexicon.exceptions:
                stop = line.find(" ", start + 1)
                before = line[line.rfind(" ", 0, start) + 1 : start] if start else ""
                word = line[start + 1 : stop]
                after = line[stop + 1 : line.find(" ", stop + 1)] if stop + 1 < len(line) else ""
                if f"{before} {word}" in self.lexicon.exceptions or f"{word} {after}" in self.lexicon.exceptions:
                    continue
            total += weight
            hits += 1
        return total, hits, len(words)

    def features(self, text: str) -> tuple[float, float]:
        """Matched weight damped by logarithm, and matched weight per hundred words."""
        return self._features(*self.weigh(text))

    @staticmethod
    def _features(total: float, _: int, words: int) -> tuple[float, float]:
        return math.log1p(total), min(5.0, 100.0 * total / (words + 20))

    def score(self, text: str) -> float:
        a, b = self.features(text)
        return 1.0 / (1.0 + math.exp(-(self.lexicon.bias + self.lexicon.per_hit * a + self.lexicon.per_rate * b)))


PREFIX_LENGTHS = (4, 5, 6)


def _units(words: set[str]) -> set[str]:
    """Entries that a text of these words could match."""
    units = set(words)
    for w in words:
        units.update(f"{w[:n]}*" for n in PREFIX_LENGTHS if len(w) > n)
    return units


def learn(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", least_docs: int = 3, labelled_rows: int = 50_000) -> Lexicon:
    """A lexicon from the labelled rows for which ``train`` (on the id) holds.

    At most ``labelled_rows`` of them are used, the first by hash of the id: so
    their ids may be broadcast, and no text is shuffled.  Of several labels of
    an id the highest counts.  Document frequencies of words, word beginnings
    and word pairs are counted by label (copies of a text count once); only
    entries whose log-odds are clearly above zero come to the driver, as many as
    there are: the bound on the rows bounds them.  The three numbers of the
    logistic curve are fitted on the same rows, which are folded once.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).where(train)
    known = known.groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("__y"))
    known = settle(least_by_hash(known, id_col, labelled_rows), "known")
    texts = docs.select(id_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = labelled = settle(texts.join(F.broadcast(known), id_col), "labelled")
    # Copies of one text would make all its words look alike: each text counts once for a label.
    firsts = rows.groupBy(F.xxhash64("text").alias("h"), "__y").agg(F.min(id_col).alias(id_col)).select(id_col)
    rows = rows.join(F.broadcast(firsts), id_col, "left_semi").select("text", "__y")

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([" ".join(_WORD.findall(fold(t))) for t in batch.column(0).to_pylist()], pa.string()), batch.column(1)], names=["line", "__y"])

    rows = settle(rows.mapInArrow(folded, "line string, __y int"), "folded")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Counts are combined before they are shuffled, in a table of bounded size.
        counts: dict[str, list[int]] = {}
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for u in _units(set(text.split())) | {""}:
                    counts.setdefault(u, [0, 0])[y] += 1
            if len(counts) > 400_000:
                yield _counted(counts)
                counts = {}
        yield _counted(counts)

    units = settle(rows.mapInArrow(split, "unit string, neg long, pos long").groupBy("unit").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")).where((F.col("pos") >= least_docs) | (F.col("unit") == "")), "units")
    total = units.where("unit = ''").first()
    if total is None or not total["pos"] or not total["neg"]:
        return Lexicon()
    neg, pos = total["neg"], total["pos"]
    odds = F.log((F.col("pos") + 0.5) / (pos + 1.0)) - F.log((F.col("neg") + 0.5) / (neg + 1.0))
    # Thousands of units are tried: 2.4 standard errors below, the log-odds still have to be positive.
    sure = odds - 2.4 * F.sqrt(1.0 / (F.col("pos") + 0.5) + 1.0 / (F.col("neg") + 0.5))
    ranked = units.where("unit <> ''").select("unit", "pos", "neg", odds.alias("odds"), sure.alias("sure")).where("odds > 1.8 and sure > 0")
    found = ranked.collect()
    entries: dict[str, float] = {}
    # Beginnings first: a word that adds nothing to its beginning is left out.
    for r in sorted(found, key=lambda r: (not r["unit"].endswith("*"), len(r["unit"]), r["unit"])):
        unit = r["unit"]
        stem = unit.rstrip("*")
        shorter = [f"{stem[:n]}*" for n in PREFIX_LENGTHS if n < len(unit)]
        if not any(s in entries and entries[s] >= 0.8 * r["odds"] for s in shorter if s != unit):
            entries[unit] = float(r["odds"])
    lexicon = Lexicon(dict(sorted(entries.items(), key=lambda e: (-e[1], e[0]))))
    lexicon.exceptions = _learn_exceptions(rows, lexicon)
    matcher = spark.sparkContext.broadcast(lexicon)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(matcher.value)
        for batch in batches:
            f = [m._features(*m.weigh_words(t.split())) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in f], pa.float64()), pa.array([x[1] for x in f], pa.float64()), batch.column(1).cast(pa.int64())], names=["a", "b", "y"])

    # Hits are sparse: equal features are counted together before they come to the driver.
    table = rows.mapInArrow(featured, "a double, b double, y long").groupBy(F.round("a", 3).alias("a"), F.round("b", 3).alias("b"), "y").count().collect()
    lexicon.bias, lexicon.per_hit, lexicon.per_rate = _fit(sorted(table))
    release(labelled, rows, units)
    return lexicon


def _counted(counts: dict[str, list[int]]) -> pa.RecordBatch:
    columns = {"unit": list(counts), "neg": [c[0] for c in counts.values()], "pos": [c[1] for c in counts.values()]}
    return pa.RecordBatch.from_pydict(columns, schema=pa.schema([("unit", pa.string()), ("neg", pa.int64()), ("pos", pa.int64())]))


def _learn_exceptions(rows: DataFrame, lexicon: Lexicon, least: int = 5) -> frozenset[str]:
    """Pairs around a lexicon word that are found in several documents, next to never in toxic ones."""
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = shared.value.entries
        listed = lambda w: w in entries or any(f"{w[:n]}*" in entries for n in PREFIX_LENGTHS if len(w) > n)
        for batch in batches:
            out, ys = [], []
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = text.split()
                at = [i for i, w in enumerate(words) if listed(w)]
                around = {f"{words[i - 1]} {words[i]}" for i in at if i} | {f"{words[i]} {words[i + 1]}" for i in at if i + 1 < len(words)}
                out += around
                ys += [y] * len(around)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(ys, pa.int64())], names=["pair", "y"])

    seen = rows.mapInArrow(pairs, "pair string, y long").groupBy("pair").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    found = seen.where((F.col("n") >= least) & (F.col("pos") <= 0.05 * F.col("n"))).select("pair").collect()
    return frozenset(r["pair"] for r in found)


def _fit(table: list, rounds: int = 50) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton's method on counted feature rows."""
    if not table:
        return -4.0, 2.0, 0.5
    x = np.array([[1.0, r["a"], r["b"]] for r in table])
    y, n = np.array([r["y"] for r in table], float), np.array([r["count"] for r in table], float)
    w = np.zeros(3)
    ridge = np.diag([1e-3, 0.05, 0.05])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (n * (y - p)) - ridge @ w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    # More matches never make a text less toxic.
    return float(w[0]), max(0.0, float(w[1])), max(0.0, float(w[2]))


def score_texts(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """id and score (0 to 1) of each row; keep=True passes all columns and adds score, hits and n_words.

    Null and empty texts match nothing and get the curve's lowest score;
    repeated rows and null ids stay; an empty table gives none.
    """
    arrow_rows(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    docs = docs.drop("score", "hits", "n_words") if keep else docs.select(id_col, text_col)
    at = docs.columns.index(text_col)
    out = [c for c in docs.columns if keep or c != text_col]
    places = [docs.columns.index(c) for c in out]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in out) + ", score double, hits long, n_words long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(shared.value)
        for batch in batches:
            scores, hits, sizes = [], [], []
            for text in batch.column(at):
                total, h, n = m.weigh(text.as_py() or "")
                a, b = math.log1p(total), min(5.0, 100.0 * total / (n + 20))
                scores.append(1.0 / (1.0 + math.exp(-(m.lexicon.bias + m.lexicon.per_hit * a + m.lexicon.per_rate * b))))
                hits.append(h)
                sizes.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in places] + [pa.array(scores, pa.float64()), pa.array(hits, pa.int64()), pa.array(sizes, pa.int64())], names=[*out, "score", "hits", "n_words"])

    return docs.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """The rows whose labels are never learnt from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
