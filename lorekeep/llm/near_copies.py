"""Near copies by word shingles: SimHash links first, MinHash bands for what they cannot reach, exact Jaccard for each pair.

Fingerprints at most three bits apart come from the vantage-point trees of
simhash.py.  At a Jaccard of 0.8 the fingerprints of two texts differ by some
ten bits of 64, too many for any metric tree over them, so bands of MinHash
values add the pairs further apart.  All pairs are verified on the shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import arrow_rows, connected_components, release, settle, small
from lorekeep.llm.simhash import Forest, fingerprint, link_fingerprints

BANDS, ROWS = 30, 5
_RNG = np.random.default_rng(11)
MULTIPLY = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingle_hashes(text: bytes | None, words: int = 5) -> np.ndarray:
    """Sorted XXH64 of the distinct word shingles, in lower case; of fewer words, of the whole run."""
    tokens = (text or b"").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    joined = b" ".join(tokens)
    ends = list(accumulate(len(t) + 1 for t in tokens))
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return np.array([digest(joined)], np.uint64)
    return np.unique(np.array([digest(joined[s : e - 1]) for s, e in zip([0, *ends[:-1]], ends[words - 1 :])], np.uint64))


def bands(hashes: np.ndarray) -> list[int]:
    """A key for each band: at a Jaccard of 0.8 two texts share one with probability 0.99999."""
    if not len(hashes):
        return []
    least = np.full(len(MULTIPLY), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 4096):
        mixed = hashes[i : i + 4096, None] * MULTIPLY + ADD
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(axis=0))
    return [xxhash.xxh64_intdigest(row.tobytes(), b) >> 1 for b, row in enumerate(least.reshape(BANDS, ROWS))]


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, reach: int = 3, cell_rows: int = 500) -> DataFrame:
    """(id_col, component_id): the smallest id reachable over pairs with a shingle Jaccard of ``similarity`` or more.

    Texts with equal shingle sets are one row from the start, texts without
    words being equal.  Buckets with the same members are compared once; one
    with over ``cell_rows`` is cut into chunks, compared pair by pair in cells
    of bounded size.  A null id is left out, an empty table gives none.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    kind = docs.schema[id_col].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_hashes(t.as_py(), words) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]), pa.array([bands(s) for s in sets], pa.list_(pa.int64())), pa.array(np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], np.uint64).view(np.int64))], names=[id_col, "digest", "bands", "fp"])

    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col), F.col(text_col).cast("binary").alias("t"))
    sketched = settle(texts.mapInArrow(sketch, f"`{id_col}` {kind}, digest binary, bands array<long>, fp long"), "sketches")
    reps = settle(sketched.groupBy("digest").agg(F.min(id_col).cast("long").alias("rep"), F.first("bands").alias("bands"), F.min("fp").alias("fp")), "reps")
    members = reps.select("rep", F.posexplode("bands").alias("band", "key"))
    buckets = members.groupBy("band", "key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("s")).where("n > 1")
    buckets = settle(buckets.groupBy("n", "s").agg(F.min(F.struct("band", "key")).alias("b")).select("b.band", "b.key", "n"), "buckets")
    # SimHash: a bucket for each fingerprint that several texts have, and for each link between two.
    prints = settle(reps.where(F.size("bands") > 0).groupBy("fp").agg(F.min("rep").alias("rep"), F.count("*").alias("n")), "prints")
    near = settle(link_fingerprints(prints.select("fp", F.col("fp").alias("rep")), reach), "near")
    ends = near.select(F.xxhash64("src", "dst").alias("key"), F.explode(F.array("src", "dst")).alias("fp")).join(prints.select("fp", "rep"), "fp").select(F.lit(-1).alias("band"), "key", "rep", F.lit(2).cast("long").alias("n"))
    alike = reps.select("rep", "fp").join(prints.where("n > 1").select("fp", "n"), "fp").select(F.lit(-2).alias("band"), F.col("fp").alias("key"), "rep", "n")
    banded = members.join(buckets, ["band", "key"]).select("band", "key", "rep", "n")
    dealt = settle(banded.unionByName(ends).unionByName(alike), "members")
    release(prints, near, buckets)
    chunks = F.ceil(F.col("n") / cell_rows).cast("int")
    cells = dealt.withColumn("g", chunks).withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("g")).cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    cells = cells.select("band", "key", F.least("chunk", "k").alias("i"), F.greatest("chunk", "k").alias("j"), "chunk", "rep")
    # An id may be on several rows: any of its texts with the digest of its rep stands for it.
    own = sketched.join(reps.select("digest", "rep"), "digest").where(F.col(id_col) == F.col("rep")).select("rep", "digest").distinct()
    # Texts stay where they are while those to be compared are few.
    asked = settle(dealt.select("rep").distinct(), "asked")
    wanted = asked.join(own, "rep")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_hashes(t.as_py(), words).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashlib.blake2b(s, digest_size=16).digest() for s in sets], pa.binary()), pa.array(sets, pa.binary())], names=["rep", "digest", "grams"])

    grams = texts.select(F.col(id_col).cast("long").alias("rep"), "t").join(small(asked), "rep", "left_semi").mapInArrow(hashed, "rep long, digest binary, grams binary")
    grams = settle(grams.join(wanted, ["rep", "digest"], "left_semi").dropDuplicates(["rep", "digest"]).select("rep", "digest", "grams"), "grams")

    def match(table: pa.Table) -> pa.Table:
        rep, chunk = table["rep"].to_pylist(), table["chunk"].to_pylist()
        sets = [np.frombuffer(g, np.uint64) for g in table["grams"].to_pylist()]
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        forest, src, dst = Forest(len(sets)), [], []
        for a in (x for x, c in enumerate(chunk) if c == i):
            for b in (x for x, c in enumerate(chunk) if c == j):
                if (i == j and b <= a) or forest.find(a) == forest.find(b):
                    continue
                small, large = sorted((len(sets[a]), len(sets[b])))
                if small >= similarity * large:
                    both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                    if both >= similarity * (small + large - both) - 1e-9 and forest.join(a, b):
                        src.append(rep[a])
                        dst.append(rep[b])
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    links = settle(cells.join(grams, "rep").groupBy("band", "key", "i", "j").applyInArrow(match, "src long, dst long"), "links")
    parts = connected_components(links)
    release(dealt, grams)
    classes = reps.join(parts, reps["rep"] == parts["node"], "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    return sketched.join(classes, "digest").select(id_col, "component_id")
