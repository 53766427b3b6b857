"""SimHash fingerprints and their exact near-duplicates through vantage-point trees."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import arrow_rows, connected_components, least_by_hash, settle

SEED = 42


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """64-bit SimHash of the XXH64 (seed 42) of word shingles: a bit is set if it is in over half of them."""
    tokens = (text or b"").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = list(accumulate(len(t) + 1 for t in tokens))
    starts = [0, *ends[:-1]]
    digest = xxhash.xxh64_digest
    if len(tokens) <= words:
        raw = digest(joined, SEED)
    else:
        raw = b"".join([digest(joined[s : e - 1], SEED) for s, e in zip(starts, ends[words - 1 :])])
    bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
    ones = bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(bits)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id_col, fp): fp is the fingerprint as a signed long.  Null text counts as empty: fingerprint zero."""
    arrow_rows(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=[id_col, "fp"])

    return docs.select(F.col(id_col), F.col(text_col).cast("binary")).mapInArrow(run, f"`{id_col}` {kind}, fp long")


# ---------------------------------------------------------------- vantage-point trees


class VpTree:
    """Top of the tree, grown over a bounded sample; its leaves are the shards of all fingerprints.

    A node keeps a vantage point and a radius mu: fingerprints at a distance up
    to mu live left, others right.  Two fingerprints at most ``reach`` apart
    that the radius parts have, by the triangle inequality, the left one at
    over mu - reach: so it is enough that those on the left in that band are
    also sent right.  Every pair within reach meets in a leaf.
    """

    #: Splits are chosen for the least total of shares to this power, the growth of a balanced tree over random bits.
    POWER = 1.58

    def __init__(self, sample: np.ndarray, total: int, leaf_rows: int, reach: int, seed: int = 7):
        self.reach, self.nodes, self.leaves = reach, [], 0
        self._rng = np.random.default_rng(seed)
        self._least = max(24, leaf_rows * len(sample) // max(1, total))
        self.root = self._grow(sample)

    def _grow(self, points: np.ndarray) -> int:
        """Index of the node, or -1 - leaf."""
        best = None
        if len(points) > self._least:
            some = points if len(points) <= 4096 else self._rng.choice(points, 4096, replace=False)
            for vp in self._rng.choice(some, 16, replace=False):
                counts = np.cumsum(np.bincount(np.bitwise_count(some ^ vp), minlength=65)) / len(some)
                for mu in range(self.reach, 62):
                    left, right = counts[mu], 1 - counts[mu - self.reach]
                    if 0.03 < left < 0.97 and right < 0.97:
                        cost = left**self.POWER + right**self.POWER
                        if best is None or cost < best[0]:
                            best = (cost, vp, mu)
        if best is None:
            self.leaves += 1
            return -self.leaves
        _, vp, mu = best
        d = np.bitwise_count(points ^ vp).astype(np.int64)
        at = len(self.nodes)
        self.nodes.append(None)
        self.nodes[at] = (np.uint64(vp), mu, self._grow(points[d <= mu]), self._grow(points[d > mu - self.reach]))
        return at

    def route(self, fps: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows that belong there)."""
        stack = [(self.root, np.arange(len(fps)))]
        while stack:
            at, rows = stack.pop()
            if at < 0:
                yield -1 - at, rows
                continue
            vp, mu, left, right = self.nodes[at]
            d = np.bitwise_count(fps[rows] ^ vp).astype(np.int64)
            for child, near in ((left, d <= mu), (right, d > mu - self.reach)):
                if near.any():
                    stack.append((child, rows[near]))


def _search(queries: np.ndarray, members: np.ndarray, fps: np.ndarray, reach: int, depth: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query row, member row) within reach, by vantage points down to small blocks."""
    if not len(queries) or not len(members):
        return
    if len(members) <= 256 or len(queries) <= 16 or depth >= 8:
        step = max(1, 1_000_000 // len(members))
        own = fps[members]
        for i in range(0, len(queries), step):
            block = queries[i : i + step]
            q, m = np.nonzero(np.bitwise_count(fps[block][:, None] ^ own[None, :]) <= reach)
            yield block[q], members[m]
        return
    vp = fps[members[len(members) // 2]]
    dm = np.bitwise_count(fps[members] ^ vp).astype(np.int64)
    dq = np.bitwise_count(fps[queries] ^ vp).astype(np.int64)
    mu = int(np.median(dm))
    left = dm <= mu
    yield from _search(queries[dq <= mu + reach], members[left], fps, reach, depth + 1)
    yield from _search(queries[dq > mu - reach], members[~left], fps, reach, depth + 1)


#: Rows from which a shard is searched by blocks of bits: only shards of a tree that its sample cannot grow deeper.
DENSE_ROWS = 20_000


def _by_blocks(fps: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs within reach of one shard, some more than once: they agree in one of reach + 1 blocks of bits."""
    width = 64 // (reach + 1)
    for b in range(reach + 1):
        key = (fps >> np.uint64(b * width)) & np.uint64((1 << width) - 1)
        order = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0]))
        for start, stop in zip(starts.tolist(), [*starts[1:].tolist(), len(order)]):
            own = order[start:stop]
            step = max(1, 1_000_000 // len(own))
            for i in range(0, len(own) if len(own) > 1 else 0, step):
                block = own[i : i + step]
                q, m = np.nonzero(np.bitwise_count(fps[block][:, None] ^ fps[own][None, :]) <= reach)
                yield block[q], own[m]


class Forest:
    """Union-find over the rows of one block; keeps only links that join two trees."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def link_fingerprints(fps: DataFrame, reach: int = 3, leaf_rows: int | None = None, sample_rows: int = 65_536, cell_rows: int = 2_000_000) -> DataFrame:
    """Spanning links between distinct fingerprints at most ``reach`` bits apart.

    ``fps`` has fp and rep (long), one row per distinct fingerprint.  Returns
    (src, dst) reps: enough links to join whatever all links join, at most one
    per row and shard, so a ball of near copies gives no square of links.

    A tree over a bounded sample deals every fingerprint to the shard of its
    leaf and to those its ball overlaps.  Shards hold about ``leaf_rows`` (by
    default in proportion to the root of all rows); one with over
    ``cell_rows`` is cut into chunks, compared pair by pair in cells of bounded
    size.  The sample bounds the depth of the tree: shards that stay large are
    searched by blocks of bits instead of pairs.
    """
    spark = fps.sparkSession
    arrow_rows(spark)
    total = fps.count()
    if not total:
        return fps.select(F.col("rep").alias("src"), F.col("rep").alias("dst"))
    leaf_rows = leaf_rows or max(1_000, int(6 * total**0.5))
    sample = least_by_hash(fps.select("fp"), "fp", sample_rows)
    tree = VpTree(np.array([r[0] for r in sample.collect()], np.int64).view(np.uint64), total, leaf_rows, reach)
    shared = spark.sparkContext.broadcast(tree)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, rep = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            placed = list(shared.value.route(own.view(np.uint64)))
            leaf = np.concatenate([np.full(len(rows), k, np.int32) for k, rows in placed]) if placed else np.array([], np.int32)
            rows = np.concatenate([rows for _, rows in placed]) if placed else np.array([], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(own[rows]), pa.array(rep[rows])], names=["leaf", "fp", "rep"])

    dealt = settle(fps.select("fp", "rep").mapInArrow(deal, "leaf int, fp long, rep long"), "shards")
    # One row per leaf of the tree: a count bounded by the sample.
    sizes = dealt.groupBy("leaf").agg(F.ceil(F.count("*") / cell_rows).cast("int").alias("g"))
    cut = dealt.join(F.broadcast(sizes), "leaf").withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("g")).cast("int"))
    cut = cut.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    cells = cut.select("leaf", F.least("chunk", "k").alias("i"), F.greatest("chunk", "k").alias("j"), "chunk", "fp", "rep")

    def match(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        fp, rep, chunk = table["fp"].to_numpy().view(np.uint64), table["rep"].to_numpy(), table["chunk"].to_numpy()
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        forest, src, dst = Forest(len(fp)), [], []
        left, right = np.nonzero(chunk == j)[0], np.nonzero(chunk == i)[0]
        for q, m in _search(left, right, fp, reach) if len(fp) <= DENSE_ROWS else _by_blocks(fp, reach):
            keep = q < m if i == j else chunk[q] != chunk[m]
            for a, b in zip(q[keep].tolist(), m[keep].tolist()):
                if forest.join(a, b):
                    src.append(a)
                    dst.append(b)
        return pa.table({"src": rep[np.array(src, np.int64)], "dst": rep[np.array(dst, np.int64)]})

    return cells.groupBy("leaf", "i", "j").applyInArrow(match, "src long, dst long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, reach: int = 3) -> DataFrame:
    """One row per document: id, fp (long), fingerprint (hex), component_id (smallest id reachable by links).

    Links: fingerprints at most ``reach`` bits apart.  Equal fingerprints are
    grouped first, so that copies cost one row, however many they are.  Null
    and empty texts have fingerprint zero and link like any other; repeated ids
    keep one row each; a null id links like any other and is the smallest only
    where no id is reached (then component_id is null); an empty table gives none.
    """
    prints = settle(fingerprints(docs, id_col, text_col, words), "prints")
    distinct = settle(prints.groupBy("fp").agg(F.min(id_col).cast("long").alias("low")), "fps")
    links = settle(link_fingerprints(distinct.select("fp", F.col("fp").alias("rep")), reach), "links")
    parts = connected_components(links)
    classes = distinct.join(parts, distinct["fp"] == parts["node"], "left").select("fp", "low", F.coalesce("component", "fp").alias("part"))
    lows = classes.groupBy("part").agg(F.min("low").alias("component_id"))
    return prints.join(classes.join(lows, "part").select("fp", "component_id"), "fp").select(id_col, "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
