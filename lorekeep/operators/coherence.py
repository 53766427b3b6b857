"""Health of a knowledge base: similar pairs, coherence, drift."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorekeep.functions.order import numbered
from lorekeep.functions.vectors import cosine, dot
from lorekeep.operators.graph import _cut

NEAR_COPY, EDGE, DRIFT, BACKBONE = 0.95, 0.5, 0.08, 0.01


#: Rows are copied as often as there are blocks: over BLOCKS blocks only where a block would hold more than BLOCK_BYTES.
#: A block meets another by tiles of TILE rows.
BLOCKS, BLOCK_BYTES, TILE = 16, 32 << 20, 2_000
#: Edges and nodes of a graph whose connectivity is found in one task.
IN_ONE_TASK = 10_000_000


def similar_pairs(vectors: DataFrame, least: float, id_col: str = "id", vector_col: str = "embedding", block_rows: int = 2_000) -> DataFrame:
    """(a, b, sim) of all pairs a < b with cosine at least ``least``, exactly.

    Rows are dealt to blocks by hash; each pair of blocks meets in one task and
    is compared by matrix products, so a task holds two blocks whatever the
    size of the table, and only pairs that qualify leave it.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    return _block_join(rows, block_rows, f"a {kind}, b {kind}, sim double", lambda ids, _, tiles: _pairs(ids, None, tiles, least))


def _pairs(ids, places, tiles, least):
    """Columns a, b, sim of the pairs in the tiles; with places also of neighbours that are not similar, at BACKBONE."""
    a, b, sims = [ids[:0]], [ids[:0]], [np.array([], float)]
    for x, y, s, same in tiles:
        near = s >= least
        r, c = np.divmod(np.flatnonzero(np.triu(near, 1) if same else near), len(y))
        left, right = ids[x[r]], ids[y[c]]
        low = left < right
        keep = left != right
        a.append(np.where(low, left, right)[keep])
        b.append(np.where(low, right, left)[keep])
        sims.append(s[r, c][keep])
        if places is None:
            continue
        order = np.argsort(places[y])
        for step in (1,) if same else (1, -1):
            at = np.searchsorted(places[y], places[x] + step, sorter=order)
            c = order[np.minimum(at, len(y) - 1)]
            r = np.flatnonzero(places[y[c]] == places[x] + step)
            c = c[r]
            # In a tile of itself a pair was compared above the diagonal.
            weak = ~(near[np.minimum(r, c), np.maximum(r, c)] if same else near[r, c])
            first, second = (x[r[weak]], y[c[weak]]) if step == 1 else (y[c[weak]], x[r[weak]])
            a.append(ids[first])
            b.append(ids[second])
            sims.append(np.full(len(first), BACKBONE))
    return {"a": np.concatenate(a), "b": np.concatenate(b), "sim": np.concatenate(sims)}


def nearest_similarity(vectors: DataFrame, id_col: str = "id", vector_col: str = "embedding", block_rows: int = 2_000) -> DataFrame:
    """(id, sim): each row's highest cosine to another row; one row a vector and block pair is shuffled."""

    def best(ids, _, tiles):
        top = np.full(len(ids), -np.inf)
        for x, y, s, same in tiles:
            if same:
                np.fill_diagonal(s, -np.inf)
            else:
                top[y] = np.maximum(top[y], s.max(axis=0))
            top[x] = np.maximum(top[x], s.max(axis=1))
        met = top > -np.inf
        return {"a": ids[met], "sim": top[met]}

    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    found = _block_join(rows, block_rows, f"a {vectors.schema[id_col].dataType.simpleString()}, sim double", best)
    return found.groupBy(F.col("a").alias(id_col)).agg(F.max("sim").alias("sim"))


def _block_join(rows: DataFrame, block_rows: int, schema: str, compare) -> DataFrame:
    """compare(ids, places, tiles) of each pair of blocks of rows (id, v, place or none).

    tiles gives (x, y, s, same): the cosines s of the rows at x and at y, ``same``
    where both are one part of the table.  Each two rows meet in one tile.
    """
    rows = rows.withColumn("v", F.col("v").cast("array<double>"))
    n, dim = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    most = max(block_rows, BLOCK_BYTES // (8 * max(1, dim or 1)))
    g = max(1, min(-(-n // block_rows), max(BLOCKS, -(-n // most))))
    cut = rows.withColumn("c", F.pmod(F.xxhash64("id"), F.lit(g)).cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(g - 1))))
    cut = cut.select(F.least("c", "k").alias("i"), F.greatest("c", "k").alias("j"), "c", *rows.columns)

    def meet(table: pa.Table) -> pa.Table:
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        ids, c = table["id"].to_numpy(), table["c"].to_numpy()
        places = table["place"].to_numpy() if "place" in table.column_names else None
        v = _matrix(table["v"])
        norms = np.linalg.norm(v, axis=1)
        v /= np.where(norms > 0, norms, 1.0)[:, None]
        left = np.flatnonzero(c == i)
        right = left if i == j else np.flatnonzero(c == j)

        def tiles():
            for a in range(0, len(left), TILE):
                x = left[a : a + TILE]
                for b in range(a if i == j else 0, len(right), TILE):
                    y = right[b : b + TILE]
                    yield x, y, v[x] @ v[y].T, i == j and a == b

        found = compare(ids, places, tiles())
        kind = table.schema.field("id").type
        return pa.table({k: pa.array(x, kind if k in ("a", "b") else pa.float64()) for k, x in found.items()})

    # A partition for each pair of blocks: the work lies in comparing, not in the bytes by which partitions would be joined.
    return cut.repartition(g * (g + 1) // 2, "i", "j").groupBy("i", "j").applyInArrow(meet, schema)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of one size as a matrix of its own."""
    flat = np.concatenate([np.asarray(x.flatten()) for x in column.chunks])
    sizes = np.concatenate([np.asarray(x.value_lengths()) for x in column.chunks])
    if (sizes != sizes[0]).any() or np.isnan(sizes.astype(float)).any():
        raise ValueError("vectors of different sizes")
    return flat.reshape(len(sizes), -1)


def similarity_graph(vectors: DataFrame, id_col: str = "id", vector_col: str = "embedding", least: float = EDGE, block_rows: int = 2_000) -> DataFrame:
    """(a, b, weight): similar pairs, and a weak chain of neighbours by id where they are not similar.

    Neighbours are told where their blocks meet, so the pairs are found once and joined with nothing.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = numbered(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")), ["id"], "place")
    return _block_join(rows, block_rows, f"a {kind}, b {kind}, sim double", lambda *x: _pairs(*x, least)).withColumnRenamed("sim", "weight")


def contradiction_rate(vectors: DataFrame, order_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """One row: the share of cyclic neighbours in order whose dot product is negative."""
    placed = numbered(vectors.select(F.col(order_col).alias("o"), F.col(vector_col).alias("v")), ["o"])
    total = placed.count()
    nexts = placed.join(placed.select(F.pmod(F.col("n") - 1, F.lit(max(1, total))).alias("n"), F.col("v").alias("next")), "n")
    return nexts.agg(F.coalesce(F.avg((dot(F.col("v"), F.col("next")) < 0).cast("double")), F.lit(0.0)).alias("rate"))


def centroid(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """One row: the element-wise mean, scaled to length one."""
    parts = vectors.select(F.posexplode(vector_col).alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = parts.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("c"))
    n = F.sqrt(F.aggregate("c", F.lit(0.0), lambda s, x: s + x * x))
    return mean.select(F.when(n > 0, F.transform("c", lambda x: x / n)).otherwise(F.col("c")).alias("centroid"))


def workspace_score(vectors: DataFrame, vector_col: str = "embedding", least: float = EDGE) -> DataFrame:
    """One row: the share of vectors with at least ``least`` cosine to the centroid."""
    near = vectors.crossJoin(F.broadcast(centroid(vectors, vector_col))).select((cosine(F.col(vector_col), F.col("centroid")) >= least).cast("double").alias("x"))
    return near.agg(F.coalesce(F.avg("x"), F.lit(0.0)).alias("score"))


def fiedler_value(edges: DataFrame, nodes: int, most: int = 3_000, rounds: int = 300, tolerance: float = 1e-7, in_one_task: int = IN_ONE_TASK) -> float:
    """Second smallest Laplacian eigenvalue over n, within 0..1: our normalisation of the algebraic connectivity.

    Graphs of at most ``most`` nodes are solved dense on the driver, larger ones
    by power iteration: with at most ``in_one_task`` nodes and edges in one task,
    else over the edge table (see _power_iteration).
    """
    if nodes < 2:
        return 0.0
    if nodes > most:
        size = edges.count()
        if not size:
            return 0.0
        solve = _power_iteration_in_memory if max(nodes, size) <= in_one_task else _power_iteration
        return float(np.clip(solve(edges, nodes, rounds, tolerance) / nodes, 0.0, 1.0))
    rows = edges.select("a", "b", "weight").collect()
    at = {x: i for i, x in enumerate(sorted({r[0] for r in rows} | {r[1] for r in rows}))}
    lap = np.zeros((nodes, nodes))
    for a, b, w in rows:
        i, j = at[a], at[b]
        lap[i, j] -= w
        lap[j, i] -= w
        lap[i, i] += w
        lap[j, j] += w
    return float(np.clip(np.sort(np.linalg.eigvalsh(lap))[1] / nodes, 0.0, 1.0))


def _power_iteration(edges: DataFrame, nodes: int, rounds: int, tolerance: float) -> float:
    """Second smallest eigenvalue of the Laplacian L: the largest of c I - L off the constant vector, c twice the highest degree.

    The vector is a table of a row per node, a step is a join over the edges and
    a sum per node; single numbers come to the driver.  It ends when the
    estimate moves by less than ``tolerance`` of c, or after ``rounds``; the
    estimate falls towards the value, so what is left over is an upper bound.
    """
    both = edges.select(F.col("a").alias("i"), F.col("b").alias("j"), "weight").unionByName(edges.select(F.col("b").alias("i"), F.col("a").alias("j"), "weight"))
    both = _cut(both.repartition("i"))
    degree = _cut(both.groupBy("i").agg(F.sum("weight").alias("d")))
    c = 2 * (degree.agg(F.max("d")).first()[0] or 0.0)
    if c == 0 or degree.count() < nodes:
        return 0.0
    x = degree.select("i", "d", _start("i").alias("x"))
    value = last = c
    for k in range(rounds):
        mean, size = x.agg(F.avg("x"), F.sqrt(F.sum(F.col("x") * F.col("x")) - F.count("*") * F.pow(F.avg("x"), 2))).first()
        if not size:
            return 0.0
        x = x.select("i", "d", ((F.col("x") - mean) / size).alias("x"))
        pulled = both.join(x.select(F.col("i").alias("j"), F.col("x").alias("y")), "j").groupBy("i").agg(F.sum(F.col("weight") * F.col("y")).alias("w"))
        step = _cut(x.join(pulled, "i", "left").select("i", "d", "x", (F.col("d") * F.col("x") - F.coalesce("w", F.lit(0.0))).alias("lx")))
        last, value = value, step.agg(F.sum(F.col("x") * F.col("lx"))).first()[0]
        if k and abs(last - value) < tolerance * c:
            break
        x = step.select("i", "d", (c * F.col("x") - F.col("lx")).alias("x"))
    return value


def _start(node: str) -> Column:
    """Where the iteration starts at a node."""
    return F.pmod(F.xxhash64(node), F.lit(1_000_003)) / 1_000_003.0 - 0.5


def _power_iteration_in_memory(edges: DataFrame, nodes: int, rounds: int, tolerance: float) -> float:
    """_power_iteration on arrays, step by step the same, in one task."""

    def iterate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        ends = pa.chunked_array([b.column(k) for k in (0, 1) for b in batches])
        w, xa, xb = (np.concatenate([np.asarray(b.column(k)) for b in batches]) for k in (2, 3, 4))
        batches.clear()
        at = np.concatenate([np.asarray(x.indices) for x in ends.dictionary_encode().chunks])
        i, j, n = at[: len(w)], at[len(w) :], int(at.max()) + 1
        d = np.bincount(i, w, n) + np.bincount(j, w, n)
        value, c = 0.0, 2 * d.max()
        if c > 0 and n >= nodes:
            x = np.empty(n)
            x[i], x[j] = xa, xb
            value = c
            for k in range(rounds):
                x -= x.mean()
                size = np.sqrt(x @ x)
                if not size:
                    value = 0.0
                    break
                x /= size
                lx = d * x - np.bincount(i, w * x[j], n) - np.bincount(j, w * x[i], n)
                last, value = value, float(x @ lx)
                if k and abs(last - value) < tolerance * c:
                    break
                x = c * x - lx
        yield pa.RecordBatch.from_arrays([pa.array([value], pa.float64())], names=["value"])

    return edges.select("a", "b", F.col("weight").cast("double"), _start("a").alias("xa"), _start("b").alias("xb")).coalesce(1).mapInArrow(iterate, "value double").first()[0]


def interpretation(score: Column) -> Column:
    return F.when(score < 0.30, "Disjoint").when(score < 0.60, "Loose").when(score < 0.85, "Coherent").otherwise("HighlyIntegrated")


def _connectivity(vectors: DataFrame, n: int, id_col: str, vector_col: str, least: float) -> tuple[DataFrame, float]:
    """The similarity graph, found once and kept, and its fiedler_value."""
    edges = _cut(similarity_graph(vectors, id_col, vector_col, least))
    return edges, fiedler_value(edges, n)


def coherence_kpi(vectors: DataFrame, id_col: str = "id", vector_col: str = "embedding", least: float = EDGE, connectivity: float | None = None) -> dict:
    """integrated = connectivity x (1 - mean nearest distance); workspace; label.  Zeros for no vectors.

    ``connectivity`` is the fiedler_value at ``least`` where it is known.
    """
    n = vectors.count()
    if n == 0:
        return {"integrated": 0.0, "workspace": 0.0, "label": "Disjoint"}
    if connectivity is None:
        connectivity = _connectivity(vectors, n, id_col, vector_col, least)[1]
    near = nearest_similarity(vectors, id_col, vector_col).agg(F.avg((1 - F.col("sim")) / 2)).first()[0] or 0.0
    integrated = connectivity * (1 - near)
    label = next(l for cut, l in ((0.30, "Disjoint"), (0.60, "Loose"), (0.85, "Coherent"), (float("inf"), "HighlyIntegrated")) if integrated < cut)
    return {"integrated": integrated, "workspace": workspace_score(vectors, vector_col, least).first()[0], "label": label}


def kb_health(vectors: DataFrame, id_col: str = "id", vector_col: str = "embedding") -> dict:
    """Connectivity, contradiction rate and near copies; an error for none, zeros for one vector."""
    n = vectors.count()
    if n == 0:
        raise ValueError("no vectors")
    if n == 1:
        return {"fiedler": 0.0, "contradiction_rate": 0.0, "near_copies": 0}
    edges, fiedler = _connectivity(vectors, n, id_col, vector_col, EDGE)
    # Near copies are edges: EDGE lies under NEAR_COPY, and the weak chain under both.
    return {"fiedler": fiedler, "contradiction_rate": contradiction_rate(vectors, id_col, vector_col).first()[0], "near_copies": edges.where(F.col("weight") >= NEAR_COPY).count()}


def drift(history: DataFrame, order_by: list[str], score_col: str, by: list[str] | None = None, threshold: float = DRIFT) -> DataFrame:
    """Per group: mean score of the first and second half in order, the drop, and whether it is over the threshold.

    Groups of fewer than four rows have a null verdict.
    """
    by = by or []
    ordered = history.withColumn("__r", F.row_number().over(W.partitionBy(*by).orderBy(*order_by))) if by else numbered(history, order_by, "__n0").withColumn("__r", F.col("__n0") + 1)
    counted = history.groupBy(*by).agg(F.count("*").alias("__n"))
    joined = ordered.join(counted, by) if by else ordered.crossJoin(F.broadcast(counted))
    early = F.col("__r") <= F.floor(F.col("__n") / 2)
    # Decimals make the means independent of the order of partial sums.
    x = F.col(score_col).cast("decimal(30,12)")
    out = joined.groupBy(*by, "__n").agg(F.avg(F.when(early, x)).cast("double").alias("before"), F.avg(F.when(~early, x)).cast("double").alias("after"))
    return out.select(*by, F.col("__n").alias("n"), "before", "after", (F.col("before") - F.col("after")).alias("fall"), F.when(F.col("__n") >= 4, F.col("before") - F.col("after") > threshold).alias("drifted"))


def hamming_variance(hashes: DataFrame, by: str, hash_col: str) -> DataFrame:
    """Per group: mean pairwise Hamming distance of 64-bit hashes over 64, from the count of ones at each bit.

    With k of n hashes set at a bit, k (n - k) pairs differ there: no pairs are formed.
    """
    bits = hashes.select(by, F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit"), F.col(hash_col).alias("h"))
    ones = bits.groupBy(by, "bit").agg(F.count("*").alias("n"), F.sum(F.getbit("h", F.col("bit")).cast("long")).alias("k"))
    return ones.groupBy(by).agg(F.when(F.max("n") > 1, F.sum(F.col("k") * (F.col("n") - F.col("k"))) / (F.max("n") * (F.max("n") - 1) / 2) / 64.0).otherwise(0.0).alias("variance"))


def frame_decision(variance: Column) -> Column:
    """full over 0.30, skip under 0.015, else probe."""
    return F.when(variance > 0.30, "full").when(variance < 0.015, "skip").otherwise("probe")
