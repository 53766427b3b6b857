"""Embedding near-duplicates by hashing projections to points of the E8 lattice."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import arrow_rows, connected_components, partitions, release, settle


def _d8(x: np.ndarray) -> np.ndarray:
    """Nearest point of D8 (integers with an even sum) to each row."""
    near = np.rint(x)
    gap = x - near
    rows = np.nonzero(near.sum(axis=1).astype(np.int64) & 1)[0]
    worst = np.abs(gap[rows]).argmax(axis=1)
    near[rows, worst] += np.where(gap[rows, worst] >= 0, 1.0, -1.0)
    return near


def decode_e8(x: np.ndarray) -> np.ndarray:
    """Nearest E8 point to each row of an (n, 8) array, doubled so that it is whole numbers.

    E8 is D8 together with D8 moved by a half in every coordinate; the nearer of
    the two nearest points is the answer.
    """
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    near = np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)
    return np.rint(2 * near).astype(np.int32)


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8, doubled: the steps to neighbouring cells."""
    rows = []
    for i, j in combinations(range(8), 2):
        for a in (-2, 2):
            for b in (-2, 2):
                v = [0] * 8
                v[i], v[j] = a, b
                rows.append(v)
    rows += [[1 if bits >> k & 1 else -1 for k in range(8)] for bits in range(256) if bin(bits).count("1") % 2 == 0]
    return np.array(rows, np.int32)


_STEPS = minimal_vectors()
#: Odd multipliers that turn a lattice point into a 64-bit cell number.
_MIX = np.random.default_rng(2024).integers(1, 2**63, 8, dtype=np.int64) | 1


def cells(points: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """(home cell, cells of the ``probes`` neighbouring lattice points nearest to each row), as 64-bit numbers."""
    home = decode_e8(points)
    gap = points - home / 2.0
    # |x - (h + s)|^2 = |x - h|^2 - 2 (x - h).s + |s|^2, and all |s|^2 are 2.
    toward = gap @ (_STEPS / 2.0).T
    best = np.argpartition(-toward, probes - 1, axis=1)[:, :probes]
    around = home[:, None, :] + _STEPS[best]
    with np.errstate(over="ignore"):
        return (home.astype(np.int64) * _MIX).sum(axis=1), (around.astype(np.int64) * _MIX).sum(axis=2)


class Tables:
    """Random projections of dimension d to 8, scaled; one per table."""

    def __init__(self, dim: int, tables: int, scale: float, probes: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.probes, self.planes = probes, []
        for _ in range(tables):
            q, _ = np.linalg.qr(rng.standard_normal((dim, min(8, dim))))
            plane = np.zeros((dim, 8))
            plane[:, : q.shape[1]] = q * (scale * (dim / 8) ** 0.5)
            self.planes.append((plane, rng.uniform(-1, 1, 8)))

    def cells(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Home cells (n, tables) and probed cells (n, tables, probes)."""
        # Rounded, so that a row's cells do not depend on the rows it is multiplied with.
        each = [cells(np.round(unit @ plane + shift, 7), self.probes) for plane, shift in self.planes]
        return np.stack([h for h, _ in each], axis=1), np.stack([p for _, p in each], axis=1)


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows of length one; divided by their largest component first, so that no square overflows or vanishes."""
    unit = v / np.abs(v).max(axis=1, keepdims=True)
    return unit / np.sqrt((unit * unit).sum(axis=1, keepdims=True))


def _meet(x: np.ndarray, y: np.ndarray, home: np.ndarray, near: np.ndarray, t: int) -> np.ndarray:
    """Which pairs of rows meet in table t: the same cell, or either probes the other's."""
    hx, hy = home[x, t], home[y, t]
    return (hx == hy) | (near[x, t] == hy[:, None]).any(axis=1) | (near[y, t] == hx[:, None]).any(axis=1)


def _first_meeting(x: np.ndarray, y: np.ndarray, tab: np.ndarray, x_home: np.ndarray, y_home: np.ndarray, home: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Which pairs are counted where they were found: in their first table, and of two cells there in the lower one."""
    first = np.ones(len(x), bool)
    for t in range(home.shape[1] - 1):
        later = np.flatnonzero(first & (tab > t))
        first[later] = ~_meet(x[later], y[later], home, near, t)
    mixed = np.flatnonzero(first & ~(x_home & y_home))
    a, b, t = x[mixed], y[mixed], tab[mixed]
    ha, hb = home[a, t], home[b, t]
    both = (near[a, t] == hb[:, None]).any(axis=1) & (near[b, t] == ha[:, None]).any(axis=1)
    first[mixed] = ~both | (np.minimum(ha, hb) == np.where(x_home[mixed], ha, hb))
    return first


#: Units up to so many rows are compared together, pair by pair; larger ones by a matrix product each.
SMALL_UNIT = 48
PAIRS_AT_ONCE = 200_000


def _close_pairs(unit: np.ndarray, groups: np.ndarray, chunk: np.ndarray, ends: tuple[np.ndarray, np.ndarray], home: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, row) of one group with a cosine of ``least`` or more, one of them at home; rows lie sorted by group.

    ends: the two chunks that a row's group compares, which may be the same.
    """
    n = len(groups)
    starts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]])) if n else np.array([], np.int64)
    sizes = np.diff(np.concatenate([starts, [n]]))
    whole = ends[0] == ends[1]
    small = np.repeat(sizes <= SMALL_UNIT, sizes)
    for d in range(1, int(sizes[sizes <= SMALL_UNIT].max(initial=1))):
        k = np.flatnonzero(small[:-d] & (groups[:-d] == groups[d:]) & (home[:-d] | home[d:]) & (whole[:-d] | (chunk[:-d] != chunk[d:])))
        for at in range(0, len(k), PAIRS_AT_ONCE):
            x = k[at : at + PAIRS_AT_ONCE]
            good = x[np.einsum("ij,ij->i", unit[x], unit[x + d]) >= least]
            if len(good):
                yield good, good + d
    for start, size in zip(starts[sizes > SMALL_UNIT].tolist(), sizes[sizes > SMALL_UNIT].tolist()):
        rows = np.arange(start, start + size)
        left, right = rows[chunk[rows] == ends[0][start]], rows[chunk[rows] == ends[1][start]]
        for at in range(0, len(left), 512):
            block = left[at : at + 512]
            a, b = np.nonzero(unit[block] @ unit[right].T >= least)
            a, b = block[a], right[b]
            ok = ((a < b) if whole[start] else (a != b)) & (home[a] | home[b])
            if ok.any():
                yield a[ok], b[ok]


def near_duplicate_vectors(vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", tables: int = 6, probes: int = 12, scale: float = 2.6, cell_rows: int = 1_500, task_rows: int = 20_000) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Vectors with equal labels (not null) link at a cosine of ``least`` or more.
    Null, zero-length, zero and non-finite vectors (or components) link with
    nothing, and so do vectors with a null label; vectors of different sizes are
    never compared.  A repeated id keeps its rows, which count as different
    vectors; a null id links like any other, and its component is the smallest
    id it reaches, null if there is none (then it is kept).  An empty table
    gives none.

    Equal vectors of a label are one class, however many they are; classes are
    dealt to their home cell and to probed neighbours in each table.  A pair is
    counted in the first table where it meets, which both rows' cells tell, so
    n_links needs no list of pairs; components take one spanning link per row
    and task.  Cells over ``cell_rows`` rows are cut into chunks; a task takes
    many cells, about ``task_rows`` rows.
    """
    spark = vectors.sparkSession
    arrow_rows(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    sound = F.coalesce(F.col("label").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    marked = settle(rows.withColumn("key", F.when(sound, F.sha2(F.concat_ws(",", F.transform("v", lambda x: (x + 0.0).cast("string"))), 256))), "vectors")
    classes = marked.where("key is not null").groupBy("label", "key").agg(F.min("id").alias("low"), F.count("*").alias("n"), F.first("v").alias("v"))
    # A number for each class, fixed once the table is written.
    classes = settle(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    dims = [r[0] for r in classes.select(F.size("v").alias("d")).distinct().collect()]
    made = {d: Tables(d, tables, scale, probes) for d in dims}

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            for dim in np.unique(sizes):
                at = np.nonzero(sizes == dim)[0]
                first = np.concatenate([[0], np.cumsum(sizes)[:-1]])[at]
                home, near = made[int(dim)].cells(_unit(flat[first[:, None] + np.arange(dim)]))
                n, t = home.shape
                # A row per visited cell: the home, and each probed one.
                table = np.tile(np.repeat(np.arange(t, dtype=np.int32), probes + 1), n)
                cell = np.concatenate([home[:, :, None], near], axis=2).reshape(-1)
                is_home = np.tile(np.arange(probes + 1) == 0, n * t)
                take = pa.array(np.repeat(at, t * (probes + 1)))
                # Vectors follow only to cells where two classes meet.
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array(np.full(len(cell), dim, np.int32)), pa.array(table), pa.array(cell), pa.array(is_home), batch.column(1).take(take)], names=["label", "dim", "tab", "cell", "home", "rep"])

    visits = classes.select("label", "rep", "v").mapInArrow(hashed, "label string, dim int, tab int, cell long, home boolean, rep long")
    visits = settle(visits, "visits")
    busy = visits.groupBy("label", "dim", "tab", "cell").agg(F.count("*").alias("size"), F.sum(F.col("home").cast("long")).alias("homes")).where("size > 1 and homes > 0")
    busy = settle(busy.select("label", "dim", "tab", "cell", F.ceil(F.col("size") / cell_rows).cast("int").alias("g"), "size"), "busy")
    total = busy.agg(F.sum(F.col("size") * F.col("g"))).first()[0] or 0
    buckets = int(max(partitions(spark), -(-total // task_rows)))
    kept = visits.join(busy.drop("size"), ["label", "dim", "tab", "cell"]).withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("g")).cast("int"))
    kept = kept.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    kept = kept.select("label", "dim", "tab", "cell", F.least("chunk", "k").alias("i"), F.greatest("chunk", "k").alias("j"), "chunk", "home", "rep")
    placed = kept.join(classes.select("rep", "n", "v"), "rep").withColumn("bucket", F.pmod(F.xxhash64("label", "tab", "cell", "i", "j"), F.lit(buckets)).cast("int"))

    def match(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        dim = table["dim"][0].as_py()
        label = table["label"].combine_chunks().dictionary_encode()
        label = (label.combine_chunks() if isinstance(label, pa.ChunkedArray) else label).indices.to_numpy(zero_copy_only=False)
        keys = [table[c].to_numpy() for c in ("j", "i", "cell", "tab")]
        order = np.lexsort((*keys, label))
        j, i, cell, tab = (k[order] for k in keys)
        label = label[order]
        rep, n, chunk, home = (table[c].to_numpy()[order] for c in ("rep", "n", "chunk", "home"))
        home = home.astype(bool)
        flat = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rep), dim)
        unit = _unit(flat)[order]
        new = np.zeros(len(rep), bool)
        for k in (label, tab, cell, i, j):
            new[1:] |= k[1:] != k[:-1]
        found = list(_close_pairs(unit, np.cumsum(new), chunk, (i, j), home, least))
        x = np.concatenate([a for a, _ in found]) if found else np.array([], np.int64)
        y = np.concatenate([b for _, b in found]) if found else np.array([], np.int64)
        x, y = x[rep[x] != rep[y]], y[rep[x] != rep[y]]
        links = np.zeros(0, np.int64)
        who = np.unique(rep[np.concatenate([x, y])])
        if len(x):
            # Cells are worked out anew only for rows that have a partner, each once.
            some, back = np.unique(rep, return_index=True)
            at = back[np.searchsorted(some, who)]
            px, py = np.searchsorted(who, rep[x]), np.searchsorted(who, rep[y])
            first = np.zeros(len(x), bool)
            homes, nears = made[dim].cells(unit[at])
            for k in range(0, len(x), PAIRS_AT_ONCE):
                s = slice(k, k + PAIRS_AT_ONCE)
                first[s] = _first_meeting(px[s], py[s], tab[x[s]], home[x[s]], home[y[s]], homes, nears)
            px, py, wx, wy = px[first], py[first], n[y[first]], n[x[first]]
            links = np.bincount(px, wx, len(who)).astype(np.int64) + np.bincount(py, wy, len(who)).astype(np.int64)
        else:
            px = py = np.array([], np.int64)
        src, dst = _spanning(px, py, len(who))
        some = np.nonzero(links)[0]
        nothing = pa.nulls(len(some), pa.int64())
        return pa.table({"src": pa.array(np.concatenate([who[some], who[src]]).astype(np.int64)), "dst": pa.chunked_array([nothing, pa.array(who[dst].astype(np.int64))]), "links": pa.array(np.concatenate([links[some], np.zeros(len(src), np.int64)]))})

    found = settle(placed.groupBy("dim", "bucket").applyInArrow(match, "src long, dst long, links long"), "found")
    release(visits, busy)
    counts = found.groupBy("src").agg(F.sum("links").alias("links"))
    parts = connected_components(found.where("dst is not null").select("src", "dst"))
    classes = classes.select("label", "key", "rep", "n", "low").join(counts, F.col("rep") == F.col("src"), "left").drop("src").join(parts, F.col("rep") == F.col("node"), "left").withColumn("part", F.coalesce("component", "rep"))
    least_id = classes.groupBy("part").agg(F.min("low").alias("component_id"))
    of_key = classes.select("label", "key", "part", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")).join(least_id, "part")
    out = marked.select("id", "label", "key").join(of_key, ["label", "key"], "left")
    # A vector that links with nothing is its own component, whether it has an id or not.
    component = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def _spanning(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the graph of n nodes: its nodes, each with the least node of its part."""
    low = np.arange(n)
    while len(a):
        la, lb = low[a], low[b]
        apart = la != lb
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        hi, lo = np.maximum(la[apart], lb[apart]), np.minimum(la[apart], lb[apart])
        np.minimum.at(low, hi, lo)
        while True:
            up = low[low]
            if (up == low).all():
                break
            low = up
    src = np.flatnonzero(low != np.arange(n))
    return src, low[src]
