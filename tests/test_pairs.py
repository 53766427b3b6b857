"""Pairs of vectors by blocks and tiles, and the connectivity of their graph."""

import re

import numpy as np
import pytest

from lorekeep.operators import coherence


@pytest.fixture
def vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(f"v{i:02d}", [float(x) for x in rng.normal(size=4)]) for i in range(37)]
    return rows, spark.createDataFrame(rows, "id string, embedding array<double>").repartition(3)


def _cosines(rows):
    v = np.array([r[1] for r in rows])
    v /= np.linalg.norm(v, axis=1)[:, None]
    return v @ v.T


def test_connectivity_of_many_nodes_takes_few_jobs(spark):
    n = 3_300
    e = spark.range(n - 1).selectExpr("id a", "id + 1 b", "0.01D weight")
    spark.sparkContext.setJobGroup("fiedler", "")
    assert coherence.fiedler_value(e, n) == pytest.approx(0.0, abs=1e-4)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("fiedler")
    spark.sparkContext.setJobGroup("", "")
    assert len(jobs) < 10


@pytest.mark.parametrize("kind", ["long", "string"])
def test_connectivity_in_one_task_and_over_tables(spark, kind):
    rng = np.random.default_rng(5)
    n = 20
    edges = [(i, (i + 1) % n, 1.0) for i in range(n)] + [(int(a), int(b), 0.7) for a, b in rng.integers(0, n, (30, 2)) if a < b]
    e = spark.createDataFrame(edges, "a long, b long, weight double").selectExpr(f"cast(a as {kind}) a", f"cast(b as {kind}) b", "weight")
    one = coherence.fiedler_value(e, n, most=2, rounds=6)
    assert one > 0 and one == pytest.approx(coherence.fiedler_value(e, n, most=2, rounds=6, in_one_task=0), rel=1e-9)
    assert coherence.fiedler_value(e, n + 1, most=2) == 0.0 and coherence.fiedler_value(e.limit(0), n, most=2) == 0.0


def test_graph_has_each_pair_and_each_neighbour_once(spark, vectors, monkeypatch):
    monkeypatch.setattr(coherence, "TILE", 3)
    rows, df = vectors
    s = _cosines(rows)
    want = {(rows[i][0], rows[j][0]): round(s[i, j], 9) for i in range(37) for j in range(i + 1, 37) if s[i, j] >= 0.4}
    want |= {(rows[i][0], rows[i + 1][0]): 0.01 for i in range(36) if s[i, i + 1] < 0.4}
    for block_rows in (1, 10, 100):
        graph = coherence.similarity_graph(df, least=0.4, block_rows=block_rows)
        got = [tuple(r) for r in graph.collect()]
        assert len(got) == len(want) and {(a, b): round(w, 9) for a, b, w in got} == want
    # The pairs are found once and joined with nothing.
    plan = graph._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("FlatMapGroupsInArrow", plan)) == 1 and "LeftAnti" not in plan


def test_copies_of_a_row_do_not_grow_with_the_table(spark, vectors, monkeypatch):
    monkeypatch.setattr(coherence, "BLOCKS", 3)
    monkeypatch.setattr(coherence, "TILE", 4)
    rows, df = vectors
    s = _cosines(rows)
    pairs = coherence.similar_pairs(df, 0.5, block_rows=1)
    near = coherence.nearest_similarity(df, block_rows=1)
    for found in (pairs, near):
        assert re.search(r"RepartitionByExpression \[i#\d+, j#\d+\], 6\b", found._jdf.queryExecution().optimizedPlan().toString())
    assert {(a, b): round(x, 9) for a, b, x in pairs.collect()} == {(rows[i][0], rows[j][0]): round(s[i, j], 9) for i in range(37) for j in range(i + 1, 37) if s[i, j] >= 0.5}
    np.fill_diagonal(s, -2)
    assert {i: round(x, 9) for i, x in near.collect()} == {r[0]: round(m, 9) for r, m in zip(rows, s.max(axis=1))}
