import numpy as np

from lorekeep.llm import lattice


def test_decoding_gives_the_nearest_lattice_point():
    rng = np.random.default_rng(0)
    x = rng.uniform(-3, 3, (500, 8))
    h = lattice.decode_e8(x) / 2
    best = ((x - h) ** 2).sum(axis=1)
    assert len(lattice._STEPS) == 240 and best.max() <= 1 + 1e-9
    for step in lattice._STEPS / 2.0:
        assert (((x - h - step) ** 2).sum(axis=1) >= best - 1e-9).all()
    for h1 in h:  # all whole or all halves, with an even sum
        assert len({float(v) % 1 for v in h1}) == 1 and h1.sum() % 2 == 0


def brute(rows, least=0.93):
    ok = {}
    for k, (i, v, label) in enumerate(rows):
        if v is not None and label is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v):
            u = np.array(v, float) / np.abs(v).max()
            ok[k] = (u / np.linalg.norm(u), label)
    links, root = {k: 0 for k in range(len(rows))}, {k: k for k in range(len(rows))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = list(ok)
    pairs = 0
    for a in range(len(keys)):
        for b in range(a):
            (u, l), (v, m) = ok[keys[a]], ok[keys[b]]
            if l == m and len(u) == len(v) and float(u @ v) >= least:
                links[keys[a]] += 1
                links[keys[b]] += 1
                pairs += 1
                x, y = find(keys[a]), find(keys[b])
                root[max(x, y)] = min(x, y)
    low = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return sorted(((i, links[k], low.get(find(k)), i == low.get(find(k))) for k, (i, _, _) in enumerate(rows)), key=str), pairs


def test_links_and_components_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows, n = [], 0
    for c in range(30):
        centre = rng.standard_normal(32)
        for _ in range(int(rng.integers(1, 7))):
            v = centre + rng.standard_normal(32) * rng.uniform(0, 0.4)
            for _ in range(int(rng.integers(1, 3))):
                rows.append((n, [float(x) for x in v * rng.choice([1.0, 1.0, 2.5])], int(c % 4)))
                n += 1
    hot = [float(x) for x in rng.standard_normal(32)]
    rows += [(n + k, hot, 9) for k in range(40)]
    n += 40
    odd = [None, [], [0.0] * 32, [float("nan")] + [1.0] * 31, [float("inf")] + [1.0] * 31, [None] + [1.0] * 31, [1e-200] * 32, [1e200] * 32, [1.0] * 31, [-0.0, 1.0], [0.0, 1.0]]
    rows += [(n + k, v, 9) for k, v in enumerate(odd)] + [(n + 50, hot, None), (n + 51, hot, 8), (None, hot, 9), (None, [5.0] + [0.0] * 31, 9), (None, None, 9), (0, hot, 9)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, rep string").repartition(4)
    want, pairs = brute(rows)
    for tuning, small in (({"tables": 12, "probes": 30}, 48), ({"tables": 12, "probes": 30, "cell_rows": 5, "task_rows": 50}, 3)):
        lattice.SMALL_UNIT = small
        got = sorted((tuple(r) for r in lattice.near_duplicate_vectors(df, **tuning).collect()), key=str)
        assert got == want
    lattice.SMALL_UNIT = 48
    loose = lattice.near_duplicate_vectors(df).collect()
    assert sum(r["n_links"] for r in loose) >= 0.97 * 2 * pairs
    assert lattice.near_duplicate_vectors(df.limit(0)).count() == 0
