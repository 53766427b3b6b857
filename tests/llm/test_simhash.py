import random

import xxhash

from lorekeep.llm import simhash
from lorekeep.llm.common import connected_components


def brute_print(text, words=3):
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    grams = [b" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprint_equals_brute_force():
    rnd = random.Random(3)
    texts = ["", None, "one", "A b", "a\tB\x0bc\x1cd", "é É ß x y", *[" ".join(rnd.choice("ab cd EF gh\n").strip() or "z" for _ in range(rnd.randint(1, 40))) for _ in range(200)]]
    for t in texts:
        assert simhash.fingerprint(t.encode() if t is not None else None) == brute_print(t)


def test_links_are_exact(spark, monkeypatch):
    rnd = random.Random(5)
    seeds = [rnd.getrandbits(64) for _ in range(60)]
    fps = set(seeds)
    for s in seeds:
        for _ in range(25):
            f = s
            for _ in range(rnd.randint(0, 5)):
                f ^= 1 << rnd.randrange(64)
            fps.add(f)
    fps = sorted(fps)
    rows = [(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)]
    want = brute_components(range(len(fps)), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    df = spark.createDataFrame(rows, "fp long, rep long")
    for dense, size in ((20_000, {"leaf_rows": 50}), (20_000, {"leaf_rows": 300, "cell_rows": 40}), (20_000, {}), (30, {"leaf_rows": 300}), (30, {"leaf_rows": 300, "cell_rows": 200})):
        monkeypatch.setattr(simhash, "DENSE_ROWS", dense)
        links = simhash.link_fingerprints(df, **size)
        got = {n: n for n in range(len(fps))} | {r[0]: r[1] for r in connected_components(links).collect()}
        assert got == want


def test_documents_with_nulls_copies_and_clashing_columns(spark):
    rows = [(1, "a b c d e f", "x"), (2, "A B C D E F", "y"), (3, None, None), (4, "", "q"), (5, "quite another text here", "z"), (5, "quite another text here", "z"), (None, "a b c", "n"), (None, "a b c d e f", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((tuple(r) for r in simhash.near_duplicates(df).select("doc_id", "fingerprint", "component_id").collect()), key=str)
    fp = f"{brute_print('a b c d e f'):016x}"
    other = f"{brute_print('quite another text here'):016x}"
    assert got == sorted([(1, fp, 1), (2, fp, 1), (3, "0" * 16, 3), (4, "0" * 16, 3), (5, other, 5), (5, other, 5), (None, f"{brute_print('a b c'):016x}", None), (None, fp, 1)], key=str)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "src long, dst long")
    got = {r[0]: r[1] for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}
