import random

import corpus_pipeline
from lorekeep.llm import near_copies as nc


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def make():
    rnd = random.Random(21)
    vocab = [a + b + c for a in "bdklmprst" for b in "aeiou" for c in ("n", "r", "st", "l")]
    rows = []
    for g in range(40):
        base = [rnd.choice(vocab) for _ in range(rnd.randint(20, 300))]
        rows.append((len(rows), " ".join(base)))
        for _ in range(rnd.randint(0, 4)):
            other = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 25))):
                other[rnd.randrange(len(other))] = rnd.choice(vocab)
            rows.append((len(rows), " ".join(other)))
    return rows + [(900, None), (901, " "), (902, "one two"), (903, "One  two"), (904, "one three")]


def brute(rows):
    sets = {i: grams(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and (sets[a] == sets[b] or both and both >= 0.8 * len(sets[a] | sets[b])):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_groups_and_stage_equal_brute_force(spark):
    rows = make()
    want = brute(rows)
    df = spark.createDataFrame([*rows, (None, "no id")], "doc_id long, text string")
    for size in ({}, {"cell_rows": 2}):
        assert {r[0]: r[1] for r in nc.near_copies(df, **size).collect()} == want
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()}
    assert kept == set(want.values()) | {None}
    assert nc.near_copies(df.limit(0)).count() == 0
