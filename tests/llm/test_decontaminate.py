import math
import random
from collections import Counter

from lorekeep.llm import decontaminate as dc


def brute_scores(items, passage):
    texts = [dc.words_of(t) for _, t in items]
    n, mean = len(texts), sum(map(len, texts)) / len(texts)
    df = Counter(w for ws in texts for w in set(ws))
    out = {}
    for (i, _), ws in zip(items, texts):
        gain = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for w, c in Counter(ws).items()}
        out[i] = sum(g for w, g in gain.items() if w in passage) / sum(gain.values())
    return out


def make():
    rnd = random.Random(12)
    vocab = [a + b + c for a in "bdkl" for b in "aeiou" for c in ("n", "r", "st")]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(8, 30))) + ". " + " ".join(rnd.choice(vocab) for _ in range(rnd.randint(3, 9))) + ".") for i in range(70)]
    return rnd, vocab, items


def test_search_finds_all_above_the_threshold():
    rnd, vocab, items = make()
    index = dc.BlockMaxIndex(items, block=4)
    for _ in range(300):
        passage = set(rnd.sample(vocab, rnd.randint(0, 40)))
        for threshold in (0.3, 0.6):
            want = {i for i, s in brute_scores(items, passage).items() if s >= threshold}
            got = {index.ids[k] for k, _ in index.search({index.vocabulary[w] for w in passage if w in index.vocabulary}, threshold)}
            assert got == want


def test_parted_indexes_score_and_find_as_one():
    rnd, vocab, items = make()
    known = dc.Statistics.of([dc.words_of(t) for _, t in items])
    whole = dc.BlockMaxIndex(items)
    parts = [dc.BlockMaxIndex(items[k::3], statistics=known) for k in range(3)]
    for _ in range(100):
        passage = set(rnd.sample(vocab, rnd.randint(5, 40)))
        ask = lambda x: [(x.ids[k], s) for k, s in x.search({x.vocabulary[w] for w in passage if w in x.vocabulary}, 0.4)]
        assert sorted(ask(whole)) == sorted(h for x in parts for h in ask(x))


def test_leaks_equal_brute_force(spark):
    rnd, vocab, items = make()
    docs = []
    for d in range(150):
        words = [rnd.choice(vocab) for _ in range(rnd.randint(0, 400))]
        if d % 3 == 0:
            _, text = rnd.choice(items)
            piece = text.split()
            if d % 6 == 0:
                piece[rnd.randrange(len(piece))] = "altered"
            if d % 9 == 0:
                piece = piece[: len(piece) // 2]
            at = rnd.randint(0, len(words))
            words[at:at] = [w.upper() if d % 2 else w for w in piece]
        docs.append((d, " ".join(words), "x"))
    docs += [(900, None, "x"), (901, "", "x"), (None, items[0][1], "x"), (0, docs[0][1], "x"), (902, "filler " * 9000 + items[5][1], "x")]
    want = []
    for d, text, _ in docs:
        grams = dc.shingles(dc.words_of(text))
        for i, t in items:
            own = dc.shingles(dc.words_of(t))
            q, a = dc.question_and_answer(t)
            words = dc.words_of(text)
            runs = {tuple(words[k : k + n]) for n in {len(g) for g in dc.shingles(q) | dc.shingles(a)} for k in range(len(words) - n + 1)}
            share = [sum(g in runs for g in dc.shingles(p)) / len(dc.shingles(p)) for p in (q, a)]
            if len(own & grams) / len(own) >= 0.8 and min(share) >= 0.4:
                want.append((str(d), i))
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([*items, (None, "no id here at all"), (300, None), (301, "..."), items[3]], "item_id long, text string")
    rows = []
    for tuning in ({}, {"index_items": 20}, {"index_items": 7}):
        rows.append(sorted((tuple(r) for r in dc.find_leaks(df, bench, **tuning).collect()), key=str))
        assert sorted((str(r[0]), r[1]) for r in rows[-1]) == sorted(want)
    # Scores are those of one index, however the items are parted.
    assert rows[0] == rows[1] == rows[2]
    assert len(want) > 20
    assert dc.find_leaks(df.limit(0), bench).count() == 0
    assert dc.find_leaks(df, bench.limit(0)).count() == 0


def test_query_and_stage_find_leaks_with_an_edited_or_missing_short_answer(spark, tmp_path):
    import corpus_pipeline
    from lorekeep.llm import queries

    rnd = random.Random(14)
    question = [f"w{rnd.randrange(10**6)}" for _ in range(40)]
    item = " ".join(question) + ". it is the blue one."
    docs = [(1, "so " + item), (2, "so " + item.replace("blue", "red")), (3, "so " + " ".join(question) + "."), (4, "so " + " ".join(question[:20]) + ".")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(r["doc_id"] for r in queries.op3_decontamination(spark, str(tmp_path)).collect()) == [1, 2, 3]
    kept = corpus_pipeline.drop_leaked(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert [r["doc_id"] for r in kept.collect()] == [4]
