import random
import zlib

from pyspark.sql import functions as F

from lorekeep.llm import toxicity as tx


def test_fold_homoglyphs_digits_and_marks():
    assert tx.fold("1D10T iDіоt ＩＤＩＯＴ i​diot") == "idiot idiot idiot idiot"
    assert tx.fold("$tup1d! 12 3.5 a1 2024 p@ss") == "stupid! 12 3.5 a1 2024 pass"
    assert tx.fold("1234 $5 100%") == "1234 $5 100%"
    assert tx.fold("É è ß") == "é è ß"


def brute_weight(text, lexicon):
    words = tx._WORD.findall(tx.fold(text))
    total = 0.0
    for k, w in enumerate(words):
        best = max((v for e, v in lexicon.entries.items() if (w.startswith(e[:-1]) if e.endswith("*") else w == e)), default=None)
        pair = f"{words[k - 1]} {w}" if k else None, f"{w} {words[k + 1]}" if k + 1 < len(words) else None
        if best is not None and not lexicon.exceptions & set(pair):
            total += best
    return total


def test_matcher_equals_brute_force():
    lexicon = tx.Lexicon({"idiot": 3.0, "scum*": 2.0, "scumbag": 4.0, "clown": 1.5}, frozenset({"clown fish", "circus clown"}))
    m = tx.Matcher(lexicon)
    rnd = random.Random(9)
    pool = ["idiot", "1d1ot", "scum", "scumbag", "scumbags", "clown", "fish", "circus", "nice", "idiots", "çlown", "é", "\n"]
    for _ in range(500):
        text = " ".join(rnd.choice(pool) for _ in range(rnd.randint(0, 12)))
        assert abs(m.weigh(text)[0] - brute_weight(text, lexicon)) < 1e-9, text
    assert m.score("") == m.score("nice") < m.score("idiot") <= m.score("idiot scum idiot")
    assert m.score("idiot") > m.score("idiot" + " nice" * 3000)
    assert tx.Matcher(tx.Lexicon()).weigh("idiot") == (0.0, 0, 1)


def test_learns_words_beginnings_and_exceptions_from_training_rows_only(spark):
    rnd = random.Random(10)
    vocab = [f"{a}{b}" for a in ("ba", "ko", "mi", "tu", "re", "sa") for b in ("lan", "tor", "nis", "ped", "gum", "vex", "dol")]
    rows, labels = [], []
    for i in range(900):
        words = [rnd.choice(vocab) for _ in range(rnd.randint(0, 50))]
        toxic = i % 6 == 0
        if toxic:
            bad = rnd.choice(["grunk", "GRUNK", "gr0nk".replace("0", "u"), "zorbel" + rnd.choice("abcdefgh") + rnd.choice("xyz")])
            words.insert(rnd.randint(0, len(words)), bad)
        elif i % 24 == 1:
            words += ["grunk", "flower"]
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(toxic)))
    rows += [(5000, None, "x"), (5001, "", "x"), (None, "grunk", "x"), (7, rows[7][1], "x"), (5002, "zorbelqq", "x"), (5003, "balan " * 20000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    table = spark.createDataFrame([*labels, (9999, 1), (3, None)], "doc_id long, toxic int")
    lexicon = tx.learn(docs, table, ~tx.held_out())
    scored = tx.score_texts(docs, lexicon).withColumn("held", tx.held_out()).collect()
    assert len(scored) == len(rows)
    truth = dict(labels)
    held = [r for r in scored if r["held"] and r["doc_id"] in truth]
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in scored if r["doc_id"] is not None)
    good = sum((r["score"] >= 0.3) == bool(truth[r["doc_id"]]) for r in held)
    assert good >= 0.97 * len(held)
    by_id = {r["doc_id"]: r["score"] for r in scored}
    assert by_id[5000] == by_id[5001] < 0.3 and by_id[5003] < 0.3 and by_id[5002] >= 0.3
    hidden = tx.learn(docs, table.where(F.col("doc_id") > 1_000_000), ~tx.held_out())
    assert hidden.entries == {} and all(r["score"] < 0.3 for r in tx.score_texts(docs, hidden).collect())
    assert tx.score_texts(docs.limit(0), lexicon).count() == 0
    kept = tx.score_texts(docs, lexicon, keep=True)
    assert kept.columns == ["doc_id", "text", "score", "hits", "n_words"] and kept.count() == len(rows)
