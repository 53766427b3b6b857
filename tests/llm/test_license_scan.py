import random
import re

from lorekeep.llm import license_scan as ls

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, idf):
    w = words(text)
    base, labels, best = [], set(), 0.0
    for t in ls.BASE + ls.NOTICES:
        for s in range(len(w)):
            if all(w[s + at : s + at + n] == list(t.words[at : at + n]) for at, n in t.must):
                score = 1.0 if t.base else sum(idf[x] for j, x in enumerate(t.words) if s + j < len(w) and w[s + j] == x) / sum(idf[x] for x in t.words)
                if t.base:
                    base.append((s, t.label))
                elif score < 0.6:
                    continue
                labels.add(t.label)
                best = max(best, score)
    starts = [s for s, _ in base]
    return (len(w), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), round(min(best, 1.0), 9))


def test_scan_equals_brute_force(spark):
    rnd = random.Random(6)
    pool = sorted({w for t in ls.BASE + ls.NOTICES for w in t.words}) + ["zé", "Ünder", "99"]
    texts = [None, "", "...", "CC-BY cc by CC_BY ccby", "Licensed under CC BY-NC 4.0.", "all rights reserved. ALL RIGHTS RESERVED", "This work is licensed under the GNU General Public License, version 3.", "Released under the MIT License.", "mit license the", "general public license", "x " * 2000 + "Licensed under the Apache License, Version 2.0."]
    for _ in range(300):
        parts = []
        for _ in range(rnd.randint(1, 6)):
            t = rnd.choice(ls.BASE + ls.NOTICES)
            ws = list(t.words)
            if rnd.random() < 0.3:
                ws[rnd.randrange(len(ws))] = rnd.choice(pool)
            parts.append(rnd.choice([" ", "-", ", "]).join(ws) if rnd.random() < 0.5 else " ".join(rnd.choice(pool) for _ in range(rnd.randint(0, 9))))
        texts.append(". ".join(parts))
    df = spark.createDataFrame([(i, t, 1, "w") for i, t in enumerate(texts)] + [(0, "cc by", 2, "w"), (None, "x", 3, "w")], "doc_id long, text string, n_words int, words string")
    vocabulary = sorted({w for t in ls.BASE + ls.NOTICES for w in t.words})
    idf = ls.word_idf(df, vocabulary)
    got = sorted((str(r["doc_id"]), tuple(r)[1:7], round(r["score"], 9)) for r in ls.digest(ls.scan_licenses(df)).collect())
    want = sorted((str(r["doc_id"]), brute(r["text"], idf)[:6], brute(r["text"], idf)[6]) for r in df.collect())
    assert got == want
    assert ls.scan_licenses(df.limit(0)).count() == 0
