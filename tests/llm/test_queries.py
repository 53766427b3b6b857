"""The registered queries over small tables with odd rows, against brute force."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash

from lorekeep.llm import queries

KINDS = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, words string"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """(folder, documents): copies, near copies, repeats, nulls, a repeated row, a null id, a very long text."""
    rnd = random.Random(21)
    vocab = ["".join(rnd.choice("abcdeghilmnorstué") for _ in range(rnd.randint(2, 9))) for _ in range(900)]

    def prose(n):
        return " ".join(rnd.choice(vocab) for _ in range(n))

    texts = [prose(rnd.randint(0, 160)) for _ in range(45)]
    passage = prose(110)
    texts += [f"{prose(9)}. {passage} {prose(rnd.randint(0, 20))}" for _ in range(4)]
    texts += [texts[3], texts[3], texts[3] + " more", texts[5].upper(), "", None, "word", "ß É 1\t2", "All Rights reserved. cc by, CC BY all rights reserved", "x licensed under the GNU General Public License version 3 y"]
    texts += [prose(30_000) + passage]
    rows = [(k, t, "en", f"s{k % 3}", len(t or ""), 1.0, "f", "w") for k, t in enumerate(texts)]
    rows += [rows[7], (None, texts[8], "en", "s", 1, None, None, None)]
    root = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, KINDS).repartition(3).write.parquet(f"{root}/documents.parquet")
    item = prose(30) + ". " + prose(12) + "."
    spark.createDataFrame([(1, item), (2, passage), (3, None)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root, [(r[0], r[1]) for r in rows]


def rows_of(df, *cols):
    assert df.columns[: len(cols)] == list(cols)
    return sorted((tuple(r)[: len(cols)] for r in df.collect()), key=str)


def test_op1(spark, tables):
    from tokenizers import Tokenizer

    root, docs = tables
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = queries.op1_token_shards(spark, root).collect()
    ids = {t: library.encode(t or "", add_special_tokens=False).ids + [1] for _, t in docs}
    want = Counter((d, len(ids[t]), zlib.crc32(np.array(ids[t], "<u4").tobytes())) for d, t in docs)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"]) if r["doc_id"] is not None]
    assert order == sorted(order)


def test_op2(spark, tables):
    root, docs = tables
    raw = [(t or "").encode() for _, t in docs]
    seen = Counter(hashlib.blake2b(t[i : i + 400], digest_size=12).digest() for t in raw for i in range(len(t) - 399))
    want = []
    for (d, _), t in zip(docs, raw):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 399):
            if seen[hashlib.blake2b(t[i : i + 400], digest_size=12).digest()] > 1:
                gone[i : i + 400] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        want.append((d, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    out = queries.op2_substring_dedup(spark, root)
    assert rows_of(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=str)
    assert sum(w[2] > 0 for w in want) >= 9


def test_op3(spark, tables):
    root, docs = tables
    got = {(r["doc_id"], r["item_id"]) for r in queries.op3_decontamination(spark, root).collect()}
    passage = docs[45][1].split(". ", 1)[1].split()[:100]
    assert got == {(d, 2) for d, t in docs if t and " ".join(passage) in t} and len(got) == 5


def test_op4(spark, tables):
    root, docs = tables
    prints = []
    for _, t in docs:
        words = (t or "").encode().lower().split()
        grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        h = np.array([xxhash.xxh64_intdigest(g, 42) for g in grams], np.uint64)
        prints.append(sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > len(h)) if grams else 0)
    part = list(range(len(docs)))
    for _ in docs:
        part = [min(part[j] for j in range(len(docs)) if (prints[i] ^ prints[j]).bit_count() <= 3) for i in range(len(docs))]
    low = {}
    for (d, _), p in zip(docs, part):
        low[p] = min([x for x in (low.get(p), d) if x is not None], default=None)
    want = sorted(((d, f"{f:016x}", low[p]) for (d, _), f, p in zip(docs, prints, part)), key=str)
    assert rows_of(queries.op4_simhash(spark, root), "doc_id", "fingerprint", "component_id") == want


def test_op5(spark, tmp_path):
    rnd = random.Random(4)
    vocab = [a + b + c for a in "bdkl" for b in "aeiou" for c in ("n", "r", "st")]
    docs, labels = [], []
    for k in range(400):
        words = [rnd.choice(vocab) for _ in range(rnd.randint(5, 80))]
        if k % 5 == 0:
            words.insert(rnd.randrange(len(words)), "gru4nkle" if k % 2 else "Grunkle")
        docs.append((k, " ".join(words)))
        labels.append((k, 1, int(k % 5 == 0)))
    docs += [(900, None), (901, ""), (None, "grunkle"), (0, docs[0][1])]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = queries.op5_toxicity(spark, str(tmp_path)).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(d for d, _ in docs)
    wrong = 0
    for r in out:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        if r["held_out"] and r["doc_id"] < 400:
            wrong += r["predicted"] != int(r["doc_id"] % 5 == 0 and r["doc_id"] % 2 == 0) and r["doc_id"] % 10 != 5
    assert wrong == 0


def test_op7(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(60):
        centre = rng.standard_normal(64)
        for j in range(4):
            v = centre + rng.standard_normal(64) * 0.05 * j
            rows.append((4 * k + j, [float(np.float32(x)) for x in v], int(k % 3)))
    rows += [(1000, None, 1), (1001, [0.0] * 64, 1), (1002, rows[0][1], None), (None, rows[0][1], 0), (1003, rows[0][1], 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    unit = {k: np.array(v) / np.linalg.norm(v) for k, (_, v, l) in enumerate(rows) if v and any(v) and l is not None}
    near = {k: [j for j in unit if j != k and rows[j][2] == rows[k][2] and unit[k] @ unit[j] >= 0.93] for k in unit}
    want = []
    for k, (i, _, _) in enumerate(rows):
        reach, todo = {k}, [k]
        while todo:
            new = [j for j in near.get(todo.pop(), []) if j not in reach]
            reach |= set(new)
            todo += new
        low = min((rows[j][0] for j in reach if rows[j][0] is not None), default=None)
        want.append((i, len(near.get(k, [])), low, i == low))
    assert rows_of(queries.op7_lattice(spark, str(tmp_path)), "vec_id", "n_links", "component_id", "kept") == sorted(want, key=str)


def test_op8(spark, tmp_path):
    rnd = random.Random(6)
    line = lambda: " ".join("".join(rnd.choice("abcdefg") for _ in range(6)) for _ in range(8))
    docs = []
    for k in range(30):
        own = [line() for _ in range(6)]
        if k % 3 == 0:
            own.insert(rnd.randint(1, 5), f"Posted on 2024-01-{k + 1:02d} by user{k} today")
        docs.append((k, own))
    long = [line() for _ in range(20_000)]
    docs.append((50, [*long[:9000], "Posted on 2020-02-02 by user7 today", *long[9000:]]))
    rows = [(k, "\n".join(t)) for k, t in docs] + [(60, None), (61, ""), (None, "one line only here")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op8_line_dedup(spark, str(tmp_path)).collect()}
    for k, t in docs:
        kept = [x for x in t if not x.startswith("Posted on")]
        r = got[k]
        assert (r["n_lines"], r["n_dropped"]) == (len(t), len(t) - len(kept)) and r["kept_sha256"] == hashlib.sha256("\n".join(kept).encode()).hexdigest()
    assert got[60]["n_lines"] == 0 and got[61]["n_lines"] == 1 and got[None]["n_dropped"] == 0


def test_op9(spark, tables):
    import sentencepiece

    root, docs = tables
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = []
    for d, t in docs:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((d, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert rows_of(queries.op9_sentencepiece(spark, root), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=str)


def test_op10(spark, tables):
    root, docs = tables
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    want = []
    for d, t in docs:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        starts = [i for i, _ in places]
        want.append((d, len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))))
    out = queries.op10_license_scan(spark, root)
    assert rows_of(out, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(want, key=str)
    labels = {r["doc_id"]: (set(r["labels"].split(",")), r["score"]) for r in out.collect() if r["labels"]}
    assert any("gpl-3.0" in x for x, _ in labels.values()) and all(0 <= s <= 1 for _, s in labels.values())
