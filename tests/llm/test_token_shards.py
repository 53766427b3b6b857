import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lorekeep.llm import token_shards as ts

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = ["", " ", "a b", "x\x1cy\x85z", "é è", "Don't  stop\n\n NOW 123", "<|endoftext|> x<|startoftext|>", "日本 語", "😀😀", "ΣΑΣ Σ", "a\t́b ́c", "word " * 3000, "Été, É. naïve!! Straße? ÿ|", "A" * 300 + ".", "don't, can't. I'll"]


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [1]


def test_word_memo_equals_library():
    enc = ts.WordMemoEncoder(PATH, memo_words=50)
    rnd = random.Random(4)
    texts = ODD + ["".join(rnd.choice("abE's’tréÉ1 \n\t́<|>.,") for _ in range(rnd.randint(0, 80))) for _ in range(800)]
    for text, raw in zip(texts, enc.encode_batch(texts)):
        assert np.frombuffer(raw, "<u4").tolist() + [1] == library_ids(text), text


def test_round_trip_in_id_order(spark, tmp_path):
    rows = [(i * 7 % 101, ODD[i % len(ODD)], "n") for i in range(60)] + [(500, None, "n"), (None, "lost", "n"), (9000000000, "big id", "n"), (7, "twice", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(5)
    manifest = ts.write_shards(df, PATH, str(tmp_path), shards=4)
    got = sorted(ts.read_shards(manifest, str(tmp_path)).collect(), key=lambda r: r["start"])
    order = [r["doc_id"] for r in got]
    assert order[0] is None and order[1:] == sorted(order[1:]) and len(got) == len(rows)
    start, left = 0, [(i, library_ids(t)) for i, t, _ in rows]
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        left.remove((r["doc_id"], ids))
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(bytes(r["ids"])))
        start += len(ids)
    assert not left
    first = manifest.orderBy("shard").first()
    whole = ts.read_records(str(tmp_path), first["path"], list(range(first["n_docs"])))
    back = ts.read_records(str(tmp_path), first["path"], list(range(first["n_docs"]))[::-1])
    assert [(a, b.tolist()) for a, b in whole] == [(a, b.tolist()) for a, b in back[::-1]]
    assert ts.read_shards(ts.write_shards(df.limit(0), PATH, str(tmp_path)), str(tmp_path)).count() == 0


def test_wide_ids_and_damage():
    import io

    record = ts.frame(None, np.array([70000, 3], np.uint32)) + ts.frame(-5, np.array([], np.uint32))
    assert [(a, b.tolist()) for a, b in ts.unframe(io.BytesIO(record).read)] == [(None, [70000, 3]), (-5, [])]
    for at in (3, 9, 14, 25):
        broken = bytearray(record)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            list(ts.unframe(io.BytesIO(bytes(broken)).read))
    with pytest.raises(ValueError):
        list(ts.unframe(io.BytesIO(record[:-2]).read))
