import hashlib
import random

import numpy as np
import public_tokenizers
import sentencepiece

from lorekeep.llm import spm
from lorekeep.llm.prefix_bpe import PrefixTableBpe

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
ODD = ["", " ", "      ", "  a  b ", "\n\n x\t\ty ", "▁▁a▁b", "日本語テキスト", "😀 a", "<s> </s> <0x0A> <unk>", "a" * 500, "aaab" * 300, "\x00a", "é", "\x01 \x02b", "end. \n next,\nx", "é", "wor.d, (x)."]


def test_encoding_and_decoding_equal_the_library():
    bpe = PrefixTableBpe(MODEL, memo_segments=200)
    rnd = random.Random(1)
    texts = ODD + ["".join(rnd.choice("abcdeé ▁\n<0x>theonin 12.,") for _ in range(rnd.randint(0, 60))) for _ in range(1500)]
    texts += ["".join(rnd.choice("aeinorst") for _ in range(rnd.randint(0, 200))) for _ in range(300)]
    for text in texts:
        want = LIBRARY.encode(text, add_bos=True, add_eos=True)
        assert bpe.encode(text) == want, text
        assert bpe.decode(want) == LIBRARY.decode(want), text


def test_decoding_of_any_ids():
    bpe = PrefixTableBpe(MODEL)
    rnd = random.Random(2)
    for _ in range(2000):
        ids = [rnd.choice([rnd.randrange(32000), rnd.randrange(300)]) for _ in range(rnd.randint(0, 12))]
        assert bpe.decode(ids) == LIBRARY.decode(ids), ids


def test_frames(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(0, None, None), (None, "a", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = spm.encode_texts(df, MODEL)
    got = {(r["doc_id"], r["decoded"]): r for r in out.collect()}
    for i, t, _ in rows:
        want = LIBRARY.encode(t or "", add_bos=True, add_eos=True)
        row = got[(i, LIBRARY.decode(want))]
        raw = np.array(want, "<u4").tobytes()
        assert (row["n_tokens"], bytes(row["ids"]), row["ids_sha256"]) == (len(want), raw, hashlib.sha256(raw).hexdigest())
    back = spm.decode_ids(out.select("doc_id", "ids"), MODEL)
    assert {r["text"] for r in back.collect()} == {k[1] for k in got}
    assert spm.encode_texts(df.limit(0), MODEL).count() == 0
