import hashlib
import random

import numpy as np
import public_tokenizers
import sentencepiece

import corpus_pipeline


def test_stages_take_effect_on_known_documents(spark, tmp_path):
    rnd = random.Random(16)
    vocab = [a + b + c for a in "bdklmprst" for b in "aeiou" for c in ("n", "r", "st", "l")]

    def line(n=14):
        return " ".join(rnd.choice(vocab) for _ in range(n))

    docs = {i: [line() for _ in range(6)] for i in range(60)}
    toxic = {i for i in range(60) if i % 10 == 3}
    for i in toxic:
        docs[i][2] += " grunkle"
    labels = [(i, 1, int(i in toxic)) for i in range(60)]
    for i in range(60, 90):  # labelled examples to learn from
        docs[i] = [line(), line()]
        if i % 2:
            docs[i][0] += " grunkle"
            toxic.add(i)
        labels.append((i, 1, i % 2))
    boiler = "Subscribe to our letter today"
    for i in range(0, 60, 4):
        docs[i].insert(3, boiler)
    leak = "which " + line(12) + " is it. the answer is " + line(6) + "."
    docs[20].insert(1, leak)
    for k, i in enumerate((100, 101, 102)):  # copies of document 5, one with a changed space
        docs[i] = docs[5][:-1] + [docs[5][-1] + " " * k]
    rows = [(i, "\n".join(t), "en", "s", len("\n".join(t))) for i, t in docs.items()] + [(200, None, "en", "s", None), (201, "", "en", "s", 0), (None, "no id " + line(), "en", "s", 5)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    for name, data, schema in (("documents", rows, kinds), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", [(1, leak)], "item_id long, text string")):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    want = {i: "\n".join(x for x in t if x != boiler) for i, t in docs.items() if i not in toxic and i not in (20, 100, 101, 102)}
    want |= {200: "", None: rows[-1][1]}  # of the two texts without words, one stays
    assert set(out) == set(want)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for i, text in want.items():
        ids = library.encode(text, add_bos=True, add_eos=True)
        assert bytes(out[i]["ids"]) == np.array(ids, "<u4").tobytes() and out[i]["n_tokens"] == len(ids)
        assert out[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_stage_columns_and_empty_table(spark, tmp_path):
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    for name, schema in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.createDataFrame([], kinds)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.schema.simpleString() == docs.schema.simpleString()
