"""Captions, chunking and diversity against plain models and properties."""

import random

import pytest
from pyspark.sql import functions as F

from lorekeep.functions import text as T
from lorekeep.operators import chunking as C
from lorekeep.operators import retrieve as R

VTT = """WEBVTT

NOTE skip me
1
00:00:00.000 --> 00:00:02.000
<c>Hello</c>   there

00:00:02.000 --> 00:00:04.500
Hello there
00:00:04.500 --> 00:00:06.000
Hello there general
NOTE inside

00:00:06.000 --> 00:00:07.000
Hello there general
00:00:07.000 --> 00:01:08.250
last"""


def test_captions():
    cues = C.parse_vtt_text("﻿" + VTT)
    assert cues == [(0.0, 4.5, "Hello there"), (4.5, 7.0, "Hello there general"), (7.0, 68.25, "last")]
    assert C.roll_up(cues) == [(0.0, 4.5, "Hello there"), (4.5, 7.0, "general"), (7.0, 68.25, "last")]
    assert C.parse_vtt_text("nothing here\n0:00 --> 1") == []
    assert C.roll_up([(0, 1, "a"), (1, 2, "a"), (2, 3, "a ")]) == [(0, 3, "a")]


def slow_chunks(tokens, target, overlap):
    """The packing written out window by window."""
    out, window = [], []
    for i, n in enumerate(tokens):
        if window and sum(tokens[j] for j in window) + n >= target:
            window.append(i)
            out.append((window[0], window[-1] + 1))
            keep = []
            for j in reversed(window):
                if sum(tokens[x] for x in keep) + tokens[j] > overlap:
                    break
                keep.insert(0, j)
            window = keep
        else:
            window.append(i)
    return out, (window[0] if window else len(tokens))


def test_pack_equals_the_plain_model():
    rnd = random.Random(1)
    for _ in range(500):
        tokens = [rnd.choice([1, 5, 20, 49, 50, 51, 120, 400]) for _ in range(rnd.randint(0, 40))]
        assert C.pack(tokens) == slow_chunks(tokens, 300, 50)


def test_chunk_properties():
    rnd = random.Random(2)
    for _ in range(200):
        sentences = [(" ".join("word" for _ in range(rnd.randint(1, 60))) + ".", float(i), float(i + 1), rnd.choice([C.CAPTION, C.FRAME])) for i in range(rnd.randint(0, 50))]
        chunks = C.chunk_rows("v", sentences)
        assert bool(chunks) == bool(sentences)
        longest = max((C.approx_tokens(s[0]) for s in sentences), default=0)
        for k, c in enumerate(chunks):
            assert c[0] == f"v:{k}" and c[3] <= c[4] and c[5]
            if k < len(chunks) - 1:
                assert c[6] <= 300 + longest + 60
        assert all(any(s[0] in c[5] for c in chunks) for s in sentences)
    with pytest.raises(ValueError):
        C.ChunkConfig(target_tokens=0)
    with pytest.raises(ValueError):
        C.ChunkConfig(target_tokens=50, overlap_tokens=50)


def test_kinds():
    one = lambda *kinds: C.chunk_rows("v", [("x.", 0.0, 1.0, k) for k in kinds])[0][7]
    assert (one(C.CAPTION), one(C.FRAME), one(C.CAPTION, C.FRAME)) == (C.CAPTION, C.FRAME, C.MIXED)


def test_diversity():
    e = lambda i: [1.0 if j == i else 0.0 for j in range(4)]
    scores, vectors = [1.0, 0.99, 0.5], [e(0), e(0), e(1)]
    assert R.select_diverse(scores, vectors, ["a", "b", "c"], 2, lam=1.0) == [0, 1]
    assert R.select_diverse(scores, vectors, ["a", "b", "c"], 2, lam=0.3) == [0, 2]
    assert R.select_diverse([1.0] * 5, [None] * 5, ["a"] * 5, 5) == [0, 1, 2]
    assert R.select_diverse([], [], [], 3) == []


def test_columns(spark):
    df = spark.createDataFrame([("Rust & C++: a  guide!",), ("  ---  ",), ("café français",), ("a" * 30 + " " + "b" * 30,), ("x" * 60,)], "t string")
    got = [r[0] for r in df.select(T.topic_slug(F.col("t"))).collect()]
    assert got == ["rust-c-a-guide", None, "caf-fran-ais", "a" * 30, "x" * 40]
    row = df.select(T.claim_id(F.lit("Rust is fast"), F.lit("alice"), F.lit("vid1"), F.lit("c1")), T.clock(F.lit(3725.9)), T.clock(F.lit(65)), T.abstained(F.lit(" ABSTAIN now")), T.unfenced_json(F.lit('```json\n{"a":1}\n```')), T.topic_of_source(F.lit("https://x.org/a/My_Talk/?q=1")), T.topic_of_source(F.lit("https://y.com/watch?v=AbC")), T.cron_fields(F.lit("0 3 * * 1"))["hour"], T.sentences(F.lit(" One two. Three!  Four? five.six "))).first()
    assert tuple(row) == ("6e7e902b31e75f71", "1:02:05", "1:05", True, '{"a":1}', "my-talk", "abc", 3, ["One two.", "Three!", "Four?", "five.six"])


def test_segments_chunk_and_roll(spark):
    files = spark.createDataFrame([("v1", VTT), ("v2", "broken"), ("v3", None)], "video_id string, text string")
    segs = C.parse_vtt(files)
    assert [r["text"] for r in segs.orderBy("seg_no").collect()] == ["Hello there", "general", "last"]
    chunks = C.chunk(segs).collect()
    assert [(c["chunk_id"], c["text"], c["start_seconds"], c["end_seconds"], c["kind"]) for c in chunks] == [("v1:0", "Hello there general last", 0.0, 68.25, "caption")]
    rolled = C.rolling_dedupe(spark.createDataFrame([("k", 1, "a"), ("k", 2, "a b"), ("k", 3, "b"), ("k", 4, "b")], "g string, o long, text string"), ["g"], "o").collect()
    assert [(r["pos"], r["text"], r["last_order"]) for r in sorted(rolled, key=lambda r: r["pos"])] == [(0, "a", 1), (1, "b", 4)]
