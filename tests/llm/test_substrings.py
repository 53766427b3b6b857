import hashlib
import random
from collections import Counter

import numpy as np

from lorekeep.llm import runs, substrings


def test_loser_tree_merges_front_coded_runs():
    rnd = random.Random(14)
    for k in (1, 2, 3, 7):
        every, blocks = [], []
        for _ in range(k):
            own = sorted({bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 12))) for _ in range(rnd.randint(0, 60))})
            every += own
            blocks.append(runs.encode_run(own, [7] * len(own), [1] * len(own)))
        got = list(runs.LoserTree([runs.decode_run(b) for b in blocks]))
        assert [g[2] for g in got] == sorted(every)
        last = b""
        for _, shared, s, tag, n in got:
            assert (shared, tag, n) == (runs.common_prefix(last, s), 7, 1)
            last = s


def test_hashes_and_runs_depend_on_window_contents_only():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 100, 3000).astype(np.uint8)
    for size in (1, 3, 128, 400):
        h = substrings.hashes(data, size)
        assert len(h) == len(data) - size + 1
        assert (h[100:200] == substrings.hashes(data[100 : 200 + size - 1], size)).all()
        assert len(set(h.tolist())) == len({data[i : i + size].tobytes() for i in range(len(h))})
    a, b, g = substrings.window_runs(data, 400)
    assert a[0] == 0 and b[-1] == len(data) - 400 and (a[1:] == b[:-1] + 1).all()


def brute(texts, length=400):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_rows_equal_brute_force(spark, monkeypatch):
    rnd = random.Random(15)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(2, 8))) for _ in range(300)]

    def prose(n):
        return " ".join(rnd.choice(words) for _ in range(n))

    shared = [prose(rnd.randint(60, 200)) for _ in range(6)]
    texts = [prose(rnd.randint(0, 250)) for _ in range(60)]
    for _ in range(40):
        s = rnd.choice(shared)
        cut = rnd.randint(0, len(s) // 2)
        texts.append(prose(rnd.randint(0, 60)) + s[cut : cut + rnd.randint(380, 900)] + prose(rnd.randint(0, 60)))
    base = shared[0] * 2
    texts += [base[:k] + "X" + base[k:] for k in (0, 399, 400, 401, 700)] + [base, base, "ab" * 600, "a" * 401, "a" * 400, "b" * 399, "", None, "é" * 300]
    edge = prose(80)[:399]
    texts += [edge + "x", edge + "y", "z" + edge + "x"]
    # One passage in many different surroundings: a gram with many different spans.
    texts += [prose(3) + shared[1] + prose(3) for _ in range(40)]
    rows = [(i if i % 17 else None, t, "k") for i, t in enumerate(texts)]
    rows.append(rows[5])
    rows += [(None, shared[2], "k")] * 50  # identical rows without an id
    want = sorted((str(i), *b) for (i, _, _), b in zip(rows, brute([(t or "").encode() for _, t, _ in rows])))
    df = spark.createDataFrame(rows, "doc_id long, text string, r1 string").repartition(3)
    for hot, block in ((256, 256 << 10), (3, 2_000)):
        monkeypatch.setattr(substrings, "HOT", hot)
        monkeypatch.setattr(substrings, "BLOCK_BYTES", block)
        out = substrings.drop_repeats(df)
        got = sorted((str(r[0]), *tuple(r)[1:5]) for r in out.collect())
        assert got == want
    assert sum(w[2] > 0 for w in want) > 40
    assert substrings.drop_repeats(df.limit(0)).count() == 0
    for r in out.where("doc_id is not null").collect():
        assert bytes(r["kept"]).decode(errors="replace") == r["text"] and r["has_repeats"] == (r["n_removed"] > 0)


def test_pieces_of_long_texts_join_at_their_seams(monkeypatch):
    data = np.random.default_rng(4).integers(97, 123, 3000).astype(np.uint8)
    whole = substrings.window_runs(data, 400)
    monkeypatch.setattr(substrings, "PIECE", 700)
    a, b, g = substrings.window_runs(data, 400)
    assert a[0] == 0 and b[-1] == 2600 and (a[1:] == b[:-1] + 1).all()
    # Each window has the anchor it had, only runs are cut at the seams.
    gram = lambda x: np.repeat(x[2], x[1] - x[0] + 1)
    assert (gram((a, b, g)) == gram(whole)).all()


def test_windows_whose_hashes_collide_are_told_apart_by_bytes():
    texts = [b"abcd", b"abxx", b"abcd", b"zzzz"]
    who, place = np.arange(4), np.zeros(4, int)
    code, gram = np.zeros(4, np.uint64), np.zeros(4, np.int64)
    assert substrings._verified(texts, who, place, code, gram, 4).tolist() == [True, False, True, False]
