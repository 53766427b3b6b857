"""Exact substring dedup: every byte that a repeated 400-byte string covers.

Suffixes are sorted only where a repeat must show.  Each window of ``length``
bytes has an anchor, the place of its least ``GRAM``-byte hash, the leftmost of
equals: equal windows have it at the same offset.  Neighbouring windows share
anchors, so a text has one run of windows for about 137 bytes.  A run's span is
the suffix at its first window, cut where its last window ends.

0. Copies of a text are one text from here on, told by 128 bits of hash.
   A copied text is all repeats, but takes part once, so that others meet it.
1. Anchors whose gram occurs once cannot lie in a repeat: counted, they go.
2. The spans of the others are sorted in each task into runs, front-coded,
   exchanged, and merged by loser trees that never compare known prefixes
   again.  A span that occurs twice has all its windows repeated.
3. What is left are spans that share a gram but not all their bytes: the ends
   of repeats.  Of each different span there, one, the windows are matched by
   64-bit hashes of their bytes and of their grams, and matches are verified
   byte by byte, a stretch of windows at a time.  Grams with over ``HOT``
   different spans count their windows by 192 bits of hash instead.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import arrow_rows, partitions, release, settle
from lorekeep.llm.runs import LoserTree, decode_run, encode_run

GRAM = 128
_PLACE_BITS = 20
_PLACES = np.uint64((1 << _PLACE_BITS) - 1)
_ODD = 0x9E3779B97F4A7C15
_WRAP = (1 << 64) - 1
RUN_BYTES = 32 << 20
#: A block of a front-coded run, and the bytes of spans that one merge takes.
BLOCK_BYTES, MERGE_BYTES = 256 << 10, 16 << 20
HOT = 256
#: Texts a task remembers to pass on copies once.
SEEN_TEXTS = 1_000_000
PIECE = 1 << (_PLACE_BITS - 1)


def _mixed(data: np.ndarray) -> np.ndarray:
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(29))


def hashes(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of the ``size`` bytes from each place on, by doubling; ``size`` may be any number."""
    h, n, out, done, mul = _mixed(data), 1, None, 0, _ODD
    left = size
    while True:
        if left & 1:
            out = h.copy() if out is None else out[: len(h) - done] * np.uint64(mul) + h[done:]
            done += n
        left >>= 1
        if not left:
            break
        h = h[:-n] * np.uint64(mul) + h[n:]
        h ^= h >> np.uint64(31)
        n *= 2
        mul = (mul * mul | 1) & _WRAP
    return (out[: len(data) - size + 1]) ^ (out[: len(data) - size + 1] >> np.uint64(33))


def window_runs(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, gram hash) of each run of windows with one anchor."""
    firsts, lasts, grams = [], [], []
    for start in range(0, len(data) - length + 1, PIECE):
        part = data[start : start + PIECE + length - 1]
        h = hashes(part, GRAM)
        key = (h & ~_PLACES) | np.arange(len(h), dtype=np.uint64)
        wide, n = length - GRAM + 1, 1
        while n * 2 <= wide:
            key = np.minimum(key[:-n], key[n:])
            n *= 2
        if wide > n:
            key = np.minimum(key[: n - wide], key[wide - n :])
        at = (key & _PLACES).astype(np.int64)
        cut = np.flatnonzero(np.diff(at)) + 1
        first = np.concatenate([[0], cut])
        firsts.append(first + start)
        lasts.append(np.concatenate([cut - 1, [len(at) - 1]]) + start)
        grams.append(h[at[first]])
    if not firsts:
        return np.array([], np.int64), np.array([], np.int64), np.array([], np.uint64)
    return np.concatenate(firsts), np.concatenate(lasts), np.concatenate(grams)


def merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Half-open intervals, overlapping and touching ones joined."""
    out: list[list[int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _stretches(places: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each stretch of consecutive numbers."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) > 1) + 1
    return list(zip(places[np.concatenate([[0], cut])].tolist(), places[np.concatenate([cut - 1, [len(places) - 1]])].tolist()))


def _verified(texts: list[bytes], who: np.ndarray, place: np.ndarray, code: np.ndarray, gram: np.ndarray, length: int) -> np.ndarray:
    """Which windows occur twice: matched by hash, verified by bytes.

    Windows are sorted by gram and hash; neighbours of equal hashes that go on
    in step (the same two texts, both places one further) are one comparison.
    """
    order = np.lexsort((place, who, code, gram))
    near = (code[order][1:] == code[order][:-1]) & (gram[order][1:] == gram[order][:-1])
    x, y = order[:-1][near], order[1:][near]
    steps = np.lexsort((place[x], place[y] - place[x], who[y], who[x]))
    x, y = x[steps], y[steps]
    twice = np.zeros(len(who), bool)
    if not len(x):
        return twice
    jump = (np.diff(who[x]) != 0) | (np.diff(who[y]) != 0) | (np.diff(place[x]) != 1) | (np.diff(place[y]) != 1)
    cut = np.flatnonzero(jump) + 1
    false = []
    for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(x)]):
        a, b, n = int(place[x[i]]), int(place[y[i]]), j - i + length - 1
        if texts[who[x[i]]][a : a + n] == texts[who[y[i]]][b : b + n]:
            twice[x[i:j]] = twice[y[i:j]] = True
        else:
            false += code[x[i:j]].tolist()
    for c in set(false):
        # Hashes that collide: their windows are told apart by their bytes.
        groups: dict[bytes, list[int]] = {}
        for k in np.flatnonzero(code == np.uint64(c)).tolist():
            groups.setdefault(texts[who[k]][place[k] : place[k] + length], []).append(k)
        for same in groups.values():
            twice[same] = len(same) > 1
    return twice


def repeated_windows(docs: DataFrame, text: str, length: int) -> tuple[DataFrame, list[DataFrame]]:
    """(r1, r2, a, b): windows a..b of the text with these hashes start a string that starts elsewhere in the distinct texts too.

    docs: r1, r2 (hashes of the text) and the text column; copies may be on any
    number of rows.  The second value lists the settled tables behind the
    result, to be released after it was written.
    """
    spark = docs.sparkSession
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    arrow_rows(spark)
    source = docs.select("r1", "r2", F.col(text).cast("binary").alias("t")).where(F.octet_length("t") >= length)

    def unseen(batch: pa.RecordBatch, seen: set) -> list[int]:
        """Rows of a batch whose text the task has not had; copies beyond what it remembers do no harm."""
        new = []
        for k, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            if key not in seen:
                if len(seen) >= SEEN_TEXTS:
                    seen.clear()
                seen.add(key)
                new.append(k)
        return new

    def anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            row, first, last, gram = [], [], [], []
            for k in unseen(batch, seen):
                a, b, g = window_runs(np.frombuffer(batch.column(2)[k].as_py(), np.uint8), length)
                row.append(np.full(len(a), k))
                first.append(a)
                last.append(b)
                gram.append(g)
            take = pa.array(np.concatenate(row) if row else [], pa.int64())
            made = [np.concatenate(x) if x else np.array([], d) for x, d in ((first, np.int64), (last, np.int64), (gram, np.uint64))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(made[0].astype(np.int32)), pa.array(made[1].astype(np.int32)), pa.array(made[2].view(np.int64))], names=["r1", "r2", "i0", "i1", "h"])

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            yield batch.take(pa.array(unseen(batch, seen), pa.int64()))

    anchors = settle(source.mapInArrow(anchor, "r1 long, r2 long, i0 int, i1 int, h long"), "anchors")
    # A gram is common if two different places have it; copies of a text in several tasks are one place.
    at = F.xxhash64("r1", "r2", "i0")
    common = anchors.groupBy("h").agg(F.count("*").alias("c"), F.min(at).alias("low"), F.max(at).alias("high")).where("low <> high").select("h", "c")
    common = settle(common, "grams")
    # Grams on over a thousandth of the anchors are under a thousand: they are broadcast, and the rest has no hot key.
    floor = max(1_000, anchors.count() // 1_000)
    hot_grams, cold_grams = F.broadcast(common.where(F.col("c") > floor).select("h")), common.where(F.col("c") <= floor).select("h")
    own = anchors.join(hot_grams, "h", "left_semi").unionByName(anchors.join(hot_grams, "h", "left_anti").join(cold_grams, "h", "left_semi"))
    lists = own.groupBy("r1", "r2").agg(F.sort_array(F.collect_set(F.struct("i0", "i1", "h"))).alias("runs"))
    lists = settle(lists, "lists")
    size = lists.agg(F.sum(F.aggregate("runs", F.lit(0).cast("long"), lambda s, w: s + w["i1"] - w["i0"] + length))).first()[0] or 0
    wide = int(max(32, partitions(spark), -(-size // MERGE_BYTES)))
    fields = [("kind", pa.int8()), ("run", pa.string()), ("part", pa.int32()), ("block", pa.binary()), ("idx", pa.int32()), ("r1", pa.int64()), ("r2", pa.int64()), ("i0", pa.int32()), ("i1", pa.int32())]

    def sort_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans: dict[bytes, list] = {}
        held = 0
        for batch in batches:
            for r1, r2, t, own in zip(*(batch.column(i).to_pylist() for i in range(4))):
                for w in own:
                    s = t[w["i0"] : w["i1"] + length]
                    refs = spans.get(s)
                    if refs is None:
                        refs = spans[s] = [w["h"]]
                        held += len(s) + 200
                    refs.append((r1, r2, w["i0"], w["i1"]))
                    held += 100
                if held > RUN_BYTES:
                    yield from flush(spans)
                    spans, held = {}, 0
        yield from flush(spans)

    def flush(spans: dict[bytes, list]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[bytes]] = {}
        for s in spans:
            parts.setdefault(zlib.crc32(s) % wide, []).append(s)
        rows: list[tuple] = []
        for part, every in sorted(parts.items()):
            every.sort()
            while every:
                total, n = 0, 0
                while n < len(every) and total < BLOCK_BYTES:
                    total += len(every[n])
                    n += 1
                own, every, run = every[:n], every[n:], uuid.uuid4().hex
                rows.append((0, run, part, encode_run(own, [spans[s][0] & _WRAP for s in own], [len(spans[s]) - 1 for s in own]), None, None, None, None, None))
                for idx, s in enumerate(own):
                    rows += [(1, run, part, None, idx, *ref) for ref in spans[s][1:]]
        for k in range(0, len(rows), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows[k : k + 20_000]), fields)], names=[n for n, _ in fields])

    # One row a text: a task passes a copied text on once, and what several tasks pass on meets here.
    texts = source.mapInArrow(once, "r1 long, r2 long, t binary").groupBy("r1", "r2").agg(F.first("t").alias("t"))
    joined = texts.join(lists, ["r1", "r2"]).select("r1", "r2", "t", "runs")
    table = settle(joined.mapInArrow(sort_runs, "kind byte, run string, part int, block binary, idx int, r1 long, r2 long, i0 int, i1 int"), "runs")
    release(anchors, common, lists)
    blocks, refs = table.where("kind = 0").select("run", "part", "block"), table.where("kind = 1")

    def merge(group: pa.Table) -> pa.Table:
        names = group["run"].to_pylist()
        tree = LoserTree([decode_run(b) for b in group["block"].to_pylist()])
        seen, out = [0] * len(names), []
        same: list[tuple[int, int]] = []
        last, tag, total = None, 0, 0

        def close() -> None:
            for k, (r, i) in enumerate(same):
                out.append((names[r], i, tag - (1 << 64) if tag >> 63 else tag, k == 0, total > 1))

        for r, shared, s, t, n in tree:
            if last is None or shared != len(s) or len(s) != len(last):
                close()
                same, last, tag, total = [], s, t, 0
            same.append((r, seen[r]))
            seen[r] += 1
            total += n
        close()
        columns = list(zip(*out)) if out else [[] for _ in range(5)]
        part = group["part"][0].as_py()
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.bool_(), pa.bool_())
        made = [pa.array(c, t) for c, t in zip(columns, kinds)]
        return pa.Table.from_arrays([made[0], pa.array(np.full(len(out), part, np.int32)), *made[1:]], names=["run", "part", "idx", "h", "rep", "whole"])

    spans = settle(blocks.groupBy("part").applyInArrow(merge, "run string, part int, idx int, h long, rep boolean, whole boolean"), "spans")
    groups = spans.where("rep").groupBy("h").agg(F.count("*").alias("kinds"), F.min("whole").alias("closed")).where("kinds > 1 and not closed").select("h", "kinds")
    wanted = spans.where("rep").join(groups, "h").groupBy("run", "part").agg(F.collect_list(F.struct("idx", "h", "kinds", "whole")).alias("want"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run, part, block, want in zip(*(batch.column(i).to_pylist() for i in range(4))):
                need = {w["idx"]: w for w in want}
                got = [(idx, s) for idx, (_, s, _, _) in enumerate(decode_run(block)) if idx in need]
                for k in range(0, len(got), 5_000):
                    some = got[k : k + 5_000]
                    yield pa.RecordBatch.from_arrays([pa.array([run] * len(some)), pa.array([part] * len(some), pa.int32()), pa.array([i for i, _ in some], pa.int32()), pa.array([need[i]["h"] for i, _ in some], pa.int64()), pa.array([need[i]["kinds"] for i, _ in some], pa.int64()), pa.array([need[i]["whole"] for i, _ in some]), pa.array([s for _, s in some], pa.binary())], names=["run", "part", "idx", "h", "kinds", "whole", "s"])

    ends = settle(blocks.join(wanted, ["run", "part"]).select("run", "part", "block", "want").mapInArrow(fetch, "run string, part int, idx int, h long, kinds long, whole boolean, s binary"), "ends")

    def compare(group: pa.Table) -> pa.Table:
        """All windows of a bucket's spans."""
        texts, grams, whole = group["s"].to_pylist(), group["h"].to_numpy(), group["whole"].to_numpy()
        who, place, code = [], [], []
        for k, s in enumerate(texts):
            w = hashes(np.frombuffer(s, np.uint8), length)
            who.append(np.full(len(w), k))
            place.append(np.arange(len(w)))
            code.append(w)
        who, place, code = np.concatenate(who), np.concatenate(place), np.concatenate(code)
        at = np.flatnonzero(_verified(texts, who, place, code, grams[who], length) & ~whole[who])
        jump = np.flatnonzero((np.diff(place[at]) != 1) | (np.diff(who[at]) != 0)) + 1 if len(at) else np.array([], int)
        begin = np.concatenate([[0], jump]) if len(at) else jump
        stop = np.concatenate([jump - 1, [len(at) - 1]]) if len(at) else jump
        take = pa.array(who[at[begin]], pa.int64())
        return pa.table({"run": group["run"].take(take), "part": group["part"].take(take), "idx": group["idx"].take(take), "a": pa.array(place[at[begin]], pa.int32()), "b": pa.array(place[at[stop]], pa.int32())})

    buckets = int(max(8 * partitions(spark), 8 * wide))
    cold = ends.where(F.col("kinds") <= HOT).withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(buckets)))
    few = cold.groupBy("bucket").applyInArrow(compare, "run string, part int, idx int, a int, b int")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, s in enumerate(batch.column(5).to_pylist()):
                data = np.frombuffer(s, np.uint8)
                w, v = hashes(data, length), hashes(data[::-1], length)[::-1]
                take = pa.array(np.full(len(w), k))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(take) for i in range(5)), pa.array(w.view(np.int64)), pa.array(np.ascontiguousarray(v).view(np.int64)), pa.array(np.arange(len(w), dtype=np.int32))], names=["run", "part", "idx", "h", "whole", "w", "v", "place"])

    # Grams with many different spans: their windows are counted one by one, combined before the shuffle.
    hot = ends.where(F.col("kinds") > HOT).select("run", "part", "idx", "h", "whole", "s").mapInArrow(windows, "run string, part int, idx int, h long, whole boolean, w long, v long, place int")
    twice = hot.groupBy("h", "w", "v").agg(F.count("*").alias("c")).where("c > 1").select("h", "w", "v")
    many = hot.where("not whole").join(twice, ["h", "w", "v"]).select("run", "part", "idx", F.col("place").alias("a"), F.col("place").alias("b"))
    parts = settle(few.unionByName(many), "parts")

    state = spans.select("run", "part", "idx", "whole")
    placed = refs.select("run", "part", "idx", "r1", "r2", "i0", "i1").join(state, ["run", "part", "idx"])
    whole = placed.where("whole").select("r1", "r2", F.col("i0").alias("a"), F.col("i1").alias("b"))
    some = placed.where("not whole").join(parts, ["run", "part", "idx"]).select("r1", "r2", (F.col("i0") + F.col("a")).alias("a"), (F.col("i0") + F.col("b")).alias("b"))
    return whole.unionByName(some), [table, spans, ends, parts]


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, payload: bool = True) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256, has_repeats and, with payload, kept (binary) and text.

    A byte goes if a string of ``length`` bytes of its text that also starts
    anywhere else, in the same text or another row, covers it; overlaps count
    and all strings are judged on the input.  Null and shorter texts lose
    nothing (null counts as empty), repeated rows are copies of each other, null
    ids stay, other columns are ignored, an empty table gives none.  text is
    kept as a string; a character that a cut went through is replaced.
    """
    arrow_rows(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col), text.alias("text"), F.xxhash64(text).alias("r1"), F.xxhash64(F.lit(7), text).alias("r2"))
    found, behind = repeated_windows(rows, "text", length)
    # Copied texts are repeats from end to end.
    copied = rows.select("r1", "r2", F.octet_length("text").alias("n")).where(F.col("n") >= length).groupBy("r1", "r2").agg(F.count("*").alias("c"), F.max("n").alias("n")).where("c > 1")
    found = found.unionByName(copied.select("r1", "r2", F.lit(0).alias("a"), (F.col("n") - length).cast("int").alias("b")))
    covers = settle(found.groupBy("r1", "r2").agg(F.collect_set(F.struct("a", "b")).alias("cover")), "cover")
    release(*behind)
    kind = docs.schema[id_col].dataType.simpleString()
    extra = [("kept", pa.binary(), "binary"), ("text", pa.string(), "string")] if payload else []

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, removed, spans, digest, kept = [], [], [], [], []
            for raw, cover in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = raw or b""
                gone = merged([(c["a"], c["b"] + length) for c in cover or []])
                parts, last = [], 0
                for a, b in gone:
                    parts.append(raw[last:a])
                    last = b
                rest = b"".join([*parts, raw[last:]])
                size.append(len(raw))
                removed.append(len(raw) - len(rest))
                spans.append(len(gone))
                digest.append(hashlib.sha256(rest).hexdigest())
                if payload:
                    kept.append(rest)
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in (size, removed, spans)), pa.array(digest, pa.string()), pa.array([n > 0 for n in removed], pa.bool_())]
            if payload:
                columns += [pa.array(kept, pa.binary()), pa.array([k.decode(errors="replace") for k in kept], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "has_repeats"] + [n for n, _, _ in extra])

    joined = rows.join(covers, ["r1", "r2"], "left").select(id_col, F.col("text").cast("binary").alias("t"), "cover")
    return joined.mapInArrow(cut, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, has_repeats boolean" + "".join(f", {n} {t}" for n, _, t in extra))
