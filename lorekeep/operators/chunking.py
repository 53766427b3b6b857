"""Captions to segments, segments to overlapping chunks of sentences."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorekeep.session import arrow_rows

SEGMENTS = "video_id string, seg_no int, start_seconds double, end_seconds double, text string, kind string"
CHUNKS = "chunk_id string, video_id string, chunk_idx int, start_seconds double, end_seconds double, text string, token_count int, kind string"
CAPTION, FRAME, MIXED = "caption", "frame_description", "mixed"
_CUE = re.compile(r"(\d{2}):(\d{2}):(\d{2})\.(\d{3})\s*-->\s*(\d{2}):(\d{2}):(\d{2})\.(\d{3})")
_END = re.compile(r"(?<=[.!?])\s+")


@dataclass(frozen=True)
class ChunkConfig:
    target_tokens: int = 300
    overlap_tokens: int = 50
    min_tokens: int = 80

    def __post_init__(self):
        if self.target_tokens <= 0:
            raise ValueError("target_tokens must be positive")
        if self.overlap_tokens >= self.target_tokens:
            raise ValueError("overlap_tokens must be under target_tokens")


def approx_tokens(text: str) -> int:
    return math.ceil(len(text) / 4)


def split_sentences(text: str) -> list[str]:
    """Ends at . ! or ? before white space; blanks are left out."""
    return [s.strip() for s in _END.split(text.strip()) if s.strip()]


def pack(tokens: list[int], config: ChunkConfig = ChunkConfig()) -> tuple[list[tuple[int, int]], int]:
    """Half-open spans of sentences, and where the unfinished tail begins.

    A sentence that lifts a running window to the target closes it; the next
    window starts with the longest run of its last sentences worth at most the
    overlap.  A window's first sentence never closes it.
    """
    spans: list[tuple[int, int]] = []
    low, total = 0, 0
    for at, n in enumerate(tokens):
        total += n
        if at > low and total >= config.target_tokens:
            spans.append((low, at + 1))
            floor, low, total = low, at + 1, 0
            while low > floor and total + tokens[low - 1] <= config.overlap_tokens:
                low -= 1
                total += tokens[low]
    return spans, low


def _kind(kinds: set[str]) -> str:
    if CAPTION in kinds and FRAME not in kinds:
        return CAPTION
    return FRAME if FRAME in kinds and CAPTION not in kinds else MIXED


def chunk_rows(video_id: str, sentences: list[tuple[str, float, float, str]], config: ChunkConfig = ChunkConfig()) -> list[tuple]:
    """Chunks of (text, start, end, kind) sentences; a short tail joins the chunk before it, overlap and all."""
    spans, low = pack([approx_tokens(s[0]) for s in sentences], config)
    drafts = []
    for a, b in spans:
        part = sentences[a:b]
        drafts.append([part[0][1], part[-1][2], " ".join(s[0] for s in part), _kind({s[3] for s in part})])
    tail = sentences[low:]
    if tail:
        text, kinds = " ".join(s[0] for s in tail), {s[3] for s in tail}
        if drafts and approx_tokens(text) < config.min_tokens:
            last = drafts[-1]
            last[1], last[2] = tail[-1][2], f"{last[2]} {text}"
            same = (last[3] == CAPTION and CAPTION in kinds and FRAME not in kinds) or (last[3] == FRAME and FRAME in kinds and CAPTION not in kinds)
            last[3] = last[3] if same else MIXED
        else:
            drafts.append([tail[0][1], tail[-1][2], text, _kind(kinds)])
    return [(f"{video_id}:{i}", video_id, i, d[0], d[1], d[2], approx_tokens(d[2]), d[3]) for i, d in enumerate(drafts)]


_COLUMNS = [c.split()[0] for c in CHUNKS.split(", ")]


def chunk(segments: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Chunks of each video's segments in (start_seconds, seg_no) order; one shuffle by video."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start_seconds", "seg_no"], kind="stable")
        parts = [(s, a, b, k) for t, a, b, k in zip(pdf["text"], pdf["start_seconds"], pdf["end_seconds"], pdf["kind"]) for s in split_sentences(t or "")]
        return pd.DataFrame(chunk_rows(pdf["video_id"].iloc[0], parts, config), columns=_COLUMNS)

    return segments.groupBy("video_id").applyInPandas(fold, CHUNKS)


def chunk_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Chunks of whole texts, a row being a video of one caption segment: no shuffle; a task holds ARROW_ROWS texts."""
    arrow_rows(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, text in zip(pdf["id"], pdf["text"]):
                rows += chunk_rows(key, [(s, 0.0, float(len(text)), CAPTION) for s in split_sentences(text)], config)
            yield pd.DataFrame(rows, columns=_COLUMNS)

    return docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInPandas(run, CHUNKS)


# ---------------------------------------------------------------- captions


def parse_vtt_text(raw: str) -> list[tuple[float, float, str]]:
    """(start, end, text) of the cues of a WebVTT file; malformed files give none."""
    cues: list[list] = []
    open_cue: list | None = None

    def close() -> None:
        if open_cue and open_cue[2]:
            text = " ".join(open_cue[2])
            if cues and cues[-1][2] == text:
                cues[-1][1] = open_cue[1]
            else:
                cues.append([open_cue[0], open_cue[1], text])

    for line in raw.removeprefix("﻿").splitlines():
        line = line.strip()
        found = _CUE.search(line)
        if found:
            close()
            t = [int(x) for x in found.groups()]
            open_cue = [t[0] * 3600 + t[1] * 60 + t[2] + t[3] / 1000, t[4] * 3600 + t[5] * 60 + t[6] + t[7] / 1000, []]
        elif not line:
            close()
            open_cue = None
        elif open_cue and line != "WEBVTT" and not line.startswith(("NOTE", "STYLE", "REGION")):
            text = re.sub(r"\s+", " ", re.sub("<[^>]*>", "", line)).strip()
            if text:
                open_cue[2].append(text)
    close()
    return [tuple(c) for c in cues]


def roll_up(cues: list[tuple[float, float, str]]) -> list[tuple[float, float, str]]:
    """Rolling captions undone: a text that repeats the kept one before it keeps only what it adds."""
    kept: list[tuple[float, float, str]] = []
    for start, end, text in cues:
        if kept and text.startswith(kept[-1][2]):
            text = text[len(kept[-1][2]) :].strip()
            if not text:
                kept[-1] = (kept[-1][0], end, kept[-1][2])
                continue
        kept.append((start, end, text))
    return kept


def parse_vtt(files: DataFrame, id_col: str = "video_id", text_col: str = "text") -> DataFrame:
    """Segments of caption files, one file a row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(key, i, a, b, t, CAPTION) for key, text in zip(pdf["id"], pdf["text"]) for i, (a, b, t) in enumerate(roll_up(parse_vtt_text(text or "")))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SEGMENTS.split(", ")])

    return files.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInPandas(run, SEGMENTS)


def rolling_dedupe(segments: DataFrame, by: list[str], order: str, text_col: str = "text") -> DataFrame:
    """roll_up for each group in order: (by, pos, text, last_order).

    Each kept text depends on the kept one before it, so a window's lag cannot
    tell it.  Groups are sorted by the shuffle and folded as they stream by: the
    state is the last kept text, whatever a group's size.
    """
    types = {f.name: f.dataType.simpleString() for f in segments.schema.fields}
    rows = segments.select(*by, F.col(order).cast("long").alias("o"), F.col(text_col).alias("t")).repartition(*by).sortWithinPartitions(*by, "o", "t")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pos, text, last, kinds = None, -1, None, None, []

        def made(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows) if rows else [[] for _ in kinds]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[*by, "pos", "text", "last_order"])

        for batch in batches:
            kinds = [*batch.schema.types[: len(by)], pa.int32(), pa.string(), pa.int64()]
            out = []
            for *own, o, t in zip(*(c.to_pylist() for c in batch.columns)):
                if own != key:
                    if text is not None:
                        out.append((*key, pos, text, last))
                    key, pos, text = own, -1, None
                t = t or ""
                tail = t[len(text) :].strip() if text is not None and t.startswith(text) else None
                if tail == "":
                    last = o
                    continue
                if text is not None:
                    out.append((*key, pos, text, last))
                pos, text, last = pos + 1, t if tail is None else tail, o
            yield made(out)
        if text is not None:
            yield made([(*key, pos, text, last)])

    return rows.mapInArrow(fold, ", ".join(f"`{c}` {types[c]}" for c in by) + ", pos int, text string, last_order long")


def merge_segments(first: DataFrame, second: DataFrame) -> DataFrame:
    """Segments of two sources in start order; at equal starts the first source leads.  seg_no is dealt anew."""
    both = first.withColumn("__src", F.lit(0)).unionByName(second.withColumn("__src", F.lit(1)))
    place = W.partitionBy("video_id").orderBy("start_seconds", "__src", "seg_no")
    return both.withColumn("seg_no", (F.row_number().over(place) - 1).cast("int")).drop("__src")


def paragraphs_to_segments(docs: DataFrame, id_col: str, paragraphs_col: str, seconds: int = 30, compat: bool = False) -> DataFrame:
    """Paragraph i as a segment from 30 i on.  compat=True leaves out those from 199 on, which two-digit minutes cannot write."""
    rows = docs.select(F.col(id_col).cast("string").alias("video_id"), F.posexplode(paragraphs_col).alias("seg_no", "text"))
    if compat:
        rows = rows.where("seg_no < 199")
    return rows.select("video_id", "seg_no", (F.col("seg_no") * float(seconds)).alias("start_seconds"), ((F.col("seg_no") + 1) * float(seconds)).alias("end_seconds"), "text", F.lit(CAPTION).alias("kind"))
