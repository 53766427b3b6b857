"""Readers and writers: playlists, feeds, pages, folders, push batches."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorekeep.functions.order import numbered
from lorekeep.functions.text import paragraphs

INFO = "id string, title string, uploader string, channel string, channel_id string, duration double, upload_date string, ext string, webpage_url string, description string, view_count long, subtitles map<string,string>, automatic_captions map<string,string>"
FLAT = "id string, url string, webpage_url string, title string, channel string, channel_id string, view_count long, duration double, upload_date string"
IMPORTABLE = ("pdf", "mp4", "mp3", "m4a", "wav", "ogg", "txt", "md")


def local_kinds(spark: SparkSession, sources: list[str]) -> DataFrame:
    """(source, local): "directory" or "file" for each source that is an existing path, else null.

    Sources are what a user names on a command line: a short list, looked up by the driver.
    """
    rows = []
    for source in sources:
        kind = None
        if re.match(r"(?i)https?:", source):  # never asked over a network
            rows.append((source, None))
            continue
        try:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
            store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            if store.exists(path):
                kind = "directory" if store.getFileStatus(path).isDirectory() else "file"
        except Exception:  # no path of any known file system
            kind = None
        rows.append((source, kind))
    return spark.createDataFrame(rows, "source string, local string")


def contained(root: str, path: str) -> str:
    """The path with links and dots resolved; an error if it does not lie under root."""
    inside, top = os.path.realpath(path), os.path.realpath(root)
    if inside != top and not inside.startswith(top.rstrip(os.sep) + os.sep):
        raise ValueError(f"{path} does not lie under {root}")
    return inside


def info_json(spark: SparkSession, path: str) -> DataFrame:
    """Video descriptions in files; those without an id are an error at use."""
    return _with_id(spark.read.schema(INFO).json(path, multiLine=True))


def parse_info(rows: DataFrame, text_col: str = "value") -> DataFrame:
    """Video descriptions in a text column; broken ones and those without an id are an error at use."""
    return _with_id(rows.select(F.from_json(F.col(text_col), INFO, {"mode": "FAILFAST"}).alias("e")).select("e.*"))


def _with_id(rows: DataFrame) -> DataFrame:
    return rows.withColumn("id", F.when(F.col("id").isNotNull(), F.col("id")).otherwise(F.raise_error(F.lit("video description without id"))))


def parse_playlist(lines: DataFrame, text_col: str = "value", limit: int | None = None) -> DataFrame:
    """(pos, url) of NDJSON entries: url, else webpage_url, else id; malformed lines are skipped."""
    rows = lines.select(F.monotonically_increasing_id().alias("pos"), F.from_json(F.col(text_col), FLAT, {"mode": "PERMISSIVE"}).alias("e"))
    urls = rows.select("pos", F.coalesce("e.url", "e.webpage_url", "e.id").alias("url")).where("url is not null")
    return urls.orderBy("pos").limit(limit) if limit is not None else urls


def parse_candidates(lines: DataFrame, text_col: str = "value") -> DataFrame:
    """Candidates of NDJSON entries; entries without an id are skipped, the title defaults to the id."""
    e = lines.select(F.from_json(F.col(text_col), FLAT, {"mode": "PERMISSIVE"}).alias("e")).select("e.*").where("id is not null")
    return e.select(F.col("id").alias("video_id"), F.coalesce("title", "id").alias("title"), "channel", "channel_id", "view_count", F.col("duration").alias("duration_seconds"), "upload_date", F.lit(None).cast("boolean").alias("has_captions"))


def has_en_captions(subtitles: Column, automatic: Column) -> Column:
    en = lambda m: F.coalesce(F.exists(F.map_keys(m), lambda k: k.startswith("en")), F.lit(False))
    return en(subtitles) | en(automatic)


def caption_files(files: DataFrame, path_col: str = "path") -> DataFrame:
    """Per folder the caption file to read: *.en.vtt before any other .vtt, ties by name."""
    own = files.where(F.col(path_col).endswith(".vtt")).withColumn("folder", F.regexp_extract(path_col, r"^(.*)/[^/]*$", 1))
    order = F.struct((~F.col(path_col).endswith(".en.vtt")).alias("late"), F.col(path_col).alias("path"))
    return own.groupBy("folder").agg(F.min(order)["path"].alias("path"))


def vtt_files(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, text) of caption files, the id being the file's name up to its first dot."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]*)", 1).alias("video_id"), F.col("value").alias("text"))


class _Text(HTMLParser):
    """Text nodes under wanted elements, once for each match that holds them; p as a fallback."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.main: list[str] = []
        self.loose: list[str] = []
        self.verbatim = False

    def handle_starttag(self, tag, attrs):
        if tag == "p" and "p" in self.open:
            self._close("p")
        if tag not in self.VOID:
            self.open.append(tag)

    def _close(self, tag):
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_endtag(self, tag):
        self._close(tag)

    def handle_data(self, data):
        if self.verbatim and self.cdata_elem:  # references are not read in scripts and styles
            data = data.replace("&amp;", "&")
        text = data.strip()
        if text:
            self.main += [text] * sum(t in ("article", "main") for t in self.open)
            if "p" in self.open:
                self.loose.append(text)


_AMPERSAND = re.compile(r"&(?!#[0-9]+;|#[xX][0-9a-fA-F]+;)([A-Za-z][A-Za-z0-9]*;)?")


def _bare_kept(html: str) -> str:
    """Ampersands that begin no known reference with its semicolon, written as references."""
    return _AMPERSAND.sub(lambda m: m[0] if m[1] in html5 else f"&amp;{m[1] or ''}", html)


def html_main_text(html: str | None, bare: bool = True) -> str:
    """The page's text.  Browsers also read some references without their semicolon (``&amp``); bare=False leaves those as they stand."""
    parser = _Text()
    parser.verbatim = not bare
    parser.feed((html or "") if bare else _bare_kept(html or ""))
    parser.close()
    return "\n\n".join(parser.main or parser.loose)


def html_text(col: Column, bare: bool = True) -> Column:
    """Text under article and main (else p), text nodes parted by blank lines."""

    @F.pandas_udf("string")
    def parsed(pages: pd.Series) -> pd.Series:
        return pages.map(lambda html: html_main_text(html, bare))

    return parsed(col)


def page_title(url: Column) -> Column:
    """Last path segment, else the host."""
    last = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/(?:[^?#]*/)?([^/?#]+)/?(?:[?#].*)?$", 1)
    return F.when(last != "", last).otherwise(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))


def pages_to_segments(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", compat: bool = False, bare: bool = True) -> DataFrame:
    from lorekeep.operators.chunking import paragraphs_to_segments

    rows = pages.select(F.col(id_col), paragraphs(html_text(F.col(html_col), bare)).alias("paragraphs"))
    return paragraphs_to_segments(rows, id_col, "paragraphs", compat=compat)


def podcast_feed(xml: Column) -> Column:
    """struct(title, audio_url): the channel's title and the first enclosure of an audio type."""
    return F.struct(F.xpath_string(xml, F.lit("/rss/channel/title")).alias("title"), F.xpath_string(xml, F.lit("(/rss/channel/item/enclosure[contains(@type,'audio')])[1]/@url")).alias("audio_url"))


def import_dir(spark: SparkSession, path: str, extract=None, known: DataFrame | None = None, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """import_files of a folder."""
    return import_files(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path), extract, known, force)


def import_files(files: DataFrame, extract=None, known: DataFrame | None = None, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(files, counts): the importable ones of (path, content) in name order with ok and error; failures are counted, not fatal.

    ``extract(path, bytes) -> str`` gives a file's text; without it only .txt and
    .md succeed.  Files that ``known`` (path) has are skipped unless forced.
    """
    if known is not None and not force:
        files = files.join(known.select("path"), "path", "left_anti")
    files = files.where(F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).isin(*IMPORTABLE)).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for p, content in zip(pdf["path"], pdf["content"]):
                try:
                    if extract is not None:
                        text = extract(p, content)
                    elif p.lower().endswith((".txt", ".md")):
                        text = bytes(content).decode()
                    else:
                        raise ValueError("no extractor for this kind of file")
                    out.append((p, text, True, None))
                except Exception as e:
                    out.append((p, None, False, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "text", "ok", "error"])

    rows = files.mapInPandas(run, "path string, text string, ok boolean, error string").orderBy("path")
    return rows, rows.groupBy("ok").agg(F.count("*").alias("n"))


def estimated_frames(duration: Column, fps: float = 0.1, most: int = 60) -> Column:
    """struct(fps, frames): the rate falls where it would give more than ``most`` frames."""
    wanted = F.ceil(duration * fps)
    rate = F.when(wanted > most, most / duration).otherwise(F.lit(fps))
    return F.struct(rate.alias("fps"), F.least(F.lit(most), wanted).cast("long").alias("frames"))


def frame_times(videos: DataFrame, id_col: str = "video_id", duration_col: str = "duration", fps: float = 0.1, most: int = 60) -> DataFrame:
    """(id, idx, ts): the frames of each video, numbered from 1, at (idx - 1) / rate seconds."""
    rate = videos.select(F.col(id_col), estimated_frames(F.col(duration_col), fps, most).alias("e")).where("e.frames > 0")
    frames = rate.select(id_col, "e.fps", F.explode(F.sequence(F.lit(1).cast("long"), F.col("e.frames"))).alias("idx"))
    return frames.select(id_col, "idx", ((F.col("idx") - 1) / F.col("fps")).alias("ts"))


def push_batch_size(dim: int, target_bytes: int = 50_000) -> int:
    return max(1, target_bytes // (dim * 14 + 32))


def push_batches(vectors: DataFrame, dim: int, order: str, by: str | None = None, target_bytes: int = 50_000) -> DataFrame:
    """vectors with batch_no: consecutive rows (of each group) within a request's size."""
    if not by:
        return numbered(vectors, [order], "__n").withColumn("batch_no", F.floor(F.col("__n") / push_batch_size(dim, target_bytes))).drop("__n")
    place = W.partitionBy(by).orderBy(order)
    return vectors.withColumn("batch_no", F.floor((F.row_number().over(place) - 1) / push_batch_size(dim, target_bytes)))
