"""Token ids in length-delimited binary shards with a separate offset index.

Shard file: records of
    u64 n | u32 mask(crc32(n)) | n bytes | u32 mask(crc32(bytes))
(little endian), the framing of record files with masked checksums; the
checksum is CRC-32, mask(c) = rotate right by 15, plus 0xa282ead8.  The bytes
are: i64 document id, u8 flags (1: the id is null, 2: ids are 32 bits wide
instead of 16), then the token ids.

Index file, beside each shard: for each record u64 offset, u64 document's first
token counted in the shard, u32 tokens: 20 bytes, so that a reader can seek to
any record, in any order.

Writing is safe against lost executors and repeated tasks: every attempt writes
files of its own name, and only those that the manifest lists belong to the
data set.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorekeep.llm.common import arrow_rows, partitions, settle, shared_path

#: Fixed values of the record framing.
MASK_DELTA, MASK_TURN = 0xA282EAD8, 15
INDEX_ENTRY = np.dtype([("offset", "<u8"), ("start", "<u8"), ("n", "<u4")])
MEMO_WORDS = 350_000


def masked_crc(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> MASK_TURN | c << (32 - MASK_TURN)) + MASK_DELTA) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    """One record; ids are unsigned 32-bit."""
    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
    body = struct.pack("<qB", doc_id or 0, (doc_id is None) | wide << 1) + ids.astype("<u4" if wide else "<u2").tobytes()
    head = struct.pack("<Q", len(body))
    return b"".join((head, struct.pack("<I", masked_crc(head)), body, struct.pack("<I", masked_crc(body))))


def unframe(read: Callable[[int], bytes]) -> Iterator[tuple[int | None, np.ndarray]]:
    """Records of a stream; raises ValueError on a bad length, checksum or end."""
    while head := read(12):
        if len(head) < 12 or masked_crc(head[:8]) != struct.unpack("<I", head[8:])[0]:
            raise ValueError("broken record length")
        (n,) = struct.unpack("<Q", head[:8])
        body = read(n + 4)
        if len(body) < n + 4 or masked_crc(body[:n]) != struct.unpack("<I", body[n:])[0]:
            raise ValueError("broken record")
        doc_id, flags = struct.unpack_from("<qB", body)
        yield None if flags & 1 else doc_id, np.frombuffer(body, "<u4" if flags & 2 else "<u2", offset=9, count=(n - 9) // (4 if flags & 2 else 2)).astype("<u4")


class _Generations(dict):
    """A memo of two generations: when the young one is full it becomes the old one, so hot keys stay and size is bounded."""

    def __init__(self, most: int):
        self.most, self.old = most, {}

    def put(self, key: str, value: bytes) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value

    def find(self, key: str) -> bytes | None:
        """The value, taken over from the old generation if it is only there."""
        value = self.get(key)
        if value is None:
            value = self.old.get(key)
            if value is not None:
                self.put(key, value)
        return value


class WordMemoEncoder:
    """A tokenizer whose pre-tokenizer drops white space: words are encoded apart and remembered.

    Texts are cut only at spaces and line ends, where no token and no
    normalisation can reach across.  Of plain words, Latin letters before
    punctuation, both parts are encoded apart as the pre-tokenizer does, the
    letters in lower case.  The library encodes what is not in the memo.
    """

    LATIN, MARKS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch, ".,;:!?|%&$#*"

    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        for a, b in (("ab", "cd"), ("x1", "%é"), ("'s", "'t")):
            if self._library(f"{a} {b}\n{a}") != self._library(a) + self._library(b) + self._library(a):
                raise ValueError("this tokenizer does not drop white space")
        if self._library("Àé,.") != self._library("àé") + self._library(",."):
            raise ValueError("this tokenizer does not lower case or part letters from punctuation")
        self.words, self.marks = _Generations(memo_words), _Generations(10_000)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _library(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _encode_each(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_stems(self, stems: list[str]) -> list[bytes]:
        """Runs of letters, many in a call: the ends of words tell them apart."""
        out = []
        for at in range(0, len(stems), 1000):
            some = stems[at : at + 1000]
            ids = np.array(self._library(" ".join(some)), "<u4")
            cuts = ((np.nonzero(self.ends[ids])[0] + 1) * 4).tolist()
            if len(cuts) == len(some) and cuts[-1] == 4 * len(ids):
                raw = ids.tobytes()
                out += [raw[i:j] for i, j in zip([0, *cuts], cuts)]
            else:
                out += self._encode_each(some)
        return out

    def _learn(self, missing: set[str]) -> dict[str, bytes]:
        found: dict[str, bytes] = {}
        plain, odd, stems = [], [], {}
        young, old, latin, marks = self.words.get, self.words.old.get, self.LATIN, self.MARKS
        for w in missing:
            value = old(w)
            if value is not None:
                found[w] = value
                continue
            stem = w if w.isalpha() else w.rstrip(marks)
            if stem.isalpha() and (stem.isascii() or latin(stem)):
                low = stem.lower()
                plain.append((w, low, w[len(stem) :]))
                if low not in stems:
                    stems[low] = young(low) or old(low)
            elif w:
                odd.append(w)
            else:
                found[w] = b""
        new = [s for s, v in stems.items() if v is None]
        stems.update(zip(new, self._encode_stems(new)))
        for w, low, mark in plain:
            if mark:
                tail = self.marks.find(mark)
                if tail is None:
                    tail = self._encode_each([mark])[0]
                    self.marks.put(mark, tail)
                found[w] = stems[low] + tail
                if len(low) <= 64:
                    self.words.put(low, stems[low])
            else:
                found[w] = stems[low]
        found.update(zip(odd, self._encode_each(odd) if odd else []))
        for w, v in found.items():
            if len(w) <= 64:
                self.words.put(w, v)
        return found

    def encode_batch(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        Words that are new to the memo are gathered over some texts, so that the
        library is asked seldom.
        """
        at = 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and (end == at or (end < at + 32 and size < 200_000)):
                size += len(texts[end])
                end += 1
            cut = [t.replace("\n", " ").split(" ") for t in texts[at:end]]
            parts = [list(map(self.words.get, words)) for words in cut]
            missing = {w for words, own in zip(cut, parts) if None in own for w, p in zip(words, own) if p is None}
            found = self._learn(missing) if missing else {}
            for words, own in zip(cut, parts):
                yield b"".join([found[w] if p is None else p for w, p in zip(words, own)] if found and None in own else own)
            at = end


@lru_cache(maxsize=4)
def encoder(path: str) -> WordMemoEncoder:
    return WordMemoEncoder(path)


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write_shards(docs: DataFrame, tokenizer_path: str, out: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """Encodes every whole text and writes the shards under ``out`` in ascending id order.

    Returns the manifest, one row per shard: shard, path, n_docs, n_tokens,
    n_bytes; the index lies at path + ".idx".  Null texts count as empty (the
    end id alone), null ids come first, equal ids follow each other in the order of
    their texts' hashes, other columns are ignored; an empty table gives no
    shard.  Rows are dealt by ranges of the id, and each task streams one shard,
    so memory is one Arrow batch.
    """
    arrow_rows(docs.sparkSession)
    n = shards or partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # The hash parts rows that share an id, or have none, among shards.
    rows = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(n, "id", "h").sortWithinPartitions("id", "h").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(out)
        path = f"{root}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.rec"
        enc, tail = encoder(tokenizer_path), np.array([] if end_id is None else [end_id], "<u4").tobytes()
        stream, index, at, tokens = None, [], 0, 0
        for batch in batches:
            if stream is None and batch.num_rows:
                store.create_dir(root, recursive=True)
                stream = store.open_output_stream(path)
            for doc_id, raw in zip(batch.column(0).to_pylist(), enc.encode_batch(batch.column(1).to_pylist())):
                ids = np.frombuffer(raw + tail, "<u4")
                record = frame(doc_id, ids)
                stream.write(record)
                index.append((at, tokens, len(ids)))
                at += len(record)
                tokens += len(ids)
        if stream is None:
            return
        stream.close()
        with store.open_output_stream(f"{path}.idx") as f:
            f.write(np.array(index, INDEX_ENTRY).tobytes())
        yield pa.RecordBatch.from_pydict({"shard": [TaskContext.get().partitionId()], "path": [path], "n_docs": [len(index)], "n_tokens": [tokens], "n_bytes": [at]}, schema=pa.schema([("shard", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())]))

    return settle(rows.mapInArrow(run, "shard long, path string, n_docs long, n_tokens long, n_bytes long"), "manifest")


def read_shards(manifest: DataFrame, out: str, payload: bool = True) -> DataFrame:
    """Reads the shards of a manifest back, checking frames, checksums and index.

    Returns doc_id, start (tokens of all documents before it), n_tokens,
    ids_crc32 and, with payload, ids (binary, little-endian unsigned 32-bit).
    """
    # The manifest has a row per file; its running sum is the one ordered pass.
    base = F.coalesce(F.sum("n_tokens").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    jobs = manifest.select("shard", "path", base.cast("long").alias("base")).repartition(partitions(manifest.sparkSession), "shard")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = _store(out)[0]
        for batch in batches:
            for path, base in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                with store.open_input_stream(f"{path}.idx") as f:
                    index = np.frombuffer(f.read(), INDEX_ENTRY)
                rows: list[tuple] = []
                with store.open_input_stream(path, buffer_size=1 << 20) as f:
                    for k, (doc_id, ids) in enumerate(unframe(f.read)):
                        if int(index[k]["n"]) != len(ids):
                            raise ValueError("index and shard differ")
                        raw = ids.tobytes()
                        rows.append((doc_id, base + int(index[k]["start"]), len(ids), zlib.crc32(raw)) + ((raw,) if payload else ()))
                        if len(rows) >= 500:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                            rows = []
                if k + 1 != len(index):
                    raise ValueError("index and shard differ")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return jobs.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * payload)


def read_records(out: str, shard_path: str, which: list[int]) -> list[tuple[int | None, np.ndarray]]:
    """Records of one shard in the order asked for, by the index alone: for shuffled reads."""
    store = _store(out)[0]
    with store.open_input_stream(f"{shard_path}.idx") as f:
        index = np.frombuffer(f.read(), INDEX_ENTRY)
    with store.open_input_file(shard_path) as f:
        found = []
        for k in which:
            f.seek(int(index[k]["offset"]))
            found.append(next(unframe(f.read)))
    return found


def write_and_read(docs: DataFrame, tokenizer_path: str, end_id: int | None = 1, payload: bool = False) -> DataFrame:
    """Round trip through shards in the shared folder."""
    out = shared_path(docs.sparkSession, "shards")
    return read_shards(write_shards(docs, tokenizer_path, out, end_id), out, payload)
