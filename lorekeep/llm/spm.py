"""SentencePiece encoding and decoding of a text column (see prefix_bpe)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import arrow_rows


def encode_texts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", payload: bool = True) -> DataFrame:
    """Encodes every whole text with begin and end ids and decodes the ids again.

    Returns id_col, ids (binary, little-endian unsigned 32-bit), decoded
    (string), n_tokens, ids_sha256 and decoded_sha256; with payload=False
    without ids and decoded.  A row in gives a row out: repeated rows stay, a
    null text counts as empty (begin and end only), a null id stays null, other
    columns are ignored.  One pass, no shuffle; memory is one Arrow batch plus
    the encoder's bounded memo.
    """
    arrow_rows(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, " + "ids binary, decoded string, " * payload + "n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lorekeep.llm.prefix_bpe import tokenizer

        bpe = tokenizer(model_path)
        first, last = np.array([bpe.bos], "<u4").tobytes(), np.array([bpe.eos], "<u4").tobytes()
        for batch in batches:
            ids, decoded, counts, id_sha, text_sha = [], [], [], [], []
            for text in batch.column(1):
                raw = first + bpe.encode_bytes(text.as_py() or "") + last
                back = bpe.decode_bytes(np.frombuffer(raw, "<u4"))
                counts.append(len(raw) // 4)
                id_sha.append(hashlib.sha256(raw).hexdigest())
                text_sha.append(hashlib.sha256(back).hexdigest())
                if payload:
                    ids.append(raw)
                    decoded.append(back.decode())
            columns = [batch.column(0)] + ([pa.array(ids, pa.binary()), pa.array(decoded, pa.string())] if payload else [])
            columns += [pa.array(counts, pa.int64()), pa.array(id_sha, pa.string()), pa.array(text_sha, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, *["ids", "decoded"] * payload, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def decode_ids(rows: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """Adds the text of a binary column of little-endian unsigned 32-bit ids; null ids give null."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != out_col)
    names = [f.name for f in rows.schema if f.name != out_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lorekeep.llm.prefix_bpe import tokenizer

        bpe = tokenizer(model_path)
        for batch in batches:
            texts = [None if v is None else bpe.decode_bytes(np.frombuffer(v, "<u4")).decode() for v in batch.column(names.index(ids_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, out_col])

    return rows.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(run, f"{kinds}, `{out_col}` string")
