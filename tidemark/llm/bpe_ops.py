"""Byte-level BPE as operators on tables: ids and offsets of every text, and back."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import CHUNK_BYTES, texts_in_chunks
from tidemark.llm.bpe import vocabulary


def lists(values: np.ndarray, starts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values, kind))


def bpe_encode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``keep`` columns of ``docs``, ``ids`` and ``offsets``: the tokens of the whole text and where each begins in its UTF-8 bytes.

    ``path`` is a rank file or a tokenizer file of byte-level BPE.  Null and
    empty texts have no tokens.  Rows are independent: ties, repeated rows and
    null keys pass, an empty table stays empty, and a very long text is a
    batch of its own.  A kept column named ids or offsets gives an error.
    """
    if {"ids", "offsets"} & set(keep):
        raise ValueError("kept columns can't be named ids or offsets")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for part, texts in texts_in_chunks(batches, "_text", chunk_bytes):
            ids, starts = v.encode(texts)
            lengths = v.lengths[ids]
            at = np.cumsum(lengths) - lengths
            at -= np.repeat(at[np.minimum(starts[:-1], max(0, len(at) - 1))] if len(at) else np.zeros(len(texts), np.int64), np.diff(starts))
            columns = [part.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, lists(ids.astype(np.int32), starts, pa.int32()), lists(at, starts, pa.int32())], names=[*keep, "ids", "offsets"])

    held = docs.select(*keep, F.col(text).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema[: len(keep)])
    return held.mapInArrow(encode, f"{kinds}, ids array<int>, offsets array<int>")


def bpe_decode(tokens: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``raw``, the bytes that ``ids`` stand for; a null list gives no bytes."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            column = batch["ids"]
            ids = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            counts = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            raw, at = v.decode(ids)
            ends = at[np.append(0, np.cumsum(counts))]
            out = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in keep), out], names=[*keep, "raw"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.select(*keep).schema)
    return tokens.select(*keep, "ids").mapInArrow(decode, f"{kinds}, raw binary")


def bpe_round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256: digests of the ids of every text and of the bytes they decode to.

    Ids live as long as their chunk of texts: encoding and decoding are one
    stage, so a task has one worker with one vocabulary.  Nulls, empty and very
    long texts, ties and repeated rows are as in :func:`bpe_encode`.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for part, texts in texts_in_chunks(batches, "_text", chunk_bytes):
            flat, starts = v.encode(texts)
            raw, at = v.decode(flat)
            bytes_at, ends = at[starts].tolist(), starts.tolist()
            raw, flat = memoryview(raw), memoryview(np.ascontiguousarray(flat, "<u4")).cast("B")
            ids = [hashlib.sha256(flat[4 * a : 4 * b]).hexdigest() for a, b in zip(ends[:-1], ends[1:])]
            back = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(bytes_at[:-1], bytes_at[1:])]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(starts), pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    held = docs.select(F.col(key), F.col(text).alias("_text"))
    return held.mapInArrow(digests, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
