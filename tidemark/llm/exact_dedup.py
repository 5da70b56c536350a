"""Exact deduplication by a two-pass Bloom filter.

Pass one sets, for every row, two bits of a filter of bounded size, in the task
that reads it, and merges the tasks' bitmaps into the bits that were set twice
or more.  Pass two tests every row: only rows
whose two bits are both such bits can have an equal partner, so only those are
shuffled by digest; the others pass straight through.  A filter that is too
small for the corpus flags more rows and costs more shuffling; it never
changes the result.  What moves is a digest and an id, never a text.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import written

#: Bits of the filter at most: 32 MB, which is what a task holds at most.
MAX_BITS = 1 << 28
MIN_BITS = 1 << 16
BITS_PER_ROW = 16


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _bits(digest: Column, n_bits: int) -> list[Column]:
    """Two bit numbers of a digest, from different bytes of it."""
    part = lambda at: F.conv(F.hex(F.substring(digest, at, 7)), 16, 10).cast("long")
    return [F.pmod(part(at), F.lit(n_bits)) for at in (1, 9)]


#: Bytes of a piece of the filter.
PIECE = 4096


def _set_bits(n_bits: int):
    """From rows (bit0, bit1) the pieces of a task's bitmaps: the bits that its rows have set, and those that were set twice or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = -(-n_bits // (8 * PIECE)) * PIECE
        once, twice = np.zeros(size, np.uint8), np.zeros(size, np.uint8)
        for batch in batches:
            bit, count = np.unique(np.concatenate([batch[c].to_numpy() for c in ("bit0", "bit1")]), return_counts=True)
            byte, mask = bit >> 3, (1 << (bit & 7)).astype(np.uint8)
            again = (count > 1) | (once[byte] & mask > 0)
            np.bitwise_or.at(twice, byte[again], mask[again])
            np.bitwise_or.at(once, byte, mask)
        held = np.flatnonzero(once.reshape(-1, PIECE).any(1))
        for at in range(0, len(held), 256):
            some = held[at : at + 256]
            pieces = [pa.array([x[k * PIECE : (k + 1) * PIECE].tobytes() for k in some.tolist()], pa.binary()) for x in (once, twice)]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), *pieces], names=["bucket", "once", "twice"])

    return run


def _merged(pieces: pa.Table) -> pa.Table:
    """The bits of a piece that are set twice in a task, or in two tasks."""
    once, twice = np.zeros(PIECE, np.uint8), np.zeros(PIECE, np.uint8)
    for a, b in zip(pieces["once"].to_pylist(), pieces["twice"].to_pylist()):
        a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
        twice |= b | once & a
        once |= a
    return pa.table({"bucket": pieces["bucket"].slice(0, 1), "bitmap": pa.array([twice.tobytes()], pa.binary())})


def repeated_bits(keyed: DataFrame, n_bits: int) -> DataFrame:
    """(bucket, bitmap): the bits that two rows or more have set, 4 KB a row.

    Each task sets the bits of its own rows; only its bitmaps move, to be merged piece by piece.
    """
    bits = keyed.select(*[b.alias(f"bit{i}") for i, b in enumerate(_bits(F.col("digest"), n_bits))])
    made = bits.mapInArrow(_set_bits(n_bits), "bucket bigint, once binary, twice binary")
    return made.groupBy("bucket").applyInArrow(_merged, "bucket bigint, bitmap binary")


def _piece(bit: Column) -> Column:
    """The piece of the filter that a bit is in."""
    return F.floor(bit / (8 * PIECE)).cast("bigint")


def _is_set(bitmap: Column, bit: Column) -> Column:
    position = bit % (8 * PIECE)
    byte = F.conv(F.hex(F.substring(bitmap, (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.pmod((byte / F.pow(F.lit(2), position % 8)).cast("int"), F.lit(2)) == 1, F.lit(False))


def possibly_repeated(keyed: DataFrame, n_bits: int) -> DataFrame:
    """``keyed`` and ``maybe``: whether another row may have the same digest.

    The filter has ``n_bits`` / 8 bytes, at most 32 MB, so it can be broadcast.
    """
    bitmaps = written(repeated_bits(keyed, n_bits), "bitmaps")
    tested = keyed
    for i, bit in enumerate(_bits(F.col("digest"), n_bits)):
        side = F.broadcast(bitmaps.select(F.col("bucket").alias(f"bucket{i}"), F.col("bitmap").alias(f"bitmap{i}")))
        tested = tested.withColumn(f"bit{i}", bit).join(side, _piece(F.col(f"bit{i}")) == F.col(f"bucket{i}"), "left")
    maybe = _is_set(F.col("bitmap0"), F.col("bit0")) & _is_set(F.col("bitmap1"), F.col("bit1"))
    return tested.select(*keyed.columns, maybe.alias("maybe"))


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: its group of equal texts and the row that stays.

    Texts are equal when identical after lower-casing A-Z; a null text counts
    as empty.  Of equal texts the largest ``key`` stays; a null key is smaller
    than any other.  Rows that share that key all stay; if every key of a
    group is null, ``keep_id`` is null and all its rows stay.  An empty table
    gives an empty result; other columns are not read.

    Returns key, keep_id, group_size, kept, text_sha256.
    """
    digest = F.unhex(F.sha2(ascii_lower(F.coalesce(F.col(text), F.lit(""))), 256))
    keyed = written(docs.select(F.col(key).alias("id"), digest.alias("digest")), "digests")
    n_bits = min(max_bits, max(MIN_BITS, 1 << (BITS_PER_ROW * keyed.count()).bit_length()))
    tested = written(possibly_repeated(keyed, n_bits), "tested")
    maybe = tested.filter("maybe").select("id", "digest")
    groups = written(maybe.groupBy("digest").agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "groups")
    grouped = maybe.join(groups, "digest", "left").select("id", "digest", F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep")).alias("keep"), F.coalesce("n", F.lit(1)).alias("n"))
    alone = tested.filter("not maybe").select("id", "digest", F.col("id").alias("keep"), F.lit(1).cast("long").alias("n"))
    return grouped.unionByName(alone).select(
        F.col("id").alias(key),
        F.col("keep").alias("keep_id"),
        F.col("n").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
