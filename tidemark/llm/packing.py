"""Best-fit packing in bulk-synchronous rounds.

Each round sorts the items that have no place by size and the open sequences by
gap, both by range over the cluster.  Every partition sums up its runs of equal
values; a sweep over these sums in ascending order matches each gap with the
largest items below it that no smaller gap has taken.  The sweep is made range
by range of values, each in a task of its own; what a range leaves, gaps without
an item and items without a gap, goes on to a sweep of ``FAN`` ranges together,
until one is left.  An item of a gap's own range is larger than any below it, so
this matches just what a sweep over all would.  Equal items are told apart, and
conflicts resolved, by rank: the k-th item of a run goes to the k-th gap of the
run it was matched with.  Then gaps shrink, and the next round follows.  Where
no item fits a gap, the largest items open new sequences, as many as the items
left must need.  There are at most as many runs as partitions and sizes
together; the driver sees totals, and the runs of one size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import texts_in_chunks
from tidemark.llm.bpe import vocabulary
from tidemark.llm.scratch import written

CAPACITY = 1024
END_ID = 2
#: Ranges of values that a sweep begins with, and how many of them are swept together after each step.
RANGES, FAN = 64, 8

#: A run of equal values: the value, the place of its first row, rows.
Run = tuple[int, int, int]


def token_pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The pieces of every document: key, piece, start, length, ids_crc32 and, if asked for, ids.

    A document's ids are those of its whole text (null: empty) and ``end_id``.
    One of more than ``capacity`` ids is cut into pieces of that length, the
    first of which may be shorter.  Rows are independent of each other.
    """
    held = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for part, texts in texts_in_chunks(batches):
            flat, ends = v.encode(texts)
            flat = np.insert(flat, ends[1:], end_id).astype("<u4")
            total = np.diff(ends) + 1
            pieces = -(-total // capacity)
            owner = np.repeat(np.arange(len(texts)), pieces)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first = total - (pieces - 1) * capacity
            length = np.where(piece == 0, first[owner], capacity)
            start = np.where(piece == 0, 0, first[owner] + (piece - 1) * capacity)
            at = np.cumsum(length) - length
            raw = memoryview(flat).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist())]
            columns = [part["key"].take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(flat)), pa.int32()), pa.array(flat.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names=["key", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    kinds = f"key {held.schema['key'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return held.mapInArrow(cut, kinds).withColumnRenamed("key", key)


def _sorted(table: DataFrame, value: str, name: str) -> tuple[DataFrame, DataFrame]:
    """``table`` sorted by ``value`` over the cluster, each row's place in ``at``, and its runs (value, at, n)."""
    held = written(table.repartitionByRange(value, name).sortWithinPartitions(value, name).withColumn("at", F.monotonically_increasing_id()), "sorted")
    runs = held.groupBy(F.shiftright("at", 33), F.col(value).alias("value")).agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("n"))
    return held, runs.select("value", "at", "n")


def sweep_range(items: list[Run], gaps: list[Run]) -> tuple[list[tuple[int, int, int, int, int, int, int]], list[Run], list[Run]]:
    """(size, first item, items, gap, first gap, gaps, items a gap), and the items and gaps that are left: gaps in ascending order take the largest items that fit.

    A gap takes as many items of one size as it has room for.
    """
    found, open_gaps, waiting, k = [], [], [], 0
    for gap, first, left in gaps:
        while k < len(items) and items[k][0] <= gap:
            waiting.append(list(items[k]))
            k += 1
        while left and waiting:
            size, at, count = waiting[-1]
            slots = gap // size
            use = min(left, -(-count // slots))
            taken = min(count, use * slots)
            found.append((size, at + count - taken, taken, gap, first, use, slots))
            first, left = first + use, left - use
            waiting[-1][2] -= taken
            if not waiting[-1][2]:
                waiting.pop()
        if left:
            open_gaps.append((gap, first, left))
    return found, [*map(tuple, waiting), *items[k:]], open_gaps


def sweep(items: list[Run], gaps: list[Run]) -> list[tuple[int, int, int, int, int, int, int]]:
    """The matches of a sweep over all items and gaps as one range."""
    return sweep_range(items, gaps)[0]


#: Rows of a sweep: runs of items (kind 0) and of gaps (1), and matches (2), whose range is negative, as nothing more is done to them.
ITEM, GAP, MATCH = 0, 1, 2
SWEPT = "range bigint, kind int, value bigint, at bigint, n bigint, gap bigint, gap_at bigint, gaps bigint, slots bigint"


def _sweep_group(rows: pd.DataFrame) -> pd.DataFrame:
    here = int(rows["range"].iloc[0])
    if here < 0:
        return rows
    items, gaps = (list(rows.loc[rows["kind"] == kind, ["value", "at", "n"]].sort_values(["value", "at"]).itertuples(index=False, name=None)) for kind in (ITEM, GAP))
    found, items, gaps = sweep_range(items, gaps)
    out = [(-1 - here, MATCH, *match) for match in found]
    out += [(here // FAN, kind, *run, 0, 0, 0, 0) for kind, runs in ((ITEM, items), (GAP, gaps)) for run in runs]
    return pd.DataFrame(out, columns=rows.columns)


def swept(items: DataFrame, gaps: DataFrame, capacity: int) -> DataFrame:
    """The matches of :func:`sweep` for runs (value, at, n) of items and of gaps, whose values are at most ``capacity``."""
    none = [F.lit(0).cast("bigint").alias(c) for c in ("gap", "gap_at", "gaps", "slots")]
    of = F.floor(F.col("value") * RANGES / (capacity + 1)).cast("bigint").alias("range")
    rows = None
    for kind, runs in ((ITEM, items), (GAP, gaps)):
        these = runs.select(of, F.lit(kind).alias("kind"), "value", "at", "n", *none)
        rows = these if rows is None else rows.unionByName(these)
    left = RANGES
    while True:
        rows = rows.groupBy("range").applyInPandas(_sweep_group, SWEPT)
        if left == 1:
            break
        left = -(-left // FAN)
    return rows.filter(F.col("kind") == MATCH).select(F.col("value").alias("size"), F.col("at").alias("item_at"), F.col("n").alias("items"), "gap", "gap_at", "gaps", "slots")


def openers(runs: DataFrame, over: int, capacity: int) -> Column:
    """Which rows (size, at) open sequences: all that are over half, or else as many of the largest as all need.

    The driver sees one total a size, and the runs of the size that is cut.
    """
    totals = sorted(((r["value"], r["n"]) for r in runs.groupBy("value").agg(F.sum("n").alias("n")).collect()), reverse=True)
    if totals[0][0] > over:
        return F.col("size") > over
    need = -(-sum(size * n for size, n in totals) // capacity)
    for size, n in totals:  # noqa: B007
        if need <= n:
            break
        need -= n
    for at, n in sorted(((r["at"], r["n"]) for r in runs.filter(F.col("value") == size).collect()), reverse=True):  # noqa: B007
        if need <= n:
            break
        need -= n
    return (F.col("size") > size) | ((F.col("size") == size) & (F.col("at") >= at + n - need))


def _within(table: DataFrame, plan: DataFrame, value: str, name: str, n: str, how: str) -> DataFrame:
    """``table`` with the row of ``plan`` in whose interval it is; a plan has at most three rows a run, so it can be broadcast."""
    inside = (F.col(value) == F.col(f"m_{value}")) & (F.col("at") >= F.col(name)) & (F.col("at") < F.col(name) + F.col(n))
    return table.join(F.broadcast(plan.withColumnRenamed(value, f"m_{value}")), inside, how)


def best_fit(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(item, sequence, offset) for ``items`` (item, size): as few sequences of ``capacity`` as best fit finds.

    Items are unique longs, sizes from 1 to ``capacity``; equal sizes are told
    apart by item.  Items whose size is null or out of range get no row.  An
    empty table gives an empty result.  Sequences have numbers of their own, none
    negative, and their offsets have no gaps.
    """
    spark = items.sparkSession
    left = items.filter(F.col("size").between(1, capacity)).select("item", "size")
    opened, times, placed = None, 0, []
    while True:
        left, item_runs = _sorted(left, "size", "item")
        least = item_runs.agg(F.min("value")).first()[0]
        if least is None:
            break
        plan = None
        if opened is not None:
            opened, gap_runs = _sorted(opened.filter(F.col("gap") >= least), "gap", "sequence")
            plan = written(swept(item_runs, gap_runs, capacity), "plan")
        if plan is not None and not plan.isEmpty():
            taken = _within(left, plan, "size", "item_at", "items", "inner")
            rank = F.col("at") - F.col("item_at")
            taken = taken.select("item", "size", (F.col("gap_at") + F.floor(rank / F.col("slots"))).alias("at"), (rank % F.col("slots")).alias("slot"))
            held = taken.join(opened, "at").select("item", "sequence", (capacity - F.col("gap") + F.col("slot") * F.col("size")).alias("offset"))
            placed.append(written(held, "placed"))
            rank = F.col("at") - F.col("gap_at")
            used = F.least(F.col("slots"), F.col("items") - rank * F.col("slots")) * F.col("size")
            opened = _within(opened, plan, "gap", "gap_at", "gaps", "left").select("sequence", (F.col("gap") - F.coalesce(used, F.lit(0))).alias("gap"))
            left = _within(left, plan, "size", "item_at", "items", "left_anti").select("item", "size")
            continue
        opens = openers(item_runs, capacity // 2, capacity)
        new = left.filter(opens).select("item", "size", (F.lit(times << 53) + F.col("at")).alias("sequence"))  # a place is below 1 << 53
        times += 1
        placed.append(new.select("item", "sequence", F.lit(0).cast("bigint").alias("offset")))
        gaps = new.select("sequence", (capacity - F.col("size")).alias("gap"))
        opened = gaps if opened is None else opened.select("sequence", "gap").unionByName(gaps)
        left = left.filter(~opens).select("item", "size")
    if not placed:
        return spark.createDataFrame([], "item bigint, sequence bigint, offset bigint")
    out = placed[0]
    for table in placed[1:]:
        out = out.unionByName(table)
    return out


def pack_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The pieces of :func:`token_pieces` with sequence_id and offset.

    Full pieces are sequences of their own, with negative numbers; the others
    are packed by :func:`best_fit`.  Rows with equal keys or texts, and null
    keys, are documents like any other; an empty table gives an empty result.
    Other columns are not read.
    """
    pieces = written(token_pieces(docs, path, key, text, capacity, with_ids=with_ids).withColumn("_item", F.monotonically_increasing_id()), "pieces")
    places = best_fit(pieces.filter(F.col("length") < capacity).select(F.col("_item").alias("item"), F.col("length").alias("size")), capacity)
    held = pieces.join(places.select(F.col("item").alias("_item"), "sequence", F.col("offset").alias("_offset")), "_item", "left")
    return held.select(*[c for c in pieces.columns if c != "_item"], F.coalesce("sequence", -1 - F.col("_item")).alias("sequence_id"), F.coalesce("_offset", F.lit(0)).alias("offset"))
