"""Harrell's concordance index without a join of all pairs.

Durations and risks are cut into ranges, as many as the rows ask for.  Pairs in
different ranges of both are counted from the sums of the cells; pairs in one
range of durations, and those in one range of risks but different ranges of
durations, are counted within that range by merging sorted halves.  A duration
that many rows share is a range of its own, which is cut by risk; a risk that
many rows share is summed up by ranges of durations first.  Risks tie within a
tolerance, which isn't transitive: those that a cut of the risks parts are
counted among the rows next to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranks import cuts_of, parts_for, range_of
from tidemark.sources.stored import stored

#: Risks that are no further apart tie; a fixed value.
TOLERANCE = 1e-8


def _reach(v: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """For each of the sorted values: how many are smaller by more than ``tolerance``, and how many aren't larger by more."""
    low, high = np.arange(len(v)), np.arange(1, len(v) + 1)
    if tolerance and len(v):
        low, high = np.searchsorted(v, v - tolerance), np.searchsorted(v, v + tolerance, "right")
        for step in (1, -1):  # the sums above are rounded, the differences decide
            below, above = np.clip(low - (step < 0), 0, len(v) - 1), np.clip(high - (step < 0), 0, len(v) - 1)
            low = low + np.where((step > 0) == (v - v[below] > tolerance), step, 0) * ((low > 0) if step < 0 else (low < len(v)))
            high = high + np.where((step > 0) == (v[above] - v <= tolerance), step, 0) * ((high > 0) if step < 0 else (high < len(v)))
    return low, high


def counted(u: np.ndarray, r: np.ndarray, events: np.ndarray, n: np.ndarray, tolerance: float = 0.0) -> tuple[int, int, int]:
    """Pairs (i, j) with u[j] > u[i], weighted by events[i] * n[j]: all, those with r[j] < r[i], those whose r tie."""
    order = np.lexsort((r, u))
    u, r, events, n = u[order], r[order], events[order].astype(np.int64), n[order].astype(np.int64)
    size = len(u)
    upto = np.append(0, np.cumsum(n))
    comparable = int((events * (upto[-1] - upto[np.searchsorted(u, u, "right")])).sum())
    values, rank = np.unique(r, return_inverse=True)
    _, step = np.unique(u, return_inverse=True)
    low, high = (x[rank] for x in _reach(values, tolerance))
    at = np.arange(size)
    key = step.astype(np.int64) * (size + 1) + rank  # rows of one u, those behind that tie: taken off what is counted below
    both = -int((events * (upto[np.searchsorted(key, step * (size + 1) + high)] - upto[at + 1])).sum())
    concordant, width = 0, 1
    while width < size:  # within one u risks ascend, so none of its pairs is concordant
        block = at // width
        by = np.lexsort((rank, block))
        key = block[by] * (size + 1) + rank[by]
        sums = np.append(0, np.cumsum(n[by]))
        left = np.flatnonzero(block % 2 == 0)
        first = (block[left] + 1) * (size + 1)
        before = sums[np.searchsorted(key, first)]
        concordant += int((events[left] * (sums[np.searchsorted(key, first + low[left])] - before)).sum())
        both += int((events[left] * (sums[np.searchsorted(key, first + high[left])] - before)).sum())
        width *= 2
    return comparable, concordant, both - concordant


def _clusters(cuts: list[float], tolerance: float) -> list[tuple[float, float]]:
    """The stretches within ``tolerance`` of a cut; those that meet are one."""
    out: list[tuple[float, float]] = []
    for c in cuts:
        if out and c - tolerance <= out[-1][1]:
            out[-1] = (out[-1][0], c + tolerance)
        else:
            out.append((c - tolerance, c + tolerance))
    return out


def concordance(table: DataFrame, parts: int | None = None, keys: tuple[str, ...] = (), tolerance: float = TOLERANCE) -> DataFrame:
    """One row (one for each of ``keys``): comparable pairs, concordant and tied ones, and the index (null without pairs).

    A pair is comparable if the one with the smaller duration has the event, or
    at equal durations the other has none; concordant if that one's risk is
    larger by more than ``tolerance``, tied if they are no further apart.  Rows
    with a null duration, event or risk don't count; without ``keys`` there is a
    row even if there are none.
    """
    full = table.dropna(subset=["duration", "event", "risk"])
    held = full.select(*keys, F.col("duration").cast("double").alias("t"), F.col("event").cast("bigint").alias("e"), F.col("risk").cast("double").alias("r"))
    held = stored(held.groupBy(*keys, "t", "e", "r").agg(F.count(F.lit(1)).alias("n")))
    if parts is None:
        parts = parts_for(held.count())
    (times, hot), (risks, _) = cuts_of(held, "t", parts), cuts_of(held, "r", parts)
    single = F.col("t").isin(hot) if hot else F.lit(False)
    held = held.select("*", range_of(F.col("t"), times).alias("tb"), range_of(F.col("r"), risks).alias("rb"), single.alias("single"))
    kept = ", ".join(f"`{k}` {table.schema[k].dataType.simpleString()}" for k in keys)
    kinds = ", ".join(x for x in (kept, "comparable bigint, concordant bigint, tied bigint") if x)

    def of(rows: pa.Table, comparable: int, concordant: int, tied: int) -> pa.Table:
        return pa.table({k: rows[k].slice(0, 1) for k in keys} | {"comparable": [comparable], "concordant": [concordant], "tied": [tied]})

    def arrays(rows: pa.Table, *names: str) -> list[np.ndarray]:
        return [rows[c].to_numpy() for c in names]

    def within(rows: pa.Table) -> pa.Table:
        t, e, r, n = arrays(rows, "t", "e", "r", "n")
        _, step = np.unique(t, return_inverse=True)
        return of(rows, *counted(2 * step + (e == 0), r, e * n, n, tolerance))

    def across(rows: pa.Table) -> pa.Table:
        _, concordant, tied = counted(*arrays(rows, "tb", "r", "events", "n"), tolerance)
        return of(rows, 0, concordant, tied)

    def far(rows: pa.Table) -> pa.Table:
        comparable, concordant, _ = counted(*arrays(rows, "tb", "rb", "events", "n"))
        return of(rows, comparable, concordant, 0)

    def far_single(rows: pa.Table) -> pa.Table:
        e, rb, events, n = arrays(rows, "e", "rb", "events", "n")
        comparable, concordant, same = counted(1 - e, rb, events, n)
        return of(rows, comparable - same, concordant, 0)

    def border(rows: pa.Table) -> pa.Table:
        """What changes by near ties between ranges of risks, but for those in one range of durations, which :func:`within` has seen."""
        t, e, r, n, tb, rb = arrays(rows, "t", "e", "r", "n", "tb", "rb")
        _, step = np.unique(t, return_inverse=True)
        own = np.where(rows["single"].to_numpy(zero_copy_only=False), -1 - np.arange(len(t)), tb)  # rows of a single duration count by themselves here
        total = np.zeros(3, np.int64)
        for sign, group in ((1, np.zeros(len(t))), (-1, rb), (-1, own), (1, own * (rb.max() + 1) + rb)):
            order = np.argsort(group, kind="stable")
            for i in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
                if len(i) > 1:
                    loose, exact = (np.array(counted((2 * step + (e == 0))[i], r[i], (e * n)[i], n[i], x)) for x in (tolerance, 0.0))
                    total += sign * (loose - exact)
        return of(rows, *total.tolist())

    summed = lambda *by: held.groupBy(*keys, *by).agg(F.sum(F.col("e") * F.col("n")).alias("events"), F.sum("n").alias("n"))
    found = [
        held.filter("not single").groupBy(*keys, "tb").applyInArrow(within, kinds),
        summed("rb", "tb", "r").groupBy(*keys, "rb").applyInArrow(across, kinds),
        summed("tb", "rb").groupBy(*keys).applyInArrow(far, kinds),
    ]
    if hot:
        found.append(held.filter("single").groupBy(*keys, "tb", "rb").applyInArrow(within, kinds))
        found.append(held.filter("single").groupBy(*keys, "tb", "rb", "e").agg(F.sum(F.col("e") * F.col("n")).alias("events"), F.sum("n").alias("n")).groupBy(*keys, "tb").applyInArrow(far_single, kinds))
    if tolerance and risks:
        found.append(_next_to_cuts(held, keys, risks, tolerance).groupBy(*keys, "cluster").applyInArrow(border, kinds))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    total = every.groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("comparable", "concordant", "tied")])
    return total.withColumn("c_index", F.try_divide(F.col("concordant") + F.col("tied") / 2, F.col("comparable")))


def _next_to_cuts(held: DataFrame, keys: tuple[str, ...], risks: list[float], tolerance: float) -> DataFrame:
    """The rows next to cuts of the risks, with the cluster of cuts, where a cluster has rows on both sides of one."""
    ends = _clusters(risks, tolerance)
    number = range_of(F.col("r"), [b for _, b in ends])
    starts = F.array(*[F.lit(a) for a, _ in ends])
    inside = (number < len(ends)) & (F.col("r") >= F.get(starts, number))
    near = held.withColumn("cluster", F.when(inside, number)).filter("cluster IS NOT NULL")
    both = near.groupBy("cluster").agg(F.min("rb").alias("lo"), F.max("rb").alias("hi")).filter("lo < hi").select("cluster")  # a row a cut at most
    return near.join(F.broadcast(both), "cluster", "left_semi")
