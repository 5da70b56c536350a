"""How filters interact: what each removes at each step of every order they can be applied in.

A row is, for this, the set of filters that it fails: a mask.  One grouping
counts the rows of each part and mask; what follows reads these cells, of which
a part has two to the number of filters.  All orders are visited by swaps of
two neighbours; a swap leaves all but two steps as they were, so only these are
read from the cells anew, and what a filter removes adds up along the way.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import written

#: Fixed values of the five filters.
FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, UPPER_PERCENT, MARKS = 50, 65, 5, "[#$%&*|]"
WHITE = "[\\x20\\x09-\\x0D]+"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def swaps(n: int) -> Iterator[int]:
    """The places i at which swapping i and i + 1 leads through all orders of ``n`` things, each once."""
    if n < 2:
        return
    inner, down = swaps(n - 1), True
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        at = next(inner, None)
        if at is None:
            return
        yield at + (1 if down else 0)  # the last thing is in front now, or behind
        down = not down


def step_counts(cells: np.ndarray, before: int, at: int) -> tuple[int, ...]:
    """COUNTS of filter ``at`` after the filters in the mask ``before``; ``cells`` has (rows, good, toxic) of each mask."""
    masks = np.arange(len(cells))
    fails, left = (masks >> at) & 1 == 1, masks & before == 0
    removed = cells[fails & left].sum(axis=0)
    return int(cells[left & ~fails, 0].sum()), int(removed[0]), int(cells[fails & ~left, 0].sum()), int(cells[1 << at, 0]), int(removed[1]), int(removed[2])


def interactions(cells: np.ndarray, names: str) -> list[tuple]:
    """(order, step, *COUNTS, shapley) of every order of the filters and every step."""
    n, order, held = len(names), list(range(len(names))), {}

    def counted(before: int, at: int) -> tuple[int, ...]:
        if (before, at) not in held:
            held[before, at] = step_counts(cells, before, at)
        return held[before, at]

    steps = [counted((1 << k) - 1, k) for k in range(n)]
    before, total, out = [(1 << k) - 1 for k in range(n)], [0] * n, []

    def visited() -> None:
        for k, f in enumerate(order):
            total[f] += steps[k][1]
            out.append(("".join(names[i] for i in order), k + 1, f, steps[k]))

    visited()
    for i in swaps(n):
        order[i], order[i + 1] = order[i + 1], order[i]
        before[i + 1] = before[i] | 1 << order[i]
        steps[i], steps[i + 1] = counted(before[i], order[i]), counted(before[i + 1], order[i + 1])
        visited()
    return [(name, step, *counts, total[f]) for name, step, f, counts in out]


def filter_interactions(rows: DataFrame, names: str, part: str = "part", mask: str = "mask", good: str = "good", toxic: str = "toxic") -> DataFrame:
    """One row per part, order of the filters and step, from rows with the mask of the filters they fail (bit i: ``names[i]``).

    ``good`` and ``toxic`` are booleans.  Parts appear that have rows; without
    rows there is no result.  A part is worked on from its cells, at most 32
    with five filters, whatever the number of its rows.

    Returns part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost and shapley.
    """
    one = lambda c: F.sum(F.col(c).cast("long"))
    cells = rows.groupBy(F.col(part).alias("part"), F.col(mask).alias("mask")).agg(F.count(F.lit(1)).alias("n"), one(good).alias("good"), one(toxic).alias("toxic"))

    def of(group: pd.DataFrame) -> pd.DataFrame:
        table = np.zeros((1 << len(names), 3), np.int64)
        table[group["mask"].to_numpy()] = group[["n", "good", "toxic"]].to_numpy()
        out = pd.DataFrame(interactions(table, names), columns=["filter_order", "step", *COUNTS, "shapley"])
        out.insert(0, "part", group["part"].iloc[0])
        return out

    counts = ", ".join(f"{c} bigint" for c in (*COUNTS, "shapley"))
    return cells.groupBy("part").applyInPandas(of, f"part string, filter_order string, step int, {counts}")


def text_failures(text: Column) -> list[Column]:
    """The conditions A to D of a text that isn't null."""
    words = F.filter(F.split(text, WHITE), lambda w: w != "")
    upper = F.length(text) - F.length(F.translate(text, string.ascii_uppercase, ""))
    return [
        F.size(words) < LEAST_WORDS,
        100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * F.size(words),
        100 * upper.cast("long") > UPPER_PERCENT * F.length(text).cast("long"),
        text.rlike(MARKS),
    ]


def audited_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """The interactions of five filters over ``docs``: few words, few distinct ones, capitals, marks, copies of a smaller key.

    A null text is empty, a null part the empty one.  A null key is no smaller
    than any other and has no smaller one, so it fails by no copy and makes
    none; rows of the smallest key of a text are no copies of each other.  A
    key counts as good or toxic if any of its labels says so.  Columns other
    than these are not read.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    bits = [F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(text_failures(F.col("text")))]
    plain = docs.select(F.col(key).alias("key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), whole.alias("text"))
    base = written(plain.select("key", "part", F.unhex(F.sha2("text", 256)).alias("digest"), sum(bits[1:], bits[0]).alias("mask")), "masks")
    first = base.groupBy("digest").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first")
    flags = labels.groupBy(F.col("doc_id").alias("of")).agg(F.max((F.col("quality") == 1)).alias("good"), F.max((F.col("toxic") == 1)).alias("toxic"))
    copy = F.when(F.col("key") > F.col("first"), 1 << (len(FILTERS) - 1)).otherwise(0)
    held = base.join(written(first, "first"), "digest", "left").join(flags.filter("of is not null"), F.col("key") == F.col("of"), "left")
    no = F.lit(False)
    return filter_interactions(held.select("part", (F.col("mask") + copy).alias("mask"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic")), FILTERS)
