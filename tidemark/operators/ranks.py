"""Ranks, running sums and percentiles of whole columns, over ranges of values: no task has all rows.

A table is dealt to ranges of a column and stored with their numbers; each
range is sorted and summed up by itself, and the sums of the ranges before it
are added.  How many ranges there are follows from the table's size: as many
as Spark makes of its shuffle partitions, small ones merged.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.stored import stored

#: Rows of a range that is worked on in one task, and ranges of a column at most.
RANGE_ROWS, MOST_PARTS = 1 << 16, 1024


def parts_for(rows: int) -> int:
    """How many ranges so many rows ask for."""
    return min(MOST_PARTS, max(1, -(-rows // RANGE_ROWS)))


def cuts_of(table: DataFrame, value: str, parts: int) -> tuple[list[float], list[float]]:
    """At most ``parts`` - 1 cuts of a column into ranges of about as many rows, and the values that take more than a range: each of them is a range of its own."""
    shares = [i / parts for i in range(1, parts)]
    found = table.select(F.col(value).cast("double").alias("v")).approxQuantile("v", shares, 0.25 / parts) if shares else []
    hot = sorted({v for v in found if found.count(v) > 1})
    return sorted(set(found) | {math.nextafter(v, -math.inf) for v in hot}), hot


def range_of(value: Column, cuts: list[float]) -> Column:
    """The number of the range: of the cuts, which ascend, below the value, found by halving."""
    if not cuts:
        return F.lit(0)
    held, n = F.array(*map(F.lit, cuts)), len(cuts)
    steps = F.array(*[F.lit(1 << k) for k in range(n.bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= n) & (F.get(held, at + step - 1) < value), at + step).otherwise(at))


def in_ranges(table: DataFrame, by: str, parts: int | None = None) -> DataFrame:
    """``table``, stored with _range: the number of the range that ``by`` is in, in ascending order.

    Equal values are in one range; null ones give an error.
    """
    value = F.when(F.col(by).isNull(), F.raise_error(F.lit(f"{by} is null")).cast(table.schema[by].dataType)).otherwise(F.col(by))
    held = table.drop("_range").withColumn(by, value)
    dealt = held.repartitionByRange(parts, by) if parts else held.repartitionByRange(by)
    return stored(dealt.withColumn("_range", F.spark_partition_id()))


def running_sums(table: DataFrame, by: str, sums: dict[str, Column], descending: bool = False, keys: tuple[str, ...] = (), parts: int | None = None, ranged: bool = False) -> DataFrame:
    """``table`` and, for each name, the sum of its column over all rows up to this one, in the order of ``by``.

    ``keys``: rows of different keys are summed apart.  Within equal keys the
    values of ``by`` are distinct; null ones give an error.  A table that has
    _range from before keeps its ranges; ``ranged``: the result has them too.
    """
    held = table if "_range" in table.columns else in_ranges(table, by, parts)
    held = held.withColumns({f"_{name}": c for name, c in sums.items()})
    place = F.desc if descending else F.asc
    totals = held.groupBy(*keys, "_range").agg(*[F.sum(f"_{name}").alias(f"_t_{name}") for name in sums])
    earlier = Window.partitionBy(*keys).orderBy(place("_range")).rowsBetween(Window.unboundedPreceding, -1)  # of a row a range
    before = totals.select(*keys, "_range", *[F.coalesce(F.sum(f"_t_{name}").over(earlier), F.lit(0)).alias(f"_b_{name}") for name in sums])
    inside = Window.partitionBy(*keys, "_range").orderBy(place(by)).rowsBetween(Window.unboundedPreceding, 0)
    summed = held.withColumns({f"_s_{name}": F.sum(f"_{name}").over(inside) for name in sums}).join(before if keys else F.broadcast(before), [*keys, "_range"])
    kept = [c for c in table.columns if c not in sums and c != "_range"]
    return summed.select(*[F.col(f"`{c}`") for c in kept], *[(F.col(f"_s_{name}") + F.col(f"_b_{name}")).alias(name) for name in sums], *(["_range"] if ranged else []))


def percentiles(table: DataFrame, value: str, shares: tuple[float, ...]) -> DataFrame:
    """One row: n and exact percentiles p0, p1 and so on, interpolated between neighbours; nulls don't count.

    Only the ranges that hold a percentile are sorted.
    """
    spark = table.sparkSession
    held = in_ranges(table.select(F.col(value).cast("double").alias("v")).filter("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("c")), "v")
    counts = sorted((r["_range"], r["n"]) for r in held.groupBy("_range").agg(F.sum("c").alias("n")).collect())  # a row a range
    n = sum(c for _, c in counts)
    if not n:
        return spark.range(1).select(F.lit(0).cast("bigint").alias("n"), *[F.lit(None).cast("double").alias(f"p{i}") for i in range(len(shares))])
    wanted, before = {}, 0
    ranks = {r for s in shares for r in (math.floor((n - 1) * s), math.ceil((n - 1) * s))}
    for number, count in counts:
        wanted |= {r: (number, r - before) for r in ranks if before <= r < before + count}
        before += count
    upto = F.sum("c").over(Window.partitionBy("_range").orderBy("v"))
    ordered = held.filter(F.col("_range").isin(sorted({k for k, _ in wanted.values()}))).withColumn("_upto", upto)
    at = {r: F.min(F.when((F.col("_range") == k) & (F.col("_upto") > left), F.col("v"))) for r, (k, left) in wanted.items()}
    found = ordered.agg(*[c.alias(f"r{r}") for r, c in at.items()])
    values = []
    for i, s in enumerate(shares):
        low, high = F.col(f"r{math.floor((n - 1) * s)}"), F.col(f"r{math.ceil((n - 1) * s)}")
        values.append((low + (high - low) * ((n - 1) * s - math.floor((n - 1) * s))).alias(f"p{i}"))
    return found.select(F.lit(n).cast("bigint").alias("n"), *values)
