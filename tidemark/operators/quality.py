"""Profiles and checks of readouts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranks import percentiles
from tidemark.operators.sequences import along

#: What a feature's steps say of it (fixed values).
VERDICTS = ("insufficient_data", "likely_cumulative", "possibly_cumulative_or_non_decreasing", "likely_non_cumulative")
PERCENTILES = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


def null_counts(table: DataFrame, top: int = 30) -> DataFrame:
    """(feature, nulls): the columns with most nulls, of those that have any."""
    counts = table.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in table.columns])
    return counts.unpivot([], counts.columns, "feature", "nulls").filter("nulls > 0").orderBy(F.desc("nulls"), "feature").limit(top)


def duplicate_pairs(readouts: DataFrame) -> DataFrame:
    """All rows whose (vehicle_id, time_step) occurs more than once."""
    same = Window.partitionBy("vehicle_id", "time_step")
    return readouts.withColumn("_n", F.count(F.lit(1)).over(same)).filter("_n > 1").drop("_n")


def steps_back(readouts: DataFrame) -> DataFrame:
    """Rows whose time is before the time of the row that came in before, by rid."""
    came = Window.partitionBy("vehicle_id").orderBy("rid")
    return readouts.withColumn("time_diff", F.col("time_step") - F.lag("time_step").over(came)).filter("time_diff < 0")


def time_gaps(readouts: DataFrame) -> DataFrame:
    """(vehicle_id, rid, time_step, gap): null for the first readout."""
    return readouts.select("vehicle_id", "rid", "time_step", (F.col("time_step") - F.lag("time_step").over(along())).alias("gap"))


def describe(table: DataFrame, value: str) -> DataFrame:
    """Count, mean, sample deviation, least, most and exact percentiles of a column."""
    found = table.agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("least"), F.max(value).alias("most"))
    cuts = percentiles(table, value, PERCENTILES)
    return cuts.crossJoin(F.broadcast(found)).select("n", "mean", "std", "least", "most", *[F.col(f"p{i}").alias(f"p{round(p * 100)}") for i, p in enumerate(PERCENTILES)])


def large_gaps(gaps: DataFrame, threshold: float) -> DataFrame:
    return gaps.filter(F.col("gap") > threshold)


def counter_resets(readouts: DataFrame, features: list[str]) -> DataFrame:
    """(vehicle_id, time_step, feature, value, prev, diff) wherever a feature falls."""
    long = readouts.unpivot(["vehicle_id", "rid", "time_step"], features, "feature", "value")
    before = F.lag("value").over(Window.partitionBy("vehicle_id", "feature").orderBy("time_step", "rid"))
    return long.withColumn("prev", before).withColumn("diff", F.col("value") - F.col("prev")).filter("diff < 0").drop("rid")


def cumulative_verdicts(readouts: DataFrame, features: list[str], tol: float = 1e-8, min_diffs: int = 50, most_negative: float = 0.01, least_positive: float = 0.8) -> DataFrame:
    """By feature: how its steps within vehicles go, and whether it is likely cumulative.

    Steps from or to a missing value don't count; fill them before, where they
    should.  A feature without steps has null ratios and too little data.
    """
    long = readouts.unpivot(["vehicle_id", "rid", "time_step"], features, "feature", "value")
    before = F.lag("value").over(Window.partitionBy("vehicle_id", "feature").orderBy("time_step", "rid"))
    d = F.col("d")
    share = lambda which: F.avg(F.when(d.isNotNull(), which.cast("int")))
    ratios = [share(d < -tol).alias("negative_ratio"), share(d > tol).alias("positive_ratio"), share(F.abs(d) <= tol).alias("zero_ratio")]
    found = long.select("feature", (F.col("value") - before).alias("d")).groupBy("feature").agg(F.count("d").alias("n_diffs"), *ratios, F.min("d").alias("min_diff"), F.max("d").alias("max_diff"), F.avg(F.abs(d)).alias("mean_abs_diff"))
    falls, rises = F.col("negative_ratio") > most_negative, F.col("positive_ratio") >= least_positive
    verdict = F.when(F.col("n_diffs") < min_diffs, VERDICTS[0]).when(falls, VERDICTS[3]).when(rises, VERDICTS[1]).otherwise(VERDICTS[2])
    return found.withColumn("verdict", verdict)


def features_by_verdict(verdicts: DataFrame) -> DataFrame:
    """(verdict, features): the sorted features of each."""
    return verdicts.groupBy("verdict").agg(F.array_sort(F.collect_list("feature")).alias("features"))


def key_coverage(tables: dict[str, DataFrame], key: str = "vehicle_id") -> DataFrame:
    """(measure, n): the distinct keys of each table, n_``name``, and those of one that another has not, ``a``_not_``b``."""
    marked = reduce(DataFrame.unionByName, [t.select(F.col(key).alias("_key"), F.lit(name).alias("_of")).distinct() for name, t in tables.items()])
    held = marked.groupBy("_key").agg(*[F.max((F.col("_of") == name).cast("int")).alias(name) for name in tables])
    counts = [F.sum(F.col(a)).alias(f"n_{a}") for a in tables] + [F.sum(F.col(a) * (1 - F.col(b))).alias(f"{a}_not_{b}") for a in tables for b in tables if a != b]
    found = held.agg(*counts)
    return found.unpivot([], found.columns, "measure", "n")


def inspect(table: DataFrame, top: int = 10) -> DataFrame:
    """(feature, nulls, n_rows, n_columns): the columns with most nulls, also those without any."""
    counts = table.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in table.columns])
    long = counts.unpivot(["_rows"], [f"`{c}`" for c in table.columns], "feature", "nulls")
    return long.select("feature", "nulls", F.col("_rows").alias("n_rows"), F.lit(len(table.columns)).alias("n_columns")).orderBy(F.desc("nulls"), "feature").limit(top)


def sequence_lengths(readouts: DataFrame) -> DataFrame:
    """(vehicle_id, sequence_length)."""
    return readouts.groupBy("vehicle_id").agg(F.count(F.lit(1)).alias("sequence_length"))


def extremes(table: DataFrame, value: str, n: int = 5, key: str = "vehicle_id") -> DataFrame:
    """The ``n`` rows of the smallest and of the largest ``value``, marked in ``side``; the smaller key on ties."""
    low = table.orderBy(value, key).limit(n).withColumn("side", F.lit("smallest"))
    return low.unionByName(table.orderBy(F.desc(value), key).limit(n).withColumn("side", F.lit("largest")))


def truncation_check(sequences: DataFrame, truncated: DataFrame) -> DataFrame:
    """By vehicle: lengths before and after a cut, and whether the remaining duration is what it should be."""
    before = sequences.groupBy("vehicle_id").agg(F.max("sequence_length").alias("full_length"), F.max("duration").alias("full_duration"))
    after = truncated.groupBy("vehicle_id").agg(F.count(F.lit(1)).alias("kept_length"), F.max("readout_time").alias("readout_time"), F.max("original_duration").alias("original_duration"), F.max("duration").alias("duration"))
    fits = (F.abs(F.col("duration") - (F.col("original_duration") - F.col("readout_time"))) < 1e-6) & (F.col("full_duration") == F.col("original_duration")) & (F.col("kept_length") <= F.col("full_length"))
    return before.join(after, "vehicle_id").withColumn("consistent", fits)


def normalization_check(table: DataFrame, columns: list[str], tol: float = 1e-6) -> DataFrame:
    """(feature, missing, mean, std, normalized) of each column."""
    measures = [x for c in columns for x in (F.count_if(F.col(c).isNull() | F.isnan(c)).alias(f"{c}|missing"), F.avg(c).alias(f"{c}|mean"), F.stddev_pop(c).alias(f"{c}|std"))]
    held = table.agg(*measures)
    rows = [F.struct(F.lit(c).alias("feature"), F.col(f"`{c}|missing`").alias("missing"), F.col(f"`{c}|mean`").alias("mean"), F.col(f"`{c}|std`").alias("std")) for c in columns]
    return held.select(F.inline(F.array(*rows))).withColumn("normalized", (F.col("missing") == 0) & (F.abs("mean") < tol) & (F.abs(F.col("std") - 1) < tol))
