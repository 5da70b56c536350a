"""Sequences of readouts: order, truncation, prefixes. Rows are ordered by time_step, then rid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

ORDER = ("time_step", "rid")


def whole() -> WindowSpec:
    return Window.partitionBy("vehicle_id")


def along() -> WindowSpec:
    return whole().orderBy(*ORDER)


def so_far() -> WindowSpec:
    return along().rowsBetween(Window.unboundedPreceding, 0)


def hash_number(seed: int, key: Column) -> Column:
    """A number below 2**32 drawn for a key: the start of the md5 of seed and key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8), 16, 10).cast("bigint")


def build_sequences(readouts: DataFrame) -> DataFrame:
    """``readouts`` with seq_idx from 1, time_gap (0 for the first) and sequence_length."""
    return readouts.select("*", F.row_number().over(along()).cast("bigint").alias("seq_idx"), F.coalesce(F.col("time_step") - F.lag("time_step").over(along()), F.lit(0.0)).alias("time_gap"), F.count(F.lit(1)).over(whole()).alias("sequence_length"))


def attach_vehicles(sequences: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Sequences with their vehicle's columns; those without one go."""
    return sequences.join(vehicles, "vehicle_id")


def truncate_at_random(sequences: DataFrame, seed: int = 42, min_history: int = 5) -> DataFrame:
    """Histories cut after a drawn readout, the last one included; duration is what remains after it.

    ``sequences`` have duration.  Shorter ones than ``min_history``, and those
    of which nothing remains, go.  The draw depends on seed and vehicle only.
    """
    cut = min_history + hash_number(seed, F.col("vehicle_id")) % (F.col("sequence_length") - min_history + 1)
    kept = sequences.filter(F.col("sequence_length") >= min_history).withColumn("cut", cut).filter("seq_idx <= cut")
    timed = kept.withColumn("readout_time", F.max("time_step").over(whole())).withColumn("original_duration", F.col("duration"))
    return timed.withColumn("duration", F.col("original_duration") - F.col("readout_time")).filter("duration > 0").withColumn("sequence_length", F.col("cut")).drop("cut")


def prefix_lengths(length: Column, shares: tuple[float, ...] = (0.3, 0.6, 0.9), min_length: int = 5, strict: bool = True) -> Column:
    """Distinct rounded shares of a length, in order, not below ``min_length`` nor above the longest prefix."""
    if min_length <= 0 or not shares or any(not 0 < s <= 1 for s in shares):
        raise ValueError("min_length must be positive, shares in (0, 1]")
    most = length - 1 if strict else length
    cut = F.transform(F.array(*map(F.lit, shares)), lambda s: F.least(F.greatest(F.rint(length * s).cast("bigint"), F.lit(min_length).cast("bigint")), most.cast("bigint")))
    return F.when(most >= min_length, F.array_sort(F.array_distinct(cut))).otherwise(F.array().cast("array<bigint>"))


def build_prefixes(sequences: DataFrame, shares: tuple[float, ...] = (0.3, 0.6, 0.9), min_length: int = 5, strict: bool = True) -> DataFrame:
    """A copy of the first readouts for each prefix: prefix_id, prefix_number from 1, prefix_length, prefix_fraction."""
    cut = sequences.select("*", F.posexplode(prefix_lengths(F.col("sequence_length"), shares, min_length, strict)).alias("_at", "prefix_length")).filter("seq_idx <= prefix_length")
    return cut.withColumn("prefix_number", F.col("_at") + 1).withColumn("prefix_id", F.concat(F.col("vehicle_id").cast("string"), F.lit("_p"), F.col("prefix_number").cast("string"))).withColumn("prefix_fraction", F.col("prefix_length") / F.col("sequence_length")).drop("_at")


def truncate_at_horizon(sequences: DataFrame, horizon: float, min_history: int = 5) -> DataFrame:
    """Histories up to the last readout at or before duration - ``horizon``; those of fewer than ``min_history`` readouts go."""
    if horizon <= 0:
        raise ValueError("horizon must be positive")
    early = sequences.filter((F.col("duration") - horizon > 0) & (F.col("time_step") <= F.col("duration") - horizon))
    timed = early.select("*", F.max("time_step").over(whole()).alias("readout_time"), F.count(F.lit(1)).over(whole()).alias("_kept"))
    return timed.filter(F.col("_kept") >= min_history).select(*[c for c in sequences.columns if c not in ("duration", "sequence_length")], "readout_time", F.col("_kept").alias("sequence_length"), F.col("duration").alias("original_duration"), (F.col("duration") - F.col("readout_time")).alias("duration"))


def missing_vehicles(sequences: DataFrame, vehicles: DataFrame) -> DataFrame:
    """One row: how many sequences have a row in ``vehicles``, and how many have none and would go."""
    keys = sequences.select("vehicle_id").distinct().join(vehicles.select("vehicle_id", F.lit(1).alias("_v")).distinct(), "vehicle_id", "left")
    return keys.agg(F.count("_v").alias("attached"), F.count_if(F.col("_v").isNull()).alias("dropped"))


def checked_prefixes(prefixes: DataFrame, columns: list[str]) -> DataFrame:
    """``prefixes``; an error where there are none, a column of ``columns`` isn't there, or has a null."""
    absent = [c for c in ["prefix_id", "vehicle_id", "prefix_length", *columns] if c not in prefixes.columns]
    if absent:
        raise ValueError(f"no column {', '.join(absent)}")
    if prefixes.isEmpty():
        raise ValueError("no prefixes")
    check = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{c} is null")).cast(prefixes.schema[c].dataType)).otherwise(F.col(c))
    return prefixes.withColumns({c: check(c) for c in columns})


def prefix_summary(prefixes: DataFrame) -> DataFrame:
    """One row: prefixes, their vehicles, and least, most and mean length; 0 and nulls of an empty table."""
    one = prefixes.select("prefix_id", "vehicle_id", "prefix_length").distinct()
    return one.agg(F.count(F.lit(1)).alias("n_prefixes"), F.count_distinct("vehicle_id").alias("n_vehicles"), F.min("prefix_length").alias("min_length"), F.max("prefix_length").alias("max_length"), F.avg("prefix_length").alias("mean_length"))


def packed(rows: DataFrame, columns: list[str], key: str = "vehicle_id") -> DataFrame:
    """One row for each ``key``: sequence_length and an array of each column, in order."""
    held = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("seq_idx", *columns))).alias("_rows"))
    return held.select(key, F.size("_rows").alias("sequence_length"), *[F.col(f"_rows.{c}").alias(c) for c in columns])


def packed_prefixes(sequences: DataFrame, columns: list[str], shares: tuple[float, ...] = (0.3, 0.6, 0.9), min_length: int = 5, strict: bool = True) -> DataFrame:
    """What :func:`packed` makes of :func:`build_prefixes`, of packed sequences: the first values of their arrays, and their other columns."""
    cut = sequences.select("*", F.posexplode(prefix_lengths(F.col("sequence_length"), shares, min_length, strict)).alias("_at", "_length"))
    first = {c: F.slice(c, F.lit(1), F.col("_length").cast("int")) for c in columns}
    named = F.concat(F.col("vehicle_id").cast("string"), F.lit("_p"), (F.col("_at") + 1).cast("string"))
    return cut.withColumns(first | {"prefix_id": named, "sequence_length": F.col("_length").cast("int")}).drop("_at", "_length")
