"""Views for contrastive learning, and fixed-length windows of sequences."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.sequences import hash_number


def masked_views(sequences: DataFrame, column: str, share: float = 0.15, views: int = 2, seed: int = 42) -> DataFrame:
    """Each row once a view, with ``view`` from 1; a drawn share of the values is 0, by a hash of seed, view, row and column."""
    seen = sequences.withColumn("view", F.explode(F.sequence(F.lit(1), F.lit(views))))
    key = F.concat_ws(":", "view", "rid", F.lit(column))
    return seen.withColumn(column, F.when(hash_number(seed, key) < int(share * (1 << 32)), 0.0).otherwise(F.col(column)))


def uniform(seed: int, *key: Column | str) -> Column:
    """A number in [0, 1) drawn for a key."""
    return hash_number(seed, F.concat_ws(":", *key)) / float(1 << 32)


def gaussian(seed: int, *key: Column | str) -> Column:
    """A standard normal number drawn for a key, of two uniform ones."""
    u = (hash_number(seed, F.concat_ws(":", *key, F.lit("u"))) + 1) / float(1 << 32)
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * uniform(seed, *key, F.lit("v")))


def with_noise(sequences: DataFrame, columns: list[str], std: float = 0.01, seed: int = 42, key: tuple[str, ...] = ("view", "rid"), where: Column | None = None) -> DataFrame:
    """``columns`` plus normal noise, drawn by seed, key and column; ``where``: only there."""
    return sequences.withColumns({c: F.when(where if where is not None else F.lit(True), F.col(c) + std * gaussian(seed, *key, F.lit(c))).otherwise(F.col(c)) for c in columns})


def with_dropout(sequences: DataFrame, columns: list[str], share: float = 0.1, seed: int = 42, key: tuple[str, ...] = ("view", "rid"), where: Column | None = None) -> DataFrame:
    """``columns`` with a drawn share of the values 0; ``where``: only there."""
    drop = lambda c: uniform(seed, F.lit("drop"), *key, F.lit(c)) < share
    return sequences.withColumns({c: F.when((where if where is not None else F.lit(True)) & drop(c), 0.0).otherwise(F.col(c)) for c in columns})


def augmented_views(sequences: DataFrame, numerical: list[str], histogram: list[str], mask: float = 0.15, noise: float = 0.01, dropout: float = 0.1, histogram_mask: float = 0.15, views: int = 2, seed: int = 42) -> DataFrame:
    """Each row once a view: numerical columns masked, then with noise, then with dropout; histogram columns masked only. A share or deviation of 0 leaves a step out."""
    seen = sequences.withColumn("view", F.explode(F.sequence(F.lit(1), F.lit(views))))
    masked = lambda c, share: F.when(hash_number(seed, F.concat_ws(":", "view", "rid", F.lit(c))) < int(share * (1 << 32)), 0.0).otherwise(F.col(c))
    seen = seen.withColumns({c: masked(c, mask) for c in numerical} | {c: masked(c, histogram_mask) for c in histogram})
    if noise:
        seen = with_noise(seen, numerical, noise, seed)
    return with_dropout(seen, numerical, dropout, seed) if dropout else seen


def weak_time_views(sequences: DataFrame, columns: list[str], valid: Column, std: float = 0.01, share: float = 0.05, views: int = 2, seed: int = 42) -> DataFrame:
    """Each row once a view, with noise and then dropout where ``valid``."""
    seen = sequences.withColumn("view", F.explode(F.sequence(F.lit(1), F.lit(views))))
    return with_dropout(with_noise(seen, columns, std, seed, where=valid), columns, share, seed, where=valid)


def weak_frequency_views(spectra: DataFrame, columns: list[str], std: float = 0.05, share: float = 0.01, views: int = 2, seed: int = 42) -> DataFrame:
    """Each bin (vehicle_id, bin) once a view, with noise and then dropout."""
    seen = spectra.withColumn("view", F.explode(F.sequence(F.lit(1), F.lit(views))))
    key = ("view", "vehicle_id", "bin")
    return with_dropout(with_noise(seen, columns, std, seed, key), columns, share, seed, key)


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of doubles; null where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def right_aligned(sequences: DataFrame, column: str, length: int) -> DataFrame:
    """(vehicle_id, position, value, valid): the latest ``length`` readouts at the end of as many positions, 0 before them."""
    late = sequences.filter(F.col("sequence_length") - F.col("seq_idx") < length)
    held = late.groupBy("vehicle_id").agg(F.sort_array(F.collect_list(F.struct("seq_idx", F.col(column).alias("value")))).alias("_rows"))
    free = F.lit(length) - F.size("_rows")
    values = F.concat(F.array_repeat(F.lit(0.0), free), F.col("_rows.value"))
    return held.select("vehicle_id", free.alias("_free"), F.posexplode(values).alias("position", "value")).select("vehicle_id", "position", "value", (F.col("position") >= F.col("_free")).alias("valid"))
