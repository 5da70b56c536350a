"""One row of features a vehicle, and their selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.sequences import hash_number


def aggregate_sequences(sequences: DataFrame, numerical: list[str], histogram: list[str] = []) -> DataFrame:
    """By vehicle: first, last, delta, slope, mean, std, min, max of numerical columns, mean and last of histogram columns, gaps.

    First and last are those of the readouts that have a value; a slope needs
    two of them at different times.  Gaps leave out the first readout, unless
    it is the only one.
    """
    out = []
    for c in numerical:
        at = F.when(F.col(c).isNotNull(), F.col("seq_idx"))
        first, last = F.min_by(c, at), F.max_by(c, at)
        t = F.when(F.col(c).isNotNull(), F.col("time_step"))
        delta, span = last - first, F.max(t) - F.min(t)
        out += [first.alias(f"{c}_first"), last.alias(f"{c}_last"), delta.alias(f"{c}_delta"), F.when(span != 0, delta / span).alias(f"{c}_slope")]
        out += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    for c in histogram:
        out += [F.avg(c).alias(f"{c}_mean"), F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq_idx"))).alias(f"{c}_last")]
    gap = F.when((F.col("seq_idx") > 1) | (F.col("sequence_length") == 1), F.col("time_gap"))
    out += [F.avg(gap).alias("gap_mean"), F.stddev_pop(gap).alias("gap_std"), F.min(gap).alias("gap_min"), F.max(gap).alias("gap_max"), F.median(gap).alias("gap_median")]
    n, end = F.max("sequence_length"), F.max("time_step")
    out += [n.alias("sequence_length"), end.alias("final_time_step"), F.when(end == 0, 0.0).otherwise(n / end).alias("observation_density")]
    return sequences.groupBy("vehicle_id").agg(*out)


def feature_variances(table: DataFrame, features: list[str]) -> DataFrame:
    """(feature, variance): population variances."""
    found = table.agg(*[F.var_pop(c).alias(c) for c in features])
    return found.unpivot([], features, "feature", "variance")


def near_constant(table: DataFrame, features: list[str], threshold: float = 1e-4) -> DataFrame:
    """The features whose population variance is not above ``threshold``."""
    return feature_variances(table, features).filter(F.col("variance") <= threshold)


def ranked(vehicles: DataFrame, seed: int, strata: list[str]) -> DataFrame:
    """``vehicles`` with _r, the place by a hash of seed and key within the strata, and _n, the rows there.

    Ranges of the hash are ranked by themselves; the rows of those before are added.
    """
    ranges = 256
    drawn = F.md5(F.concat(F.lit(f"{seed}:"), F.col("vehicle_id").cast("string")))
    held = vehicles.withColumn("_range", F.shiftright(hash_number(seed, F.col("vehicle_id")), 24))
    counts = held.groupBy(*strata, "_range").agg(F.count(F.lit(1)).alias("_c"))
    every = Window.partitionBy(*strata)  # of at most ``ranges`` rows
    before = counts.select(*strata, "_range", F.coalesce(F.sum("_c").over(every.orderBy("_range").rowsBetween(-ranges, -1)), F.lit(0)).alias("_b"), F.sum("_c").over(every).alias("_n"))
    same = F.lit(True)
    for c in strata:
        same = same & F.col(c).eqNullSafe(F.col(f"_s_{c}"))
    before = before.select(*[F.col(c).alias(f"_s_{c}") for c in strata], F.col("_range").alias("_at"), "_b", "_n")
    place = F.row_number().over(Window.partitionBy(*strata, "_range").orderBy(drawn, "vehicle_id"))
    joined = held.withColumn("_p", place).join(before, (F.col("_range") == F.col("_at")) & same)
    return joined.withColumn("_r", F.col("_p") + F.col("_b")).select(*vehicles.columns, "_r", "_n")


def stratified_split(vehicles: DataFrame, seed: int = 42) -> DataFrame:
    """``vehicles`` with split: 70 % train, 15 % val, 15 % test of each event class, by a hash of seed and key."""
    split = F.when(F.col("_r") <= F.floor(F.col("_n") * 0.7), "train").when(F.col("_r") <= F.floor(F.col("_n") * 0.85), "val").otherwise("test")
    return ranked(vehicles, seed, ["event"]).withColumn("split", split).drop("_r", "_n")


def train_validation_split(vehicles: DataFrame, share: float = 0.2, seed: int = 42, stratify: bool = True) -> DataFrame:
    """``vehicles`` with split, train or val: ``share`` of them, of each event class if stratified, is val."""
    held = ranked(vehicles, seed, ["event"] if stratify else [])
    return held.withColumn("split", F.when(F.col("_r") <= F.ceil(F.col("_n") * share), "val").otherwise("train")).drop("_r", "_n")


def event_rate(vehicles: DataFrame, by: str = "split") -> DataFrame:
    """(``by``, n, event_rate)."""
    return vehicles.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg("event").alias("event_rate"))


def without_near_constant(table: DataFrame, features: list[str], threshold: float = 1e-4) -> tuple[DataFrame, list[str]]:
    """``table`` without its features of a variance up to ``threshold``, and their names: drop the same of other splits."""
    gone = sorted(r["feature"] for r in near_constant(table, features, threshold).collect())
    return table.drop(*gone), gone


def correlations(table: DataFrame, features: list[str]) -> DataFrame:
    """(first, second, corr): Pearson's of each pair of columns, in column order; null where a column is constant."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    spread = lambda x, y: F.stddev_pop(F.when(F.col(y).isNotNull(), F.col(x)))
    held = table.agg(*[F.try_divide(F.covar_pop(a, b), spread(a, b) * spread(b, a)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])
    return held.select(F.inline(rows))


def highly_correlated(table: DataFrame, features: list[str], threshold: float = 0.9) -> list[str]:
    """The features to drop: of each pair above ``threshold``, in column order, the one of smaller variance, the second on ties.

    The driver sees one number a pair of columns and a column.
    """
    variance = table.agg(*[F.var_samp(c).alias(c) for c in features]).first().asDict()
    gone: set[str] = set()
    for a, b, corr in correlations(table, features).collect():
        if corr is not None and abs(corr) > threshold and not {a, b} & gone:
            gone.add(a if variance[a] < variance[b] else b)
    return sorted(gone)


def folds(vehicles: DataFrame, k: int = 3, seed: int = 42) -> DataFrame:
    """``vehicles`` with fold, from 0 to ``k`` - 1, by a hash of seed and key."""
    return vehicles.withColumn("fold", hash_number(seed, F.col("vehicle_id")) % k)
