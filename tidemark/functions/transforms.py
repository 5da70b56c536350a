"""Transforms that are fitted on train rows: a fit gives a table of one row or one per column, an apply joins it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranks import percentiles
from tidemark.operators.sequences import along, so_far


def forward_filled(column: str) -> Column:
    """The last value so far, 0 where there is none."""
    return F.coalesce(F.last(column, ignorenulls=True).over(so_far()), F.lit(0.0))


def forward_fill(sequences: DataFrame, columns: list[str]) -> DataFrame:
    """``sequences`` with ``columns`` filled, numerical or histogram ones."""
    return sequences.withColumns({c: forward_filled(c) for c in columns})


def _present(column: str) -> Column:
    """The column; a missing value is an error."""
    bad = F.col(column).isNull() | F.isnan(column)
    return F.when(bad, F.raise_error(F.lit(f"{column} has a missing value")).cast("double")).otherwise(F.col(column))


def impute(sequences: DataFrame, columns: list[str]) -> DataFrame:
    """:func:`forward_fill`; a NaN that remains is an error."""
    return forward_fill(sequences, columns).withColumns({c: _present(c) for c in columns})


def log1p_checked(column: str) -> Column:
    """log1p; null and negative values raise an error."""
    bad = F.col(column).isNull() | F.isnan(column) | (F.col(column) < 0)
    return F.when(bad, F.raise_error(F.lit(f"{column} has a missing or negative value")).cast("double")).otherwise(F.log1p(column))


def fit_normalizer(train: DataFrame, columns: list[str]) -> DataFrame:
    """One row: mean and population deviation of each column, a deviation of 0 as 1; missing values are an error."""
    held = train.select(*[_present(c).alias(c) for c in columns])
    std = lambda c: F.when(F.stddev_pop(c) == 0, 1.0).otherwise(F.stddev_pop(c))
    return held.agg(*[x for c in columns for x in (F.avg(c).alias(f"{c}_mean"), std(c).alias(f"{c}_std"))])


def normalize(table: DataFrame, fitted: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / std by the one row of ``fitted``; missing values are an error."""
    scaled = table.crossJoin(F.broadcast(fitted)).withColumns({c: (_present(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std") for c in columns})
    return scaled.drop(*fitted.columns)


def preprocess_splits(sequences: DataFrame, numerical: list[str], histogram: list[str]) -> DataFrame:
    """Sequences of all splits (column ``split``): both kinds filled, numerical ones scaled by the train rows, log1p of histograms."""
    filled = impute(sequences, numerical + histogram)
    scaled = normalize(filled, fit_normalizer(filled.filter("split = 'train'"), numerical), numerical)
    return scaled.withColumns({c: log1p_checked(c) for c in histogram})


def with_branches(sequences: DataFrame, columns: list[str]) -> DataFrame:
    """``sequences`` and arrays of ``columns``: dynamic_time, the values, and dynamic_freq, their steps from the readout before (0 for the first)."""
    return sequences.select("*", F.array(*columns).alias("dynamic_time"), F.array(*map(first_difference, columns)).alias("dynamic_freq"))


def with_modalities(sequences: DataFrame, **columns: list[str]) -> DataFrame:
    """``sequences`` and, for each name, arrays of its columns: the values as {name}_time, and their steps as {name}_freq; a name without columns gives none."""
    arrays = {f"{n}_{side}": F.array(*(map(of, some))) for n, some in columns.items() if some for side, of in (("time", F.col), ("freq", first_difference))}
    return sequences.select("*", *[v.alias(n) for n, v in arrays.items()])


def prepare_for_contrast(sequences: DataFrame, columns: list[str]) -> DataFrame:
    """Sequences of all splits with both branches, and gaps scaled by the train rows."""
    scaler = fit_gap_scaler(sequences.filter("split = 'train'"))
    return scale_gaps(with_branches(sequences, columns), scaler)


def first_difference(column: str) -> Column:
    """The step from the readout before; 0 for the first."""
    return F.coalesce(F.col(column) - F.lag(column).over(along()), F.lit(0.0))


def fit_gap_scaler(train: DataFrame) -> DataFrame:
    """One row: mean and population deviation of log1p(time_gap), a tiny deviation as 1."""
    std = F.stddev_pop(F.log1p("time_gap"))
    return train.agg(F.avg(F.log1p("time_gap")).alias("gap_mean"), F.when(std < 1e-8, 1.0).otherwise(std).alias("gap_std"))


def scale_gaps(sequences: DataFrame, fitted: DataFrame) -> DataFrame:
    return sequences.crossJoin(F.broadcast(fitted)).withColumn("time_gap_scaled", (F.log1p("time_gap") - F.col("gap_mean")) / F.col("gap_std")).drop("gap_mean", "gap_std")


def fit_vocabulary(train: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, category, code): the sorted categories of each column, coded from 0."""
    found = [train.select(F.lit(c).alias("feature"), F.col(c).alias("category")).dropna().distinct() for c in columns]
    sets = reduce(DataFrame.unionByName, found).groupBy("feature").agg(F.array_sort(F.collect_set("category")).alias("_all"))
    return sets.select("feature", F.posexplode("_all").alias("code", "category")).select("feature", "category", "code")


def one_hot(table: DataFrame, vocabulary: list[tuple[str, str]]) -> DataFrame:
    """A column of 0 and 1 for each (feature, category), in that order, instead of the features; others are all 0."""
    features = {f for f, _ in vocabulary}
    shown = [F.coalesce((F.col(f) == v).cast("int"), F.lit(0)).alias(f"{f}_{v}") for f, v in vocabulary]
    return table.select(*[c for c in table.columns if c not in features], *shown)


def one_hot_static(table: DataFrame, vocabulary: list[tuple[str, str]], name: str = "static") -> DataFrame:
    """``table`` and an array of 0 and 1, one for each (feature, category); an unknown category is all 0."""
    return table.withColumn(name, F.array(*[F.coalesce((F.col(f) == v).cast("int"), F.lit(0)) for f, v in vocabulary]))


def kept_vocabulary(vocabulary: DataFrame, drop_first: bool = True) -> list[tuple[str, str]]:
    """(feature, category) in order, without the first category of each feature; the categories are as many as columns, so they can be collected."""
    rows = vocabulary.filter("code > 0") if drop_first else vocabulary
    return [(r["feature"], r["category"]) for r in rows.orderBy("feature", "code").collect()]


def fit_medians(train: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the exact median of each column, over ranges of its values."""
    found = [percentiles(train, c, (0.5,)).select(F.col("p0").alias(f"{c}_median")) for c in columns]
    return reduce(DataFrame.crossJoin, found)  # of one row each


def impute_medians(table: DataFrame, medians: DataFrame, columns: list[str]) -> DataFrame:
    return table.crossJoin(F.broadcast(medians)).withColumns({c: F.coalesce(F.col(c).cast("double"), f"{c}_median") for c in columns}).drop(*medians.columns)
