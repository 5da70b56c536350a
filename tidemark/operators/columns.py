"""Choosing, grouping and shaping columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A feature's name: its number, and the number of its bin.
FEATURE = re.compile(r"(\d+)_(\d+)")
STATIC = "Spec_"
TARGETS = ("duration", "event")


def feature_groups(columns: list[str]) -> tuple[list[str], dict[str, list[str]]]:
    """Numerical columns (single ones of bin 0) and the bins of each histogram, by number; other names are left out."""
    found: dict[int, list[int]] = {}
    for match in filter(None, map(FEATURE.fullmatch, columns)):
        found.setdefault(int(match[1]), []).append(int(match[2]))
    single = [n for n in sorted(found) if found[n] == [0]]
    return [f"{n}_0" for n in single], {str(n): [f"{n}_{b}" for b in sorted(found[n])] for n in sorted(found) if n not in single}


def filled_values(table: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, n): how many rows of ``table`` have a value in each column."""
    counts = table.agg(*[F.count(F.col(c)).alias(f"_{i}") for i, c in enumerate(columns)])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_{i}").alias("n")) for i, c in enumerate(columns)])))


def grouped_features(table: DataFrame) -> DataFrame:
    """(feature, kind, place, n): :func:`feature_groups` of a table's columns, and how many rows have a value there."""
    numerical, histograms = feature_groups(table.columns)
    kinds = dict.fromkeys(numerical, "numerical") | {c: "histogram" for bins in histograms.values() for c in bins}
    places = {c: i for i, c in enumerate(kinds)}
    of = lambda held: F.element_at(F.create_map(*[F.lit(x) for pair in held.items() for x in pair]), F.col("feature"))
    return filled_values(table, list(kinds)).select("feature", of(kinds).alias("kind"), of(places).alias("place"), "n")


def static_columns(columns: list[str]) -> list[str]:
    return [c for c in columns if c.startswith(STATIC)]


def predictors_and_targets(table: DataFrame, key: str = "vehicle_id") -> tuple[DataFrame, DataFrame]:
    """All but duration and event, and these two; both have the key."""
    return table.drop(*TARGETS), table.select(key, *TARGETS)


def continuous_columns(table: DataFrame, key: str = "vehicle_id") -> list[str]:
    """Numerical columns that aren't the key, a target or made of a category."""
    kinds = dict(table.dtypes)
    return [c for c in table.columns if kinds[c] in ("double", "float", "bigint", "int") and c != key and c not in TARGETS and not c.startswith(STATIC)]


def census(table: DataFrame, key: str = "vehicle_id") -> DataFrame:
    """(kind, features, filled): of a table's features that are of a numerical column, a histogram, gaps or the rest how many there are, and how many values they have."""
    features = [c for c in table.columns if c != key]
    bases = {f: m[0] for f in features if (m := re.match(r"\d+_\d+", f))}
    numerical, _ = feature_groups(list(dict.fromkeys(bases.values())))

    def kind(feature: str) -> str:
        if feature in bases:
            return "numerical" if bases[feature] in numerical else "histogram"
        return "gap" if feature.startswith("gap_") else "metadata"

    of = F.element_at(F.create_map(*[F.lit(x) for f in features for x in (f, kind(f))]), F.col("feature"))
    return filled_values(table, features).groupBy(of.alias("kind")).agg(F.count(F.lit(1)).alias("features"), F.sum("n").alias("filled"))


def aligned(table: DataFrame, columns: list[str]) -> DataFrame:
    """Just ``columns``, in order: 0 where there is no such column or no value."""
    return table.select(*[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c) if c in table.columns else F.lit(0).alias(c) for c in columns])


def flattened(table: DataFrame, without: tuple[str, ...] = ()) -> DataFrame:
    """Nested structs as columns parent_child; fields named in ``without`` are left out."""

    def fields(kind: StructType, path: str, name: str) -> list[Column]:
        out = []
        for f in kind.fields:
            if f.name in without:
                continue
            at, own = f"{path}`{f.name}`", f"{name}{f.name}"
            out += fields(f.dataType, f"{at}.", f"{own}_") if isinstance(f.dataType, StructType) else [F.col(at).alias(own)]
        return out

    return table.select(*fields(table.schema, "", ""))


def shown(value: str, places: int = 3) -> Column:
    """A number with so many places, or a dash where there is none."""
    return F.when(F.col(value).isNull(), F.lit("—")).otherwise(F.format_string(f"%.{places}f", F.col(value).cast("double")))


def one_to_one(left: DataFrame, right: DataFrame, key: str = "vehicle_id") -> DataFrame:
    """The inner join on ``key``; a key that either side has twice is an error."""

    def single(table: DataFrame, side: str) -> DataFrame:
        rest = [c for c in table.columns if c != key]
        counts = table.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*rest)).alias("_row"))
        message = F.concat(F.lit(f"{side} has more than one row of {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
        return counts.select(F.when(F.col("_n") > 1, F.raise_error(message).cast(table.schema[key].dataType)).otherwise(F.col(key)).alias(key), "_row.*")

    return single(left, "left").join(single(right, "right"), key)


def with_targets(features: DataFrame, targets: DataFrame, key: str = "vehicle_id") -> DataFrame:
    """``features`` and the targets of the same key; rows without targets go."""
    return features.join(targets.select(key, *TARGETS), key)


def survival_target(table: DataFrame) -> DataFrame:
    """(vehicle_id, target): a struct of event, as a boolean, and duration."""
    return table.select("vehicle_id", F.struct((F.col("event") == 1).alias("event"), F.col("duration").cast("double").alias("duration")).alias("target"))
