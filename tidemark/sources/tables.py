"""Readers, writers, and the bindings of stored tables to readouts and vehicles."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A CSV file with a header, by a given schema; a path that isn't there is an AnalysisException."""
    return spark.read.schema(schema).option("header", True).csv(path)


def write_csv(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").option("header", True).csv(path)


def write_split_tables(table: DataFrame, path: str, split: str = "split") -> None:
    """Sequences or features of all splits as one table, a folder a split."""
    table.write.mode("overwrite").partitionBy(split).parquet(path)


def order_readouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as vehicles, orders as readouts: one numerical column that is null in every seventh order."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("vehicle_id"),
        F.col("o_orderkey").alias("rid"),
        F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")).cast("double").alias("time_step"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("1_0"),
        F.col("o_orderstatus").alias("status"),
    )


def order_vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with specifications, and an event if their last order has status F; observed 30 days longer."""
    last = order_readouts(spark, sf_dir).groupBy("vehicle_id").agg(F.max("time_step").alias("last"), F.max_by("status", F.struct("time_step", "rid")).alias("status"))
    specs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("vehicle_id"), F.col("c_mktsegment").alias("Spec_0"), F.col("c_nationkey").cast("string").alias("Spec_1"))
    return specs.join(last, "vehicle_id").select("vehicle_id", "Spec_0", "Spec_1", (F.col("last") + 30).alias("duration"), (F.col("status") == "F").cast("int").alias("event"))


#: The histogram of event readouts counts these, one bin each, in this order (fixed values of the stored table).
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
EVENT_BINS = [f"2_{i}" for i in range(len(EVENT_TYPES))]


def _as_readouts(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").alias("vehicle_id"),
        F.col("event_id").alias("rid"),
        (F.timestamp_diff("SECOND", F.lit("2024-01-01").cast("timestamp_ntz"), "ts") / 3600.0).alias("time_step"),
        F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("1_0"),
        F.col("event_type").alias("status"),
    )


def streamed_readouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readouts of :func:`event_readouts` without their histogram, as a stream of the files of the table."""
    schema = table(spark, sf_dir, "events").schema
    return _as_readouts(spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*"))


def event_readouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as vehicles, events as readouts: a numerical column, null in every eleventh event, and a cumulative histogram of event types, null in every thirteenth."""
    held = _as_readouts(table(spark, sf_dir, "events"))
    order = Window.partitionBy("vehicle_id").orderBy("time_step", "rid").rowsBetween(Window.unboundedPreceding, 0)
    counts = {c: F.when(F.col("rid") % 13 != 0, F.count_if(F.col("status") == kind).over(order).cast("double")) for c, kind in zip(EVENT_BINS, EVENT_TYPES)}
    return held.withColumns(counts)


def event_vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that have events as users: an event if their last one is a click or an error; observed one to seven days longer."""
    last = event_readouts(spark, sf_dir).groupBy("vehicle_id").agg(F.max("time_step").alias("last"), F.max_by("status", F.struct("time_step", "rid")).alias("status"))
    specs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("vehicle_id"), F.col("c_mktsegment").alias("Spec_0"), F.col("c_nationkey").cast("string").alias("Spec_1"))
    return specs.join(last, "vehicle_id").select("vehicle_id", "Spec_0", "Spec_1", (F.col("last") + 24 * (1 + F.col("vehicle_id") % 7)).alias("duration"), F.col("status").isin("click", "error").cast("int").alias("event"))


def read_raw_tables(spark: SparkSession, folder: str, schemas: dict[str, StructType | str]) -> dict[str, DataFrame]:
    """The CSV files ``name``.csv of a folder, by name, each by its schema."""
    return {name: read_csv(spark, f"{folder}/{name}.csv", schema) for name, schema in schemas.items()}


def write_processed(features: dict[str, DataFrame], targets: dict[str, DataFrame], folder: str) -> None:
    """Predictors and targets of each split: X_``split`` and y_``split`` below ``folder``."""
    for kind, tables in (("X", features), ("y", targets)):
        for split, rows in tables.items():
            rows.write.mode("overwrite").parquet(f"{folder}/{kind}_{split}")


def read_processed(spark: SparkSession, folder: str, splits: tuple[str, ...] = ("train", "val")) -> dict[str, DataFrame]:
    """What :func:`write_processed` wrote of ``splits``: X_``split`` and y_``split``."""
    return {f"{kind}_{split}": spark.read.parquet(f"{folder}/{kind}_{split}") for split in splits for kind in ("X", "y")}


def write_json(rows: DataFrame, path: str) -> None:
    """A JSON object a row."""
    rows.write.mode("overwrite").json(path)


def write_list(spark: SparkSession, items: list, path: str, name: str = "value") -> None:
    """A short list, such as column names, as JSON rows in order."""
    kind = "double" if any(isinstance(i, float) for i in items) else "bigint" if items and all(isinstance(i, int) for i in items) else "string"
    write_json(spark.createDataFrame(list(enumerate(items)), f"place bigint, {name} {kind}").coalesce(1), path)


def read_list(spark: SparkSession, path: str, name: str = "value") -> list:
    return [r[name] for r in spark.read.json(path).orderBy("place").collect()]


def write_dict(spark: SparkSession, data: dict, path: str) -> None:
    """A small dictionary, such as fitted parameters or metrics, as one JSON object."""
    spark.createDataFrame([(json.dumps(data),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_dict(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))


def write_latex(rows: DataFrame, path: str, places: int = 3) -> None:
    """A table of results as LaTeX, in its order; it is of a size to be read."""
    text = lambda v: "--" if v is None else f"{v:.{places}f}" if isinstance(v, float) else str(v)
    safe = lambda v: re.sub(r"([&%$#_{}])", r"\\\1", text(v))
    body = [" & ".join(map(safe, r)) + r" \\" for r in [rows.columns, *rows.collect()]]
    lines = [r"\begin{tabular}{" + "l" * len(rows.columns) + "}", r"\toprule", body[0], r"\midrule", *body[1:], r"\bottomrule", r"\end{tabular}"]
    rows.sparkSession.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_artifacts(folder: str, sequences: DataFrame, **fitted: DataFrame) -> None:
    """Sequences of all splits, a folder a split, and tables of fitted parameters (normalizer, vocabulary, gap scaler) beside them."""
    write_split_tables(sequences, f"{folder}/sequences")
    for name, rows in fitted.items():
        rows.write.mode("overwrite").parquet(f"{folder}/{name}")


def read_artifacts(spark: SparkSession, folder: str, *fitted: str, split: str | None = None) -> dict[str, DataFrame]:
    """What :func:`write_artifacts` wrote; of one split only its folder is read."""
    rows = spark.read.parquet(f"{folder}/sequences")
    return {"sequences": rows if split is None else rows.filter(F.col("split") == split)} | {name: spark.read.parquet(f"{folder}/{name}") for name in fitted}
