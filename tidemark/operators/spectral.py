"""Spectra of sequences, and pooling over their readouts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.sequences import packed


#: Readouts of a sequence that is transformed as a whole, at most.
WHOLE = 1 << 20


def frequency_representation(sequences: DataFrame, columns: list[str], whole: int = WHOLE) -> DataFrame:
    """(vehicle_id, bin, one column for each of ``columns``): log1p of the size of each bin of the Fourier transform over the readouts of a vehicle.

    A sequence of n readouts has n // 2 + 1 bins.  Its columns are transformed
    as arrays, so rows grow with n; readouts of a sequence of more than
    ``whole`` meet its bins and are added up there, so it is never held whole.
    A null counts as null in every bin of its sequence.
    """
    short = packed(sequences.filter(F.col("sequence_length") <= whole), columns)
    key = short.schema["vehicle_id"].dataType.simpleString()
    names = [f"_{i}" for i in range(len(columns))]

    def transformed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[np.log1p(np.abs(np.fft.rfft(np.array(v, float))) + 1e-8).tolist() for v in batch[n].to_pylist()] for n in names]
            yield pa.RecordBatch.from_arrays([batch["vehicle_id"], *[pa.array(v, pa.list_(pa.float64())) for v in found]], names=["vehicle_id", *names])

    arrays = short.select("vehicle_id", *[F.col(c).cast("array<double>").alias(n) for c, n in zip(columns, names)]).mapInArrow(transformed, f"vehicle_id {key}, " + ", ".join(f"{n} array<double>" for n in names))
    bins = arrays.select("vehicle_id", F.posexplode(F.arrays_zip(*names)).alias("bin", "_z"))
    value = lambda n: F.when(~F.isnan(f"_z.{n}"), F.col(f"_z.{n}"))
    out = bins.select("vehicle_id", F.col("bin").cast("bigint").alias("bin"), *[value(n).alias(c) for c, n in zip(columns, names)])
    return out.unionByName(_added_up(sequences.filter(F.col("sequence_length") > whole), columns))


def _added_up(sequences: DataFrame, columns: list[str]) -> DataFrame:
    """The same of long sequences: each readout meets its own vehicle's bins."""
    angle = -2 * math.pi * F.pmod((F.col("seq_idx") - 1) * F.col("bin"), F.col("sequence_length")) / F.col("sequence_length")
    met = sequences.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("sequence_length") / 2)))).withColumn("_a", angle)
    parts = [x for c in columns for x in (F.sum(F.col(c) * F.cos("_a")).alias(f"{c}|re"), F.sum(F.col(c) * F.sin("_a")).alias(f"{c}|im"))]
    held = met.groupBy("vehicle_id", "bin").agg(*parts)
    return held.select("vehicle_id", "bin", *[F.log1p(F.sqrt(F.col(f"`{c}|re`") ** 2 + F.col(f"`{c}|im`") ** 2) + 1e-8).alias(c) for c in columns])


def masked_mean(rows: DataFrame, columns: list[str], valid: str = "valid", key: str = "vehicle_id") -> DataFrame:
    """(``key``, columns): the mean over valid rows; 0 where there are none."""
    n = F.greatest(F.count_if(F.col(valid)), F.lit(1))
    return rows.groupBy(key).agg(*[(F.coalesce(F.sum(F.when(F.col(valid), F.col(c))), F.lit(0.0)) / n).alias(c) for c in columns])
