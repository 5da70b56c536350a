"""What a stream gives, batch after batch, is what the batch operators give of all rows."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions.transforms import forward_fill
from tidemark.operators.sequences import build_sequences
from tidemark.streaming.readouts import followed


@pytest.mark.parametrize("idle_hours", [None, 24])
def test_stream_equals_batch(spark, tmp_path, idle_hours):
    rows = [(v, 10 * t + v, float(t // 2 * 3), None if (t + v) % 3 == 0 else float(t * v)) for v in (1, 2, 3) for t in range(12)]
    readouts = spark.createDataFrame(rows, "vehicle_id bigint, rid bigint, time_step double, `1_0` double")
    for i in range(3):
        readouts.filter(F.col("time_step").between(6 * i, 6 * i + 5)).coalesce(1).write.parquet(f"{tmp_path}/in/batch={i}")
    stream = spark.readStream.schema(readouts.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    got = followed(stream, "1_0", f"{tmp_path}/out", idle_hours)
    names = ["vehicle_id", "rid", "time_step", "seq_idx", "time_gap", "value"]
    want = forward_fill(build_sequences(readouts), ["1_0"]).withColumnRenamed("1_0", "value")
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(map(tuple, want.select(*names).collect()))
