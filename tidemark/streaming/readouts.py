"""Gaps, places and filled values of readouts as they arrive, as the batch operators give them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Milliseconds.
HOUR = 3_600_000
OUT = "vehicle_id bigint, rid bigint, time_step double, seq_idx bigint, time_gap double, value double"


def _follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, idle: int | None) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    rows = pd.concat(list(frames)).sort_values(["time_step", "rid"], kind="stable", ignore_index=True)
    count, last, value = state.get if state.exists else (0, None, 0.0)
    before = rows["time_step"].shift(1)
    if last is not None:
        before.iloc[0] = last
    filled = rows["value"].ffill().fillna(value)
    state.update((count + len(rows), float(rows["time_step"].iloc[-1]), float(filled.iloc[-1])))
    if idle:
        state.setTimeoutTimestamp(max(int(rows["time_step"].iloc[-1] * HOUR) + 2 * idle + 1, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame({"vehicle_id": key[0], "rid": rows["rid"], "time_step": rows["time_step"], "seq_idx": count + 1 + rows.index, "time_gap": (rows["time_step"] - before).fillna(0.0), "value": filled})


def streamed_sequences(readouts: DataFrame, column: str, idle_hours: float | None = None) -> DataFrame:
    """(vehicle_id, rid, time_step, seq_idx, time_gap, value) of a stream of readouts: place, gap, and ``column`` filled forward, 0 before its first value.

    The state of a vehicle is three numbers.  A vehicle's readouts arrive in
    order of time from batch to batch; within a batch any order will do.  One
    that comes late follows what was there when it came, with a negative gap.
    ``idle_hours``: the state of a vehicle goes once the stream's time is so far
    past its last readout; what comes so late as that is dropped.  Without it
    states stay.
    """
    idle = int(idle_hours * HOUR) if idle_hours else None
    held = readouts.selectExpr("vehicle_id", "cast(rid as bigint) rid", "cast(time_step as double) time_step", f"cast(`{column}` as double) value")
    if idle:
        at = (F.col("time_step") * HOUR).cast("bigint") + idle + 1  # a stream's time begins above 0
        held = held.withColumn("at", F.timestamp_millis(at)).withWatermark("at", f"{idle} milliseconds")
    timeout = GroupStateTimeout.EventTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return held.groupBy("vehicle_id").applyInPandasWithState(lambda key, frames, state: _follow(key, frames, state, idle), OUT, "count bigint, last double, value double", "append", timeout)


def followed(readouts: DataFrame, column: str, path: str, idle_hours: float | None = None) -> DataFrame:
    """What :func:`streamed_sequences` gives of all that a stream has now, written below ``path`` and read again; a later call goes on from there."""
    query = streamed_sequences(readouts, column, idle_hours).writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return readouts.sparkSession.read.schema(OUT).parquet(f"{path}/rows")
