"""Survival curves, losses and metrics over (vehicle_id, risk, duration, event)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranks import cuts_of, parts_for, percentiles, range_of, running_sums
from tidemark.sources.stored import stored


def _by_time(table: DataFrame) -> DataFrame:
    """(time, gone, events, at_risk), stored in ranges of times: rows are added up by time first, so running sums are over distinct times."""
    counts = table.groupBy(F.col("duration").cast("double").alias("time")).agg(F.count(F.lit(1)).alias("gone"), F.sum("event").cast("bigint").alias("events")).filter("time IS NOT NULL")
    return stored(running_sums(counts, "time", {"at_risk": F.col("gone")}, descending=True, ranged=True))


def _product(table: DataFrame, lost: Column, at_risk: Column) -> DataFrame:
    """``table`` and survival: the product of 1 - lost / at_risk up to each time."""
    last = (lost > 0) & (lost == at_risk)
    log = F.when(last | (lost == 0), 0.0).otherwise(F.log1p(-lost / at_risk))
    held = running_sums(table, "time", {"_log": log, "_last": last.cast("int")})
    return held.withColumn("survival", F.when(F.col("_last") > 0, 0.0).otherwise(F.exp("_log"))).drop("_log", "_last")


def kaplan_meier(table: DataFrame) -> DataFrame:
    """(time, at_risk, events, survival) at each distinct time with an event."""
    held = _by_time(table).filter("events > 0")
    return _product(held, F.col("events"), F.col("at_risk")).select("time", "at_risk", "events", "survival")


def censoring_survival(table: DataFrame) -> DataFrame:
    """(time, survival) of the censoring times at each distinct time; at ties events leave before censored rows."""
    return _product(_by_time(table), F.col("gone") - F.col("events"), F.col("at_risk") - F.col("events")).select("time", "survival")


def step_value(points: DataFrame, steps: DataFrame, at: str, value: str, before: float) -> DataFrame:
    """``points`` and ``value``: that of the last step (time, ``value``) at or before the column ``at``; ``before`` if there is none.

    Distinct points and steps are merged in one order of times.
    """
    marks = steps.select(F.col("time").alias("_t"), F.col(value).alias("_v")).unionByName(points.select(F.col(at).cast("double").alias("_t")).distinct().withColumn("_v", F.lit(None).cast("double")))
    merged = marks.groupBy("_t").agg(F.max("_v").alias("_v"))
    held = running_sums(merged, "_t", {"_k": F.col("_v").isNotNull().cast("bigint")})
    known = held.filter("_v IS NOT NULL").select("_k", F.col("_v").alias("_w"))
    found = held.select("_t", "_k").join(known, "_k", "left").select(F.col("_t"), F.coalesce("_w", F.lit(before)).alias(value))
    return points.join(found, points[at].cast("double") == found["_t"], "left").drop("_t")


def _at_risk(table: DataFrame) -> DataFrame:
    """(time, events, hazard): by distinct time, events and the sum of exp(risk) of all that last as long or longer."""
    by_time = table.groupBy(F.col("duration").cast("double").alias("time")).agg(F.sum("event").cast("bigint").alias("events"), F.sum(F.exp("risk")).alias("_own")).filter("time IS NOT NULL")
    return running_sums(by_time, "time", {"hazard": F.col("_own")}, descending=True, ranged=True).drop("_own")


def cox_loss(table: DataFrame) -> DataFrame:
    """One row: events and the mean negative log partial likelihood over them; equal durations share a risk set; 0 without events."""
    found = table.filter("event = 1").join(_at_risk(table), F.col("duration").cast("double") == F.col("time"))
    return found.agg(F.count(F.lit(1)).alias("n_events"), F.coalesce(F.avg(F.log("hazard") - F.col("risk")), F.lit(0.0)).alias("loss"))


def breslow_baseline(table: DataFrame) -> DataFrame:
    """(time, cumulative_hazard) of the baseline at each distinct time with an event."""
    steps = stored(_at_risk(table).filter("events > 0").withColumn("_step", F.col("events") / F.col("hazard")))
    return running_sums(steps, "time", {"cumulative_hazard": F.col("_step")}).select("time", "cumulative_hazard")


def survival_curves(table: DataFrame, baseline: DataFrame, grid: DataFrame) -> DataFrame:
    """(vehicle_id, time, survival): exp(-H0(t) * exp(risk)) at each time of ``grid`` (time), which is of a bounded size."""
    at = step_value(grid, stored(baseline), "time", "cumulative_hazard", 0.0)
    return table.select("vehicle_id", "risk").crossJoin(F.broadcast(at)).select("vehicle_id", "time", F.exp(-F.col("cumulative_hazard") * F.exp("risk")).alias("survival"))


def time_grid(test: DataFrame, train: DataFrame, n: int = 100, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """(time): ``n`` even steps between two percentiles of the test durations, those strictly within the train durations."""
    ends = percentiles(test, "duration", (low, high)).select(F.col("p0").alias("a"), F.col("p1").alias("b"))
    bounds = train.agg(F.min("duration").alias("lo"), F.max("duration").alias("hi"))
    even = ends.select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")).select((F.col("a") + (F.col("b") - F.col("a")) * F.col("i") / (n - 1)).alias("time"))
    return even.crossJoin(F.broadcast(bounds)).filter((F.col("time") > F.col("lo")) & (F.col("time") < F.col("hi"))).select("time").distinct()


def baseline_grid(baseline: DataFrame, test: DataFrame, train: DataFrame, n: int = 100) -> DataFrame:
    """(time): times of the baseline that lie in both ranges of durations, thinned to ``n`` by even places among them."""
    ends = test.agg(F.min("duration").alias("a"), F.max("duration").alias("b")).crossJoin(train.agg(F.min("duration").alias("lo"), F.max("duration").alias("hi")))
    inside = baseline.select("time").crossJoin(F.broadcast(ends)).filter("time >= a AND time < b AND time > lo AND time < hi").select("time")
    placed = running_sums(inside, "time", {"place": F.lit(1).cast("bigint")})
    total = placed.agg(F.max("place").alias("held"))
    i = F.explode(F.sequence(F.lit(0), F.least(F.lit(n), F.col("held")).cast("int") - 1)).alias("i")
    picks = total.filter("held > 0").select("held", i).select(F.floor(F.when(F.least(F.lit(n), F.col("held")) > 1, F.col("i") * (F.col("held") - 1) / (F.least(F.lit(n), F.col("held")) - 1)).otherwise(0.0) + 1e-9).cast("bigint").alias("pick")).distinct()
    return placed.join(F.broadcast(picks), F.col("place") - 1 == F.col("pick")).select("time")


def weighted_events(test: DataFrame, train: DataFrame) -> DataFrame:
    """``test`` and weight: of an event the inverse of the probability, by the train rows, of not being censored by then; else 0."""
    held = step_value(test, stored(censoring_survival(train).withColumnRenamed("survival", "_g")), "duration", "_g", 1.0)
    return held.withColumn("weight", F.when(F.col("event") == 1, F.try_divide(F.lit(1.0), F.col("_g"))).otherwise(0.0)).drop("_g")


def dynamic_auc(test: DataFrame, train: DataFrame, grid: DataFrame, parts: int | None = None) -> DataFrame:
    """(time, auc): at each time of ``grid``, how often an event by then has the larger risk than a row that lasts longer.

    Events are weighted by :func:`weighted_events`; equal risks count half.
    Rows are dealt to ranges of risks and stored once.  Of a range only its sums
    at each time reach the driver; pairs within it are counted in its own task,
    a time after the other, and a risk that many rows share needs its sums only.
    """
    times = sorted(r["time"] for r in grid.select("time").distinct().collect())
    rows = weighted_events(test, train).select(F.col("risk").cast("double").alias("r"), F.col("duration").cast("double").alias("t"), (F.col("event") == 1).alias("e"), "weight").filter("r IS NOT NULL")
    held = stored(rows)
    cuts, _ = cuts_of(held, "r", parts or parts_for(held.count()))
    held = held.withColumn("range", range_of(F.col("r"), cuts))
    case = lambda at: F.coalesce(F.sum(F.when((F.col("t") <= at) & F.col("e"), F.col("weight"))), F.lit(0.0))
    control = lambda at: F.count_if(F.col("t") > at).cast("double")
    sums = F.array(*[f(at) for f in (case, control) for at in times]) if times else F.array().cast("array<double>")
    found = held.groupBy("range").agg(F.min("r").alias("lo"), F.max("r").alias("hi"), sums.alias("v")).orderBy("range").collect()  # a row a range
    cases, controls, won = np.zeros(len(times)), np.zeros(len(times)), np.zeros(len(times))
    below = {}
    for r in found:
        own = np.array(r["v"]).reshape(2, -1)
        below[r["range"]] = controls
        if r["lo"] == r["hi"]:
            won = won + own[0] * (controls + own[1] / 2)
        cases, controls = cases + own[0], controls + own[1]

    def within(rows: pa.Table) -> pa.Table:
        r, t, e, w = (rows[c].to_numpy(zero_copy_only=False) for c in ("r", "t", "e", "weight"))
        order = np.argsort(r)
        r, t, e, w = r[order], t[order], e[order].astype(bool), np.nan_to_num(w[order].astype(float))
        low, high, before = np.searchsorted(r, r), np.searchsorted(r, r, "right"), below[rows["range"][0].as_py()]
        out = []
        for k, at in enumerate(times):
            upto = np.append(0, np.cumsum(t > at))
            i = np.flatnonzero((t <= at) & e)
            out.append(float((w[i] * (before[k] + (upto[low[i]] + upto[high[i]]) / 2)).sum()))
        return pa.table({"won": pa.array([out], pa.list_(pa.float64()))})

    mixed = [r["range"] for r in found if r["lo"] < r["hi"]]
    if mixed and times:
        parted = held.filter(F.col("range").isin(mixed)).groupBy("range").applyInArrow(within, "won array<double>")
        won = won + np.array(parted.agg(F.array(*[F.sum(F.col("won")[k]) for k in range(len(times))]).alias("w")).first()["w"])
    rows = [(at, float(x / (a * b)) if a * b else None) for at, x, a, b in zip(times, won, cases, controls)]
    return test.sparkSession.createDataFrame(rows, "time double, auc double")


def mean_auc(auc: DataFrame, test: DataFrame) -> DataFrame:
    """One row, mean_auc: over the grid, weighted by how much the survival of the test rows falls up to each time."""
    curve = step_value(auc, kaplan_meier(test), "time", "survival", 1.0)
    falls = curve.withColumn("_fall", F.coalesce(F.lag("survival").over(Window.orderBy("time")), F.lit(1.0)) - F.col("survival"))  # a row a time of the grid
    return falls.agg(F.try_divide(F.sum(F.col("auc") * F.col("_fall")), 1 - F.min("survival")).alias("mean_auc"))


def brier_scores(test: DataFrame, train: DataFrame, curves: DataFrame) -> DataFrame:
    """(time, brier): the mean weighted squared error of ``curves`` (vehicle_id, time, survival) at each of their times."""
    weighted = weighted_events(test, train).select("vehicle_id", "duration", "event", "weight")
    at = stored(censoring_survival(train).withColumnRenamed("survival", "_g"))
    grid = step_value(curves.select("time").distinct(), at, "time", "_g", 1.0)
    rows = curves.join(weighted, "vehicle_id").join(F.broadcast(grid), "time")
    gone = F.when((F.col("duration") <= F.col("time")) & (F.col("event") == 1), F.pow("survival", F.lit(2)) * F.col("weight")).otherwise(0.0)
    there = F.when(F.col("duration") > F.col("time"), F.try_divide(F.pow(1 - F.col("survival"), F.lit(2)), F.col("_g"))).otherwise(0.0)
    return rows.groupBy("time").agg(F.avg(gone + there).alias("brier"))


def integrated_brier(scores: DataFrame) -> DataFrame:
    """One row, integrated_brier: the trapezoid over the times of ``scores``, by their span."""
    order = Window.orderBy("time")  # a row a time of the grid
    area = (F.col("time") - F.lag("time").over(order)) * (F.col("brier") + F.lag("brier").over(order)) / 2
    return scores.withColumn("_area", area).agg(F.try_divide(F.sum("_area"), F.max("time") - F.min("time")).alias("integrated_brier"))


def nearest_to_percentiles(table: DataFrame, value: str, shares: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """(share, cut, vehicle_id): the row nearest to each percentile, the smaller id on ties."""
    found = percentiles(table, value, shares)
    cuts = found.select(F.inline(F.array(*[F.struct(F.lit(s).alias("share"), F.col(f"p{i}").alias("cut")) for i, s in enumerate(shares)])))
    near = table.crossJoin(F.broadcast(cuts)).groupBy("share", "cut")  # a row for each share
    return near.agg(F.min_by("vehicle_id", F.struct(F.abs(F.col(value) - F.col("cut")), "vehicle_id")).alias("vehicle_id"))


def leaderboard(table: DataFrame, by: str = "c_index") -> DataFrame:
    """``table`` (model, split and metrics) with place: the best first, by name on ties."""
    return table.withColumn("place", F.row_number().over(Window.partitionBy("split").orderBy(F.desc(by), "model")))
