"""Proportional hazards by Newton's method over ranges of durations, with Efron's handling of ties."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.transforms import fit_normalizer, normalize
from tidemark.operators.concordance import concordance
from tidemark.operators.ranks import cuts_of, parts_for, range_of


@dataclass
class CoxModel:
    """Coefficients of ``features``, as they are scaled by ``scaler`` (a mean and a deviation each)."""

    features: list[str]
    scaler: dict[str, float]
    beta: np.ndarray
    log_likelihood: float
    steps: int

    def coefficients(self, spark: SparkSession) -> DataFrame:
        rows = [(f, float(b), float(np.exp(b))) for f, b in zip(self.features, self.beta)]
        return spark.createDataFrame(rows, "feature string, coefficient double, hazard_ratio double")

    def score(self, table: DataFrame, name: str = "partial_hazard") -> DataFrame:
        """``table`` and the hazard of each row by that of the mean of the train rows."""
        z = [(F.col(f) - self.scaler[f"{f}_mean"]) / self.scaler[f"{f}_std"] * float(b) for f, b in zip(self.features, self.beta)]
        return table.withColumn(name, F.exp(sum(z[1:], z[0])))


def _unpacked(rows: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = rows["x"].combine_chunks() if isinstance(rows, pa.Table) else rows["x"]
    return rows["t"].to_numpy(), rows["e"].to_numpy(), x.flatten().to_numpy().reshape(rows.num_rows, -1)


def _moments(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sums of w, w x and w x x', in one vector."""
    return np.concatenate([[w.sum()], w @ x, ((x * w[:, None]).T @ x).ravel()])


#: Events of one time whose terms are worked out at a time.
EVENTS_AT_ONCE = 4096


def _terms(later: np.ndarray, risk: np.ndarray, dead: np.ndarray, d: int, x_sum: np.ndarray, eta: float, p: int) -> np.ndarray:
    """What the d events of one time add to the log likelihood, its gradient and its negative second derivative."""
    out = np.concatenate([[eta], x_sum, np.zeros(p * p)])
    for at in range(0, d, EVENTS_AT_ONCE):
        k = np.arange(at, min(d, at + EVENTS_AT_ONCE))
        s = (later + risk) - np.outer(k / d, dead)
        mean = s[:, 1 : p + 1] / s[:, :1]
        out[0] -= np.log(s[:, 0]).sum()
        out[1 : p + 1] -= mean.sum(0)
        out[p + 1 :] += (1 / s[:, 0]) @ s[:, p + 1 :] - (mean.T @ mean).ravel()
    return out


def _range_terms(t: np.ndarray, e: np.ndarray, x: np.ndarray, beta: np.ndarray, later: np.ndarray) -> np.ndarray:
    """:func:`_terms` of all times of a range, from the last to the first; ``later`` are the moments of the ranges behind it."""
    p = len(beta)
    out, s = np.zeros(1 + p + p * p), later.copy()
    order = np.argsort(-t, kind="stable")
    t, e, x = t[order], e[order], x[order]
    eta = x @ beta
    w = np.exp(eta)
    head = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
    for a, b in zip(head.tolist(), np.append(head[1:], len(t)).tolist()):
        own, dead = _moments(w[a:b], x[a:b]), e[a:b] == 1
        if dead.any():
            out += _terms(s, own, _moments(w[a:b][dead], x[a:b][dead]), int(dead.sum()), x[a:b][dead].sum(0), float(eta[a:b][dead].sum()), p)
        s += own
    return out


def _terms_of(beta: np.ndarray, behind: dict[int, np.ndarray]):
    def terms(table: pa.Table) -> pa.Table:
        out = _range_terms(*_unpacked(table), beta, behind[table["range"][0].as_py()])
        return pa.table({"range": table["range"][:1], "v": pa.array([out.tolist()], pa.list_(pa.float64()))})

    return terms


def fit_cox(train: DataFrame, features: list[str], penalizer: float = 0.1, steps: int = 30, tol: float = 1e-9, parts: int | None = None) -> CoxModel:
    """Maximise (log partial likelihood) / n - ``penalizer`` / 2 * |beta|^2 over scaled ``features``.

    ``train`` has duration, event and ``features``; rows with a null duration
    or event don't count, a missing feature is an error.  Each step takes two
    passes: one sums up moments of ranges of durations, within each partition
    first; the next adds the terms of each range's times, given the ranges
    behind it.  A range that is a single duration, however many rows have it,
    needs its sums only; without ``parts`` there are as many ranges as the rows ask for.  The driver sees a vector of 1 + p + p * p numbers a
    range.  Without events all coefficients are 0.
    """
    held = train.dropna(subset=["duration", "event"])
    fitted = fit_normalizer(held, features)
    scaler = fitted.first().asDict()
    p = len(features)
    cuts, _ = cuts_of(held, "duration", parts or parts_for(held.count()))
    z = normalize(held, fitted, features)
    rows = z.select(range_of(F.col("duration"), cuts).alias("range"), F.col("duration").cast("double").alias("t"), F.col("event").cast("int").alias("e"), F.array(*[F.col(f).cast("double") for f in features]).alias("x"))
    rows = rows.persist()
    facts = {r["range"]: r for r in rows.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi"), F.sum("e").alias("d")).collect()}
    n = sum(r["n"] for r in facts.values())
    several = sorted(k for k, r in facts.items() if r["lo"] < r["hi"] and r["d"])
    beta, value, step = np.zeros(p), -np.inf, 0

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            _, e, x = _unpacked(batch)
            of, eta = batch["range"].to_numpy(), x @ beta
            for k in np.unique(of).tolist():
                i = of == k
                j = i & (e == 1)
                own = np.concatenate([_moments(np.exp(eta[i]), x[i]), _moments(np.exp(eta[j]), x[j]), x[j].sum(0), [eta[j].sum()]])
                total[k] = total.get(k, 0) + own
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], names=["range", "v"])

    def added(table: pa.Table) -> pa.Table:
        total = np.stack([np.array(v) for v in table["v"].to_pylist()]).sum(0)
        return pa.table({"range": table["range"][:1], "v": pa.array([total.tolist()], pa.list_(pa.float64()))})

    try:
        for step in range(1, steps + 1):
            kind = "range int, v array<double>"
            found = {r["range"]: np.array(r["v"]) for r in rows.mapInArrow(sums, kind).groupBy("range").applyInArrow(added, kind).collect()}
            q = 1 + p + p * p
            later, behind = np.zeros(q), {}
            for k in sorted(found, reverse=True):
                behind[k], later = later, later + found[k][:q]
            total = np.zeros(q)
            for k, v in found.items():
                if facts[k]["lo"] == facts[k]["hi"] and facts[k]["d"]:
                    total += _terms(behind[k], v[:q], v[q : 2 * q], facts[k]["d"], v[2 * q : 2 * q + p], float(v[-1]), p)

            if several:
                total += sum(np.array(r["v"]) for r in rows.filter(F.col("range").isin(several)).groupBy("range").applyInArrow(_terms_of(beta, behind), kind).collect())
            new = total[0] / n - penalizer / 2 * beta @ beta
            if abs(new - value) < tol:
                break
            value = new
            gradient = total[1 : p + 1] / n - penalizer * beta
            curvature = total[p + 1 :].reshape(p, p) / n + penalizer * np.eye(p)
            beta = beta + np.linalg.lstsq(curvature, gradient, rcond=None)[0]
    finally:
        rows.unpersist()
    return CoxModel(features, scaler, beta, float(total[0]) if n else 0.0, step)


def evaluate_cox(train: DataFrame, test: DataFrame, features: list[str], penalizer: float = 0.1) -> tuple[CoxModel, DataFrame]:
    """The model of ``train``, and the concordance of its hazards on ``test``."""
    model = fit_cox(train, features, penalizer)
    return model, concordance(model.score(test, "risk"))
