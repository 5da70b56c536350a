"""Training of networks as Spark jobs: a run of small steps, or a step of many batches, is one job.

An epoch's sequences are dealt to batches by a permutation of their places and
stored by runs of steps.  Each step needs the weights of the one before.  So
steps of one batch, or of few values, are walked through in one task, a bounded
run of them at a time, which reads its own run only and gives the state for the
next one; what batches read that needs no weights (views, spectra) is drawn
before, side by side, and stored in their place.  The next runs, also those of the
next epoch, are dealt and drawn beside the steps of this one, a bounded number of
runs ahead.  Of a larger step each batch is one group, whose task gives the
gradient of the loss, the moments of the batch norms and the metrics; these are
summed by pieces of the weights, and the driver gets one sum the size of the
model and moves the weights.  Both add in the order of batches, so neither the
length of runs, the number of partitions nor lost executors change anything.
What the driver holds is the weights and their moments, which :func:`saved`
makes a table of.
"""

from __future__ import annotations

import pickle
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from itertools import groupby, pairwise

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import networks
from tidemark.operators.batches import event_batches, permuted
from tidemark.operators.concordance import concordance
from tidemark.operators.layers import Weights, merged_moments
from tidemark.operators.networks import Batch, Draws, Network, Result
from tidemark.sources.stored import removed, shared_folder, stored

#: Values of the weights that are summed in one group.
PIECE = 1 << 14
#: Values (readouts by hidden states, on average) of a run of steps, and of a step from which on its batches are dealt to tasks.
RUN_VALUES, STEP_VALUES = 1 << 23, 1 << 20
#: Runs that are dealt and drawn ahead of the one whose steps are under way.
RUNS_AHEAD = 8
LOSSES = ("simple", "tfc", "guided", "survival")


@dataclass(frozen=True)
class Options:
    """``size`` sequences are a batch, ``per_step`` batches a step, whose gradients are averaged.

    ``clip`` bounds the norm of a step's gradient, if it is set.  ``decay`` takes
    that share of ``rate`` off the weights.  ``events``: batches hold so many
    events each, for losses that need them.  Weights whose names begin with one
    of ``frozen`` stay.  ``best``: what picks the weights to keep, "loss" (least)
    or "c_index" (most), of the validation rows.
    """

    loss: str
    epochs: int = 20
    rate: float = 1e-3
    decay: float = 0.0
    clip: float | None = 1.0
    size: int = 128
    per_step: int = 1
    events: int | None = None
    temperature: float = 0.2
    share: float = 0.5
    weight: float = 0.3
    frozen: tuple[str, ...] = ()
    best: str = "loss"
    seed: int = 42

    def __post_init__(self) -> None:
        if self.loss not in LOSSES:
            raise ValueError(f"loss must be one of {', '.join(LOSSES)}")
        if self.best not in ("loss", "c_index"):
            raise ValueError("best must be loss or c_index")


#: The options of the four trainers.
SIMPLE = Options("simple", epochs=20, rate=1e-4, clip=None, temperature=0.5)
TFC = Options("tfc", epochs=20, rate=1e-3, decay=1e-4, size=256)
GUIDED = Options("guided", epochs=40, rate=1e-4, size=32, events=8, best="c_index")
FINE_TUNED = Options("survival", epochs=10, rate=1e-4, size=32, events=8, best="c_index")


@dataclass
class State:
    """Weights and Adam's moments after ``epoch`` epochs, the best weights so far, the metrics of each epoch, and the sums over the steps of one under way."""

    weights: Weights
    first: Weights
    second: Weights
    steps: int = 0
    epoch: int = 0
    best: float | None = None
    best_weights: Weights = field(default_factory=dict)
    history: list[dict[str, float]] = field(default_factory=list)
    sums: dict[str, float] = field(default_factory=dict)


@dataclass(frozen=True)
class Columns:
    """Where packed rows have the features, the gaps and static features; targets are ``duration`` and ``event``."""

    numerical: list[str]
    histogram: list[str]
    gaps: str
    static: list[str] = field(default_factory=list)
    key: str = "vehicle_id"

    @property
    def features(self) -> list[str]:
        return [*self.numerical, *self.histogram]

    def batch(self, table: pa.Table, number: int) -> Batch:
        return networks.batch_of(table, self.features, len(self.numerical), self.gaps, self.static, self.key, number)


def begun(weights: Weights) -> State:
    none = lambda: {n: np.zeros_like(w) for n, w in weights.items()}
    return State({n: w.copy() for n, w in weights.items()}, none(), none())


def draws_of(options: Options, epoch: int, train: bool) -> Draws:
    """Validation draws views too, of an epoch of their own."""
    return replace(networks.SIMPLE_DRAWS if options.loss == "simple" else Draws(), seed=options.seed, epoch=2 * epoch + (not train))


def loss_of(net: Network, options: Options, batch: Batch, w: Weights, epoch: int, train: bool) -> Result | None:
    """Metrics, gradient and moments of a batch; None where it has no loss."""
    draws = draws_of(options, epoch, train)
    if options.loss == "simple":
        return networks.simple_loss(net, batch, w, draws, options.temperature, train)
    if options.loss == "tfc":
        return networks.tfc_loss(net, batch, w, draws, options.temperature, options.share, train)
    if options.loss == "guided":
        return networks.guided_loss(net, batch, w, draws, options.temperature, options.share, options.weight, train)
    frozen = any(n in options.frozen for n in net.encoder)
    return networks.survival_loss(net, batch, w, draws, frozen, train)


def _named(result: Result | None) -> dict[str, np.ndarray]:
    """What a batch gives, by name: gradients, "metric:..." and "moment:place:head:mean" or "var"; "skipped" where it has no loss."""
    if result is None:
        return {"skipped": np.ones(1)}
    metrics, grads, moments = result
    out = {f"metric:{k}": np.array([v]) for k, v in metrics.items()} | dict(grads or {})
    for i, (name, mean, var) in enumerate(moments or []):
        out |= {f"moment:{i}:{name}:mean": mean, f"moment:{i}:{name}:var": var}
    return out


def _mean(batches: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """What :func:`summed` gives of the same batches."""
    out = {}
    for name in sorted({n for b in batches for n in b}):
        values = np.array([b[name].ravel() for b in batches if name in b])
        out[name] = np.sum(values, axis=0) / (1 if name == "skipped" else len(values))
    return out


def _pieces(number: int, found: dict[str, np.ndarray]) -> pa.Table:
    rows = [(number, name, at // PIECE, value.ravel()[at : at + PIECE]) for name, value in found.items() for at in range(0, max(1, value.size), PIECE)]
    batch, names, parts, values = zip(*rows)
    return pa.table([pa.array(batch, pa.int64()), pa.array(names), pa.array(parts, pa.int32()), pa.array([v.tolist() for v in values], pa.list_(pa.float64()))], ["batch", "name", "part", "values"])


def _added(pieces: pa.Table) -> pa.Table:
    pieces = pieces.sort_by("batch")
    total = np.sum(np.array(pieces.column("values").to_pylist()), axis=0)
    return pa.table([pieces.column("name").slice(0, 1), pieces.column("part").slice(0, 1), pa.array([total.tolist()], pa.list_(pa.float64())), pa.array([pieces.num_rows], pa.int64())], ["name", "part", "values", "n"])


def summed(rows: DataFrame, columns: Columns, net: Network, options: Options, w: Weights, epoch: int, train: bool = True) -> dict[str, np.ndarray]:
    """The mean over the batches of ``rows`` that have a loss: gradients by name, "metric:..." and "moment:place:head:mean" or "var"; and how many have none, as "skipped"."""

    def of(table: pa.Table) -> pa.Table:
        number = table.column("batch")[0].as_py()
        return _pieces(number, _named(loss_of(net, options, columns.batch(table, number), w, epoch, train)))

    kind = "name string, part int, values array<double>"
    pieces = rows.groupBy("batch").applyInArrow(of, f"batch bigint, {kind}")
    got = pieces.groupBy("name", "part").applyInArrow(_added, f"{kind}, n bigint").collect()
    out: dict[str, list] = {}
    for r in sorted(got, key=lambda r: (r["name"], r["part"])):
        out.setdefault(r["name"], []).append(np.array(r["values"]) / (1 if r["name"] == "skipped" else r["n"]))
    return {n: np.concatenate(v) for n, v in out.items()}


def moved(state: State, found: dict[str, np.ndarray], options: Options) -> None:
    """One step of Adam with decoupled decay, by the gradient in ``found``; its moments of batch norms go into the running ones."""
    trained = [n for n in state.weights if n in found and not n.startswith(options.frozen or ("\0",))]
    grads = {n: found[n].reshape(state.weights[n].shape) for n in trained}
    norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
    scale = min(1.0, options.clip / (norm + 1e-6)) if options.clip else 1.0
    state.steps += 1
    for n, g in grads.items():
        g = g * scale
        state.first[n] = 0.9 * state.first[n] + 0.1 * g
        state.second[n] = 0.999 * state.second[n] + 0.001 * g**2
        step = state.first[n] / (1 - 0.9**state.steps) / (np.sqrt(state.second[n] / (1 - 0.999**state.steps)) + 1e-8)
        state.weights[n] = state.weights[n] * (1 - options.rate * options.decay) - options.rate * step
    names = sorted({tuple(n.split(":")[1:3]) for n in found if n.startswith("moment:")}, key=lambda x: int(x[0]))
    merged_moments(state.weights, [(name, found[f"moment:{i}:{name}:mean"], found[f"moment:{i}:{name}:var"]) for i, name in names])


def stepped(state: State, found: dict[str, np.ndarray], options: Options) -> None:
    """Moves ``state`` by what the batches of a step gave, and adds their metrics to its sums; a step without a loss is none."""
    sums = state.sums
    sums["skipped"] = sums.get("skipped", 0.0) + float(found.get("skipped", [0])[0])
    if "metric:loss" not in found:
        return
    moved(state, found, options)
    sums["done"] = sums.get("done", 0.0) + 1
    for n, v in found.items():
        if n.startswith("metric:"):
            sums[n] = sums.get(n, 0.0) + float(v[0])


def _batches(stream: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Number and rows of each batch of a stream that is in their order."""
    number, held = None, []
    for some in stream:
        numbers = some.column("batch").to_numpy()
        for at, to in pairwise([0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]):
            if at == to:
                continue
            if held and numbers[at] != number:
                yield number, pa.Table.from_batches(held)
                held = []
            number = int(numbers[at])
            held.append(some.slice(at, to - at))
    if held:
        yield number, pa.Table.from_batches(held)


BODY = "batch bigint, body binary"


def drawn_ahead(rows: DataFrame, columns: Columns, net: Network, options: Options, epoch: int) -> DataFrame:
    """(batch, body): each batch of ``rows`` with what its steps read, drawn in tasks side by side that leave some for the steps of other runs."""
    draws = draws_of(options, epoch, True)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, table in _batches(stream):
            body = pickle.dumps(networks.drawn_ahead(net, columns.batch(table, number), draws, options.loss), protocol=5)
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([body], pa.binary())], names=["batch", "body"])

    tasks = max(1, rows.sparkSession.sparkContext.defaultParallelism // 2)
    return rows.repartition(tasks, "batch").sortWithinPartitions("batch").mapInArrow(run, BODY)


def walked(bodies: DataFrame, net: Network, options: Options, state: State, epoch: int) -> State:
    """``state`` after the steps of the batches in ``bodies``, one after the other, in one task."""
    begin = replace(state, best=None, best_weights={}, history=[])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = replace(begin, weights=dict(begin.weights), first=dict(begin.first), second=dict(begin.second), sums=dict(begin.sums))
        batches = ((number.as_py(), pickle.loads(body.as_buffer())) for some in stream for number, body in zip(some.column("batch"), some.column("body")))
        for _, some in groupby(batches, lambda b: b[0] // options.per_step):
            stepped(now, _mean([_named(loss_of(net, options, batch, now.weights, epoch, True)) for _, batch in some]), options)
        part, name, shape, values = zip(*_rows(now))
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(name), pa.array(shape, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))], names=["part", "name", "shape", "values"])

    done = resumed(bodies.coalesce(1).sortWithinPartitions("batch").mapInArrow(run, STATE))
    return replace(done, best=state.best, best_weights=state.best_weights, history=state.history)


def dealt(rows: DataFrame, options: Options, epoch: int, key: str) -> DataFrame:
    """``rows`` with batch, of an epoch: all of them in the order of a permutation, or by events."""
    if options.events:
        pool = event_batches(rows.select(F.col(key).alias("vehicle_id"), "event"), options.size, options.events, options.seed, epoch=epoch)
        return rows.join(pool.select(F.col("vehicle_id").alias(key), "batch"), key)
    return permuted(rows, key, options.seed, epoch).withColumn("batch", F.floor(F.col("place") / options.size)).drop("place")


def c_index(rows: DataFrame, columns: Columns, net: Network, w: Weights) -> float | None:
    """The concordance of the risks of ``rows``, over all of them."""
    return concordance(scored(rows, columns, net, w, ["duration", "event"])).first()["c_index"]


def validated(rows: DataFrame, columns: Columns, net: Network, options: Options, w: Weights, epoch: int) -> dict[str, float]:
    """The mean metrics of the batches of ``rows`` and, where risks are trained, their concordance."""
    found = summed(rows, columns, net, options, w, epoch, train=False)
    out = {n.split(":")[1]: float(v[0]) for n, v in found.items() if n.startswith("metric:")}
    if options.loss in ("guided", "survival"):
        index = c_index(rows, columns, net, w)
        out["c_index"] = float("nan") if index is None else index
    return out


def better(options: Options, new: float | None, old: float | None) -> bool:
    if new is None or np.isnan(new):
        return False
    return old is None or (new < old if options.best == "loss" else new > old)


def ahead(spark: SparkSession, items: Iterator, most: int) -> Iterator:
    """``items``, in order; the next ones, ``most`` at a time, are worked out by a thread beside what is done with this one."""
    step = inheritable_thread_target(spark)(lambda: next(items, None))
    pool = ThreadPoolExecutor(1)
    try:
        held = deque(pool.submit(step) for _ in range(most))
        while (item := held.popleft().result()) is not None:
            held.append(pool.submit(step))
            yield item
    finally:
        pool.shutdown(cancel_futures=True)


def train(rows: DataFrame, validation: DataFrame, columns: Columns, net: Network, options: Options, state: State | Callable[[], State] | None = None, until: int | None = None) -> State:
    """``state`` (drawn weights without one) after further epochs over packed ``rows``, up to ``options.epochs`` or ``until``.

    Sequences have no missing values; batches without a loss (a single
    sequence, no event) are skipped and counted.  ``validation`` is in batches
    of its own order.  Without rows there is nothing to learn from: an error.
    A state made by :func:`saved` and :func:`resumed` between epochs goes on as
    if it had never stopped.  A function that gives a state before its first
    epoch is asked for it once there are runs to begin with.
    """
    spark = rows.sparkSession
    state = state or begun(net.weights(options.seed))
    begin = 0 if callable(state) else state.epoch
    each = rows.agg(F.avg("sequence_length").alias("n")).first()["n"]
    if each is None:
        raise ValueError("there are no rows to train on")
    values = max(1.0, each * net.hidden * options.size * options.per_step)
    dealt_out = options.per_step > 1 and values > STEP_VALUES
    per_run = 1 if dealt_out else max(1, int(RUN_VALUES // values))
    epochs = range(begin, options.epochs if until is None else min(until, options.epochs))
    targets = [c for c in ("duration", "event") if c in rows.columns]
    picked = dict.fromkeys(["run", "batch", columns.key, "sequence_length", *columns.features, columns.gaps, *columns.static, *targets])

    def runs() -> Iterator[tuple[int, DataFrame | None, DataFrame, list[str]]]:
        """Of each run its epoch, the validation rows by batch if it is the last of it, what its steps read, and the folders that nothing reads after them."""
        kept = None
        for epoch in epochs:
            folder = shared_folder(spark)
            order = dealt(rows, options, epoch, columns.key).withColumn("run", F.floor(F.col("batch") / (options.per_step * per_run)))
            table = stored(order.select(*picked).repartitionByRange("run", "batch"), folder, "run")
            last = table.agg(F.max("run").alias("r")).first()["r"]
            if last is None:
                raise ValueError("there are no rows to train on")
            for run in range(last + 1):
                some, gone = spark.read.schema(table.drop("run").schema).parquet(f"{folder}/run={run}"), [folder] if run == last else []
                if not dealt_out:
                    gone.append(shared_folder(spark))
                    some = stored(drawn_ahead(some, columns, net, options, epoch), gone[-1])
                if run == last and kept is None:
                    kept = stored(permuted(validation, columns.key, options.seed, 0).withColumn("batch", F.floor(F.col("place") / options.size)), held)
                yield epoch, kept if run == last else None, some, gone

    held, started = shared_folder(spark), False
    for epoch, kept, some, gone in ahead(spark, runs(), RUNS_AHEAD):
        if not started:
            state, started = state() if callable(state) else state, True
            state.sums = {}
        if dealt_out:
            stepped(state, summed(some, columns, net, options, state.weights, epoch), options)
        else:
            state = walked(some, net, options, state, epoch)
        for folder in gone:
            removed(spark, folder)
        if kept is None:
            continue
        state.epoch = epoch + 1
        sums, state.sums = state.sums, {}
        metrics = {f"train_{n.split(':')[1]}": v / sums["done"] for n, v in sums.items() if n.startswith("metric:")} | {"skipped": sums["skipped"]}
        found = validated(kept, columns, net, options, state.weights, epoch)
        state.history.append({"epoch": float(epoch + 1)} | metrics | {f"val_{k}": v for k, v in found.items()})
        if better(options, found.get(options.best), state.best):
            state.best, state.best_weights = found[options.best], {n: w.copy() for n, w in state.weights.items()}
    removed(spark, held)
    return state() if callable(state) else state


def scored(rows: DataFrame, columns: Columns, net: Network, w: Weights, more: list[str] | None = None) -> DataFrame:
    """(key, pooled, projection, risk) of each packed sequence, and ``more`` of its columns: mean states of the branches, what the heads make of them by their running moments, the risk where there is a survival head."""
    more, names = more or [], ["time", "freq"] if net.kind == "tfc" else ["time"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch]).sort_by(columns.key)
            b = columns.batch(table, 0)
            states = {p: networks.pooled(*networks.inputs(net, b, p), w, p) for p in {*net.parts, *names}}
            joint = states if net.kind == "tfc" else {"time": np.concatenate([states[p] for p in net.parts], 1)}
            heads = np.concatenate([networks.layers.head(joint[p], w, f"{p}_head")[0] for p in names], 1)
            risk = networks.risks(net, b, w)[1] if net.survival else np.full(len(b.x), np.nan)
            vectors = [pa.array(v.tolist(), pa.list_(pa.float64())) for v in (np.concatenate([joint[p] for p in names], 1), heads)]
            yield pa.RecordBatch.from_arrays([*[table.column(c).combine_chunks() for c in (columns.key, *more)], *vectors, pa.array(risk, from_pandas=True)], names=[columns.key, *more, "pooled", "projection", "risk"])

    kept = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (columns.key, *more))
    picked = dict.fromkeys([columns.key, *more, "sequence_length", *columns.features, columns.gaps, *columns.static])
    return rows.select(*picked).mapInArrow(run, f"{kept}, pooled array<double>, projection array<double>, risk double")


def history(spark: SparkSession, state: State) -> DataFrame:
    """(epoch, metric, value) of every epoch."""
    rows = [(int(e["epoch"]), k, None if np.isnan(v) else v) for e in state.history for k, v in e.items() if k != "epoch"]
    return spark.createDataFrame(rows, "epoch int, metric string, value double")


STATE = "part string, name string, shape array<int>, values array<double>"


def _rows(state: State) -> list[tuple[str, str, list[int], list[float]]]:
    rows = [("at", "steps", [2], [float(state.steps), float(state.epoch)]), ("at", "best", [], [] if state.best is None else [state.best])]
    for part in ("weights", "first", "second", "best_weights"):
        rows += [(part, n, list(w.shape), w.ravel().tolist()) for n, w in getattr(state, part).items()]
    for epoch in state.history:
        rows += [("history", f"{int(epoch['epoch'])}:{k}", [], [v]) for k, v in epoch.items()]
    return rows + [("sums", n, [], [v]) for n, v in state.sums.items()]


def saved(spark: SparkSession, state: State) -> DataFrame:
    """(part, name, shape, values): a state as a table."""
    return spark.createDataFrame(_rows(state), STATE)


def resumed(table: DataFrame) -> State:
    """The state that :func:`saved` made a table of."""
    parts: dict[str, dict] = {p: {} for p in ("at", "weights", "first", "second", "best_weights", "history", "sums")}
    for r in table.collect():
        parts[r["part"]][r["name"]] = r["values"] if r["part"] in ("at", "history", "sums") else np.array(r["values"]).reshape(r["shape"])
    epochs: dict[int, dict[str, float]] = {}
    for name, (value,) in parts["history"].items():
        epoch, metric = name.split(":")
        epochs.setdefault(int(epoch), {})[metric] = value
    steps, epoch = parts["at"]["steps"]
    best = parts["at"]["best"][0] if parts["at"]["best"] else None
    return State(parts["weights"], parts["first"], parts["second"], int(steps), int(epoch), best, parts["best_weights"], [epochs[e] for e in sorted(epochs)], {n: v for n, (v,) in parts["sums"].items()})
