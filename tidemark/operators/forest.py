"""Random survival forests: a tree a task, grown on rows drawn by hash.

Trees of several settings and folds are one job.  A leaf holds the steps of its
hazard and of its survival; its mortality is its hazard added up over the event
times of all train rows, so trees of different draws share one scale.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.concordance import concordance
from tidemark.operators.features import folds
from tidemark.operators.ranks import running_sums
from tidemark.sources.stored import stored


@dataclass(frozen=True)
class ForestParams:
    """``most_rows`` bounds the rows that a tree is grown on, whatever the table's size; ``cuts`` how many cuts of a feature are tried at a node."""

    trees: int = 100
    max_depth: int = 30
    min_split: int = 30
    min_leaf: int = 20
    max_features: str = "sqrt"
    most_rows: int = 10_000
    cuts: int = 32
    seed: int = 42


def log_rank(t: np.ndarray, e: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The log-rank statistic of each split: ``left`` (splits, rows) tells whose rows go left; rows are sorted by time."""
    head = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
    after = lambda x: np.flip(np.cumsum(np.flip(np.add.reduceat(x, head, axis=-1), -1), -1), -1)
    at_risk, dead = after(np.ones(len(t))), np.add.reduceat(e.astype(float), head)
    own = after(left.astype(float))
    seen = np.add.reduceat(left * e, head, axis=-1)
    share = own / at_risk
    spread = np.where(at_risk > 1, dead * (at_risk - dead) / np.maximum(1, at_risk - 1), 0) * share * (1 - share)
    total = spread.sum(-1)
    return np.where(total > 0, np.abs((seen - dead * share).sum(-1)) / np.sqrt(np.maximum(total, 1e-300)), 0)


def leaf_steps(t: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct event times of rows sorted by time, the steps of their hazard there, and their survival after each."""
    head = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
    dead, at_risk = np.add.reduceat(e.astype(float), head), len(t) - head
    some = dead > 0
    steps = dead[some] / at_risk[some]
    return t[head][some], steps, np.cumprod(1 - steps)


@dataclass
class Node:
    """A leaf has feature -1, and steps; an inner node has neither mortality nor steps."""

    feature: int = -1
    cut: float = 0.0
    left: int = -1
    right: int = -1
    mortality: float = 0.0
    times: np.ndarray | tuple = ()
    hazard: np.ndarray | tuple = ()
    survival: np.ndarray | tuple = ()


def grow(t: np.ndarray, e: np.ndarray, x: np.ndarray, later: np.ndarray, p: ForestParams, rng: np.random.Generator) -> list[Node]:
    """The nodes of a tree.  Rows are sorted by time; ``later``: how many event times of the train rows are at or after each row's."""
    tried = {"sqrt": int(x.shape[1] ** 0.5), "log2": int(np.log2(x.shape[1]))}.get(p.max_features, x.shape[1])
    nodes: list[Node] = []

    def leaf(i: np.ndarray) -> Node:
        times, hazard, survival = leaf_steps(t[i], e[i])
        weight = later[i][np.searchsorted(t[i], times)]
        return Node(mortality=float((hazard * weight).sum()), times=times, hazard=hazard, survival=survival)

    def split(i: np.ndarray) -> tuple[int, float]:
        best = (0.0, -1, 0.0)
        for f in rng.permutation(x.shape[1])[: max(1, tried)].tolist():
            values = np.sort(x[i, f])
            cuts = np.unique(values[p.min_leaf - 1 : len(i) - p.min_leaf])
            if len(cuts) > p.cuts:  # quantiles of the candidates
                cuts = np.unique(cuts[np.linspace(0, len(cuts) - 1, p.cuts).astype(int)])
            left = x[i, f] <= cuts[:, None]
            n = left.sum(1)
            ok = (n >= p.min_leaf) & (len(i) - n >= p.min_leaf)
            if ok.any():
                score = log_rank(t[i], e[i], left[ok])
                k = int(score.argmax())
                if score[k] > best[0]:
                    best = float(score[k]), f, float(cuts[ok][k])
        return best[1:]

    def build(i: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append(Node())
        feature, cut = (-1, 0.0) if depth >= p.max_depth or len(i) < p.min_split or not e[i].any() else split(i)
        if feature < 0:
            nodes[at] = leaf(i)
            return at
        goes = x[i, feature] <= cut
        nodes[at] = Node(feature, cut, build(i[goes], depth + 1), build(i[~goes], depth + 1))
        return at

    build(np.arange(len(t)), 0)
    return nodes


TREE = "candidate int, fold int, tree int, node int, feature int, cut double, left int, right int, mortality double, times array<double>, hazard array<double>, survival array<double>"


def _rows(train: DataFrame, features: list[str], fold: str | None) -> DataFrame:
    """(fold, vehicle_id, t, e, x) without nulls; with ``fold`` each row is there for every fold but its own."""
    held = train.select("vehicle_id", F.col("duration").cast("double").alias("t"), F.col("event").cast("int").alias("e"), F.array(*[F.col(f).cast("double") for f in features]).alias("x"), F.col(fold).cast("int").alias("own") if fold else F.lit(-1).alias("own"))
    return held.dropna(subset=["t", "e"]).filter(~F.exists("x", F.isnull))


def fit_forests(train: DataFrame, features: list[str], candidates: list[ForestParams], fold: str | None = None, k: int = 1) -> DataFrame:
    """The nodes of the trees of every candidate, a row a node: of all ``train`` rows (vehicle_id, duration, event, features), or, with ``fold``, of those outside each of ``k`` folds.

    One job grows all trees, a task's group being one tree.  Of a larger table
    ten times ``most_rows`` are drawn by hash of the key.  A row takes part in a
    tree as often as a Poisson draw by hash of seed, tree and key says, scaled
    so that a tree has about ``most_rows`` at most.  Rows with nulls don't take
    part.  The candidates share ``most_rows`` and ``seed``.
    """
    base = candidates[0]
    rows = stored(_rows(train, features, fold))
    apart = rows.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).filter(F.col("fold") != F.col("own"))
    deaths = apart.filter("e = 1").select("fold", "t").distinct()
    later = running_sums(deaths, "t", {"later": F.lit(1)}, descending=True, keys=("fold",)).select(F.col("fold").alias("_f"), F.col("t").alias("_t"), "later")
    totals = {r["fold"]: r["count"] for r in apart.groupBy("fold").count().collect()}  # a row a fold
    pool = {f: min(max(1, n), 10 * base.most_rows) for f, n in totals.items()}
    one = lambda of: F.element_at(F.create_map(*[F.lit(v) for f in totals for v in (f, of(f))]), F.col("fold")) if totals else F.lit(1.0)
    some = apart.filter(F.pmod(F.xxhash64("vehicle_id", F.lit(base.seed)), F.lit(1 << 30)) < one(lambda f: pool[f] / max(1, totals[f])) * (1 << 30))
    timed = stored(some.join(later, (F.col("fold") == F.col("_f")) & (F.col("t") == F.col("_t")), "left").drop("_f", "_t"))
    every = F.array(*[F.struct(F.lit(c).alias("candidate"), F.lit(p.trees).alias("trees")) for c, p in enumerate(candidates)])
    each = timed.select("*", F.explode(every).alias("_c")).select("fold", "vehicle_id", "t", "e", "x", "later", "_c.candidate", F.explode(F.sequence(F.lit(0), F.col("_c.trees") - 1)).alias("tree"))
    drawn = F.pmod(F.xxhash64(F.lit(base.seed), "tree", "vehicle_id"), F.lit(1 << 30)) / float(1 << 30)

    def times_drawn(rate: float):
        upto, p, draws = 0.0, np.exp(-rate), F.lit(0)
        for n in range(6):  # more than six draws of one row have a chance below 1e-4
            upto += p
            draws = draws + (drawn >= float(upto)).cast("int")
            p *= rate / (n + 1)
        return draws

    rates = {f: min(1.0, base.most_rows / pool[f]) for f in totals}
    n = F.lit(0)
    for rate in set(rates.values()):
        n = F.when(F.col("fold").isin([f for f in rates if rates[f] == rate]), times_drawn(rate)).otherwise(n)

    def one_tree(table: pa.Table) -> pa.Table:
        candidate, fold_, tree = (table[c][0].as_py() for c in ("candidate", "fold", "tree"))
        count, key = table["_n"].to_numpy(), table["vehicle_id"].to_numpy()
        t, e = table["t"].to_numpy(), table["e"].to_numpy()
        x = table["x"].combine_chunks().flatten().to_numpy().reshape(len(t), -1)
        after = table["later"].fill_null(0).to_numpy()
        order = np.lexsort((key, t))
        order = np.repeat(order, count[order])
        nodes = grow(t[order], e[order], x[order], after[order], candidates[candidate], np.random.default_rng([base.seed, tree]))
        same = lambda v: pa.array([v] * len(nodes), pa.int32())
        kinds = {"feature": pa.int32(), "cut": pa.float64(), "left": pa.int32(), "right": pa.int32(), "mortality": pa.float64()}
        steps = {c: pa.array([np.asarray(getattr(d, c)).tolist() for d in nodes], pa.list_(pa.float64())) for c in ("times", "hazard", "survival")}
        plain = {c: pa.array([getattr(d, c) for d in nodes], kind) for c, kind in kinds.items()}
        return pa.table({"candidate": same(candidate), "fold": same(fold_), "tree": same(tree), "node": pa.array(range(len(nodes)), pa.int32())} | plain | steps)

    return each.withColumn("_n", n).filter("_n > 0").groupBy("candidate", "fold", "tree").applyInArrow(one_tree, TREE)


def fit_forest(train: DataFrame, features: list[str], params: ForestParams = ForestParams()) -> DataFrame:
    """The nodes of the trees of one forest; see :func:`fit_forests`."""
    return fit_forests(train, features, [params])


Tree = tuple[np.ndarray, ...]


def _trees(forest: DataFrame, *more: str) -> dict[tuple[int, int], list[Tree]]:
    """By candidate and fold the trees' columns, which are of a bounded size: feature, cut, left, right and ``more``."""
    names = ["candidate", "fold", "tree", "node", "feature", "cut", "left", "right", *more]
    table = forest.select(*names).toArrow().sort_by([(c, "ascending") for c in names[:4]])
    columns = [np.array(table[c].to_pylist(), object) if c in ("times", "survival") else table[c].to_numpy() for c in names]
    if not table.num_rows:
        return {}
    key = np.stack(columns[:3], 1)
    first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1)))
    out: dict[tuple[int, int], list[Tree]] = {}
    for a, b in zip(first, [*first[1:], table.num_rows]):
        out.setdefault((int(key[a][0]), int(key[a][1])), []).append(tuple(c[a:b] for c in columns[4:]))
    return out


def _leaves(x: np.ndarray, tree: Tree) -> np.ndarray:
    """The leaf that each row of x comes to."""
    feature, cut, left, right = tree[:4]
    at = np.zeros(len(x), np.int64)
    while (inner := feature[at] >= 0).any():
        i = np.flatnonzero(inner)
        at[i] = np.where(x[i, feature[at[i]]] <= cut[at[i]], left[at[i]], right[at[i]])
    return at


def _features(table: DataFrame, features: list[str], *more: str) -> DataFrame:
    return table.select("vehicle_id", *more, *[F.col(f).cast("double").alias(f"_{i}") for i, f in enumerate(features)])


def _matrix(batch: pa.RecordBatch, features: list[str]) -> np.ndarray:
    return np.stack([batch[f"_{i}"].to_numpy(zero_copy_only=False) for i in range(len(features))], 1)


def score_forest(table: DataFrame, forest: DataFrame, features: list[str], name: str = "risk") -> DataFrame:
    """(vehicle_id, ``name``): the mean mortality of each row over the trees of the first forest; null where a feature is."""
    grown = next(iter(_trees(forest, "mortality").values()), [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, features)
            risk = sum((tree[4][_leaves(x, tree)] for tree in grown), np.zeros(len(x))) / max(1, len(grown))
            risk[np.isnan(x).any(1)] = np.nan
            yield pa.RecordBatch.from_arrays([batch["vehicle_id"], pa.array(risk, pa.float64(), from_pandas=True)], names=["vehicle_id", name])

    held = _features(table, features)
    return held.mapInArrow(run, f"vehicle_id {held.schema['vehicle_id'].dataType.simpleString()}, {name} double")


def forest_curves(table: DataFrame, forest: DataFrame, features: list[str], grid: DataFrame) -> DataFrame:
    """(vehicle_id, time, survival) at each time of ``grid`` (time), which is of a bounded size: the mean over the trees of the survival of the leaf that a row comes to.

    Rows with a null feature have no curve.
    """
    times = np.array(sorted(r["time"] for r in grid.select("time").distinct().collect()))
    grown = []
    for tree in next(iter(_trees(forest, "times", "survival").values()), []):
        at = [np.append(1.0, s)[np.searchsorted(t, times, "right")] for t, s in zip(tree[4], tree[5])]
        grown.append((*tree[:4], np.array(at).reshape(len(at), len(times))))  # a row a node

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, features)
            whole = ~np.isnan(x).any(1)
            total = np.zeros((int(whole.sum()), len(times)))
            for tree in grown:
                total += tree[4][_leaves(x[whole], tree)]
            yield pa.RecordBatch.from_arrays([batch["vehicle_id"].filter(pa.array(whole)), pa.array((total / max(1, len(grown))).tolist(), pa.list_(pa.float64()))], names=["vehicle_id", "s"])

    held = _features(table, features)
    curves = held.mapInArrow(run, f"vehicle_id {held.schema['vehicle_id'].dataType.simpleString()}, s array<double>")
    points = F.arrays_zip(F.array(*map(F.lit, times.tolist())).alias("time"), F.col("s").alias("survival"))
    return curves.select("vehicle_id", F.explode(points).alias("p")).select("vehicle_id", "p.time", "p.survival")


def fold_risks(table: DataFrame, forests: DataFrame, features: list[str], candidates: int) -> DataFrame:
    """(candidate, fold, duration, event, risk) of rows (fold, ...) by the trees grown without their fold."""
    grown = _trees(forests, "mortality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, fold_ = _matrix(batch, features), batch["fold"].to_numpy()
            known = ~np.isnan(x).any(1)
            for c in range(candidates):
                risk = np.full(len(x), np.nan)
                for f in np.unique(fold_).tolist():
                    i, trees = np.flatnonzero((fold_ == f) & known), grown.get((c, f), [])
                    risk[i] = sum((tree[4][_leaves(x[i], tree)] for tree in trees), np.zeros(len(i))) / max(1, len(trees))
                yield pa.RecordBatch.from_arrays([pa.array([c] * len(x), pa.int32()), batch["fold"], batch["duration"], batch["event"], pa.array(risk, from_pandas=True)], names=["candidate", "fold", "duration", "event", "risk"])

    held = _features(table, features, F.col("fold").cast("int").alias("fold"), F.col("duration").cast("double").alias("duration"), F.col("event").cast("int").alias("event"))
    return held.mapInArrow(run, "candidate int, fold int, duration double, event int, risk double")


#: The grid of the search; fixed values.
GRID = {"trees": [80, 100, 120], "max_depth": [20, 30, 40], "min_split": [20, 30, 40], "min_leaf": [10, 20, 30], "max_features": ["sqrt", "log2"]}


def drawn_settings(grid: dict[str, list], draws: int, base: ForestParams) -> list[ForestParams]:
    """``draws`` different settings of ``grid``, drawn by the seed; all of them where it has no more."""
    size = int(np.prod([len(v) for v in grid.values()]))
    out = []
    for number in sorted(np.random.default_rng(base.seed).permutation(size)[:draws].tolist()):
        chosen = {}
        for name, values in grid.items():
            number, at = divmod(number, len(values))
            chosen[name] = values[at]
        out.append(replace(base, **chosen))
    return out


def search_forest(spark: SparkSession, train: DataFrame, features: list[str], grid: dict[str, list] = GRID, draws: int = 10, k: int = 3, base: ForestParams = ForestParams()) -> tuple[DataFrame, ForestParams, DataFrame]:
    """(the grid's parameters, c_index), the best setting, and its forest fitted on all rows.

    Each of ``draws`` settings is scored by its mean concordance over ``k``
    folds, the best first; the trees of all settings and folds are one job.  A
    fold without comparable pairs doesn't count.
    """
    dealt = stored(folds(train, k, base.seed))
    candidates = drawn_settings(grid, draws, base)
    forests = stored(fit_forests(dealt, features, candidates, "fold", k))
    risks = stored(fold_risks(dealt, forests, features, len(candidates)))
    found = {(r["candidate"], r["fold"]): r["c_index"] for r in concordance(risks, keys=("candidate", "fold")).collect()}  # a row a forest
    rows = []
    for c, params in enumerate(candidates):
        known = [v for f in range(k) if (v := found.get((c, f))) is not None]
        rows.append((*[asdict(params)[n] for n in grid], float(np.mean(known)) if known else None))
    kinds = [f"{n} {'string' if isinstance(v[0], str) else 'int'}" for n, v in grid.items()]
    table = spark.createDataFrame(rows, ", ".join([*kinds, "c_index double"])).orderBy(F.desc_nulls_last("c_index"), *grid)
    best = max(range(len(rows)), key=lambda c: (rows[c][-1] is not None, rows[c][-1] or 0, -c))
    return table, candidates[best], stored(fit_forest(train, features, candidates[best]))


def fitted_forests(spark: SparkSession, train: DataFrame, validation: DataFrame, features: list[str], base: ForestParams = ForestParams(), **search) -> DataFrame:
    """(model, params, c_index): the baseline and the best of a search, by their concordance on ``validation``."""
    _, best, tuned = search_forest(spark, train, features, base=base, **search)
    out = None
    for name, params, grown in (("baseline", base, stored(fit_forest(train, features, base))), ("tuned", best, tuned)):
        risks = validation.join(score_forest(validation, grown, features), "vehicle_id")
        shown = ", ".join(f"{n}={v}" for n, v in asdict(params).items())
        one = concordance(stored(risks.select("duration", "event", "risk"))).select(F.lit(name).alias("model"), F.lit(shown).alias("params"), "c_index")
        out = one if out is None else out.unionByName(one)
    return out
