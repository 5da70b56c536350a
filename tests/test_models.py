"""Ranks, concordance, fits and encoders against plain versions; readers and writers; errors that are asked for."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import transforms as X
from tidemark.operators import batches, columns, concordance, cox, features, forest, ranks, sequences, spectral, survival
from tidemark.sources import paths, stored, tables


def survivors(n=120, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    t = np.ceil(rng.exponential(np.exp(-0.8 * x[:, 0] + 0.5 * x[:, 1])) * 6)
    return [(i, float(t[i]), int(rng.random() < 0.7), float(x[i, 0]), float(x[i, 1])) for i in range(n)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(survivors(), "vehicle_id bigint, duration double, event int, a double, b double").repartition(3).cache()


def test_running_sums_and_percentiles(spark):
    values = [3.0, 1.0, 7.0, 2.0, 9.0, 4.0]
    rows = spark.createDataFrame([(v, k) for k in "xy" for v in values], "v double, k string")
    got = {(r.k, r.v): r.s for r in ranks.running_sums(rows, "v", {"s": F.col("v")}, descending=True, keys=("k",), parts=3).collect()}
    assert got == {(k, v): sum(w for w in values if w >= v) for k in "xy" for v in values}
    many = [float(i % 7) for i in range(40)] + [None]
    found = ranks.percentiles(spark.createDataFrame([(v,) for v in many], "v double"), "v", (0.0, 0.25, 0.5, 0.9, 1.0)).first()
    assert list(found)[1:] == pytest.approx(list(np.percentile([v for v in many if v is not None], [0, 25, 50, 90, 100]))) and found.n == 40
    with pytest.raises(Exception, match="v is null"):
        ranks.running_sums(spark.createDataFrame([(None,), (1.0,)], "v double"), "v", {"s": F.lit(1)}).collect()


def pairs(rows, tolerance):
    """(comparable, concordant, tied) of all pairs."""
    full = [r for r in rows if None not in r]
    found = [(a[2], b[2]) for a in full if a[1] for b in full if b[0] > a[0] or (b[0] == a[0] and not b[1])]
    return len(found), sum(a - b > tolerance for a, b in found), sum(abs(a - b) <= tolerance for a, b in found)


@pytest.mark.parametrize("parts", [None, 2, 5, 64])
def test_concordance_equals_all_pairs(spark, parts):
    rng = np.random.default_rng(2)
    rows = [(float(rng.integers(1, 15)), int(rng.integers(0, 2)), float(rng.integers(0, 6))) for _ in range(150)] + [(None, 1, 1.0), (3.0, None, 1.0), (2.0, 1, None)]
    got = concordance.concordance(spark.createDataFrame(rows, "duration double, event int, risk double"), parts).first()
    assert (got.comparable, got.concordant, got.tied) == pairs(rows, 0)
    none = concordance.concordance(spark.createDataFrame([(1.0, 0, 1.0)], "duration double, event int, risk double")).first()
    assert none.comparable == 0 and none.c_index is None


@pytest.mark.parametrize("parts", [1, 7, 30])
def test_concordance_with_near_ties_and_hot_values(spark, parts):
    """Chains of risks half a tolerance apart, across borders of ranges; half of the rows at one duration, a third at one risk."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(240):
        risk = 0.5 if i % 3 == 0 else float(rng.integers(0, 12)) * 0.25 + float(rng.integers(0, 9)) * 2.0**-28
        rows.append((7.0 if i % 2 else float(rng.integers(1, 30)), int(rng.integers(0, 2)), risk))
    tolerance = 2.0**-27
    got = concordance.concordance(spark.createDataFrame(rows, "duration double, event int, risk double"), parts, tolerance=tolerance).first()
    assert (got.comparable, got.concordant, got.tied) == pairs(rows, tolerance) != pairs(rows, 0)


def test_concordance_by_keys(spark):
    rng = np.random.default_rng(6)
    rows = {k: [(float(rng.integers(1, 9)), int(rng.integers(0, 2)), float(rng.normal())) for _ in range(40)] for k in (1, 2, 3)}
    table = spark.createDataFrame([(k, *r) for k, some in rows.items() for r in some], "k int, duration double, event int, risk double")
    got = {r.k: (r.comparable, r.concordant, r.tied) for r in concordance.concordance(table, 4, keys=("k",)).collect()}
    assert got == {k: pairs(some, concordance.TOLERANCE) for k, some in rows.items()}


def plain_cox(rows, penalizer, steps=40):
    x = np.array([r[3:] for r in rows])
    x = (x - x.mean(0)) / x.std(0)
    t, e = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        gradient, curvature = -penalizer * beta, penalizer * np.eye(len(beta))
        w = np.exp(x @ beta)
        for time in np.unique(t[e == 1]):
            dead, risk = np.flatnonzero((t == time) & (e == 1)), np.flatnonzero(t >= time)
            for k in range(len(dead)):
                v = np.where(np.isin(risk, dead), w[risk] * (1 - k / len(dead)), w[risk])
                mean = v @ x[risk] / v.sum()
                gradient = gradient + (x[dead[k]] - mean) / len(t)
                curvature = curvature + ((x[risk] * v[:, None]).T @ x[risk] / v.sum() - np.outer(mean, mean)) / len(t)
        beta = beta + np.linalg.solve(curvature, gradient)
    return beta


@pytest.mark.parametrize("parts", [1, 6])
def test_cox_equals_plain_newton(table, parts):
    model = cox.fit_cox(table, ["a", "b"], 0.1, parts=parts)
    assert model.beta == pytest.approx(plain_cox(survivors(), 0.1), abs=1e-6)
    assert model.beta[0] > 0 > model.beta[1]


def test_cox_where_a_third_has_one_duration(spark):
    rows = [(i, 4.0 if i % 3 == 0 else t, e, a, b) for i, t, e, a, b in survivors(90)]
    model = cox.fit_cox(spark.createDataFrame(rows, "vehicle_id bigint, duration double, event int, a double, b double"), ["a", "b"], parts=8)
    assert model.beta == pytest.approx(plain_cox(rows, 0.1), abs=1e-6)
    censored = [(i, t, 0, a, b) for i, t, _, a, b in rows]
    assert not cox.fit_cox(spark.createDataFrame(censored, "vehicle_id bigint, duration double, event int, a double, b double"), ["a", "b"]).beta.any()


def test_forest_ranks_by_hazard(table):
    params = forest.ForestParams(trees=12, min_split=12, min_leaf=6)
    grown = forest.fit_forest(table, ["a", "b"], params)
    risk = forest.score_forest(table, grown, ["a", "b"])
    assert concordance.concordance(table.join(risk, "vehicle_id")).first().c_index > 0.65
    again = forest.score_forest(table, forest.fit_forest(table.repartition(2), ["a", "b"], params), ["a", "b"])
    assert {r.vehicle_id: r.risk for r in risk.collect()} == pytest.approx({r.vehicle_id: r.risk for r in again.collect()})


def plain_leaf(times, events):
    """Event times, hazard steps and survival of a leaf's rows."""
    out, left = [], 1.0
    for time in sorted({t for t, e in zip(times, events) if e}):
        step = sum(t == time and e for t, e in zip(times, events)) / sum(t >= time for t in times)
        left *= 1 - step
        out.append((time, step, left))
    return out


def test_leaves_equal_plain_curves():
    rng = np.random.default_rng(3)
    t = np.sort(rng.integers(1, 12, 60).astype(float))
    e, x = rng.integers(0, 2, 60), rng.normal(size=(60, 2))
    axis = sorted({1.5, 20.0, *t[e == 1]})  # event times of all train rows
    later = np.array([sum(a >= v for a in axis) for v in t])
    nodes = forest.grow(t, e, x, later, forest.ForestParams(max_depth=2, min_leaf=8, max_features="all"), np.random.default_rng(0))
    members = {}
    for row in range(60):
        at = 0
        while nodes[at].feature >= 0:
            at = nodes[at].left if x[row, nodes[at].feature] <= nodes[at].cut else nodes[at].right
        members.setdefault(at, []).append(row)
    assert len(members) > 2
    for at, rows in members.items():
        plain = plain_leaf(t[rows].tolist(), e[rows].tolist())
        assert np.array(plain).T == pytest.approx(np.array([nodes[at].times, nodes[at].hazard, nodes[at].survival]))
        assert nodes[at].mortality == pytest.approx(sum(step for time, step, _ in plain for a in axis if a >= time))


def test_forest_curves_are_means_of_leaves(spark, table):
    params = forest.ForestParams(trees=5, max_depth=3, min_split=12, min_leaf=6)
    grown = forest.fit_forest(table, ["a", "b"], params).cache()
    grid = spark.createDataFrame([(v,) for v in (0.5, 2.0, 3.0, 8.0, 500.0)], "time double")
    curves = {}
    for r in forest.forest_curves(table, grown, ["a", "b"], grid).collect():
        curves.setdefault(r.vehicle_id, {})[r.time] = r.survival
    trees = {}
    for r in grown.collect():
        trees.setdefault(r.tree, {})[r.node] = r
    for i, _, _, a, b in survivors()[:20]:
        for time in (0.5, 2.0, 3.0, 8.0, 500.0):
            want = []
            for nodes in trees.values():
                node = nodes[0]
                while node.feature >= 0:
                    node = nodes[node.left if (a, b)[node.feature] <= node.cut else node.right]
                before = [s for at, s in zip(node.times, node.survival) if at <= time]
                want.append(before[-1] if before else 1.0)
            assert curves[i][time] == pytest.approx(np.mean(want))
    assert all(c[0.5] == 1 and sorted(c.values(), reverse=True) == [c[k] for k in sorted(c)] for c in curves.values())
    test = table.withColumn("duration", F.col("duration") + 0.0)
    auc = survival.dynamic_auc(test.join(forest.score_forest(table, grown, ["a", "b"]), "vehicle_id"), table, survival.time_grid(test, table, 6))
    scores = survival.brier_scores(test, table, forest.forest_curves(test, grown, ["a", "b"], survival.time_grid(test, table, 6)))
    assert np.mean([r.auc for r in auc.collect()]) > 0.6 and 0 < survival.integrated_brier(scores).first()[0] < 0.25


def test_search_equals_the_loop(spark, table):
    base = forest.ForestParams(trees=4, min_split=12, min_leaf=6)
    grid = {"trees": [2, 4], "max_depth": [1, 3]}
    found, best, tuned = forest.search_forest(spark, table, ["a", "b"], grid, draws=3, k=2, base=base)
    got = {(r.trees, r.max_depth): r.c_index for r in found.collect()}
    dealt = features.folds(table, 2, base.seed).cache()
    want = {}
    for params in forest.drawn_settings(grid, 3, base):
        scores = []
        for i in range(2):
            held = dealt.filter(F.col("fold") == i)
            risk = forest.score_forest(held, forest.fit_forest(dealt.filter(F.col("fold") != i), ["a", "b"], params), ["a", "b"])
            scores.append(concordance.concordance(held.join(risk, "vehicle_id")).first().c_index)
        want[params.trees, params.max_depth] = np.mean(scores)
    assert got == pytest.approx(want) and len(got) == 3
    assert want[best.trees, best.max_depth] == max(want.values())
    assert tuned.select("tree").distinct().count() == best.trees
    both = forest.fitted_forests(spark, table, table, ["a", "b"], base, grid=grid, draws=2, k=2).collect()
    assert [r.model for r in both] == ["baseline", "tuned"] and all(r.c_index > 0.6 for r in both)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 8, 100])
def test_range_of_a_value(spark, n):
    cuts = [0.5 * i for i in range(n)]
    values = [-1.0, *cuts, *(c + 0.1 for c in cuts), None]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", ranks.range_of(F.col("v"), cuts).alias("k")).collect()
    assert all(r.k == (0 if r.v is None else sum(c < r.v for c in cuts)) for r in got)


def test_running_sums_of_many_ranges(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).cast("double").alias("v"))
    got = ranks.running_sums(rows, "v", {"s": F.col("v")}, parts=40)
    assert got.filter("s != v * (v + 1) / 2").count() == 0 and got.count() == 5000
    held = ranks.in_ranges(rows, "v", 40)
    sizes = [r["count"] for r in held.groupBy("_range").count().collect()]
    assert len(sizes) == 40 and max(sizes) < 4 * 125
    twice = ranks.running_sums(ranks.running_sums(rows, "v", {"n": F.lit(1)}, descending=True, ranged=True), "v", {"m": F.lit(1)})
    assert twice.filter("n + m != 5001").count() == 0


def test_log_rank_of_one_split():
    t, e = np.array([1, 2, 2, 3, 4.0]), np.array([1, 1, 0, 1, 1])
    left = np.array([[1, 1, 0, 0, 0]], bool)
    seen = expected = spread = 0.0
    for time in (1, 2, 3, 4):
        n, own = (t >= time).sum(), (left[0] & (t >= time)).sum()
        d, mine = ((t == time) & (e == 1)).sum(), (left[0] & (t == time) & (e == 1)).sum()
        seen, expected = seen + mine, expected + d * own / n
        spread += d * (n - d) / (n - 1) * own / n * (1 - own / n) if n > 1 else 0
    assert forest.log_rank(t, e, left)[0] == pytest.approx(abs(seen - expected) / spread**0.5)


def test_errors_that_are_asked_for(spark):
    rows = spark.createDataFrame([(1, 1.0), (1, 2.0)], "vehicle_id bigint, v double")
    with pytest.raises(Exception, match="more than one row"):
        columns.one_to_one(rows, rows).collect()
    missing = spark.createDataFrame([(None,), (1.0,)], "v double")
    for broken in (X.fit_normalizer(missing, ["v"]), missing.select(X.log1p_checked("v")), spark.createDataFrame([(-1.0,)], "v double").select(X.log1p_checked("v"))):
        with pytest.raises(Exception, match="missing"):
            broken.collect()
    with pytest.raises(ValueError):
        sequences.checked_prefixes(rows, [])
    empty = spark.createDataFrame([], "prefix_id string, vehicle_id bigint, prefix_length bigint")
    with pytest.raises(ValueError, match="no prefixes"):
        sequences.checked_prefixes(empty, [])
    assert tuple(sequences.prefix_summary(empty).first()) == (0, 0, None, None, None)
    with pytest.raises(Exception, match="too few censored"):
        batches.event_batches(spark.createDataFrame([(1, 1), (2, 0)], "vehicle_id bigint, event int"), 8, 2).collect()


def test_readers_and_writers(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.5, "train"), (2, None, "test")], "vehicle_id bigint, v double, split string")
    tables.write_csv(rows, f"{tmp_path}/rows.csv")
    back = tables.read_raw_tables(spark, str(tmp_path), {"rows": rows.schema})["rows"]
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.read_csv(spark, f"{tmp_path}/none.csv", rows.schema)
    tables.write_processed({"train": rows}, {"train": rows.select("vehicle_id")}, f"{tmp_path}/p")
    held = tables.read_processed(spark, f"{tmp_path}/p", ("train",))
    assert held["X_train"].count() == held["y_train"].count() == 2
    tables.write_list(spark, ["b", "a"], f"{tmp_path}/list")
    assert tables.read_list(spark, f"{tmp_path}/list") == ["b", "a"]
    tables.write_artifacts(f"{tmp_path}/a", rows, scaler=rows.agg(F.avg("v").alias("v_mean")))
    found = tables.read_artifacts(spark, f"{tmp_path}/a", "scaler", split="test")
    assert found["sequences"].first().vehicle_id == 2 and found["scaler"].first().v_mean == 0.5


@pytest.mark.parametrize("parts", [1, 9])
def test_dynamic_auc_equals_all_pairs(spark, parts):
    """Half of the rows have one risk."""
    rng = np.random.default_rng(9)
    rows = [(i, float(rng.integers(1, 20)), int(rng.integers(0, 2)), 0.5 if i % 2 else float(rng.integers(0, 30)) / 10) for i in range(150)]
    test = spark.createDataFrame(rows, "vehicle_id bigint, duration double, event int, risk double")
    weight = {r.vehicle_id: r.weight for r in survival.weighted_events(test, test).collect()}
    grid = spark.createDataFrame([(3.5,), (9.0,), (15.0,)], "time double")
    got = {r.time: r.auc for r in survival.dynamic_auc(test, test, grid, parts).collect()}
    for at, auc in got.items():
        cases, controls = [r for r in rows if r[2] and r[1] <= at], [r for r in rows if r[1] > at]
        won = sum(weight[a[0]] * ((a[3] > b[3]) + (a[3] == b[3]) / 2) for a in cases for b in controls)
        assert auc == pytest.approx(won / (sum(weight[a[0]] for a in cases) * len(controls)))
    assert len(got) == 3
    assert survival.dynamic_auc(test.limit(0), test, grid).filter("auc is null").count() == 3


def test_paths_and_results(spark, tmp_path):
    project = paths.Paths(f"file://{tmp_path}/p/")
    project.create(spark)
    project.create(spark)
    assert {str(f.relative_to(tmp_path / "p")) for f in (tmp_path / "p").rglob("*")} >= {"data/raw", "data/processed/sequences", "results/tables", "results/logs"}
    assert project.raw("tte").endswith("/data/raw/train_tte.csv") and project.predictors("val", "with_static").endswith("X_val_trunc_with_static.csv")
    with pytest.raises(ValueError, match="split"):
        project.targets("all")
    tables.write_dict(spark, {"a": [1, {"b": None}], "c": "x\ny"}, f"{tmp_path}/d")
    assert tables.read_dict(spark, f"{tmp_path}/d") == {"a": [1, {"b": None}], "c": "x\ny"}
    tables.write_latex(spark.createDataFrame([("a_1", 0.5, None), ("b", 2.0, 3)], "model string, c_index double, n int"), f"{tmp_path}/t")
    text = "\n".join(r.value for r in spark.read.text(f"{tmp_path}/t", wholetext=True).collect())
    assert "a\\_1 & 0.500 & --" in text and text.count(r"\\") >= 3 and r"\toprule" in text


def test_what_is_stored_can_be_released(spark, tmp_path):
    kept = stored.stored(spark.range(3), f"file://{tmp_path}/kept")
    held = stored.stored(spark.range(5))
    assert held.count() == 5 and stored.release(spark) >= 1 and stored.release(spark) == 0
    assert kept.count() == 3
    with pytest.raises(Exception, match="FILE_NOT_EXIST|PATH_NOT_FOUND|does not exist"):
        held.count()


def test_spectra_of_long_sequences_are_the_same(spark):
    rng = np.random.default_rng(1)
    rows = [(v, i + 1, n, float(rng.normal())) for v, n in ((1, 9), (2, 30)) for i in range(n)]
    table = spark.createDataFrame(rows, "vehicle_id bigint, seq_idx bigint, sequence_length bigint, x double")
    whole, added = ({(r.vehicle_id, r.bin): r.x for r in spectral.frequency_representation(table, ["x"], k).collect()} for k in (100, 10))
    assert whole == pytest.approx(added) and len(whole) == 5 + 16


def test_kaplan_meier_of_censoring(spark):
    rows = spark.createDataFrame([(1.0, 1), (2.0, 1), (2.0, 0), (3.0, 0), (4.0, 1)], "duration double, event int")
    got = {r.time: r.survival for r in survival.censoring_survival(rows).collect()}
    assert got == pytest.approx({1.0: 1.0, 2.0: 2 / 3, 3.0: 1 / 3, 4.0: 1 / 3})
