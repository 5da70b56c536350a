"""Queries of losses, models and survival metrics; SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import cox, forest
from tidemark.operators import features as A
from tidemark.operators import losses as L
from tidemark.operators import sequences as B
from tidemark.operators import survival as M
from tidemark.operators.columns import with_targets
from tidemark.operators.concordance import concordance
from tidemark.plans.catalog import READOUTS, RISKS, SEQUENCES, SPLIT, VEHICLES, _risks, _sql, rounded
from tidemark.sources.stored import stored
from tidemark.sources.tables import order_readouts, order_vehicles, table

GRID = 20
FEATURES = ["sequence_length", "1_0_mean", "gap_mean", "observation_density"]


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    split = A.stratified_split(order_vehicles(spark, d)).select("vehicle_id", "split")
    rows = stored(_risks(spark, d).select("vehicle_id", "duration", "event", "risk").join(split, "vehicle_id"))
    return rows.filter("split = 'train'").drop("split"), rows.filter("split = 'test'").drop("split")


def m3_time_grid(spark, d):
    train, test = _parts(spark, d)
    return rounded(M.time_grid(test, train, GRID))


def m4_baseline_grid(spark, d):
    train, test = _parts(spark, d)
    return M.baseline_grid(M.breslow_baseline(train), test, train, GRID)


def _curves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    train, test = _parts(spark, d)
    return train, test, stored(M.survival_curves(test, M.breslow_baseline(train), M.time_grid(test, train, GRID)))


def m2_survival_curves(spark, d):
    return rounded(_curves(spark, d)[2])


def m5_dynamic_auc(spark, d):
    train, test = _parts(spark, d)
    return rounded(M.dynamic_auc(test, train, stored(M.time_grid(test, train, GRID))))


def m5_mean_auc(spark, d):
    train, test = _parts(spark, d)
    return rounded(M.mean_auc(stored(M.dynamic_auc(test, train, stored(M.time_grid(test, train, GRID)))), test))


def m6_brier_scores(spark, d):
    train, test, curves = _curves(spark, d)
    return rounded(M.brier_scores(test, train, curves))


def m6_integrated_brier(spark, d):
    train, test, curves = _curves(spark, d)
    return rounded(M.integrated_brier(M.brier_scores(test, train, curves)))


def t3_leaderboard(spark, d):
    train, test = _parts(spark, d)
    out = None
    for model, risk in (("drawn", F.col("risk")), ("longest", F.col("duration")), ("shortest", -F.col("duration"))):
        for split, rows in (("train", train), ("test", test)):
            found = concordance(rows.withColumn("risk", risk)).select(F.lit(model).alias("model"), F.lit(split).alias("split"), "c_index")
            out = found if out is None else out.unionByName(found)
    return rounded(M.leaderboard(out))


def _views(spark: SparkSession, d: str) -> DataFrame:
    """Two views of each embedding: as it is, and with small steps added that depend on id and place."""
    held = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    moved = F.transform("vector", lambda x, i: x + 0.1 * ((F.col("id") * 31 + (i + 1) * 17) % 7 - 3))
    both = held.withColumn("view", F.lit(1)).unionByName(held.select("id", moved.alias("vector"), F.lit(2).alias("view")))
    return L.in_batches(both, 50)


def l1_nt_xent(spark, d):
    return rounded(L.nt_xent(_views(spark, d)))


def l3_combined_loss(spark, d):
    views = _views(spark, d)
    halves = views.withColumn("vector", F.slice("vector", 1, 32))
    apart = [views.filter(F.col("view") == v).groupBy("batch").agg(F.avg(L.consistency(F.col("vector"), F.reverse("vector"))).alias("loss")) for v in (1, 2)]
    return rounded(L.combined_loss(L.nt_xent(views), L.nt_xent(halves, 0.5), *apart))


def l4_batch_diagnostics(spark, d):
    return rounded(L.batch_diagnostics(_views(spark, d)))


def _tabular(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Features and targets of train and test vehicles."""
    vehicles = order_vehicles(spark, d)
    rows = with_targets(A.aggregate_sequences(B.build_sequences(order_readouts(spark, d).drop("status")), ["1_0"]), vehicles)
    rows = rows.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in FEATURES}).select("vehicle_id", "duration", "event", *FEATURES)
    split = A.stratified_split(vehicles).select("vehicle_id", "split")
    held = stored(rows.join(split, "vehicle_id"))
    return held.filter("split = 'train'").drop("split"), held.filter("split = 'test'").drop("split")


def l11_cox_coefficients(spark, d):
    return rounded(cox.fit_cox(_tabular(spark, d)[0], FEATURES).coefficients(spark), 4)


def l11_cox_concordance(spark, d):
    return rounded(cox.evaluate_cox(*_tabular(spark, d), FEATURES)[1])


def m7_curve_evaluation(spark, d):
    """One row: concordance, mean AUC and integrated Brier score of a fitted model on test vehicles."""
    train, test = _tabular(spark, d)
    model = cox.fit_cox(train, FEATURES)
    train, test = (stored(model.score(t).select("vehicle_id", "duration", "event", F.log("partial_hazard").alias("risk"))) for t in (train, test))
    grid = stored(M.time_grid(test, train, GRID))
    curves = stored(M.survival_curves(test, M.breslow_baseline(train), grid))
    out = concordance(test).select("c_index").crossJoin(M.mean_auc(stored(M.dynamic_auc(test, train, grid)), test))
    return rounded(out.crossJoin(M.integrated_brier(stored(M.brier_scores(test, train, curves)))), 4)


def m8_predictions(spark, d):
    train, test = _tabular(spark, d)
    scored = cox.fit_cox(train, FEATURES).score(test)
    return rounded(scored.select("vehicle_id", F.log("partial_hazard").alias("risk"), "duration", "event"), 4)


FOREST = forest.ForestParams(trees=10, max_depth=8)


def _forest(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    train, test = _tabular(spark, d)
    return train, test, stored(forest.fit_forest(train, FEATURES, FOREST))


def l12_forest_risk(spark, d):
    _, test, grown = _forest(spark, d)
    return rounded(forest.score_forest(test, grown, FEATURES), 4)


def l12_forest_curves(spark, d):
    train, test, grown = _forest(spark, d)
    return rounded(forest.forest_curves(test, grown, FEATURES, M.time_grid(test, train, GRID)), 4)


def l12_forest_evaluation(spark, d):
    """One row: concordance, mean AUC and integrated Brier score of the forest's risks and curves on test vehicles."""
    train, test, grown = _forest(spark, d)
    grid = stored(M.time_grid(test, train, GRID))
    scored = stored(test.select("vehicle_id", "duration", "event").join(forest.score_forest(test, grown, FEATURES), "vehicle_id"))
    curves = stored(forest.forest_curves(test, grown, FEATURES, grid))
    out = concordance(scored).select("c_index").crossJoin(M.mean_auc(stored(M.dynamic_auc(scored, train, grid)), test))
    return rounded(out.crossJoin(M.integrated_brier(stored(M.brier_scores(test, train, curves)))), 4)


SEARCH = {"grid": {"trees": [4, 8], "max_depth": [3, 6], "min_leaf": [10, 20]}, "draws": 2, "k": 2}


def l13_forest_search(spark, d):
    return rounded(forest.search_forest(spark, _tabular(spark, d)[0], FEATURES, base=FOREST, **SEARCH)[0], 4)


def l13_forest_models(spark, d):
    """The baseline forest and the best of a search, refitted, by their concordance on test vehicles."""
    train, test = _tabular(spark, d)
    return rounded(forest.fitted_forests(spark, train, test, FEATURES, FOREST, **SEARCH), 4)


PARTS = """te AS (SELECT t.* FROM t JOIN p USING (vehicle_id) WHERE split = 'test'),
tr AS (SELECT t.* FROM t JOIN p USING (vehicle_id) WHERE split = 'train'),
"""
TIMES = f"""gr AS (SELECT DISTINCT time FROM (SELECT a + (b - a) * i / {GRID - 1} AS time FROM (SELECT quantile_cont(duration, 0.05) AS a, quantile_cont(duration, 0.95) AS b FROM te), range({GRID}) AS i(i)), (SELECT min(duration) AS lo, max(duration) AS hi FROM tr)
  WHERE time > lo AND time < hi),
"""
CENSORING = """cr AS (SELECT time, gone - ev AS c, sum(gone) OVER (ORDER BY time DESC) - ev AS m FROM (SELECT duration AS time, count(*) AS gone, sum(event) AS ev FROM tr GROUP BY 1)),
cg AS (SELECT time, CASE WHEN max((c > 0 AND c = m)::INT) OVER w = 1 THEN 0 ELSE exp(sum(CASE WHEN c > 0 AND c < m THEN ln(1 - c / m) ELSE 0 END) OVER w) END AS g FROM cr WINDOW w AS (ORDER BY time)),
wt AS (SELECT te.*, CASE WHEN event = 1 THEN 1 / nullif(coalesce(g, 1), 0) ELSE 0 END AS weight FROM te ASOF LEFT JOIN cg ON te.duration >= cg.time),
"""
AUC = """au AS (SELECT time, sum(a.weight * ((b.risk < a.risk)::INT + (b.risk = a.risk)::INT / 2)) / nullif(sum(a.weight), 0) AS auc FROM gr LEFT JOIN wt a ON a.event = 1 AND a.duration <= time LEFT JOIN te b ON b.duration > time GROUP BY time),
"""
BASELINE = """ho AS (SELECT duration, events, sum(own) OVER (ORDER BY duration DESC) AS hazard FROM (SELECT duration, sum(event) AS events, sum(exp(risk)) AS own FROM tr GROUP BY 1)),
bl AS (SELECT duration AS time, sum(events / hazard) OVER (ORDER BY duration) AS h0 FROM ho WHERE events > 0),
"""
CURVES = """cu AS (SELECT vehicle_id, time, exp(-coalesce(h0, 0) * exp(risk)) AS s FROM (SELECT gr.time, h0 FROM gr ASOF LEFT JOIN bl ON gr.time >= bl.time), te),
"""
BRIER = """br AS (SELECT time, avg(CASE WHEN duration <= time AND event = 1 THEN s ** 2 * weight WHEN duration > time THEN (1 - s) ** 2 / nullif(coalesce(g, 1), 0) ELSE 0 END) AS brier
  FROM (SELECT cu.*, duration, event, weight, g FROM cu JOIN wt USING (vehicle_id) JOIN (SELECT gr.time, g FROM gr ASOF LEFT JOIN cg ON gr.time >= cg.time) USING (time)) GROUP BY time),
"""
KM = """kr AS (SELECT time, events, sum(gone) OVER (ORDER BY time DESC) AS m FROM (SELECT duration AS time, count(*) AS gone, sum(event) AS events FROM te GROUP BY 1)),
km AS (SELECT time, CASE WHEN max((events = m)::INT) OVER w = 1 THEN 0 ELSE exp(sum(CASE WHEN events < m THEN ln(1 - events / m) ELSE 0 END) OVER w) END AS s FROM kr WHERE events > 0 WINDOW w AS (ORDER BY time)),
"""
BASE = (READOUTS, VEHICLES, SPLIT, RISKS, PARTS)
EMBEDDINGS = """e AS (SELECT vec_id AS id, vec_id // 50 AS batch, 1 AS view, embedding::DOUBLE[] AS v FROM embeddings
  UNION ALL SELECT vec_id, vec_id // 50, 2, [embedding[i]::DOUBLE + 0.1 * ((vec_id * 31 + i * 17) % 7 - 3) FOR i IN range(1, len(embedding) + 1)] FROM embeddings),
"""


def _loss(name: str, vector: str, temperature: float) -> str:
    return f"""{name} AS (SELECT batch, avg(l) AS loss FROM (SELECT a.batch, ln(sum(exp(list_cosine_similarity(a.{vector}, b.{vector}) / {temperature}))) - max(CASE WHEN a.id = b.id THEN list_cosine_similarity(a.{vector}, b.{vector}) / {temperature} END) AS l
  FROM {'e' if vector == 'v' else 'eh'} a JOIN {'e' if vector == 'v' else 'eh'} b ON a.batch = b.batch AND (a.id, a.view) <> (b.id, b.view) GROUP BY a.batch, a.id, a.view HAVING count(DISTINCT b.id) > 1) GROUP BY batch),
"""


ORACLE_SQL = {
    "m3_time_grid": _sql(*BASE, TIMES, "SELECT round(time, 5) AS time FROM gr"),
    "m4_baseline_grid": _sql(*BASE, BASELINE, f"""n AS (SELECT time, row_number() OVER (ORDER BY time) - 1 AS i, count(*) OVER () AS m FROM bl, (SELECT min(duration) AS a, max(duration) AS b FROM te), (SELECT min(duration) AS lo, max(duration) AS hi FROM tr) WHERE time >= a AND time < b AND time > lo AND time < hi)""", f"""
SELECT time FROM n WHERE i IN (SELECT floor(j * (m - 1) / (least(m, {GRID}) - 1) + 1e-9)::BIGINT FROM (SELECT DISTINCT m FROM n), range({GRID}) AS j(j) WHERE j < m)"""),
    "m2_survival_curves": _sql(*BASE, TIMES, BASELINE, CURVES, "SELECT vehicle_id, round(time, 5) AS time, round(s, 5) AS survival FROM cu"),
    "m5_dynamic_auc": _sql(*BASE, TIMES, CENSORING, AUC, "SELECT round(time, 5) AS time, round(auc, 5) AS auc FROM au"),
    "m5_mean_auc": _sql(*BASE, TIMES, CENSORING, AUC, KM, """st AS (SELECT au.time, auc, coalesce(s, 1) AS s FROM au ASOF LEFT JOIN km ON au.time >= km.time)""", "\nSELECT round(sum(auc * f) / (1 - min(s)), 5) AS mean_auc FROM (SELECT *, coalesce(lag(s) OVER (ORDER BY time), 1) - s AS f FROM st)"),
    "m6_brier_scores": _sql(*BASE, TIMES, CENSORING, BASELINE, CURVES, BRIER, "SELECT round(time, 5) AS time, round(brier, 5) AS brier FROM br"),
    "m6_integrated_brier": _sql(*BASE, TIMES, CENSORING, BASELINE, CURVES, BRIER, "SELECT round(sum(a) / (max(time) - min(time)), 5) AS integrated_brier FROM (SELECT time, (time - lag(time) OVER o) * (brier + lag(brier) OVER o) / 2 AS a FROM br WINDOW o AS (ORDER BY time))"),
    "t3_leaderboard": _sql(*BASE, """b AS (SELECT *, 'test' AS split FROM te UNION ALL SELECT *, 'train' FROM tr),
x AS (SELECT 'drawn' AS model, split, duration, event, risk FROM b UNION ALL SELECT 'longest', split, duration, event, duration FROM b UNION ALL SELECT 'shortest', split, duration, event, -duration FROM b),
c AS (SELECT a.model, a.split, (count(*) FILTER (a.risk > o.risk) + count(*) FILTER (a.risk = o.risk) / 2) / count(*) AS c FROM x a JOIN x o ON a.model = o.model AND a.split = o.split AND a.event = 1 AND (o.duration > a.duration OR (o.duration = a.duration AND o.event = 0)) GROUP BY 1, 2)""", """
SELECT model, split, round(c, 5) AS c_index, row_number() OVER (PARTITION BY split ORDER BY c DESC, model)::INT AS place FROM c"""),
    "l1_nt_xent": _sql(EMBEDDINGS, _loss("n", "v", 0.2), "SELECT batch, round(loss, 5) AS loss FROM n"),
    "l3_combined_loss": _sql(EMBEDDINGS, "eh AS (SELECT id, batch, view, v[1:32] AS h FROM e),\n", _loss("n", "v", 0.2), _loss("m", "h", 0.5), "c AS (SELECT batch, avg(1 - list_cosine_similarity(v, list_reverse(v))) AS loss FROM e GROUP BY batch)", "\nSELECT batch, round((n.loss + m.loss) / 2 + c.loss / 2, 5) AS loss FROM n JOIN m USING (batch) JOIN c USING (batch)"),
    "l4_batch_diagnostics": _sql(EMBEDDINGS, """s AS (SELECT batch, avg(sd) AS mean_std FROM (SELECT batch, i, stddev_samp(x) AS sd FROM (SELECT batch, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e) GROUP BY 1, 2) GROUP BY 1),
n AS (SELECT batch, avg(sqrt(list_dot_product(v, v))) AS mean_norm FROM e GROUP BY 1),
c AS (SELECT a.batch, avg(list_cosine_similarity(a.v, b.v)) FILTER (a.id = b.id) AS p, avg(list_cosine_similarity(a.v, b.v)) FILTER (a.id <> b.id) AS q FROM e a JOIN e b ON a.batch = b.batch AND (a.id, a.view) <> (b.id, b.view) GROUP BY 1)""", """
SELECT batch, round(mean_std, 5) AS mean_std, round(mean_norm, 5) AS mean_norm, round(p, 5) AS positive_cosine, round(q, 5) AS negative_cosine FROM s JOIN n USING (batch) JOIN c USING (batch)"""),
}
#: Iterative fits: these have no SQL and are tested against plain versions.
PLAIN = ("l11_cox_coefficients", "l11_cox_concordance", "m7_curve_evaluation", "m8_predictions", "l12_forest_risk", "l12_forest_curves", "l12_forest_evaluation", "l13_forest_search", "l13_forest_models")
QUERIES = {name: globals()[name] for name in (*ORACLE_SQL, *PLAIN)}
