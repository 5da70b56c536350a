"""The operators as queries over the stored tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import transforms as X
from tidemark.operators import features as A
from tidemark.operators import quality as Q
from tidemark.operators import sequences as B
from tidemark.operators import survival as M
from tidemark.operators.concordance import concordance
from tidemark.operators import views as V
from tidemark.sources.tables import order_readouts, order_vehicles, table

PRICE = "1_0"
LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def rounded(table: DataFrame, places: int = 5) -> DataFrame:
    """``table`` with its doubles rounded, so that results can be compared by value."""
    kinds = dict(table.dtypes)
    return table.select(*[(F.round(F.col(f"`{c}`"), places) if kinds[c] == "double" else F.col(f"`{c}`")).alias(c) for c in table.columns])


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.build_sequences(order_readouts(spark, sf_dir).drop("status"))


def _attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.attach_vehicles(_sequences(spark, sf_dir), order_vehicles(spark, sf_dir))


def _filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.forward_fill(_sequences(spark, sf_dir), [PRICE])


def _train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.stratified_split(order_vehicles(spark, sf_dir)).filter("split = 'train'").select("vehicle_id")


def a5_tabular_aggregate(spark, d):
    return rounded(A.aggregate_sequences(_sequences(spark, d), [PRICE]), 4)


def q2_duplicate_pairs(spark, d):
    return Q.duplicate_pairs(order_readouts(spark, d)).select("vehicle_id", "rid", "time_step")


def q3_steps_back(spark, d):
    return Q.steps_back(order_readouts(spark, d)).select("vehicle_id", "rid", "time_diff")


def q4_time_gaps(spark, d):
    return Q.time_gaps(order_readouts(spark, d))


def q5_gap_summary(spark, d):
    return rounded(Q.describe(Q.time_gaps(order_readouts(spark, d)), "gap"))


def q6_large_gaps(spark, d):
    return Q.large_gaps(Q.time_gaps(order_readouts(spark, d)), 50)


def q7_counter_resets(spark, d):
    return rounded(Q.counter_resets(order_readouts(spark, d), [PRICE]))


def q11_null_counts(spark, d):
    return Q.null_counts(order_readouts(spark, d))


def b1_sequences(spark, d):
    return _sequences(spark, d).select("vehicle_id", "rid", "time_step", "seq_idx", "time_gap", "sequence_length")


def b2_random_truncation(spark, d):
    return B.truncate_at_random(_attached(spark, d)).select("vehicle_id", "rid", "seq_idx", "sequence_length", "readout_time", "original_duration", "duration", "event")


def b6_prefixes(spark, d):
    return rounded(B.build_prefixes(_sequences(spark, d)).select("prefix_id", "vehicle_id", "rid", "seq_idx", "prefix_number", "prefix_length", "prefix_fraction"))


def b10_fixed_horizon(spark, d):
    return B.truncate_at_horizon(_attached(spark, d), 365.0).select("vehicle_id", "rid", "seq_idx", "sequence_length", "readout_time", "original_duration", "duration")


def n3_forward_fill(spark, d):
    return _filled(spark, d).select("vehicle_id", "rid", F.col(PRICE).alias("filled"))


def n8_normalized(spark, d):
    filled = _filled(spark, d)
    fitted = X.fit_normalizer(filled.join(_train(spark, d), "vehicle_id"), [PRICE])
    return rounded(X.normalize(filled, fitted, [PRICE]).select("vehicle_id", "rid", F.col(PRICE).alias("scaled")))


def n10_first_difference(spark, d):
    return rounded(_filled(spark, d).select("vehicle_id", "rid", X.first_difference(PRICE).alias("step")), 3)


def n12_scaled_gaps(spark, d):
    sequences = _sequences(spark, d)
    return rounded(X.scale_gaps(sequences, X.fit_gap_scaler(sequences.join(_train(spark, d), "vehicle_id"))).select("vehicle_id", "rid", "time_gap_scaled"))


def n15_vocabulary(spark, d):
    return X.fit_vocabulary(order_vehicles(spark, d).join(_train(spark, d), "vehicle_id"), ["Spec_0", "Spec_1"])


def x1_stratified_split(spark, d):
    return A.stratified_split(order_vehicles(spark, d)).select("vehicle_id", "event", "split")


def m_kaplan_meier(spark, d):
    return rounded(M.kaplan_meier(order_vehicles(spark, d)))


def m1_c_index(spark, d):
    return rounded(concordance(_risks(spark, d)))


def _risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_vehicles(spark, sf_dir).withColumn("risk", F.col("vehicle_id") * 7919 % 1009 / 500)


def l5_cox_loss(spark, d):
    return rounded(M.cox_loss(_risks(spark, d)))


def m2_breslow_baseline(spark, d):
    return rounded(M.breslow_baseline(_risks(spark, d)))


def t4_nearest_to_percentiles(spark, d):
    return M.nearest_to_percentiles(order_vehicles(spark, d), "duration")


def f2_correlations(spark, d):
    return rounded(A.correlations(table(spark, d, "lineitem"), LINE_FEATURES))


def x3_folds(spark, d):
    return A.folds(order_vehicles(spark, d)).select("vehicle_id", "fold")


def g1_masked_views(spark, d):
    return V.masked_views(_filled(spark, d), PRICE).select("vehicle_id", "rid", "view", F.col(PRICE).alias("masked"))


def l2_consistency(spark, d):
    view = F.col("embedding").cast("array<double>")
    return rounded(table(spark, d, "embeddings").select("vec_id", (1 - V.cosine(view, F.reverse(view))).alias("distance")), 4)


def n14_right_aligned(spark, d):
    return V.right_aligned(_sequences(spark, d), "time_gap", 8)


READOUTS = """r AS (SELECT o_custkey AS vehicle_id, o_orderkey AS rid, date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::DOUBLE AS time_step,
  CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS f, o_orderstatus AS status FROM orders),
"""
VEHICLES = """v AS (SELECT c_custkey AS vehicle_id, c_mktsegment AS s0, c_nationkey::VARCHAR AS s1, last + 30 AS duration, (status = 'F')::INT AS event
  FROM customer JOIN (SELECT vehicle_id, max(time_step) AS last, arg_max(status, (time_step, rid)) AS status FROM r GROUP BY 1) ON c_custkey = vehicle_id),
"""
SEQUENCES = """s AS (SELECT *, row_number() OVER w AS seq_idx, coalesce(time_step - lag(time_step) OVER w, 0) AS time_gap, count(*) OVER (PARTITION BY vehicle_id) AS n
  FROM r WINDOW w AS (PARTITION BY vehicle_id ORDER BY time_step, rid)),
"""
FILLED = """f AS (SELECT *, coalesce(last_value(f IGNORE NULLS) OVER (PARTITION BY vehicle_id ORDER BY time_step, rid ROWS UNBOUNDED PRECEDING), 0) AS x FROM s),
"""
SPLIT = """p AS (SELECT vehicle_id, event, CASE WHEN k <= floor(m * 0.7) THEN 'train' WHEN k <= floor(m * 0.85) THEN 'val' ELSE 'test' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY event ORDER BY md5('42:' || vehicle_id), vehicle_id) AS k, count(*) OVER (PARTITION BY event) AS m FROM v)),
"""
GAPS = "g AS (SELECT vehicle_id, rid, time_step, time_step - lag(time_step) OVER (PARTITION BY vehicle_id ORDER BY time_step, rid) AS gap FROM r),\n"
RISKS = "t AS (SELECT vehicle_id, duration, event, vehicle_id * 7919 % 1009 / 500 AS risk FROM v),\nh AS (SELECT duration, events, sum(own) OVER (ORDER BY duration DESC) AS hazard FROM (SELECT duration, sum(event) AS events, sum(exp(risk)) AS own FROM t GROUP BY 1)),\n"
STEPS = "d AS (SELECT *, lag(f) OVER (PARTITION BY vehicle_id ORDER BY time_step, rid) AS prev FROM r),\n"


def _sql(*parts: str) -> str:
    *tables, last = parts
    return f"WITH {''.join(tables).rstrip().rstrip(',')}\n{last}"


ORACLE_SQL = {
    "a5_tabular_aggregate": _sql(READOUTS, SEQUENCES, """SELECT vehicle_id, round(a, 4) AS "1_0_first", round(b, 4) AS "1_0_last", round(b - a, 4) AS "1_0_delta",
  round(CASE WHEN t1 <> t0 THEN (b - a) / (t1 - t0) END, 4) AS "1_0_slope", round(m, 4) AS "1_0_mean", round(sd, 4) AS "1_0_std", round(lo, 4) AS "1_0_min", round(hi, 4) AS "1_0_max",
  round(gap_mean, 4) AS gap_mean, round(gap_std, 4) AS gap_std, gap_min, gap_max, round(gap_median, 4) AS gap_median, n AS sequence_length, te AS final_time_step,
  round(CASE WHEN te = 0 THEN 0 ELSE n / te END, 4) AS observation_density
FROM (SELECT vehicle_id, arg_min(f, seq_idx) FILTER (f IS NOT NULL) AS a, arg_max(f, seq_idx) FILTER (f IS NOT NULL) AS b, min(time_step) FILTER (f IS NOT NULL) AS t0,
  max(time_step) FILTER (f IS NOT NULL) AS t1, avg(f) AS m, stddev_pop(f) AS sd, min(f) AS lo, max(f) AS hi, avg(g) AS gap_mean, stddev_pop(g) AS gap_std, min(g) AS gap_min, max(g) AS gap_max,
  median(g) AS gap_median, max(n) AS n, max(time_step) AS te FROM (SELECT *, CASE WHEN seq_idx > 1 OR n = 1 THEN time_gap END AS g FROM s) GROUP BY vehicle_id)"""),
    "q2_duplicate_pairs": _sql(READOUTS, "SELECT vehicle_id, rid, time_step FROM r QUALIFY count(*) OVER (PARTITION BY vehicle_id, time_step) > 1"),
    "q3_steps_back": _sql(READOUTS, "SELECT vehicle_id, rid, time_step - lag(time_step) OVER (PARTITION BY vehicle_id ORDER BY rid) AS time_diff FROM r QUALIFY time_diff < 0"),
    "q4_time_gaps": _sql(READOUTS, GAPS, "SELECT * FROM g"),
    "q5_gap_summary": _sql(READOUTS, GAPS, "SELECT count(gap) AS n, round(avg(gap), 5) AS mean, round(stddev_samp(gap), 5) AS std, min(gap) AS least, max(gap) AS most, " + ", ".join(f"round(quantile_cont(gap, {p}), 5) AS p{round(p * 100)}" for p in Q.PERCENTILES) + " FROM g"),
    "q6_large_gaps": _sql(READOUTS, GAPS, "SELECT * FROM g WHERE gap > 50"),
    "q7_counter_resets": _sql(READOUTS, STEPS, "SELECT vehicle_id, time_step, '1_0' AS feature, round(f, 5) AS value, round(prev, 5) AS prev, round(f - prev, 5) AS diff FROM d WHERE f < prev"),
    "q11_null_counts": _sql(READOUTS, "SELECT '1_0' AS feature, count(*) - count(f) AS nulls FROM r"),
    "b1_sequences": _sql(READOUTS, SEQUENCES, "SELECT vehicle_id, rid, time_step, seq_idx, time_gap, n AS sequence_length FROM s"),
    "b2_random_truncation": _sql(READOUTS, VEHICLES, SEQUENCES, """c AS (SELECT *, 5 + ('0x' || substr(md5('42:' || vehicle_id), 1, 8))::BIGINT % (n - 4) AS cut FROM s WHERE n >= 5),
t AS (SELECT vehicle_id, rid, seq_idx, cut AS sequence_length, max(time_step) OVER (PARTITION BY vehicle_id) AS readout_time FROM c WHERE seq_idx <= cut)""", """
SELECT t.*, duration AS original_duration, duration - readout_time AS duration, event FROM t JOIN v USING (vehicle_id) WHERE duration > readout_time"""),
    "b6_prefixes": _sql(READOUTS, SEQUENCES, """l AS (SELECT vehicle_id, n, list_sort(list_distinct([least(greatest(round_even(n * 0.3, 0)::BIGINT, 5), n - 1), least(greatest(round_even(n * 0.6, 0)::BIGINT, 5), n - 1), least(greatest(round_even(n * 0.9, 0)::BIGINT, 5), n - 1)])) AS ls
  FROM (SELECT DISTINCT vehicle_id, n FROM s) WHERE n > 5),
q AS (SELECT vehicle_id, n, unnest(ls) AS prefix_length, generate_subscripts(ls, 1) AS prefix_number FROM l)""", """
SELECT vehicle_id || '_p' || prefix_number AS prefix_id, vehicle_id, rid, seq_idx, prefix_number, prefix_length, round(prefix_length / q.n, 5) AS prefix_fraction FROM q JOIN s USING (vehicle_id) WHERE seq_idx <= prefix_length"""),
    "b10_fixed_horizon": _sql(READOUTS, VEHICLES, SEQUENCES, """t AS (SELECT vehicle_id, rid, seq_idx, duration AS original_duration, max(time_step) OVER (PARTITION BY vehicle_id) AS readout_time, count(*) OVER (PARTITION BY vehicle_id) AS k
  FROM s JOIN v USING (vehicle_id) WHERE duration > 365 AND time_step <= duration - 365)""", """
SELECT vehicle_id, rid, seq_idx, k AS sequence_length, readout_time, original_duration, original_duration - readout_time AS duration FROM t WHERE k >= 5"""),
    "n3_forward_fill": _sql(READOUTS, SEQUENCES, FILLED, "SELECT vehicle_id, rid, x AS filled FROM f"),
    "n8_normalized": _sql(READOUTS, VEHICLES, SEQUENCES, FILLED, SPLIT, "SELECT vehicle_id, rid, round((x - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 5) AS scaled FROM f, (SELECT avg(x) AS m, stddev_pop(x) AS sd FROM f JOIN p USING (vehicle_id) WHERE split = 'train')"),
    "n10_first_difference": _sql(READOUTS, SEQUENCES, FILLED, "SELECT vehicle_id, rid, round(coalesce(x - lag(x) OVER (PARTITION BY vehicle_id ORDER BY time_step, rid), 0), 3) AS step FROM f"),
    "n12_scaled_gaps": _sql(READOUTS, VEHICLES, SEQUENCES, SPLIT, "SELECT vehicle_id, rid, round((ln(1 + time_gap) - m) / CASE WHEN sd < 1e-8 THEN 1 ELSE sd END, 5) AS time_gap_scaled FROM s, (SELECT avg(ln(1 + time_gap)) AS m, stddev_pop(ln(1 + time_gap)) AS sd FROM s JOIN p USING (vehicle_id) WHERE split = 'train')"),
    "n15_vocabulary": _sql(READOUTS, VEHICLES, SPLIT, "u AS (SELECT DISTINCT feature, category FROM (SELECT vehicle_id, 'Spec_0' AS feature, s0 AS category FROM v UNION ALL SELECT vehicle_id, 'Spec_1', s1 FROM v) JOIN p USING (vehicle_id) WHERE split = 'train')", " SELECT feature, category, (row_number() OVER (PARTITION BY feature ORDER BY category) - 1)::INT AS code FROM u"),
    "x1_stratified_split": _sql(READOUTS, VEHICLES, SPLIT, "SELECT * FROM p"),
    "m_kaplan_meier": _sql(READOUTS, VEHICLES, """k AS (SELECT duration AS time, count(*) AS gone, sum(event)::BIGINT AS events FROM v GROUP BY 1),
h AS (SELECT time, events, (sum(gone) OVER (ORDER BY time DESC))::BIGINT AS at_risk FROM k)""", """
SELECT time, at_risk, events, round(coalesce(exp(sum(CASE WHEN events < at_risk THEN ln(1 - events / at_risk) END) OVER w), 1) * CASE WHEN max((events = at_risk)::INT) OVER w = 1 THEN 0 ELSE 1 END, 5) AS survival FROM h WHERE events > 0 WINDOW w AS (ORDER BY time)"""),
    "m1_c_index": _sql(READOUTS, VEHICLES, RISKS, """
SELECT comparable, concordant, tied, round((concordant + tied / 2) / comparable, 5) AS c_index FROM (SELECT count(*) AS comparable, count(*) FILTER (a.risk > b.risk) AS concordant, count(*) FILTER (a.risk = b.risk) AS tied
  FROM t a JOIN t b ON a.event = 1 AND (b.duration > a.duration OR (b.duration = a.duration AND b.event = 0)))"""),
    "l5_cox_loss": _sql(READOUTS, VEHICLES, RISKS, "SELECT count(*) AS n_events, round(coalesce(avg(ln(hazard) - risk), 0), 5) AS loss FROM t JOIN h USING (duration) WHERE event = 1"),
    "m2_breslow_baseline": _sql(READOUTS, VEHICLES, RISKS, "SELECT duration AS time, round(sum(events / hazard) OVER (ORDER BY duration), 5) AS cumulative_hazard FROM h WHERE events > 0"),
    "t4_nearest_to_percentiles": _sql(READOUTS, VEHICLES, "c AS (SELECT unnest([0.1, 0.5, 0.9])::DOUBLE AS share, unnest((SELECT quantile_cont(duration, [0.1, 0.5, 0.9]) FROM v)) AS cut)", """
SELECT share, cut, vehicle_id FROM c, v QUALIFY row_number() OVER (PARTITION BY share ORDER BY abs(duration - cut), vehicle_id) = 1"""),
    "f2_correlations": "\nUNION ALL ".join(f"SELECT '{a}' AS first, '{b}' AS second, round(corr({a}, {b}), 5) AS corr FROM lineitem" for i, a in enumerate(LINE_FEATURES) for b in LINE_FEATURES[i + 1 :]),
    "x3_folds": _sql(READOUTS, VEHICLES, "SELECT vehicle_id, ('0x' || substr(md5('42:' || vehicle_id), 1, 8))::BIGINT % 3 AS fold FROM v"),
    "g1_masked_views": _sql(READOUTS, SEQUENCES, FILLED, """SELECT vehicle_id, rid, view, CASE WHEN ('0x' || substr(md5('42:' || view || ':' || rid || ':1_0'), 1, 8))::BIGINT < floor(0.15 * 4294967296) THEN 0 ELSE x END AS masked
FROM f, (SELECT unnest([1, 2])::INT AS view)"""),
    "l2_consistency": "SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding::DOUBLE[])), 4) AS distance FROM embeddings",
    "n14_right_aligned": _sql(READOUTS, SEQUENCES, """SELECT i.vehicle_id, position, coalesce(time_gap, 0) AS value, s.rid IS NOT NULL AS valid
FROM (SELECT vehicle_id, n, unnest(range(8))::INT AS position FROM (SELECT DISTINCT vehicle_id, n FROM s)) i LEFT JOIN s ON s.vehicle_id = i.vehicle_id AND s.seq_idx = i.n - 7 + position"""),
}
QUERIES = {name: globals()[name] for name in ORACLE_SQL}
