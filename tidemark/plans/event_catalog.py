"""Queries over users and their events, whose readouts have a numerical column and a histogram, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import transforms as X
from tidemark.operators import batches as H
from tidemark.operators import columns as C
from tidemark.operators import features as A
from tidemark.operators import quality as Q
from tidemark.operators import sequences as B
from tidemark.operators import spectral as E
from tidemark.operators import views as V
from tidemark.plans.catalog import GAPS, SEQUENCES, SPLIT, _sql, rounded
from tidemark.plans.catalog import READOUTS as ORDERS
from tidemark.plans.catalog import VEHICLES as CUSTOMERS
from tidemark.sources.stored import shared_folder
from tidemark.sources.tables import EVENT_BINS, EVENT_TYPES, event_readouts, event_vehicles, order_vehicles, streamed_readouts
from tidemark.streaming.readouts import followed

VALUE = "1_0"
FEATURES = [VALUE, *EVENT_BINS]
AT = "date_diff('second', TIMESTAMP '2024-01-01', ts) / 3600.0"
BINS = range(len(EVENT_BINS))

READOUTS = f"""r AS (SELECT user_id AS vehicle_id, event_id AS rid, {AT} AS time_step, CASE WHEN event_id % 11 <> 0 THEN value END AS f, event_type AS status,
  {', '.join(f"CASE WHEN event_id % 13 <> 0 THEN (count(*) FILTER (WHERE event_type = '{kind}') OVER w)::DOUBLE END AS h{i}" for i, kind in enumerate(EVENT_TYPES))}
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY {AT}, event_id ROWS UNBOUNDED PRECEDING)),
"""
VEHICLES = """v AS (SELECT c_custkey AS vehicle_id, c_mktsegment AS s0, c_nationkey::VARCHAR AS s1, last + 24 * (1 + c_custkey % 7) AS duration, (status IN ('click', 'error'))::INT AS event
  FROM customer JOIN (SELECT vehicle_id, max(time_step) AS last, arg_max(status, (time_step, rid)) AS status FROM r GROUP BY 1) ON c_custkey = vehicle_id),
"""
ALONG = "(PARTITION BY vehicle_id ORDER BY time_step, rid)"
SO_FAR = "(PARTITION BY vehicle_id ORDER BY time_step, rid ROWS UNBOUNDED PRECEDING)"
FILLED = f"""f AS (SELECT vehicle_id, rid, time_step, seq_idx, time_gap, n, coalesce(last_value(f IGNORE NULLS) OVER {SO_FAR}, 0) AS x,
  {', '.join(f"coalesce(last_value(h{i} IGNORE NULLS) OVER {SO_FAR}, 0) AS y{i}" for i in BINS)} FROM s),
"""
#: (feature, x) of each filled value, and the step d from the readout before.
LONG = f"""u AS (SELECT vehicle_id, rid, time_step, '1_0' AS feature, x FROM f {' '.join(f"UNION ALL SELECT vehicle_id, rid, time_step, '2_{i}', y{i} FROM f" for i in BINS)}),
d AS (SELECT feature, x - lag(x) OVER (PARTITION BY vehicle_id, feature ORDER BY time_step, rid) AS d FROM u),
"""
VERDICT = """c AS (SELECT feature, count(d) AS n_diffs, avg((d < -1e-8)::INT) AS negative_ratio, avg((d > 1e-8)::INT) AS positive_ratio, avg((abs(d) <= 1e-8)::INT) AS zero_ratio, min(d) AS min_diff, max(d) AS max_diff,
  avg(abs(d)) AS mean_abs_diff FROM d WHERE d IS NOT NULL GROUP BY feature),
k AS (SELECT *, CASE WHEN n_diffs < 50 THEN 'insufficient_data' WHEN negative_ratio > 0.01 THEN 'likely_non_cumulative' WHEN positive_ratio >= 0.8 THEN 'likely_cumulative'
  ELSE 'possibly_cumulative_or_non_decreasing' END AS verdict FROM c),
"""
VALUES = ["x", *(f"y{i}" for i in BINS)]


def _readouts(spark: SparkSession, d: str) -> DataFrame:
    return event_readouts(spark, d).drop("status")


def _sequences(spark: SparkSession, d: str) -> DataFrame:
    return B.build_sequences(_readouts(spark, d))


def _filled(spark: SparkSession, d: str) -> DataFrame:
    return X.impute(_sequences(spark, d), FEATURES)


def _with_split(spark: SparkSession, d: str) -> DataFrame:
    return _sequences(spark, d).join(A.stratified_split(event_vehicles(spark, d)).select("vehicle_id", "split"), "vehicle_id")


def q1_inspect(spark, d):
    return Q.inspect(event_readouts(spark, d))


def q8_cumulative_verdicts(spark, d):
    return rounded(Q.cumulative_verdicts(_filled(spark, d), FEATURES))


def q9_features_by_verdict(spark, d):
    return Q.features_by_verdict(Q.cumulative_verdicts(_filled(spark, d), FEATURES)).select("verdict", F.array_join("features", ",").alias("features"))


def q10_key_coverage(spark, d):
    customers = event_vehicles(spark, d)
    return Q.key_coverage({"readouts": _readouts(spark, d), "specifications": spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("vehicle_id")), "targets": customers.filter("event = 1")})


def q12_length_summary(spark, d):
    return rounded(Q.describe(Q.sequence_lengths(_readouts(spark, d)), "sequence_length"))


def q13_length_extremes(spark, d):
    return Q.extremes(Q.sequence_lengths(_readouts(spark, d)), "sequence_length")


def _truncated(spark: SparkSession, d: str) -> DataFrame:
    return B.truncate_at_random(B.attach_vehicles(_sequences(spark, d), event_vehicles(spark, d)))


def q14_truncation_check(spark, d):
    return rounded(Q.truncation_check(B.attach_vehicles(_sequences(spark, d), event_vehicles(spark, d)), _truncated(spark, d)))


def _preprocessed(spark: SparkSession, d: str) -> DataFrame:
    return X.preprocess_splits(_with_split(spark, d), [VALUE], EVENT_BINS)


def q15_normalization_check(spark, d):
    return rounded(Q.normalization_check(_preprocessed(spark, d).filter("split = 'train'"), [VALUE]), 4)


def q16_one_vehicle(spark, d):
    return _sequences(spark, d).filter("vehicle_id = 7").select("rid", "time_step", "seq_idx", F.col(VALUE).alias("value"))


def q17_feature_census(spark, d):
    return C.census(A.aggregate_sequences(_sequences(spark, d), [VALUE], EVENT_BINS))


def p1_feature_groups(spark, d):
    return C.grouped_features(event_readouts(spark, d))


def p3_static_columns(spark, d):
    """How many categories each static column has, and how many vehicles have one."""
    vehicles = event_vehicles(spark, d)
    out = None
    for c in C.static_columns(vehicles.columns):
        one = vehicles.agg(F.lit(c).alias("feature"), F.count(c).alias("n"), F.count_distinct(c).alias("categories"))
        out = one if out is None else out.unionByName(one)
    return out


def p4_continuous_columns(spark, d):
    features, targets = C.predictors_and_targets(C.with_targets(A.aggregate_sequences(_sequences(spark, d), [VALUE]), event_vehicles(spark, d)))
    return rounded(features.select("vehicle_id", *C.continuous_columns(features)).select("vehicle_id", "1_0_mean", "gap_max", "sequence_length").join(targets, "vehicle_id"))


def p6_flattened(spark, d):
    nested = event_vehicles(spark, d).select("vehicle_id", F.struct("duration", F.struct("event", "Spec_0").alias("inner"), F.lit(1).alias("fitted_model")).alias("result"))
    return rounded(C.flattened(nested, without=("fitted_model",)))


def p7_shown(spark, d):
    return _readouts(spark, d).select("rid", C.shown(VALUE).alias("value"))


def j1_one_to_one(spark, d):
    vehicles = event_vehicles(spark, d)
    return rounded(C.one_to_one(vehicles.select("vehicle_id", "Spec_0", "Spec_1"), vehicles.select("vehicle_id", "duration", "event")))


def j2_attach_counts(spark, d):
    return B.missing_vehicles(_sequences(spark, d), event_vehicles(spark, d).filter("Spec_0 = 'BUILDING'"))


def j5_with_targets(spark, d):
    return rounded(C.with_targets(Q.sequence_lengths(_readouts(spark, d)), event_vehicles(spark, d)))


def l14_survival_target(spark, d):
    return C.flattened(C.survival_target(event_vehicles(spark, d))).select("vehicle_id", "target_event", F.round("target_duration", 5).alias("target_duration"))


def t2_largest_gaps(spark, d):
    return rounded(Q.time_gaps(_readouts(spark, d)).filter("gap IS NOT NULL").orderBy(F.desc("gap"), "rid").limit(10).select("vehicle_id", "rid", "gap"))


def b1_streamed_sequences(spark, d):
    """Places, gaps and filled values by a stream with state, of all that the table has."""
    return rounded(followed(streamed_readouts(spark, d), VALUE, shared_folder(spark)), 4)


def b5_one_sequence(spark, d):
    carried = B.attach_vehicles(_sequences(spark, d).filter("vehicle_id = 7"), event_vehicles(spark, d))
    return rounded(B.build_prefixes(carried).select("prefix_id", "rid", "prefix_number", "prefix_fraction", "Spec_0", "duration", "event"))


def _prefixes(spark: SparkSession, d: str) -> DataFrame:
    prepared = X.prepare_for_contrast(X.preprocess_splits(_with_split(spark, d), [VALUE], EVENT_BINS), FEATURES)
    return B.checked_prefixes(B.build_prefixes(prepared), ["dynamic_time", "dynamic_freq", "time_gap_scaled"])


def b7_contrast_prefixes(spark, d):
    scalars = [F.col("dynamic_time")[0].alias("value"), F.col("dynamic_time")[1].alias("bin"), F.col("dynamic_freq")[0].alias("value_step"), F.col("dynamic_freq")[1].alias("bin_step")]
    return rounded(_prefixes(spark, d).select("prefix_id", "rid", "time_gap_scaled", *scalars), 4)


def b7_modality_prefixes(spark, d):
    held = X.with_modalities(X.preprocess_splits(_with_split(spark, d), [VALUE], EVENT_BINS), numerical=[VALUE], histogram=EVENT_BINS, other=[])
    cut = B.checked_prefixes(B.build_prefixes(held), ["numerical_time", "numerical_freq", "histogram_time", "histogram_freq"])
    last = F.size("histogram_freq") - 1
    return rounded(cut.select("prefix_id", "rid", F.col("numerical_time")[0].alias("value"), F.col("numerical_freq")[0].alias("value_step"), F.get("histogram_time", last).alias("bin"), F.get("histogram_freq", last).alias("bin_step")), 4)


def b7_modality_spectra(spark, d):
    """Spectra of the steps of each prefix, by modality."""
    held = X.with_modalities(X.preprocess_splits(_with_split(spark, d), [VALUE], EVENT_BINS), numerical=[VALUE], histogram=EVENT_BINS)
    cut = B.build_prefixes(held).select(F.col("prefix_id").alias("vehicle_id"), "seq_idx", F.col("prefix_length").alias("sequence_length"), F.col("numerical_freq")[0].alias("numerical"), F.col("histogram_freq")[0].alias("histogram"))
    return rounded(E.frequency_representation(cut, ["numerical", "histogram"]).withColumnRenamed("vehicle_id", "prefix_id"), 4)


def b9_prefix_summary(spark, d):
    return rounded(B.prefix_summary(B.build_prefixes(_sequences(spark, d))))


def b11_truncated_branches(spark, d):
    held = X.with_branches(X.impute(_truncated(spark, d), FEATURES), FEATURES)
    return rounded(held.select("vehicle_id", "rid", "sequence_length", F.col("dynamic_time")[0].alias("value"), F.col("dynamic_freq")[0].alias("value_step"), F.col("dynamic_freq")[2].alias("bin_step")))


def n5_histogram_filled(spark, d):
    return X.impute(_sequences(spark, d), EVENT_BINS).select("rid", *[F.col(c).alias(f"y{i}") for i, c in enumerate(EVENT_BINS)])


def n6_log_histogram(spark, d):
    return rounded(X.impute(_sequences(spark, d), EVENT_BINS).select("rid", *[X.log1p_checked(c).alias(f"y{i}") for i, c in enumerate(EVENT_BINS)]))


def n9_preprocessed_splits(spark, d):
    return rounded(_preprocessed(spark, d).select("rid", "split", F.col(VALUE).alias("x"), *[F.col(c).alias(f"y{i}") for i, c in enumerate(EVENT_BINS)]))


def n13_prepared(spark, d):
    held = X.prepare_for_contrast(X.impute(_with_split(spark, d), FEATURES), FEATURES)
    return rounded(held.select("rid", "split", "time_gap_scaled", F.col("dynamic_freq")[0].alias("value_step"), F.col("dynamic_freq")[3].alias("bin_step")))


def n14_scaled_right_aligned(spark, d):
    filled = X.impute(_with_split(spark, d), [VALUE])
    scaled = X.normalize(filled, X.fit_normalizer(filled.filter("split = 'train'"), [VALUE]), [VALUE])
    return rounded(V.right_aligned(scaled, VALUE, 60))


def _vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return X.fit_vocabulary(A.stratified_split(order_vehicles(spark, d)).filter("split = 'train'"), ["Spec_0"])


def n15_one_hot_static(spark, d):
    held = X.one_hot_static(order_vehicles(spark, d), X.kept_vocabulary(_vocabulary(spark, d), drop_first=False))
    return held.select("vehicle_id", F.array_join(F.col("static").cast("array<string>"), "").alias("static"))


def n16_one_hot_train(spark, d):
    train = A.stratified_split(order_vehicles(spark, d)).filter("split = 'train'").select("vehicle_id", "Spec_0")
    return X.one_hot(train, X.kept_vocabulary(_vocabulary(spark, d)))


def n17_one_hot_other(spark, d):
    kept = X.kept_vocabulary(_vocabulary(spark, d))
    test = A.stratified_split(order_vehicles(spark, d)).filter("split = 'test'").select("vehicle_id", "Spec_0")
    return C.aligned(X.one_hot(test, kept), ["vehicle_id", *[f"{f}_{c}" for f, c in kept], "Spec_0_OTHER"])


def n18_median_imputed(spark, d):
    columns = [VALUE, "2_0"]
    held = _with_split(spark, d)
    return rounded(X.impute_medians(held, X.fit_medians(held.filter("split = 'train'"), columns), columns).select("rid", F.col(VALUE).alias("x"), F.col("2_0").alias("y")))


def n20_standardized(spark, d):
    lengths = C.with_targets(Q.sequence_lengths(_readouts(spark, d)), A.stratified_split(event_vehicles(spark, d)))
    split = A.stratified_split(event_vehicles(spark, d)).select("vehicle_id", "split")
    held = lengths.join(split, "vehicle_id").withColumn("sequence_length", F.col("sequence_length").cast("double"))
    return rounded(X.normalize(held, X.fit_normalizer(held.filter("split = 'train'"), ["sequence_length"]), ["sequence_length"]).select("vehicle_id", "sequence_length"))


def a5_histogram_aggregate(spark, d):
    held = A.aggregate_sequences(_sequences(spark, d), [VALUE], EVENT_BINS)
    return rounded(held.select("vehicle_id", "1_0_slope", *[f"{c}_{m}" for c in EVENT_BINS for m in ("mean", "last")], "gap_median", "observation_density"), 4)


def a6_event_rate(spark, d):
    return rounded(A.event_rate(A.stratified_split(event_vehicles(spark, d))))


def _aggregates(spark: SparkSession, d: str) -> DataFrame:
    return A.aggregate_sequences(_sequences(spark, d), [VALUE], EVENT_BINS)


def f1_kept_by_variance(spark, d):
    held = _aggregates(spark, d).withColumn("constant", F.lit(1.0))
    kept, _ = A.without_near_constant(held, ["1_0_mean", "gap_min", "constant"])
    return rounded(kept.select(*[c for c in ("vehicle_id", "1_0_mean", "gap_min", "constant") if c in kept.columns]))


def f2_kept_by_correlation(spark, d):
    features = ["2_0_last", "2_1_last", "1_0_max", "1_0_std", "sequence_length", "final_time_step"]
    gone = A.highly_correlated(_aggregates(spark, d), features, 0.75)
    return spark.createDataFrame([(f, f in gone) for f in features], "feature string, dropped boolean")


def x2_train_validation(spark, d):
    return A.train_validation_split(event_vehicles(spark, d)).select("vehicle_id", "split")


def x5_event_batches(spark, d):
    return H.event_batches(event_vehicles(spark, d), 12, 4).select("batch", "place", "vehicle_id", "event")


def x8_loaded(spark, d):
    return H.loaded(event_vehicles(spark, d).select("vehicle_id"), "vehicle_id", 128, epochs=2)


def x6_collated(spark, d):
    packed = B.packed(_filled(spark, d), [VALUE]).withColumn("batch", F.floor(F.col("vehicle_id") / 16))
    held = H.collated(packed, [VALUE])
    return held.select("batch", "vehicle_id", F.posexplode(F.arrays_zip(F.col(VALUE).alias("x"), F.col("padding_mask").alias("m"))).alias("position", "_v")).select("batch", "vehicle_id", "position", F.col("_v.x").alias("value"), F.col("_v.m").alias("valid"))


def x7_dataset(spark, d):
    return rounded(H.survival_dataset(B.attach_vehicles(_sequences(spark, d), event_vehicles(spark, d))))


def g2_noise(spark, d):
    return rounded(V.with_noise(_filled(spark, d).withColumn("view", F.lit(1)), [VALUE], 0.5).select("rid", F.col(VALUE).alias("x")), 4)


def g3_dropout(spark, d):
    return V.with_dropout(_filled(spark, d).withColumn("view", F.lit(1)), [VALUE], 0.3).select("rid", F.col(VALUE).alias("x"))


def g4_augmented_views(spark, d):
    held = V.augmented_views(_filled(spark, d), [VALUE], EVENT_BINS, 0.3, 0.5, 0.3, 0.4)
    return rounded(held.select("rid", "view", F.col(VALUE).alias("x"), F.col("2_0").alias("y")), 4)


def g6_weak_time_views(spark, d):
    return rounded(V.weak_time_views(_filled(spark, d), [VALUE], F.col("seq_idx") <= 40).select("rid", "view", F.col(VALUE).alias("x")), 4)


def _spectra(spark: SparkSession, d: str) -> DataFrame:
    return E.frequency_representation(_filled(spark, d), [VALUE])


def e1_spectrum(spark, d):
    return rounded(_spectra(spark, d).select("vehicle_id", "bin", F.col(VALUE).alias("size")), 4)


def g7_weak_frequency_views(spark, d):
    return rounded(V.weak_frequency_views(_spectra(spark, d), [VALUE]).select("vehicle_id", "bin", "view", F.col(VALUE).alias("size")), 4)


def e2_masked_mean(spark, d):
    return rounded(E.masked_mean(_filled(spark, d).withColumn("valid", F.col("seq_idx") <= 40), [VALUE]).select("vehicle_id", F.col(VALUE).alias("pooled")))


def _draw(key: str) -> str:
    return f"('0x' || substr(md5('42:' || {key}), 1, 8))::BIGINT"


def _noise(key: str, std: float) -> str:
    return f"{std} * sqrt(-2 * ln(({_draw(key + chr(124) * 2 + chr(39) + ':u' + chr(39))} + 1) / 4294967296.0)) * cos(2 * pi() * {_draw(key + chr(124) * 2 + chr(39) + ':v' + chr(39))} / 4294967296.0)"


def _kept(key: str, share: float, value: str) -> str:
    return f"CASE WHEN {_draw(chr(39) + 'drop:' + chr(39) + ' || ' + key)} / 4294967296.0 < {share} THEN 0 ELSE {value} END"


TRUNCATED = """c AS (SELECT *, 5 + ('0x' || substr(md5('42:' || vehicle_id), 1, 8))::BIGINT % (n - 4) AS cut FROM s WHERE n >= 5),
a AS (SELECT c.*, max(time_step) OVER (PARTITION BY vehicle_id) AS readout_time FROM c WHERE seq_idx <= cut),
t AS (SELECT a.*, v.duration AS original_duration, v.duration - readout_time AS duration FROM a JOIN v USING (vehicle_id) WHERE v.duration > readout_time),
"""
PREFIXES = """l AS (SELECT vehicle_id, n, list_sort(list_distinct([least(greatest(round_even(n * p, 0)::BIGINT, 5), n - 1) FOR p IN [0.3::DOUBLE, 0.6::DOUBLE, 0.9::DOUBLE]])) AS ls FROM (SELECT DISTINCT vehicle_id, n FROM s) WHERE n > 5),
q AS (SELECT vehicle_id, n, unnest(ls) AS prefix_length, generate_subscripts(ls, 1) AS prefix_number FROM l),
"""
#: Both kinds filled, numerical ones scaled by the train rows, log1p of histograms; gaps scaled; steps.
PREPARED = f"""z AS (SELECT f.*, split, (x - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END AS sx, {', '.join(f'ln(1 + y{i}) AS sy{i}' for i in BINS)}, (ln(1 + time_gap) - gm) / CASE WHEN gs < 1e-8 THEN 1 ELSE gs END AS sg
  FROM f JOIN p USING (vehicle_id), (SELECT avg(x) AS m, stddev_pop(x) AS sd, avg(ln(1 + time_gap)) AS gm, stddev_pop(ln(1 + time_gap)) AS gs FROM f JOIN p USING (vehicle_id) WHERE split = 'train')),
"""
STEP = lambda c: f"coalesce({c} - lag({c}) OVER {ALONG}, 0)"
DESCRIBED = "count(gap) AS n, round(avg(gap), 5) AS mean, round(stddev_samp(gap), 5) AS std, min(gap) AS least, max(gap) AS most, " + ", ".join(f"round(quantile_cont(gap, {p}), 5) AS p{round(p * 100)}" for p in Q.PERCENTILES)
COLUMNS = {"vehicle_id": "vehicle_id", "rid": "rid", "time_step": "time_step", "1_0": "f", "status": "status"} | {c: f"h{i}" for i, c in enumerate(EVENT_BINS)}
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
CORRELATED = {"2_0_last": "arg_max(h0, seq_idx) FILTER (h0 IS NOT NULL)", "2_1_last": "arg_max(h1, seq_idx) FILTER (h1 IS NOT NULL)", "1_0_max": "max(f)", "1_0_std": "stddev_pop(f)", "sequence_length": "count(*)", "final_time_step": "max(time_step)"}


def _greedy() -> str:
    """The filter by correlation, a pair at a time in column order, as a recursive query over lists of names."""
    names = list(CORRELATED)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    rows = " UNION ALL ".join(f"""SELECT {k} AS k, '{a}' AS a, '{b}' AS b, abs(corr("{a}", "{b}")) AS c, var_samp("{a}") AS va, var_samp("{b}") AS vb FROM w""" for k, (a, b) in enumerate(pairs))
    return f"""WITH RECURSIVE {READOUTS}{SEQUENCES}w AS (SELECT vehicle_id, {', '.join(f'{e} AS "{c}"' for c, e in CORRELATED.items())} FROM s GROUP BY vehicle_id),
o AS ({rows}),
g AS (SELECT -1 AS k, []::VARCHAR[] AS gone
  UNION ALL SELECT o.k, CASE WHEN c > 0.75 AND NOT list_contains(gone, a) AND NOT list_contains(gone, b) THEN list_append(gone, CASE WHEN va < vb THEN a ELSE b END) ELSE gone END FROM g JOIN o ON o.k = g.k + 1)
SELECT feature, list_contains(gone, feature) AS dropped FROM (SELECT unnest({names}) AS feature), (SELECT gone FROM g ORDER BY k DESC LIMIT 1)"""


def _shuffled(source: str, name: str) -> str:
    """shuffled: the rows of ``source`` (i, n, ...) with v, where the permutation of this name takes i."""
    number = lambda text: f"('0x' || substr(md5('42:' || {text}), 1, 8))::BIGINT"
    out = [f"r0 AS (SELECT *, i AS v FROM {source}),"]
    for k in range(1, H.ROUNDS + 1):
        at = f"(({number(f"{name} || ':{k}'")} % n - v) % n + n) % n"
        bit = number(f"{name} || ':{k}:' || greatest(v, m)")
        out.append(f"r{k} AS (SELECT * EXCLUDE (v, m), CASE WHEN {bit} % 2 = 1 THEN m ELSE v END AS v FROM (SELECT *, {at} AS m FROM r{k - 1})),")
    return "\n".join([*out, f"shuffled AS (SELECT * FROM r{H.ROUNDS}),"])


ORACLE_SQL = {
    "q1_inspect": _sql(READOUTS, "SELECT feature, nulls, n_rows, 10 AS n_columns FROM (" + " UNION ALL ".join(f"SELECT '{name}' AS feature, count(*) - count({c}) AS nulls, count(*) AS n_rows FROM r" for name, c in COLUMNS.items()) + ") ORDER BY nulls DESC, feature LIMIT 10"),
    "q8_cumulative_verdicts": _sql(READOUTS, SEQUENCES, FILLED, LONG, VERDICT, "SELECT feature, n_diffs, " + ", ".join(f"round({c}, 5) AS {c}" for c in ("negative_ratio", "positive_ratio", "zero_ratio", "min_diff", "max_diff", "mean_abs_diff")) + ", verdict FROM k"),
    "q9_features_by_verdict": _sql(READOUTS, SEQUENCES, FILLED, LONG, VERDICT, "SELECT verdict, string_agg(feature, ',' ORDER BY feature) AS features FROM k GROUP BY 1"),
    "q10_key_coverage": _sql(READOUTS, VEHICLES, "i AS (SELECT DISTINCT vehicle_id AS k, 'readouts' AS o FROM r UNION SELECT c_custkey, 'specifications' FROM customer UNION SELECT vehicle_id, 'targets' FROM v WHERE event = 1),\n", "SELECT 'n_' || o AS measure, count(*) AS n FROM i GROUP BY o " + " ".join(f"UNION ALL SELECT '{a}_not_{b}', count(*) FROM i WHERE o = '{a}' AND k NOT IN (SELECT k FROM i WHERE o = '{b}')" for a in ("readouts", "specifications", "targets") for b in ("readouts", "specifications", "targets") if a != b)),
    "q12_length_summary": _sql(READOUTS, f"SELECT {DESCRIBED} FROM (SELECT count(*) AS gap FROM r GROUP BY vehicle_id)"),
    "q13_length_extremes": _sql(READOUTS, "c AS (SELECT vehicle_id, count(*) AS sequence_length FROM r GROUP BY 1)", "\n(SELECT *, 'smallest' AS side FROM c ORDER BY 2, 1 LIMIT 5) UNION ALL (SELECT *, 'largest' FROM c ORDER BY 2 DESC, 1 LIMIT 5)"),
    "q14_truncation_check": _sql(READOUTS, VEHICLES, SEQUENCES, TRUNCATED, """SELECT vehicle_id, max(n) AS full_length, round(max(v.duration), 5) AS full_duration, count(*) AS kept_length, round(max(readout_time), 5) AS readout_time, round(max(original_duration), 5) AS original_duration,
  round(max(t.duration), 5) AS duration, abs(max(t.duration) - (max(original_duration) - max(readout_time))) < 1e-6 AND max(v.duration) = max(original_duration) AND count(*) <= max(n) AS consistent FROM t JOIN v USING (vehicle_id) GROUP BY vehicle_id"""),
    "q15_normalization_check": _sql(READOUTS, VEHICLES, SEQUENCES, FILLED, SPLIT, PREPARED, "SELECT '1_0' AS feature, count(*) - count(sx) AS missing, round(avg(sx), 4) + 0 AS mean, round(stddev_pop(sx), 4) AS std, abs(avg(sx)) < 1e-6 AND abs(stddev_pop(sx) - 1) < 1e-6 AS normalized FROM z WHERE split = 'train'"),
    "q16_one_vehicle": _sql(READOUTS, SEQUENCES, "SELECT rid, time_step, seq_idx, f AS value FROM s WHERE vehicle_id = 7"),
    "q17_feature_census": _sql(READOUTS, SEQUENCES, f"""a AS (SELECT vehicle_id, (count(f) > 0)::INT AS c, (count(f) > 0 AND max(time_step) FILTER (f IS NOT NULL) > min(time_step) FILTER (f IS NOT NULL))::INT AS slope, {' + '.join(f'(count(h{i}) > 0)::INT' for i in BINS)} AS b FROM s GROUP BY vehicle_id)""", f"""
SELECT 'numerical' AS kind, 8 AS features, (7 * sum(c) + sum(slope))::BIGINT AS filled FROM a UNION ALL SELECT 'histogram', {2 * len(EVENT_BINS)}, (2 * sum(b))::BIGINT FROM a UNION ALL SELECT 'gap', 5, 5 * count(*) FROM a UNION ALL SELECT 'metadata', 3, 3 * count(*) FROM a"""),
    "p1_feature_groups": _sql(READOUTS, f"""c AS (SELECT unnest([{', '.join(f"'{c}'" for c in COLUMNS)}]) AS feature, unnest([{', '.join(f'count({c})' for c in COLUMNS.values())}]) AS n FROM r),
m AS (SELECT feature, n, regexp_extract(feature, '^(\\d+)_(\\d+)$', 1)::INT AS g, regexp_extract(feature, '^(\\d+)_(\\d+)$', 2)::INT AS b FROM c WHERE regexp_matches(feature, '^\\d+_\\d+$'))""", """
SELECT feature, kind, (row_number() OVER (ORDER BY kind DESC, g, b) - 1)::INT AS place, n FROM (SELECT *, CASE WHEN count(*) OVER (PARTITION BY g) = 1 AND b = 0 THEN 'numerical' ELSE 'histogram' END AS kind FROM m)"""),
    "p3_static_columns": _sql(READOUTS, VEHICLES, "SELECT 'Spec_0' AS feature, count(s0) AS n, count(DISTINCT s0) AS categories FROM v UNION ALL SELECT 'Spec_1', count(s1), count(DISTINCT s1) FROM v"),
    "b7_modality_prefixes": _sql(READOUTS, VEHICLES, SEQUENCES, FILLED, SPLIT, PREPARED, PREFIXES, f"e AS (SELECT vehicle_id, rid, seq_idx, sx, sy{len(EVENT_BINS) - 1} AS sy, {STEP('sx')} AS dx, {STEP(f'sy{len(EVENT_BINS) - 1}')} AS dy FROM z)", """
SELECT q.vehicle_id || '_p' || prefix_number AS prefix_id, rid, round(sx, 4) AS value, round(dx, 4) AS value_step, round(sy, 4) AS bin, round(dy, 4) AS bin_step FROM q JOIN e USING (vehicle_id) WHERE seq_idx <= prefix_length"""),
    "b7_modality_spectra": _sql(READOUTS, VEHICLES, SEQUENCES, FILLED, SPLIT, PREPARED, PREFIXES, f"e AS (SELECT vehicle_id, seq_idx, {STEP('sx')} AS dx, {STEP('sy0')} AS dy FROM z),\nk AS (SELECT vehicle_id || '_p' || prefix_number AS prefix_id, vehicle_id, prefix_length AS n, unnest(range(prefix_length // 2 + 1)) AS bin FROM q)", """
SELECT prefix_id, bin, round(ln(1 + sqrt(sum(dx * cos(a)) ** 2 + sum(dx * sin(a)) ** 2) + 1e-8), 4) AS numerical, round(ln(1 + sqrt(sum(dy * cos(a)) ** 2 + sum(dy * sin(a)) ** 2) + 1e-8), 4) AS histogram
FROM (SELECT prefix_id, bin, dx, dy, -2 * pi() * (((seq_idx - 1) * bin) % n) / n AS a FROM k JOIN e ON e.vehicle_id = k.vehicle_id AND seq_idx <= n) GROUP BY prefix_id, bin"""),
    "p4_continuous_columns": _sql(READOUTS, VEHICLES, SEQUENCES, """SELECT s.vehicle_id, round(avg(f), 5) AS "1_0_mean", round(max(CASE WHEN seq_idx > 1 OR n = 1 THEN time_gap END), 5) AS gap_max, max(n) AS sequence_length, round(max(duration), 5) AS duration, max(event) AS event FROM s JOIN v USING (vehicle_id) GROUP BY 1"""),
    "p6_flattened": _sql(READOUTS, VEHICLES, "SELECT vehicle_id, round(duration, 5) AS result_duration, event AS result_inner_event, s0 AS \"result_inner_Spec_0\" FROM v"),
    "p7_shown": _sql(READOUTS, "SELECT rid, CASE WHEN f IS NULL THEN '—' ELSE format('{:.3f}', f) END AS value FROM r"),
    "j1_one_to_one": _sql(READOUTS, VEHICLES, 'SELECT vehicle_id, s0 AS "Spec_0", s1 AS "Spec_1", round(duration, 5) AS duration, event FROM v'),
    "j2_attach_counts": _sql(READOUTS, VEHICLES, "SELECT count(*) FILTER (b) AS attached, count(*) FILTER (NOT b) AS dropped FROM (SELECT vehicle_id IN (SELECT vehicle_id FROM v WHERE s0 = 'BUILDING') AS b FROM r GROUP BY vehicle_id)"),
    "j5_with_targets": _sql(READOUTS, VEHICLES, "SELECT vehicle_id, count(*) AS sequence_length, round(max(duration), 5) AS duration, max(event) AS event FROM r JOIN v USING (vehicle_id) GROUP BY 1"),
    "l14_survival_target": _sql(READOUTS, VEHICLES, "SELECT vehicle_id, event = 1 AS target_event, round(duration, 5) AS target_duration FROM v"),
    "t2_largest_gaps": _sql(READOUTS, GAPS, "SELECT vehicle_id, rid, round(gap, 5) AS gap FROM g WHERE gap IS NOT NULL ORDER BY g.gap DESC, rid LIMIT 10"),
    "b1_streamed_sequences": _sql(READOUTS, SEQUENCES, FILLED, "SELECT vehicle_id, rid, round(time_step, 4) AS time_step, seq_idx, round(time_gap, 4) AS time_gap, round(x, 4) AS value FROM f"),
    "b5_one_sequence": _sql(READOUTS, VEHICLES, SEQUENCES, PREFIXES, 'SELECT q.vehicle_id || \'_p\' || prefix_number AS prefix_id, rid, prefix_number, round(prefix_length / q.n, 5) AS prefix_fraction, s0 AS "Spec_0", round(duration, 5) AS duration, event FROM q JOIN s USING (vehicle_id) JOIN v USING (vehicle_id) WHERE seq_idx <= prefix_length AND q.vehicle_id = 7'),
    "b7_contrast_prefixes": _sql(READOUTS, VEHICLES, SEQUENCES, FILLED, SPLIT, PREPARED, PREFIXES, f"e AS (SELECT vehicle_id, rid, seq_idx, sg, sx, sy0, {STEP('sx')} AS dx, {STEP('sy0')} AS dy FROM z)", """
SELECT q.vehicle_id || '_p' || prefix_number AS prefix_id, rid, round(sg, 4) AS time_gap_scaled, round(sx, 4) AS value, round(sy0, 4) AS bin, round(dx, 4) AS value_step, round(dy, 4) AS bin_step FROM q JOIN e USING (vehicle_id) WHERE seq_idx <= prefix_length"""),
    "b9_prefix_summary": _sql(READOUTS, SEQUENCES, PREFIXES, "SELECT count(*) AS n_prefixes, count(DISTINCT vehicle_id) AS n_vehicles, min(prefix_length) AS min_length, max(prefix_length) AS max_length, round(avg(prefix_length), 5) AS mean_length FROM q"),
    "b11_truncated_branches": _sql(READOUTS, VEHICLES, SEQUENCES, TRUNCATED, f"i AS (SELECT *, coalesce(last_value(f IGNORE NULLS) OVER {SO_FAR}, 0) AS x, coalesce(last_value(h1 IGNORE NULLS) OVER {SO_FAR}, 0) AS y FROM t)", f"\nSELECT vehicle_id, rid, cut AS sequence_length, round(x, 5) AS value, round({STEP('x')}, 5) AS value_step, round({STEP('y')}, 5) AS bin_step FROM i"),
    "n5_histogram_filled": _sql(READOUTS, SEQUENCES, FILLED, f"SELECT rid, {', '.join(f'y{i}' for i in BINS)} FROM f"),
    "n6_log_histogram": _sql(READOUTS, SEQUENCES, FILLED, f"SELECT rid, {', '.join(f'round(ln(1 + y{i}), 5) AS y{i}' for i in BINS)} FROM f"),
    "n9_preprocessed_splits": _sql(READOUTS, VEHICLES, SEQUENCES, FILLED, SPLIT, PREPARED, f"SELECT rid, split, round(sx, 5) AS x, {', '.join(f'round(sy{i}, 5) AS y{i}' for i in BINS)} FROM z"),
    "n13_prepared": _sql(READOUTS, VEHICLES, SEQUENCES, FILLED, SPLIT, PREPARED, f"SELECT rid, split, round(sg, 5) AS time_gap_scaled, round({STEP('x')}, 5) AS value_step, round({STEP('y2')}, 5) AS bin_step FROM z"),
    "n14_scaled_right_aligned": _sql(READOUTS, VEHICLES, SEQUENCES, FILLED, SPLIT, PREPARED, """SELECT i.vehicle_id, position, round(coalesce(sx, 0), 5) AS value, z.rid IS NOT NULL AS valid
FROM (SELECT vehicle_id, n, unnest(range(60))::INT AS position FROM (SELECT DISTINCT vehicle_id, n FROM z)) i LEFT JOIN z ON z.vehicle_id = i.vehicle_id AND z.seq_idx = i.n - 59 + position"""),
    "n15_one_hot_static": _sql(ORDERS, CUSTOMERS, SPLIT, "o AS (SELECT DISTINCT s0 AS c FROM v JOIN p USING (vehicle_id) WHERE split = 'train')", "\nSELECT vehicle_id, string_agg((s0 = c)::INT::VARCHAR, '' ORDER BY c) AS static FROM v, o GROUP BY vehicle_id"),
    "n16_one_hot_train": _sql(ORDERS, CUSTOMERS, SPLIT, f"SELECT vehicle_id, {', '.join(f'(s0 = {chr(39)}{c}{chr(39)})::INT AS {chr(34)}Spec_0_{c}{chr(34)}' for c in SEGMENTS[1:])} FROM v JOIN p USING (vehicle_id) WHERE split = 'train'"),
    "n17_one_hot_other": _sql(ORDERS, CUSTOMERS, SPLIT, f"SELECT vehicle_id, {', '.join(f'(s0 = {chr(39)}{c}{chr(39)})::INT AS {chr(34)}Spec_0_{c}{chr(34)}' for c in SEGMENTS[1:])}, 0 AS \"Spec_0_OTHER\" FROM v JOIN p USING (vehicle_id) WHERE split = 'test'"),
    "n18_median_imputed": _sql(READOUTS, VEHICLES, SEQUENCES, SPLIT, "SELECT rid, round(coalesce(f, mx), 5) AS x, round(coalesce(h0, my), 5) AS y FROM s JOIN p USING (vehicle_id), (SELECT median(f) AS mx, median(h0) AS my FROM s JOIN p USING (vehicle_id) WHERE split = 'train')"),
    "n20_standardized": _sql(READOUTS, VEHICLES, SPLIT, "c AS (SELECT vehicle_id, count(*) AS n FROM r GROUP BY 1)", "\nSELECT vehicle_id, round((n - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 5) AS sequence_length FROM c JOIN p USING (vehicle_id), (SELECT avg(n) AS m, stddev_pop(n) AS sd FROM c JOIN p USING (vehicle_id) WHERE split = 'train')"),
    "a5_histogram_aggregate": _sql(READOUTS, SEQUENCES, f"""SELECT vehicle_id, round((arg_max(f, seq_idx) FILTER (f IS NOT NULL) - arg_min(f, seq_idx) FILTER (f IS NOT NULL)) / nullif(max(time_step) FILTER (f IS NOT NULL) - min(time_step) FILTER (f IS NOT NULL), 0), 4) AS "1_0_slope",
  {', '.join(f'round(avg(h{i}), 4) AS "2_{i}_mean", round(arg_max(h{i}, seq_idx) FILTER (h{i} IS NOT NULL), 4) AS "2_{i}_last"' for i in BINS)}, round(median(time_gap) FILTER (seq_idx > 1 OR n = 1), 4) AS gap_median, round(max(n) / max(time_step), 4) AS observation_density FROM s GROUP BY vehicle_id"""),
    "a6_event_rate": _sql(READOUTS, VEHICLES, SPLIT, "SELECT split, count(*) AS n, round(avg(event), 5) AS event_rate FROM p GROUP BY 1"),
    "f1_kept_by_variance": _sql(READOUTS, SEQUENCES, """SELECT vehicle_id, round(avg(f), 5) AS "1_0_mean", round(min(time_gap) FILTER (seq_idx > 1 OR n = 1), 5) AS gap_min FROM s GROUP BY vehicle_id"""),
    "f2_kept_by_correlation": _greedy(),
    "x2_train_validation": _sql(READOUTS, VEHICLES, "SELECT vehicle_id, CASE WHEN row_number() OVER (PARTITION BY event ORDER BY md5('42:' || vehicle_id), vehicle_id) <= ceil(count(*) OVER (PARTITION BY event) * 0.2) THEN 'val' ELSE 'train' END AS split FROM v"),
    "x5_event_batches": _sql(READOUTS, VEHICLES, """k AS (SELECT vehicle_id, event, row_number() OVER (PARTITION BY event ORDER BY md5('42:' || vehicle_id), vehicle_id) - 1 AS i, count(*) OVER (PARTITION BY event) AS n FROM v),
b AS (SELECT ceil(sum(event) / 4)::BIGINT AS batches, floor(count(*) FILTER (event = 0) / 8)::BIGINT AS shares FROM v),
q AS (SELECT k.*, unnest(range(CASE WHEN event = 1 THEN 1 ELSE ceil(batches / shares)::BIGINT END)) AS pass FROM k, b),
""", _shuffled("q", "'0:' || event || ':' || pass"), """
o AS (SELECT vehicle_id, event, pass * shares + v // CASE WHEN event = 1 THEN 4 ELSE 8 END AS batch FROM shuffled, b WHERE (event = 1 OR v // 8 < shares) AND pass * shares + v // CASE WHEN event = 1 THEN 4 ELSE 8 END < batches)""", """
SELECT batch, row_number() OVER (PARTITION BY batch ORDER BY ('0x' || substr(md5('42:0:' || batch || ':' || vehicle_id), 1, 8))::BIGINT, vehicle_id) - 1 AS place, vehicle_id, event FROM o"""),
    "x8_loaded": _sql(READOUTS, VEHICLES, """q AS (SELECT k.*, epoch FROM (SELECT vehicle_id, row_number() OVER (ORDER BY md5('42:' || vehicle_id), vehicle_id) - 1 AS i, count(*) OVER () AS n FROM v) k, range(2) AS e(epoch)),
""", _shuffled("q", "'epoch:' || epoch")[:-1], "\nSELECT epoch::INT AS epoch, v // 128 AS batch, v % 128 AS place, vehicle_id FROM shuffled"),
    "x6_collated": _sql(READOUTS, SEQUENCES, FILLED, """i AS (SELECT vehicle_id, max(n) AS n, max(max(n)) OVER (PARTITION BY vehicle_id // 16) AS w FROM s GROUP BY vehicle_id)""", """
SELECT i.vehicle_id // 16 AS batch, i.vehicle_id, position, coalesce(x, 0) AS value, position < i.n AS valid FROM (SELECT vehicle_id, n, unnest(range(w))::INT AS position FROM i) i LEFT JOIN f ON f.vehicle_id = i.vehicle_id AND f.seq_idx = position + 1"""),
    "x7_dataset": _sql(READOUTS, VEHICLES, SEQUENCES, "SELECT vehicle_id, count(*) AS sequence_length, round(max(duration), 5) AS duration, max(event) AS event, 1.0::DOUBLE AS sample_weight, false AS is_pseudo, row_number() OVER (ORDER BY vehicle_id::VARCHAR) - 1 AS index FROM s JOIN v USING (vehicle_id) GROUP BY vehicle_id"),
    "g2_noise": _sql(READOUTS, SEQUENCES, FILLED, f"SELECT rid, round(x + {_noise(chr(39) + '1:' + chr(39) + ' || rid || ' + chr(39) + ':1_0' + chr(39), 0.5)}, 4) AS x FROM f"),
    "g3_dropout": _sql(READOUTS, SEQUENCES, FILLED, f"SELECT rid, {_kept(chr(39) + '1:' + chr(39) + ' || rid || ' + chr(39) + ':1_0' + chr(39), 0.3, 'x')} AS x FROM f"),
    "g4_augmented_views": _sql(READOUTS, SEQUENCES, FILLED, f"""m AS (SELECT rid, view, view || ':' || rid || ':1_0' AS k, CASE WHEN {_draw("view || ':' || rid || ':1_0'")} < floor(0.3 * 4294967296) THEN 0 ELSE x END AS x, CASE WHEN {_draw("view || ':' || rid || ':2_0'")} < floor(0.4 * 4294967296) THEN 0 ELSE y0 END AS y
  FROM f, (SELECT unnest([1, 2])::INT AS view))""", f"\nSELECT rid, view, round({_kept('k', 0.3, 'x + ' + _noise('k', 0.5))}, 4) AS x, y FROM m"),
    "g6_weak_time_views": _sql(READOUTS, SEQUENCES, FILLED, "m AS (SELECT rid, view, view || ':' || rid || ':1_0' AS k, x, seq_idx <= 40 AS ok FROM f, (SELECT unnest([1, 2])::INT AS view))", f"\nSELECT rid, view, round(CASE WHEN ok THEN {_kept('k', 0.05, 'x + ' + _noise('k', 0.01))} ELSE x END, 4) AS x FROM m"),
    "e1_spectrum": _sql(READOUTS, SEQUENCES, FILLED, """a AS (SELECT vehicle_id, bin, x, -2 * pi() * ((seq_idx - 1) * bin % n) / n AS a FROM (SELECT *, unnest(range(n // 2 + 1)) AS bin FROM f))""", "\nSELECT vehicle_id, bin, round(ln(1 + sqrt(sum(x * cos(a)) ** 2 + sum(x * sin(a)) ** 2) + 1e-8), 4) AS size FROM a GROUP BY 1, 2"),
    "g7_weak_frequency_views": _sql(READOUTS, SEQUENCES, FILLED, """a AS (SELECT vehicle_id, bin, x, -2 * pi() * ((seq_idx - 1) * bin % n) / n AS a FROM (SELECT *, unnest(range(n // 2 + 1)) AS bin FROM f)),
b AS (SELECT vehicle_id, bin, ln(1 + sqrt(sum(x * cos(a)) ** 2 + sum(x * sin(a)) ** 2) + 1e-8) AS x FROM a GROUP BY 1, 2),
m AS (SELECT vehicle_id, bin, view, x, view || ':' || vehicle_id || ':' || bin || ':1_0' AS k FROM b, (SELECT unnest([1, 2])::INT AS view))""", f"\nSELECT vehicle_id, bin, view, round({_kept('k', 0.01, 'x + ' + _noise('k', 0.05))}, 4) AS size FROM m"),
    "e2_masked_mean": _sql(READOUTS, SEQUENCES, FILLED, "SELECT vehicle_id, round(coalesce(avg(x) FILTER (seq_idx <= 40), 0), 5) AS pooled FROM f GROUP BY 1"),
}
QUERIES = {name: globals()[name] for name in ORACLE_SQL}
