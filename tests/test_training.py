"""Gradients against finite differences; training that doesn't depend on partitions and goes on where it stopped."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import layers, networks, training
from tidemark.operators.batches import event_batches, loaded, permuted
from tidemark.operators.networks import Batch, Draws, Network
from tidemark.operators.training import Columns, Options


def drawn_batch(n=6, seed=3, numerical=2, histogram=3, static=2):
    rng = np.random.default_rng(seed)
    x = [rng.normal(size=(rng.integers(1, 9), numerical + histogram)) for _ in range(n)]
    gaps = [rng.random(len(v)) for v in x]
    return Batch(x, gaps, numerical, rng.integers(1, 5, n).astype(float), rng.integers(0, 2, n).astype(float), rng.normal(size=(n, static)), 4)


def checked(loss, weights, names=None, step=1e-6):
    """The gradient that ``loss`` gives against the change of the loss, at some places of every weight."""
    metrics, grads, _ = loss(weights)
    rng = np.random.default_rng(0)
    for name in names or grads:
        flat = weights[name].ravel()
        for at in rng.choice(flat.size, min(4, flat.size), replace=False):
            kept = flat[at]
            sides = []
            for sign in (1, -1):
                flat[at] = kept + sign * step
                sides.append(loss(weights)[0]["loss"])
            flat[at] = kept
            assert grads[name].ravel()[at] == pytest.approx((sides[0] - sides[1]) / (2 * step), rel=2e-4, abs=2e-7), name
    return metrics


SMALL = {"hidden": 4, "head": 5, "projection": 3, "survival_hidden": 4}


@pytest.mark.parametrize("before", [False, True])
def test_tfc_gradient(before, monkeypatch):
    monkeypatch.setattr(layers, "SEGMENT", 3)
    monkeypatch.setattr(networks, "GROUP_VALUES", 40)
    net = Network("tfc", 2, 3, **SMALL)
    metrics = checked(lambda w: networks.tfc_loss(net, drawn_batch(), w, Draws(), before=before), net.weights())
    assert metrics["loss"] == pytest.approx(0.5 * (metrics["loss_time"] + metrics["loss_freq"]) + 0.5 * metrics["loss_consistency"])


def test_simple_gradient():
    net = Network("simple", 2, 3, **SMALL)
    checked(lambda w: networks.simple_loss(net, drawn_batch(), w, networks.SIMPLE_DRAWS), net.weights())


@pytest.mark.parametrize("kind", ["tfc", "simple"])
@pytest.mark.parametrize("survival, fusion", [("plain", "direct"), ("guided", "direct"), ("static", "direct"), ("static", "mlp")])
def test_survival_gradient(kind, survival, fusion):
    net = Network(kind, 2, 3, survival=survival, fusion=fusion, static=2, **SMALL)
    checked(lambda w: networks.survival_loss(net, drawn_batch(12), w, Draws()), net.weights())


def test_guided_gradient():
    net = Network("tfc", 2, 3, survival="guided", **SMALL)
    checked(lambda w: networks.guided_loss(net, drawn_batch(), w, Draws()), net.weights())


def test_losses_equal_plain_ones():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(4, 3)), rng.normal(size=(4, 3))
    z = [v / np.linalg.norm(v) for v in (*a, *b)]
    rows = [-(z[i] @ z[(i + 4) % 8] / 0.2 - np.log(sum(np.exp(z[i] @ z[j] / 0.2) for j in range(8) if j != i))) for i in range(8)]
    assert layers.nt_xent_gradient(a, b, 0.2)[0] == pytest.approx(np.mean(rows))
    risk, t, e = np.array([0.3, -1, 2, 0.5]), np.array([3.0, 1, 2, 5]), np.array([1, 1, 0, 1])
    want = [risk[i] - np.log(sum(np.exp(risk[j]) for j in range(4) if t[j] >= t[i])) for i in range(4) if e[i]]
    assert layers.cox_gradient(risk, t, e)[0] == pytest.approx(-np.mean(want))
    assert not layers.cox_gradient(risk, t, np.zeros(4))[1].any()
    # a batch norm's running moments move one after the other, and score
    net = Network("simple", 2, 3, **SMALL)
    w = net.weights()
    layers.merged_moments(w, [("time_head", np.full(5, 2.0), np.full(5, 3.0)), ("time_head", np.full(5, 4.0), np.full(5, 1.0))])
    assert w["time_head_mean"] == pytest.approx(0.9 * 0.2 + 0.4) and w["time_head_var"] == pytest.approx(0.9 * 1.2 + 0.1)
    assert networks.simple_loss(net, drawn_batch(1), w, Draws()) is None
    with pytest.raises(ValueError, match="fusion"):
        Network("tfc", 1, 1, survival="static", fusion="sum")


@pytest.mark.parametrize("segment, values", [(256, 1 << 20), (3, 30)])
def test_encoders_equal_steps(monkeypatch, segment, values):
    monkeypatch.setattr(layers, "SEGMENT", segment)
    monkeypatch.setattr(networks, "GROUP_VALUES", values)
    net, b = Network("tfc", 2, 3, **SMALL), drawn_batch()
    w = net.weights()
    s = lambda v: 1 / (1 + np.exp(-v))

    def states(x, name, gaps):
        h, out = np.zeros(4), []
        for v, gap in zip(x, gaps):
            old = h if gap is None else h * np.exp(-np.maximum(0, gap * w["time_decay_w"] + w["time_decay_b"]))
            r, z, m = np.split(w[f"{name}_w"] @ v + w[f"{name}_b"], 3)
            p, q, c = np.split(w[f"{name}_u"] @ old + w[f"{name}_c"], 3)
            gate = s(z + q)
            h = (1 - gate) * np.tanh(m + s(r + p) * c) + gate * old
            out.append(h)
        return np.mean(out, 0)

    time, freq = (networks.pooled(*networks.inputs(net, b, p), w, p) for p in ("time", "freq"))
    for i, (x, gaps) in enumerate(zip(b.x, b.gaps)):
        steps = np.concatenate([np.zeros((1, 5)), x[1:] - x[:-1]])
        sizes = np.log1p(np.abs(np.fft.rfft(steps, axis=0)) + 1e-8)
        assert time[i] == pytest.approx(states(x, "time", gaps)) and freq[i] == pytest.approx(states(sizes, "freq", [None] * len(sizes)))
    simple = Network("simple", 2, 3, **SMALL)
    w = simple.weights()
    bins = networks.pooled(*networks.inputs(simple, b, "bins"), w, "bins")
    relu = lambda v: np.maximum(0, v)
    for i, x in enumerate(b.x):
        assert bins[i] == pytest.approx(np.mean([relu(w["bins_2_w"] @ relu(w["bins_1_w"] @ v + w["bins_1_b"]) + w["bins_2_b"]) for v in x[:, 2:]], 0))


COLUMNS = Columns(["x"], ["p", "q"], "gaps", ["s", "u"])


@pytest.fixture(scope="module")
def rows(spark):
    """Vehicles whose level and slope make failures early."""
    rng = np.random.default_rng(8)
    out = []
    for i in range(70):
        level, n = float(rng.normal()), int(rng.integers(3, 10))
        x = (level + 0.2 * np.arange(n) * level + rng.normal(0, 0.1, n)).tolist()
        duration = float(np.ceil(8 * np.exp(-0.8 * level) * rng.exponential()) + 1)
        out.append((i, n, x, rng.random(n).tolist(), rng.random(n).tolist(), rng.random(n).tolist(), duration, int(i % 3 < 1), float(rng.normal()), float(level > 0)))
    return spark.createDataFrame(out, "vehicle_id bigint, sequence_length int, x array<double>, p array<double>, q array<double>, gaps array<double>, duration double, event int, s double, u double")


@pytest.fixture(scope="module")
def parts(rows):
    return rows.filter("vehicle_id < 50").cache(), rows.filter("vehicle_id >= 50").cache()


def same(a, b):
    assert a.keys() == b.keys()
    assert all(np.array_equal(a[n], b[n]) for n in a)


def test_training_is_the_same_for_any_partitions_and_goes_on(spark, parts):
    net = Network("tfc", 1, 2, **SMALL)
    options = Options("tfc", epochs=2, size=12, per_step=2, decay=1e-4)
    one = training.train(parts[0].coalesce(1), parts[1], COLUMNS, net, options)
    four = training.train(parts[0].repartition(4), parts[1].repartition(3), COLUMNS, net, options)
    same(one.weights, four.weights)
    half = training.train(*parts, COLUMNS, net, options, until=1)
    again = training.resumed(training.saved(spark, half))
    whole = training.train(*parts, COLUMNS, net, options, again)
    same(one.weights, whole.weights)
    same(one.best_weights, whole.best_weights)
    assert one.history == whole.history and len(one.history) == 2
    assert one.best == min(e["val_loss"] for e in one.history)
    found = {(r.epoch, r.metric): r.value for r in training.history(spark, one).collect()}
    assert found[2, "val_loss"] == one.history[1]["val_loss"] and found[1, "skipped"] == 0


def test_step_equals_one_batch_in_numpy(parts):
    net = Network("simple", 1, 2, **SMALL)
    options = Options("simple", size=50, clip=None, rate=0.01, decay=0.1)
    state = training.begun(net.weights())
    w = {n: v.copy() for n, v in state.weights.items()}
    batch = COLUMNS.batch(parts[0].toArrow(), 0)
    _, grads, moments = training.loss_of(net, options, batch, w, 0, True)
    found = training.summed(parts[0].withColumn("batch", F.lit(0)), COLUMNS, net, options, state.weights, 0)
    training.moved(state, found, options)
    for n, g in grads.items():
        assert state.weights[n] == pytest.approx(w[n] * (1 - 0.001) - 0.01 * g / (np.abs(g) + 1e-8), abs=1e-9)
    layers.merged_moments(w, moments)
    assert state.weights["time_head_var"] == pytest.approx(w["time_head_var"])


def test_learning_lowers_the_loss(parts):
    net = Network("tfc", 1, 2, **SMALL)
    state = training.train(*parts, COLUMNS, net, Options("tfc", epochs=4, size=25, rate=0.02))
    assert state.history[-1]["train_loss"] < state.history[0]["train_loss"]


def test_guided_and_fine_tuned_rank_better_than_drawn(spark, parts):
    net = Network("tfc", 1, 2, survival="guided", **SMALL)
    options = Options("guided", epochs=3, size=12, events=4, rate=0.03, best="c_index")
    state = training.train(*parts, COLUMNS, net, options)
    assert state.best > max(0.6, training.c_index(parts[1], COLUMNS, net, net.weights()))
    assert state.best == max(e["val_c_index"] for e in state.history)
    static = Network("tfc", 1, 2, survival="static", fusion="mlp", static=2, **SMALL)
    tuned = Options("survival", epochs=1, size=12, events=4, rate=0.01, best="c_index", frozen=net.encoder)
    start = static.weights(start=state.best_weights)
    done = training.train(*parts, COLUMNS, static, tuned, training.begun(start))
    for n in start:
        assert np.array_equal(start[n], done.weights[n]) == (n.startswith(net.encoder) or "head" in n or n.startswith("freq")), n
    got = training.scored(parts[1], COLUMNS, static, done.weights)
    assert got.count() == 20 and all(r.risk is not None and len(r.pooled) == 8 and len(r.projection) == 6 for r in got.collect())


def test_scores_do_not_depend_on_neighbours(spark, rows):
    net = Network("simple", 1, 2, **SMALL)
    w = net.weights()
    risks = lambda t: {r.vehicle_id: r.projection for r in training.scored(t, COLUMNS, net, w).collect()}
    whole, few = risks(rows), risks(rows.filter("vehicle_id in (3, 44)"))
    assert all(whole[k] == pytest.approx(few[k]) for k in few)
    assert training.scored(rows, COLUMNS, net, w).filter("risk is not null").count() == 0
    assert training.scored(rows.limit(0), COLUMNS, net, w).count() == 0


def test_nothing_to_train_on(parts):
    with pytest.raises(ValueError, match="no rows"):
        training.train(parts[0].limit(0), parts[1], COLUMNS, Network("simple", 1, 2, **SMALL), Options("simple", epochs=1))


def test_permutations_and_passes(spark):
    rows = spark.range(101).withColumnRenamed("id", "vehicle_id")
    got = loaded(rows, "vehicle_id", 10, epochs=3).collect()
    for epoch in range(3):
        assert sorted(r.batch * 10 + r.place for r in got if r.epoch == epoch) == list(range(101))
    orders = [[r.vehicle_id for r in sorted(got, key=lambda r: (r.batch, r.place)) if r.epoch == e] for e in range(3)]
    assert sum(a == b for a, b in zip(*orders[:2])) < 20 and {r.vehicle_id: r.place for r in permuted(rows, "vehicle_id", epoch=1).collect()} == {v: i for i, v in enumerate(orders[1])}
    vehicles = rows.withColumn("event", (F.col("vehicle_id") < 40).cast("int"))
    dealt = event_batches(vehicles, 12, 4, epoch=1).collect()
    assert sorted(r.vehicle_id for r in dealt if r.event) == list(range(40))
    # 61 censored rows are seven shares of 8; the eighth batch begins another pass, in another order
    passes = [[{r.vehicle_id for r in dealt if r.batch == b and not r.event} for b in some] for some in (range(7), range(7, 10))]
    assert all(len(s) == 8 for p in passes for s in p)
    assert len(set().union(*passes[0])) == 56 and len(set().union(*passes[1])) == 24
    assert passes[0][:3] != passes[1] and {frozenset(s) for s in passes[0]}.isdisjoint({frozenset(s) for s in passes[1]})
    assert event_batches(vehicles, 12, 4, epoch=0).select("batch", "vehicle_id").collect() != [(r.batch, r.vehicle_id) for r in dealt]
    assert replace(Draws(), epoch=1) != Draws()


@pytest.mark.parametrize("loss, events", [("tfc", None), ("simple", None), ("guided", 3), ("survival", 3)])
def test_runs_of_steps_equal_steps_of_their_own(spark, parts, monkeypatch, loss, events):
    net = Network("simple" if loss == "simple" else "tfc", 1, 2, survival={"guided": "guided", "survival": "plain"}.get(loss), **SMALL)
    options = Options(loss, epochs=2, size=9, per_step=2, events=events)
    jobs, walk, add = [], training.walked, training.summed
    monkeypatch.setattr(training, "walked", lambda *a: jobs.append("run") or walk(*a))
    monkeypatch.setattr(training, "summed", lambda *a, train=True, **k: jobs.append("step" if train else "val") or add(*a, train=train, **k))
    one = training.train(*parts, COLUMNS, net, options)
    assert jobs == ["run", "val"] * 2  # fewer jobs than steps
    monkeypatch.setattr(training, "RUN_VALUES", 1200)
    jobs.clear()
    runs = training.train(*parts, COLUMNS, net, options)
    assert jobs.count("run") in (4, 6) and "step" not in jobs
    monkeypatch.setattr(training, "STEP_VALUES", 1)
    jobs.clear()
    steps = training.train(*parts, COLUMNS, net, options)
    assert jobs.count("step") == steps.steps >= 4 and "run" not in jobs
    for other in (runs, steps):
        same(one.weights, other.weights)
        same(one.second, other.second)
        assert one.history == other.history and one.steps == other.steps


def test_states_that_are_kept_give_the_same_gradient(monkeypatch):
    monkeypatch.setattr(layers, "SEGMENT", 3)
    net, found = Network("tfc", 2, 3, survival="guided", **SMALL), []
    for room in (1 << 20, 60, 0):
        monkeypatch.setattr(networks, "KEPT_VALUES", room)
        monkeypatch.setattr(networks, "GROUP_VALUES", 60)
        found.append(networks.guided_loss(net, drawn_batch(), net.weights(), Draws())[1])
    same(found[0], found[1])
    same(found[0], found[2])


def test_compared_trainings_run_side_by_side(spark):
    from threading import Barrier

    from tidemark.plans.training_catalog import _together

    meet = Barrier(3, timeout=30)
    assert sorted(_together(spark, [lambda i=i: (meet.wait() >= 0, i)[1] for i in range(3)])) == [0, 1, 2]


LOSSES = [("tfc", None, "tfc"), ("simple", None, "simple"), ("tfc", "guided", "guided"), ("tfc", "static", "survival"), ("simple", "plain", "survival")]


@pytest.mark.parametrize("kind, survival, loss", LOSSES)
@pytest.mark.parametrize("room", [1 << 20, 70, 0])
def test_what_is_drawn_ahead_is_what_steps_draw(monkeypatch, kind, survival, loss, room):
    monkeypatch.setattr(networks, "KEPT_VALUES", room)
    monkeypatch.setattr(networks, "GROUP_VALUES", 60)
    net, options = Network(kind, 2, 3, survival=survival, static=2, **SMALL), Options(loss)
    w, batch = net.weights(), drawn_batch()
    want = training.loss_of(net, options, batch, w, 1, True)
    ahead = networks.drawn_ahead(net, drawn_batch(), training.draws_of(options, 1, True), loss)
    if room > 1 << 10:  # nothing is left to draw
        assert not ahead.x and ahead.made
        for name in ("moved", "masked"):
            monkeypatch.setattr(Draws, name, lambda *a: pytest.fail("drawn again"))
    else:
        assert len(ahead.x) == 6 and all(len(m) < 6 for m in ahead.made.values())
    got = training.loss_of(net, options, ahead, w, 1, True)
    assert got[0] == want[0]
    same(got[1], want[1])


def test_runs_read_what_was_drawn_ahead(parts, monkeypatch):
    net, bodies, walk = Network("tfc", 1, 2, **SMALL), [], training.walked
    monkeypatch.setattr(training, "walked", lambda rows, *a: bodies.append(rows.columns) or walk(rows, *a))
    training.train(*parts, COLUMNS, net, Options("tfc", epochs=1, size=9))
    assert bodies == [["batch", "body"]]


def test_guided_loss_is_the_sum_of_its_parts():
    net = Network("tfc", 2, 3, survival="guided", **SMALL)
    w, b, draws = net.weights(), drawn_batch(), Draws()
    metrics, grads, moments = networks.guided_loss(net, b, w, draws)
    contrast, cox = networks.tfc_loss(net, b, w, draws, before=True), networks.survival_loss(net, b, w, draws)
    assert metrics["loss"] == pytest.approx(contrast[0]["loss"] + 0.3 * cox[0]["loss"]) and len(moments) == len(contrast[2])
    for n, g in grads.items():
        assert g == pytest.approx(contrast[1][n] + 0.3 * cox[1][n])
    # sequences of its views and as they are go through the recurrent layer together
    calls, states = [], layers.pooled_states
    with pytest.MonkeyPatch.context() as m:
        m.setattr(layers, "pooled_states", lambda x, lengths, *a: calls.append(len(lengths)) or states(x, lengths, *a))
        networks.guided_loss(net, b, w, draws)
    assert calls == [18, 12]


def test_values_by_readout():
    lengths = np.array([0, 1, 3, 3])
    x = np.array([10, 20, 21, 22, 30, 31, 32])
    assert x[layers.by_readout(lengths)].tolist() == [10, 20, 30, 21, 31, 22, 32]
    net = Network("simple", 1, 2, **SMALL)
    values = [np.ones((n, 3)) * n for n in lengths]
    b = Batch(values, [np.ones(n) for n in lengths], 1)
    for part in net.parts:
        states = networks.pooled(*networks.inputs(net, b, part), net.weights(), part)
        assert not states[0].any() and np.array_equal(states[2], states[3]) and states[1].any()


@pytest.mark.parametrize("values, epoch", [(1 << 23, 1), (1200, 0)])
def test_next_runs_are_dealt_and_drawn_beside_the_steps(parts, monkeypatch, values, epoch):
    """Those of the next epoch, and of the same one."""
    from threading import Event

    drawn, met, walk, draw = Event(), [], training.walked, training.drawn_ahead
    calls = []

    def seen(rows, columns, net, options, at):
        calls.append(at)
        if len(calls) == 2:
            drawn.set()
        return draw(rows, columns, net, options, at)

    monkeypatch.setattr(training, "RUN_VALUES", values)
    monkeypatch.setattr(training, "drawn_ahead", seen)
    monkeypatch.setattr(training, "walked", lambda *a: met.append(drawn.wait(60)) or walk(*a))
    net = Network("tfc", 1, 2, **SMALL)
    training.train(*parts, COLUMNS, net, Options("tfc", epochs=2, size=9, per_step=2))
    assert all(met) and len(met) == len(calls) and calls == sorted(calls) and calls[1] == epoch


def test_what_is_worked_out_ahead_is_bounded_and_ends_with_an_error(spark):
    made = []

    def items():
        for i in range(6):
            made.append(i)
            yield i
        raise ValueError("the end")

    got = training.ahead(spark, items(), 2)
    assert next(got) == 0 and next(got) == 1 and max(made) <= 3
    with pytest.raises(ValueError, match="the end"):
        list(got)


def test_prefixes_of_packed_sequences_are_packed_prefixes(spark):
    from tidemark.operators.sequences import build_prefixes, build_sequences, packed, packed_prefixes

    readouts = [(v, v * 100 + i, float(i // 2), float(i * v)) for v, n in enumerate([1, 5, 6, 7, 20, 33]) for i in range(n)]
    held = build_sequences(spark.createDataFrame(readouts, "vehicle_id bigint, rid bigint, time_step double, x double"))
    want = packed(build_prefixes(held), ["x", "time_gap"], "prefix_id")
    got = packed_prefixes(packed(held, ["x", "time_gap"]), ["x", "time_gap"]).drop("vehicle_id")
    assert sorted(want.collect()) == sorted(got.select(want.columns).collect()) and want.count() == 2 + 3 + 3 + 1
    assert got.schema["sequence_length"].dataType == want.schema["sequence_length"].dataType


def test_values_of_a_gate_lie_together():
    net, b = Network("tfc", 2, 3, **SMALL), drawn_batch()
    held: list = []
    networks.pooled(*networks.inputs(net, b, "time"), net.weights(), "time", held)
    (_, segments) = held[0][3]
    old, _, _, gates, new, _ = segments[0]
    assert gates.shape == (2, *old.shape) and gates.flags.c_contiguous and new.shape == old.shape


def test_places_are_worked_out_in_many_tasks(spark):
    """Ranks are few bytes a row, of which a task or two would be made."""
    rows = spark.range(2000).select(F.col("id").alias("vehicle_id"), (F.col("id") % 5 < 2).cast("int").alias("event"))
    for made in (permuted(rows, "vehicle_id"), event_batches(rows, 12, 4)):
        assert "REPARTITION_BY_NUM" in made._jdf.queryExecution().toString()


def test_a_state_is_asked_for_once_there_are_runs_to_begin_with(parts, monkeypatch):
    """So a head's first runs are dealt and drawn beside the steps of its encoder; the weights are the same."""
    net, drawn, draw = Network("tfc", 1, 2, survival="plain", **SMALL), [], training.drawn_ahead
    monkeypatch.setattr(training, "drawn_ahead", lambda *a: drawn.append(a[-1]) or draw(*a))
    options, asked = Options("survival", epochs=2, size=12, events=4), []

    def start():
        asked.append(len(drawn))
        return training.begun(net.weights(7))

    late = training.train(*parts, COLUMNS, net, options, start)
    assert len(asked) == 1 and asked[0] > 0
    early = training.train(*parts, COLUMNS, net, options, training.begun(net.weights(7)))
    same(late.weights, early.weights)
    assert late.history == early.history and len(late.history) == 2
