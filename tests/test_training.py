import math

import numpy as np
import pyarrow as pa
import pytest
from helpers import brute_auroc, planted
from pyspark.sql import functions as F

from probewise.config import HammingSettings, Optimiser, ProjectedSettings, Projection, Quantiser, Schedule
from probewise.functions.kernels import as_list_column
from probewise.operators import learners, training
from probewise.operators.scoring import HammingModel, qrange


def columns(y, **arrays):
    return {"y": pa.array(np.asarray(y, dtype=np.int32)), **{k: as_list_column(np.asarray(v, dtype=float)) for k, v in arrays.items()}}


def adam(p, g, state, lr, decay):
    """Reference optimiser step on one array."""
    m, v, t = state
    m, v, t = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, t + 1
    p = p * (1 - lr * decay)
    return p - lr * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8), (m, v, t)


def hamming_loss(rows, raw, bias, sims, y, pw):
    logits = (sims * (np.log1p(np.exp(raw)) + 1e-6)).max(axis=1) + bias
    return (pw * y * np.logaddexp(0, -logits) + (1 - y) * np.logaddexp(0, logits)).mean()


def numeric(function, point, eps=1e-6):
    out = np.zeros_like(point)
    for i in np.ndindex(point.shape):
        hi, lo = point.copy(), point.copy()
        hi[i] += eps
        lo[i] -= eps
        out[i] = (function(hi) - function(lo)) / (2 * eps)
    return out


class Recorder:
    """Stands in for the optimiser and keeps the gradients."""

    def update(self, params, gradients):
        self.gradients = {k: np.asarray(v) for k, v in gradients.items()}


def test_hamming_gradient_is_the_derivative():
    x, y, _ = planted(200, 6)
    rows = np.random.default_rng(1).normal(size=(3, 6))
    learner = learners.HammingReadout(rows, HammingSettings(), 1.7)
    learner.params = {"raw": np.array([0.4, -0.2, 0.9]), "bias": np.array([0.1])}
    learner.optimizer = Recorder()
    sims = HammingModel(rows).matches(x)
    loss = learner.step(learner.batch_sums(columns(y, v=sims)))
    raw, bias = np.array([0.4, -0.2, 0.9]), np.array([0.1])
    assert loss == pytest.approx(hamming_loss(rows, raw, 0.1, sims, y, 1.7))
    np.testing.assert_allclose(learner.optimizer.gradients["raw"], numeric(
        lambda r: hamming_loss(rows, r, 0.1, sims, y, 1.7), raw), atol=1e-6)
    np.testing.assert_allclose(learner.optimizer.gradients["bias"], numeric(
        lambda b: hamming_loss(rows, raw, b[0], sims, y, 1.7), bias), atol=1e-6)


def test_projected_gradient_without_quantisation():
    x, y, _ = planted(150, 6)
    rows = np.random.default_rng(2).normal(size=(3, 6))
    learner = learners.ProjectedReadout(rows, ProjectedSettings(Projection(4), Quantiser(3, on=False)))
    learner.params["raw"] = np.array([0.3, 0.1, -0.5])
    learner.optimizer = Recorder()
    z = learner.features(x.astype(float))
    r = learner.features(learner.base.rows)

    def loss(raw, bias):
        logits = ((z @ r.T) * np.log1p(np.exp(raw))).max(axis=1) + bias
        return (y * np.logaddexp(0, -logits) + (1 - y) * np.logaddexp(0, logits)).mean()

    value = learner.step(learner.batch_sums(columns(y, v=z)))
    assert value == pytest.approx(loss(learner.params["raw"], 0.0))
    assert set(learner.optimizer.gradients) == {"raw", "bias"}  # scales are not in use
    np.testing.assert_allclose(learner.optimizer.gradients["raw"],
                               numeric(lambda p: loss(p, 0.0), learner.params["raw"]), atol=1e-6)


def lsq_twin(z, r, y, raw, bias, s_a, s_r, bits, batch):
    """Straight-through gradients written out element by element."""
    low, high = qrange(bits)
    alphas = np.log1p(np.exp(raw))
    n, g_raw, g_bias, g_a, g_r = len(y), np.zeros_like(raw), 0.0, 0.0, 0.0

    def quantised(v, s):
        return np.clip(np.rint(v / s), low, high)

    def slope(v, s):
        ratio, q = v / s, np.clip(np.rint(v / s), low, high)
        return np.where((ratio >= low) & (ratio <= high), q - ratio, q)

    for i in range(n):
        q, rq = quantised(z[i], s_a) * s_a, quantised(r, s_r) * s_r
        scores = (rq @ q) * alphas
        j = int(np.argmax(scores))
        e = 1 / (1 + np.exp(-(scores[j] + bias))) - y[i]
        g_raw[j] += e * (rq[j] @ q) / (1 + np.exp(-raw[j]))
        g_bias += e
        g_a += e * alphas[j] * (rq[j] @ slope(z[i], s_a))
        g_r += e * alphas[j] * (q @ slope(r[j], s_r))
    f_a = 1 / math.sqrt(batch * z.shape[1] * high)
    f_r = 1 / math.sqrt(r.size * high)
    return g_raw / n, g_bias / n, g_a / n * f_a * s_a, g_r / n * f_r * s_r


def test_quantiser_scale_gradients_follow_the_straight_through_rules():
    x, y, _ = planted(80, 6)
    rows = np.random.default_rng(3).normal(size=(4, 6))
    learner = learners.ProjectedReadout(rows, ProjectedSettings(Projection(5), schedule=Schedule(300, 64)))
    learner.params["raw"] = np.array([0.3, 0.1, -0.5, 0.2])
    learner.params["bias"] = np.array([0.05])
    learner.optimizer = Recorder()
    z, r = learner.features(x.astype(float)), learner.features(learner.base.rows)
    s_a, s_r = learner._scales()
    want = lsq_twin(z, r, y, learner.params["raw"], 0.05, s_a, s_r, 3, 64)
    # Two batches add up to the same step.
    sums = learner.batch_sums(columns(y[:30], v=z[:30])) + learner.batch_sums(columns(y[30:], v=z[30:]))
    learner.step(sums)
    got = learner.optimizer.gradients
    np.testing.assert_allclose(got["raw"], want[0], atol=1e-12)
    np.testing.assert_allclose([got["bias"][0], got["act"][0], got["row"][0]], want[1:], atol=1e-12)


def test_learned_projection_gradient_without_quantisation():
    x, y, _ = planted(60, 5)
    rows = np.random.default_rng(4).normal(size=(2, 5))
    for normalise in (False, True):
        settings = ProjectedSettings(Projection(3, "learned", normalise), Quantiser(3, on=False))
        learner = learners.LearnedProjection(rows, settings)
        w0 = learner.params["projection"].copy()
        np.testing.assert_allclose(w0 @ w0.T, np.eye(3), atol=1e-9)
        learner.optimizer = Recorder()
        unit = learner.base.rows

        def loss(w):
            z, r = x @ w.T, unit @ w.T
            if normalise:
                z, r = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (z, r))
            logits = ((z @ r.T) * math.log(2)).max(axis=1)
            return (y * np.logaddexp(0, -logits) + (1 - y) * np.logaddexp(0, logits)).mean()

        learner.step(learner.batch_sums(columns(y, x=x)))
        np.testing.assert_allclose(learner.optimizer.gradients["projection"], numeric(loss, w0), atol=1e-6)


def test_hash_matrix_gradient_of_the_smooth_stand_in():
    """With codes replaced by their slopes times a shift, the chain rule can be checked."""
    x, y, _ = planted(40, 4)
    rows = np.random.default_rng(5).normal(size=(2, 4))
    cfg = HammingSettings()
    learner = learners.HashMatrixLearner(rows, cfg, 1.3)
    learner.optimizer = Recorder()
    xd = x.astype(float)
    loss = learner.step(learner.batch_sums(columns(y, x=xd)))
    codes, slope = learner._encode(xd)
    row_codes, row_slope = learner._encode(rows)
    alphas = learner.alphas
    n, d = x.shape
    best = ((codes @ row_codes.T) / d * alphas).argmax(axis=1)

    def smooth(w):
        """First-order model of the codes around the identity."""
        c = codes + slope * (xd @ w.T - xd)
        r = row_codes + row_slope * (rows @ w.T - rows)
        logits = ((c * r[best]).sum(axis=1)) / d * alphas[best]
        bce = (1.3 * y * np.logaddexp(0, -logits) + (1 - y) * np.logaddexp(0, logits)).mean()
        identity = np.square(w - np.eye(d)).sum() / d ** 2
        return bce + cfg.penalties.identity * identity + cfg.penalties.balance * np.square(c.mean(axis=0)).mean()

    np.testing.assert_allclose(learner.optimizer.gradients["matrix"], numeric(smooth, np.eye(d)), atol=1e-6)
    assert loss == pytest.approx(smooth(np.eye(d)))


def readout_twin(rows, x, y, val_x, val_y, cfg, pw):
    """Full-batch training of row weights with early stopping, in plain numpy."""
    sims, val_sims = HammingModel(rows).matches(x), HammingModel(rows).matches(val_x)
    raw, bias = np.full(len(rows), math.log(math.expm1(1.0))), 0.0
    s_raw = s_bias = (0.0, 0.0, 0)
    best, state, misses, evaluated = -np.inf, None, 0, []
    for epoch in range(cfg.sign_schedule.epochs):
        alphas = np.log1p(np.exp(raw)) + 1e-6
        scores = sims * alphas
        j = scores.argmax(axis=1)
        p = 1 / (1 + np.exp(-(scores.max(axis=1) + bias)))
        e = p * (1 - y + pw * y) - pw * y
        g = np.bincount(j, e * sims[np.arange(len(j)), j], len(rows)) / len(y) / (1 + np.exp(-raw))
        raw, s_raw = adam(raw, g, s_raw, cfg.readout.rate, cfg.readout.decay)
        bias, s_bias = adam(bias, e.mean(), s_bias, cfg.readout.rate, cfg.readout.decay)
        if (epoch + 1) % cfg.sign_schedule.score_every and epoch < cfg.sign_schedule.epochs - 1:
            continue
        auroc = brute_auroc((val_sims * (np.log1p(np.exp(raw)) + 1e-6)).max(axis=1) + bias, val_y)
        evaluated.append((epoch + 1, auroc))
        if auroc > best + 1e-5:
            best, state, misses = auroc, (np.log1p(np.exp(raw)) + 1e-6, bias), 0
        else:
            misses += 1
        if misses >= cfg.sign_schedule.patience:
            break
    return state, evaluated


def test_training_loop_matches_numpy_with_early_stopping(spark):
    x, y, domain = planted(300, 8, ("a", "b"))
    rows = {0: np.random.default_rng(7).normal(size=(4, 8)), 1: np.random.default_rng(8).normal(size=(3, 8))}
    cfg = HammingSettings(readout=Optimiser(0.2, 1e-4), sign_schedule=Schedule(30, 512, 2, 3))
    is_val = np.arange(300) % 4 == 0
    table = spark.createDataFrame(
        [(1 if d == "a" else 2, "val" if v else "train", i, int(t), [float(f) for f in r])
         for i, (d, v, t, r) in enumerate(zip(domain, is_val, y, x))],
        "scope_id int, split string, example_id long, y int, x array<double>")
    made = {s: learners.HammingReadout(r, cfg, 1.2) for s, r in rows.items()}
    feats = training.scope_features(table, {s: m.frozen().features for s, m in made.items()}).persist()
    progress = training.fit_learners(
        made, training.parted(feats.filter("split = 'train'"), 1), feats.filter("split = 'val'"), cfg.sign_schedule.epochs,
        eval_every=cfg.sign_schedule.score_every, patience=cfg.sign_schedule.patience, margin=1e-5, pending=4)
    models = training.final_models(made, progress)
    for s in rows:
        mine = np.ones(300, bool) if s == 0 else domain == "a"
        state, evaluated = readout_twin(
            rows[s], x[mine & ~is_val].astype(float), y[mine & ~is_val],
            x[mine & is_val].astype(float), y[mine & is_val], cfg, 1.2)
        assert [(h["epoch"], pytest.approx(h["val_auroc"])) for h in progress[s].history] == evaluated
        np.testing.assert_allclose(models[s].alphas, state[0], atol=1e-9)
        assert models[s].bias == pytest.approx(state[1], abs=1e-9)
    feats.unpersist()


def test_bias_only_training_equals_the_general_learner():
    rng = np.random.default_rng(9)
    scores, y = rng.integers(-4, 5, 200) / 8.0, rng.integers(0, 2, 200)
    distinct, slot = np.unique(scores, return_inverse=True)
    pos, neg = np.bincount(slot, y == 1), np.bincount(slot, y == 0)
    cfg = HammingSettings()
    biases, losses = training.bias_from_counts(distinct, pos, neg, 1.4, 12, cfg.readout)
    bias, state = 0.0, (0.0, 0.0, 0)
    for epoch in range(12):
        p = 1 / (1 + np.exp(-(scores + bias)))
        e = p * (1 - y + 1.4 * y) - 1.4 * y
        bias, state = adam(bias, e.mean(), state, cfg.readout.rate, cfg.readout.decay)
        assert biases[epoch] == pytest.approx(bias, abs=1e-12)
    assert losses[0] == pytest.approx((1.4 * y * np.logaddexp(0, -scores) + (1 - y) * np.logaddexp(0, scores)).mean())


def test_a_pass_takes_every_row_once_in_batches():
    rng = np.random.default_rng(11)
    sims, y, deal = rng.normal(size=(100, 2)), rng.integers(0, 2, 100), rng.random(100)
    cfg, seen = HammingSettings(), []

    class Watched(learners.HammingReadout):
        def batch_sums(self, columns):
            seen.append(columns["deal"].to_pylist())
            return super().batch_sums(columns)

    learner = Watched(np.eye(4)[:2], cfg, 1.0)
    found = training.one_pass(learner, {**columns(y, v=sims), "deal": pa.array(deal)}, 0.4, 32)
    assert [len(b) for b in seen] == [32, 32, 32, 4] and sorted(sum(seen, [])) == sorted(deal)
    assert sum(seen, []) == sorted(deal, key=lambda d: (d - 0.4) % 1.0)
    assert found[0] == 100 and found[-1] == 4
    twin = learners.HammingReadout(np.eye(4)[:2], cfg, 1.0)
    for batch in seen:
        at = [deal.tolist().index(d) for d in batch]
        twin.step(twin.batch_sums(columns(y[at], v=sims[at])))
    np.testing.assert_allclose(found[1:-2] / 100, twin.state())
    other = learners.HammingReadout(np.eye(4)[:2], cfg, 1.0)
    other.restore(found[1:-2] / 100)
    np.testing.assert_allclose(other.params["raw"], twin.params["raw"])


def test_slim_learners_train_and_score_alike():
    x, y, _ = planted(60, 6)
    rows = np.random.default_rng(12).normal(size=(3, 6))
    for learner in (learners.HammingReadout(rows, HammingSettings(), 1.2),
                    learners.ProjectedReadout(rows, ProjectedSettings(Projection(4, normalise=True)))):
        slim = learner.slim()
        v = learner.features(x.astype(float))
        for one in (learner, slim):
            one.step(one.batch_sums(columns(y, v=v)))
        np.testing.assert_allclose(slim.state(), learner.state())
        whole = learner.whole_model(slim.snapshot())
        np.testing.assert_allclose(slim.feature_scores(slim.snapshot(), v), learner.feature_scores(learner.model(), v))
        np.testing.assert_allclose(whole.scores(x.astype(float)), learner.model().scores(x.astype(float)))


def test_parts_are_packed_and_dealt_evenly(spark):
    """Four parts of scopes 0 to 2, scope 0 apart: eight tasks with one unit each, whose rows are all there, in order of their deal."""
    given = [(s, i, i % 2, [float(i), s / 3][:2 - s % 2]) for i in range(400) for s in (0, 1 + i % 2)]
    table = spark.createDataFrame(given, "scope_id int, example_id long, y int, v array<double>")
    cells = training.parted(table, 4, (0,)).withColumn("task", F.spark_partition_id()).collect()
    units = {}
    for c in cells:
        units.setdefault(c["task"], set()).add((c["part"], c["scope_id"] == 0))
    assert sorted(next(iter(u)) for u in units.values()) == [(p, own) for p in range(4) for own in (False, True)]
    assert all(len(u) == 1 for u in units.values())
    found = []
    for c in cells:
        columns = training._unpacked([c.asDict()], "v")
        deal = columns["deal"].to_pylist()
        assert deal == sorted(deal)
        found += [(c["scope_id"], int(v[0]), int(y), v) for y, v in zip(columns["y"].to_pylist(), columns["v"].to_pylist())]
    assert sorted(found) == sorted(given)


def test_parts_that_are_averaged_reach_the_same_ranking(spark):
    x, y, _ = planted(4000, 6, ("a",))
    rows = np.eye(6)[:4]
    is_val = np.arange(4000) % 4 == 0
    table = spark.createDataFrame(
        [(0, "val" if v else "train", i, int(t), m.tolist())
         for i, (v, t, m) in enumerate(zip(is_val, y, x.astype(float) @ rows.T))],
        "scope_id int, split string, example_id long, y int, v array<double>").persist()
    reached = {}
    for parts in (1, 5):
        learner = learners.HammingReadout(rows, HammingSettings(), 1.0)
        progress = training.fit_learners(
            {0: learner}, training.parted(table.filter("split = 'train'"), parts).persist(), table.filter("split = 'val'"),
            25, batch=64, pending=25, few=parts == 1)
        reached[parts] = progress[0].best_auroc
    assert reached[1] > 0.75 and abs(reached[1] - reached[5]) < 0.01
    table.unpersist()
