"""Per-scope learners: batch gradients for the tasks, optimiser steps for the driver.

``batch_sums`` returns the sums of one mini-batch as a flat vector; ``step`` turns them into one
optimiser step; ``state`` and ``restore`` carry parameters and moments between tasks and driver. Learners are
small: row weights, a bias, quantiser scales and, where asked for, one matrix.
"""

from __future__ import annotations

import math
from copy import deepcopy
from dataclasses import replace

import numpy as np
import pyarrow as pa

from probewise.config import HammingSettings, Optimiser, ProjectedSettings, Projection
from probewise.functions.kernels import as_matrix, signs
from probewise.operators.projection import row_span_projection
from probewise.operators.scoring import HammingModel, ProjectedModel, qrange


class AdamW:
    """Adam with decoupled weight decay over named arrays."""

    def __init__(self, rates: dict[str, Optimiser]):
        self.rates = rates
        self.state: dict[str, tuple[np.ndarray, np.ndarray, int]] = {}

    def update(self, params: dict[str, np.ndarray], gradients: dict[str, np.ndarray]) -> None:
        for name, gradient in gradients.items():
            lr, decay = self.rates[name].rate, self.rates[name].decay
            first, second, t = self.state.get(name, (0.0, 0.0, 0))
            first = 0.9 * first + 0.1 * gradient
            second = 0.999 * second + 0.001 * gradient * gradient
            t += 1
            self.state[name] = (first, second, t)
            move = (first / (1 - 0.9 ** t)) / (np.sqrt(second / (1 - 0.999 ** t)) + 1e-8)
            params[name] = params[name] * (1.0 - lr * decay) - lr * move


def _sigmoid(t: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * t))


def _softplus(t: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, t)


def _labels(columns: dict[str, pa.Array]) -> np.ndarray:
    return columns["y"].to_numpy(zero_copy_only=False).astype(np.float64)


def _loss(logits: np.ndarray, y: np.ndarray, pos_weight: float) -> tuple[float, np.ndarray]:
    """Summed weighted logistic loss and its derivative by logit."""
    loss = pos_weight * y * _softplus(-logits) + (1.0 - y) * _softplus(logits)
    return float(loss.sum()), _sigmoid(logits) * (1.0 - y + pos_weight * y) - pos_weight * y


class Learner:
    """Common part: parameters, their optimiser and the state to report."""

    params: dict[str, np.ndarray]
    optimizer: AdamW
    slots: int
    width: int  # numbers of a training row

    def batch_sums(self, columns: dict[str, pa.Array]) -> np.ndarray:
        raise NotImplementedError

    def step(self, sums: np.ndarray) -> float:
        raise NotImplementedError

    def model(self):
        raise NotImplementedError

    def snapshot(self):
        return self.model()

    def report(self) -> dict[str, float]:
        return {}

    def frozen(self) -> "Learner":
        """A copy to send to tasks, without the optimiser's moments."""
        return self._copied("optimizer")

    def slim(self) -> "Learner":
        """A copy that can train and score derived columns, without what only deriving them needs."""
        return self._copied()

    def _copied(self, *without: str) -> "Learner":
        other = object.__new__(type(self))
        other.__dict__.update(deepcopy({k: v for k, v in self.__dict__.items() if k not in without}))
        return other

    def whole_model(self, snapshot):
        """The model to use elsewhere, from a snapshot of this learner or of a slim copy."""
        return snapshot

    def state(self) -> np.ndarray:
        """Parameters and the optimiser's moments as one vector."""
        parts = []
        for name, value in self.params.items():
            first, second, t = self.optimizer.state.get(name, (0.0, 0.0, 0))
            parts += [value.ravel(), np.broadcast_to(first, value.shape).ravel(), np.broadcast_to(second, value.shape).ravel(), [float(t)]]
        return np.concatenate(parts)

    def restore(self, state: np.ndarray) -> None:
        at = 0
        for name, value in self.params.items():
            size = value.size
            found = [state[at + i * size:at + (i + 1) * size].reshape(value.shape).copy() for i in range(3)]
            self.params[name] = found[0]
            self.optimizer.state[name] = (found[1], found[2], float(state[at + 3 * size]))
            at += 3 * size + 1


class HammingReadout(Learner):
    """Row weights and bias over fixed sign codes; batches carry the similarities."""

    def __init__(self, rows: np.ndarray, settings: HammingSettings, pos_weight: float):
        self.rows, self.pos_weight = rows, pos_weight
        k = len(rows)
        self.params = {"raw": np.full(k, math.log(math.expm1(1.0))), "bias": np.zeros(1)}
        self.optimizer = AdamW({n: settings.readout for n in self.params})
        self.slots, self.width = k + 3, k

    @property
    def alphas(self) -> np.ndarray:
        return _softplus(self.params["raw"]) + 1e-6

    def features(self, x: np.ndarray) -> np.ndarray:
        return HammingModel(self.rows).matches(x)

    def batch_sums(self, columns):
        v, y = as_matrix(columns["v"]), _labels(columns)
        weighted = v * self.alphas
        best = weighted.argmax(axis=1)
        at = np.arange(len(best))
        loss, error = _loss(weighted[at, best] + self.params["bias"][0], y, self.pos_weight)
        by_row = np.bincount(best, error * v[at, best], len(self.rows))
        return np.concatenate([by_row, [error.sum(), loss, len(y)]])

    def step(self, sums):
        k, n = len(self.rows), sums[-1]
        self.optimizer.update(self.params, {
            "raw": sums[:k] / n * _sigmoid(self.params["raw"]), "bias": sums[k:k + 1] / n})
        return sums[k + 1] / n

    def model(self) -> HammingModel:
        return HammingModel(self.rows, self.alphas, float(self.params["bias"][0]), weighted=True)

    def slim(self):
        other = self._copied("rows")
        other.rows = np.ones((len(self.rows), 1))  # similarities are in the columns
        return other

    def whole_model(self, snapshot: HammingModel) -> HammingModel:
        return HammingModel(self.rows, snapshot.alphas, snapshot.bias, weighted=True)

    def feature_scores(self, model: HammingModel, v: np.ndarray) -> np.ndarray:
        return (v * model.alphas).max(axis=1) + model.bias


class HashMatrixLearner(HammingReadout):
    """Adds a square hash matrix, trained through a smooth stand-in for the sign."""

    def __init__(self, rows: np.ndarray, settings: HammingSettings, pos_weight: float):
        super().__init__(rows, settings, pos_weight)
        self.settings = settings
        d, k = rows.shape[1], len(rows)
        self.params["matrix"] = np.eye(d)
        self.weighted = settings.weighted
        if not self.weighted:
            del self.params["raw"]
        self.optimizer = AdamW({n: settings.readout for n in self.params} | {"matrix": settings.matrix})
        self.parts = [("row", k), ("bias", 1), ("loss", 1), ("n", 1), ("code", d),
                      ("row_code", k * d), ("matrix", d * d), ("balance", d * d)]
        self.slots, self.width = sum(size for _, size in self.parts), d
        self.penalties = (0.0, 0.0)

    @property
    def alphas(self):
        return super().alphas if self.weighted else np.ones(len(self.rows))

    def slim(self):
        return self._copied()

    def whole_model(self, snapshot: HammingModel) -> HammingModel:
        return snapshot

    def _encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hard codes and the slope of the smooth stand-in."""
        z = x @ self.params["matrix"].T
        width = self.settings.softness * np.maximum(np.abs(z).mean(axis=1, keepdims=True), 1e-6)
        return signs(z), (1.0 - np.tanh(z / width) ** 2) / width

    def batch_sums(self, columns):
        x, y = as_matrix(columns["x"]), _labels(columns)
        d, k = self.rows.shape[1], len(self.rows)
        codes, slope = self._encode(x)
        row_codes, _ = self._encode(self.rows)
        alphas = self.alphas
        similarity = codes @ row_codes.T / d
        weighted = similarity * alphas
        best = weighted.argmax(axis=1)
        at = np.arange(len(best))
        loss, error = _loss(weighted[at, best] + self.params["bias"][0], y, self.pos_weight)
        pull = (error * alphas[best])[:, None] / d
        by_row_code = np.zeros((k, d))
        np.add.at(by_row_code, best, pull * codes)
        by_matrix = (pull * row_codes[best] * slope).T @ x
        return np.concatenate([
            np.bincount(best, error * similarity[at, best], k), [error.sum(), loss, len(y)],
            codes.sum(axis=0), by_row_code.ravel(), by_matrix.ravel(), (slope.T @ x).ravel()])

    def step(self, sums):
        d, k = self.rows.shape[1], len(self.rows)
        ends = np.cumsum([size for _, size in self.parts])[:-1]
        part = dict(zip((name for name, _ in self.parts), np.split(sums, ends)))
        n = part["n"][0]
        weight = self.params["matrix"]
        mean_code = part["code"] / n
        identity = (np.square(weight).sum() - 2.0 * np.trace(weight) + d) / (d * d)
        balance = float(np.square(mean_code).mean())
        self.penalties = (float(identity), balance)
        _, row_slope = self._encode(self.rows)
        gradient = part["matrix"].reshape(d, d) / n
        gradient += (part["row_code"].reshape(k, d) / n * row_slope).T @ self.rows
        gradient += self.settings.penalties.identity * (2.0 * weight - 2.0 * np.eye(d)) / (d * d)
        gradient += self.settings.penalties.balance * 2.0 / (d * n) * mean_code[:, None] * part["balance"].reshape(d, d)
        gradients = {"matrix": gradient, "bias": part["bias"] / n}
        if self.weighted:
            gradients["raw"] = part["row"] / n * _sigmoid(self.params["raw"])
        self.optimizer.update(self.params, gradients)
        return float(part["loss"][0] / n + self.settings.penalties.identity * identity
                     + self.settings.penalties.balance * balance)

    def report(self):
        return {"identity_penalty": self.penalties[0], "bit_balance_penalty": self.penalties[1]}

    def model(self):
        return HammingModel(self.rows, self.alphas, float(self.params["bias"][0]),
                            self.params["matrix"].copy(), method="learned_matrix", weighted=self.weighted)

    def feature_scores(self, model, v):
        return model.scores(v)


class ProjectedReadout(Learner):
    """Row weights, bias and two quantiser scales; batches carry projected vectors."""

    def __init__(self, rows: np.ndarray, settings: ProjectedSettings):
        unit = rows / (np.linalg.norm(rows, axis=1, keepdims=True) + 1e-8)
        self.settings = settings
        projection, self.metadata = None, {"method": "none", "uses_labels": False}
        if settings.projection is not None:
            projection, self.metadata = self._first_projection(rows, settings.projection)
        quantiser = settings.quantiser
        self.base = ProjectedModel(
            unit, projection, quantize=quantiser.on, bits=quantiser.bits, signed=quantiser.signed,
            act_scale=quantiser.start, row_scale=quantiser.start,
            normalize=self.normalised, eval_mode=settings.distance)
        k = len(rows)
        self.params = {
            "raw": np.zeros(k), "bias": np.zeros(1),
            "act": np.array([math.log(max(self.base.act_scale, quantiser.floor))]),
            "row": np.array([math.log(max(self.base.row_scale, quantiser.floor))])}
        self.optimizer = AdamW({n: settings.optimiser for n in self.params})
        self.parts = [("raw", k), ("bias", 1), ("act", 1), ("row", 1), ("loss", 1), ("n", 1)]
        self.slots, self.width = sum(size for _, size in self.parts), unit.shape[1] if projection is None else len(projection)
        self.learned = False

    @staticmethod
    def _first_projection(rows, wanted: Projection):
        if wanted.method != "row_subspace":
            raise ValueError(f"a projection is row_subspace or learned, not {wanted.method!r}")
        weight, coverage = row_span_projection(rows, wanted.dim, wanted.seed, wanted.tolerance, wanted.complete)
        return weight, {"method": wanted.method, "uses_labels": False, **coverage.columns()}

    @property
    def normalised(self) -> bool:
        return self.settings.projection is not None and self.settings.projection.normalise

    @property
    def quantized(self) -> bool:
        return self.settings.quantiser.on and self.settings.quantiser.bits < 32

    def features(self, x: np.ndarray) -> np.ndarray:
        return self.base.project(x)

    def slim(self):
        other = self._copied("base")
        other.base = replace(self.base, rows=self.features(self.base.rows), projection=None, normalize=False)
        return other

    def snapshot(self) -> ProjectedModel:
        return self.slim().model()

    def whole_model(self, snapshot: ProjectedModel) -> ProjectedModel:
        return replace(self.base, alphas=snapshot.alphas, bias=snapshot.bias,
                       act_scale=snapshot.act_scale, row_scale=snapshot.row_scale)

    def _scales(self) -> tuple[float, float]:
        return tuple(max(float(np.exp(self.params[n][0])), self.settings.quantiser.floor) for n in ("act", "row"))

    def _encode(self, z: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Levels, their derivative by the scale, and where the quantiser is not clipped."""
        if not self.quantized:
            return z, np.zeros_like(z), np.ones_like(z)
        low, high = qrange(self.settings.quantiser.bits, self.settings.quantiser.signed)
        ratio = z / scale
        levels = np.clip(np.rint(ratio), low, high)
        inside = (ratio >= low) & (ratio <= high)
        return levels, np.where(inside, levels - ratio, levels), inside.astype(np.float64)

    def _forward(self, z: np.ndarray, y: np.ndarray):
        act, row = self._scales()
        row_z = self.features(self.base.rows)
        q, q_slope, inside = self._encode(z, act)
        r, r_slope, row_inside = self._encode(row_z, row)
        steps = act * row if self.quantized else 1.0
        alphas = _softplus(self.params["raw"])
        dots = (q @ r.T) * steps
        weighted = dots * alphas
        best = weighted.argmax(axis=1)
        at = np.arange(len(best))
        loss, error = _loss(weighted[at, best] + self.params["bias"][0], y, 1.0)
        pull = error * alphas[best]
        q_out, r_out = (q * act, r * row) if self.quantized else (q, r)
        sums = [np.bincount(best, error * dots[at, best], len(r)), [error.sum()],
                [(pull * (q_slope * r_out[best]).sum(axis=1)).sum()],
                [(pull * (q_out * r_slope[best]).sum(axis=1)).sum()], [loss], [len(y)]]
        return np.concatenate(sums), (best, pull, q_out, r_out, inside, row_inside, row_z)

    def batch_sums(self, columns):
        return self._forward(as_matrix(columns["v"]), _labels(columns))[0]

    def _split(self, sums: np.ndarray) -> dict[str, np.ndarray]:
        ends = np.cumsum([size for _, size in self.parts])[:-1]
        return dict(zip((name for name, _ in self.parts), np.split(sums, ends)))

    def _gradients(self, part: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        n = part["n"][0]
        gradients = {"raw": part["raw"] / n * _sigmoid(self.params["raw"]), "bias": part["bias"] / n}
        if self.quantized:
            high = max(abs(qrange(self.settings.quantiser.bits, self.settings.quantiser.signed)[1]), 1)
            rows = self.base.rows
            dim = rows.shape[1] if self.base.projection is None else len(self.base.projection)
            act, row = self._scales()
            batch = min(self.settings.schedule.batch, n)
            for name, count, scale in (("act", batch * dim, act), ("row", len(rows) * dim, row)):
                above = np.exp(self.params[name][0]) > self.settings.quantiser.floor
                gradients[name] = part[name] / n / math.sqrt(max(count * high, 1)) * scale * above
        return gradients

    def step(self, sums):
        part = self._split(sums)
        self.optimizer.update(self.params, self._gradients(part))
        return float(part["loss"][0] / part["n"][0])

    def report(self):
        act, row = self._scales()
        return {"act_scale": act, "row_scale": row}

    def model(self) -> ProjectedModel:
        model = deepcopy(self.base)
        model.alphas, model.bias = _softplus(self.params["raw"]), float(self.params["bias"][0])
        model.act_scale, model.row_scale = self._scales()
        return model

    def feature_scores(self, model: ProjectedModel, v: np.ndarray) -> np.ndarray:
        return (model.dots(v) * model.alphas).max(axis=1) + model.bias


class LearnedProjection(ProjectedReadout):
    """Also trains the projection; batches carry the vectors themselves."""

    def __init__(self, rows: np.ndarray, settings: ProjectedSettings):
        super().__init__(rows, settings)
        p, d = self.base.projection.shape
        self.params["projection"] = self.base.projection
        self.optimizer.rates["projection"] = settings.optimiser
        self.parts += [("rows", len(rows) * p), ("projection", p * d)]
        self.slots += len(rows) * p + p * d
        self.learned, self.width = True, d

    @staticmethod
    def _first_projection(rows, wanted: Projection):
        """Random orthonormal rows."""
        noise = np.random.default_rng(wanted.seed).normal(size=(rows.shape[1], wanted.dim))
        if noise.shape[0] >= noise.shape[1]:
            q, r = np.linalg.qr(noise)
            weight = (q * np.sign(np.diag(r))).T
        else:
            q, r = np.linalg.qr(noise.T)
            weight = q * np.sign(np.diag(r))
        return weight, {"method": wanted.method, "uses_labels": True}

    def slim(self):
        return self._copied()

    def snapshot(self) -> ProjectedModel:
        return self.model()

    def whole_model(self, snapshot: ProjectedModel) -> ProjectedModel:
        return snapshot

    def _through_norm(self, raw: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        if not self.normalised:
            return gradient
        length = np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-12)
        unit = raw / length
        return (gradient - unit * (unit * gradient).sum(axis=1, keepdims=True)) / length

    def batch_sums(self, columns):
        x, y = as_matrix(columns["x"]), _labels(columns)
        sums, (best, pull, q_out, r_out, inside, _, _) = self._forward(self.features(x), y)
        by_row = np.zeros(r_out.shape)
        np.add.at(by_row, best, pull[:, None] * q_out)
        by_z = self._through_norm(x @ self.base.projection.T, pull[:, None] * r_out[best] * inside)
        return np.concatenate([sums, by_row.ravel(), (by_z.T @ x).ravel()])

    def step(self, sums):
        part = self._split(sums)
        n = part["n"][0]
        p, d = self.base.projection.shape
        gradients = self._gradients(part)
        row_z = self.features(self.base.rows)
        row_inside = self._encode(row_z, self._scales()[1])[2]
        by_row = part["rows"].reshape(len(row_z), p) / n * row_inside
        by_row = self._through_norm(self.base.rows @ self.base.projection.T, by_row)
        gradients["projection"] = part["projection"].reshape(p, d) / n + by_row.T @ self.base.rows
        self.optimizer.update(self.params, gradients)
        self.base.projection = self.params["projection"]
        return float(part["loss"][0] / n)

    def feature_scores(self, model, v):
        return model.scores(v)
