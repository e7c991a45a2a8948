"""Training loops: one job trains all scopes for an epoch."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from probewise.config import Optimiser
from probewise.functions.kernels import as_list_column, as_matrix
from probewise.operators import curve
from probewise.operators.learners import Learner
from probewise.operators.partials import totals_by_scope, vectors_in_blocks
from probewise.schemas import PARTIAL_SUMS

PART_BYTES = 32 << 20   # derived columns of the rows that one task trains on by itself
CELL_BYTES = 256 << 10  # numbers of training rows that are packed into one
BATCH_CELLS = 16        # of these in an Arrow batch
MOST_UNITS = 8          # parts, or scopes of parts, that one task trains on in turn
PACKED = "part int, scope_id int, n int, width int, y binary, deal binary, rows binary"
PACKED_NAMES = ["part", "scope_id", "n", "width", "y", "deal", "rows"]
SCORE_COUNTS = "model_id int, snapshot int, group_id int, score double, pos long, neg long"


def scope_features(rows: DataFrame, features: dict[int, Callable[[np.ndarray], np.ndarray]],
                   whole: tuple[int, ...] = (0,)) -> DataFrame:
    """(scope_id, split, example_id, y, v): each row once per scope it belongs to.

    ``rows`` holds (scope_id of the domain, split, example_id, y, x); the scopes in ``whole`` take all rows.
    """

    def derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("scope_id").to_numpy(zero_copy_only=False)
            for scope_id in sorted((set(whole) | set(np.unique(ids).tolist())) & set(features)):
                part = batch if scope_id in whole else batch.take(pa.array(np.flatnonzero(ids == scope_id)))
                v = features[scope_id](as_matrix(part.column("x")))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(part.num_rows, scope_id, dtype=np.int32)), part.column("split"),
                     part.column("example_id"), part.column("y"), as_list_column(v)],
                    ["scope_id", "split", "example_id", "y", "v"])

    slim = rows.select("scope_id", "split", "example_id", "y", "x")
    return slim.mapInArrow(derive, "scope_id int, split string, example_id long, y int, v array<double>")


def count_model_scores(rows: DataFrame, scorers: dict[tuple[int, int], Callable[[np.ndarray], np.ndarray]],
                       own_scope: bool, column: str, whole: tuple[int, ...] = ()) -> DataFrame:
    """Distinct scores with class counts per (model_id, snapshot, group_id).

    With ``own_scope`` a model only scores rows of its own scope (all rows for the
    models in ``whole``); otherwise every model scores every row, grouped by scope. Batches are counted
    before they leave the task, and Spark adds the counts.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("scope_id").to_numpy(zero_copy_only=False)
            y = batch.column("y").to_numpy(zero_copy_only=False)
            values = batch.column(column)
            shared = None if own_scope and not whole else as_matrix(values)
            for (model_id, snapshot), scorer in scorers.items():
                if own_scope:
                    here = (np.arange(len(ids)) if model_id in whole
                            else np.flatnonzero(ids == model_id))
                    if not len(here):
                        continue
                    part = shared[here] if shared is not None else as_matrix(values.take(pa.array(here)))
                    groups, labels = np.full(len(here), model_id), y[here]
                else:
                    part, groups, labels = shared, ids, y
                scores = scorer(part) + 0.0
                for group in np.unique(groups):
                    mine = groups == group
                    distinct, slot = np.unique(scores[mine], return_inverse=True)
                    pos = np.bincount(slot, labels[mine] == 1, len(distinct)).astype(np.int64)
                    neg = np.bincount(slot, labels[mine] == 0, len(distinct)).astype(np.int64)
                    n = len(distinct)
                    yield pa.RecordBatch.from_pydict({
                        "model_id": np.full(n, model_id, np.int32), "snapshot": np.full(n, snapshot, np.int32),
                        "group_id": np.full(n, group, np.int32), "score": distinct, "pos": pos, "neg": neg})

    slim = rows.select("scope_id", "y", column)
    return slim.mapInArrow(count, SCORE_COUNTS).groupBy("model_id", "snapshot", "group_id", "score").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


@dataclass
class Progress:
    """What one scope has reached so far."""

    history: list[dict] = field(default_factory=list)
    best_auroc: float = -np.inf
    best: object | None = None
    misses: int = 0
    stopped: bool = False


def _number(salt: str, digits: int) -> Column:
    """A number in [0, 1) from ``example_id``."""
    text = F.substring(F.md5(F.concat(F.lit(f"{salt}|"), F.col("example_id").cast("string"))), 1, digits)
    return F.conv(text, 16, 10).cast("double") / float(16 ** digits)


def part_count(rows: int, width: int) -> int:
    """Parts of about ``PART_BYTES``: their number grows with the data, and small data are one."""
    return max(1, -(-rows * width * 8 // PART_BYTES))


def parted(train: DataFrame, count: int, apart: tuple[int, ...] = ()) -> DataFrame:
    """``train`` (scope_id, example_id, y, v or x) dealt to ``count`` parts, packed as a pass reads it again and again.

    A part is what a task trains on by itself in a pass. Scopes train independently, so the rows of a scope in ``apart`` may lie in
    another task than the rest of their part. There are as many tasks as cores, but none holds more than ``MOST_UNITS`` of such units, one
    after the other: starting a Python task costs more than a small part's training. A packed row (part, scope_id, n, width, y, deal, rows) holds up to ``CELL_BYTES`` of rows of one part and scope, in
    order of ``deal``, with the numbers as bytes, which pass between JVM and Python in one piece.
    """
    column = "x" if "x" in train.columns else "v"
    place = F.coalesce(F.array_position(F.array(*[F.lit(int(s)) for s in apart]), F.col("scope_id")), F.lit(0)) if apart else F.lit(0)
    units = count * (1 + len(apart))
    tasks = max(min(units, train.sparkSession.sparkContext.defaultParallelism), -(-units // MOST_UNITS))
    dealt = train.select("scope_id", "y", column, F.floor(_number("part", 13) * count).cast("int").alias("part"), _number("deal", 13).alias("deal"))
    sorted_rows = dealt.repartitionById(tasks, F.pmod(F.col("part") * (1 + len(apart)) + place, F.lit(tasks)).cast("int")).sortWithinPartitions("part", "scope_id", "deal")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parts, ids, deal = (batch.column(c).to_numpy() for c in ("part", "scope_id", "deal"))
            y = batch.column("y").to_numpy(zero_copy_only=False).astype(np.float64)
            starts = np.flatnonzero((np.diff(parts, prepend=parts[0] - 1) != 0) | (np.diff(ids, prepend=ids[0] - 1) != 0))
            cells = []
            for low, high in zip(starts, np.append(starts[1:], len(ids))):  # scopes may differ in width
                values = batch.column(column).slice(low, high - low)
                matrix = as_matrix(values, np.float32 if pa.types.is_float32(values.type.value_type) else np.float64)
                step = max(1, CELL_BYTES // (8 * max(1, matrix.shape[1])))
                for i in range(low, high, step):
                    rows = matrix[i - low:i - low + step]
                    cells.append((parts[i], ids[i], *rows.shape, *(v.tobytes() for v in (y[i:i + len(rows)], deal[i:i + len(rows)], rows))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(values, pa.int32() if i < 4 else pa.binary()) for i, values in enumerate(zip(*cells))], names=PACKED_NAMES)

    return sorted_rows.mapInArrow(pack, PACKED)


def _unpacked(cells: list[dict], column: str) -> dict[str, pa.Array]:
    """The rows of packed rows, one after the other, as columns."""
    def numbers(cell: dict) -> np.ndarray:
        size = len(cell["rows"]) // max(1, cell["n"] * cell["width"])
        return np.frombuffer(cell["rows"], np.float32 if size == 4 else np.float64).reshape(cell["n"], cell["width"])

    y, deal = (pa.array(np.concatenate([np.frombuffer(c[name], np.float64) for c in cells])) for name in ("y", "deal"))
    return {column: as_list_column(np.concatenate([numbers(c) for c in cells])), "y": y, "deal": deal}


def one_pass(learner: Learner, columns: dict[str, pa.Array], start: float, batch: int) -> np.ndarray:
    """Train ``learner`` on all rows once, ``batch`` at a time: (rows, rows x state, sum of losses, steps)."""
    deal = columns["deal"].to_numpy(zero_copy_only=False)
    order, losses = np.argsort((deal - start) % 1.0, kind="stable"), []
    ordered = {name: as_list_column(as_matrix(values)[order]) if pa.types.is_list(values.type) else values.take(pa.array(order))
               for name, values in columns.items()}
    for low in range(0, len(order), batch):
        losses.append(learner.step(learner.batch_sums({name: values.slice(low, batch) for name, values in ordered.items()})))
    return np.concatenate([[len(order)], len(order) * learner.state(), [float(np.sum(losses)), len(losses)]])


def _pass(train: DataFrame, learners: dict[int, Learner], column: str, whole: tuple[int, ...], start: float, batch: int,
          few: bool) -> dict[int, np.ndarray]:
    """Sums of ``one_pass`` over the parts of each scope, in one job."""
    shared = train.sparkSession.sparkContext.broadcast(learners)

    def train_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}

        def add(part: list[dict]) -> None:
            for s, learner in shared.value.items():
                mine = [cell for cell in part if s in whole or cell["scope_id"] == s]
                if mine:
                    found = one_pass(learner.slim(), _unpacked(mine, column), start, batch)
                    totals[s] = totals[s] + found if s in totals else found

        held: list[dict] = []
        for given in batches:
            numbers = [given.column(c) for c in PACKED_NAMES]
            for i in range(given.num_rows):
                cell = {name: values[i].as_buffer() if pa.types.is_binary(values.type) else values[i].as_py()
                        for name, values in zip(PACKED_NAMES, numbers)}
                if held and held[0]["part"] != cell["part"]:
                    add(held)
                    held = []
                held.append(cell)
        if held:
            add(held)
        yield from vectors_in_blocks(totals)

    with _cells_by_batch(train.sparkSession):
        out = totals_by_scope(train.mapInArrow(train_parts, PARTIAL_SUMS), few)
    shared.destroy()
    return out


@contextmanager
def _cells_by_batch(spark: SparkSession) -> Iterator[None]:
    """A packed row stands for many, so that a few of them fill an Arrow batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_CELLS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fit_learners(learners: dict[int, Learner], train: DataFrame, val: DataFrame, epochs: int,
                 eval_every: int = 1, patience: int | None = None, margin: float = 0.0,
                 batch: int = 512, pending: int = 8, column: str = "v",
                 whole: tuple[int, ...] = (), few: bool = True) -> dict[int, Progress]:
    """Train all learners together and keep each one's best validation state.

    An epoch is one job, however many rows and steps it has: every part of ``train`` (``parted``) takes its own mini-batch steps from the state that
    the epoch starts with, and the states they end with are averaged by rows. With one part these are
    just the steps, one after the other. Each epoch starts elsewhere in the order of rows, so batches differ.

    States are scored ``pending`` at a time in one job; the choice of the best
    state and early stopping are then replayed in order, so waiting only costs
    epochs that are thrown away. ``few``: the parts are few enough for the driver to add up.
    """
    progress = {s: Progress() for s in learners}
    waiting: list[tuple[int, dict[int, object], dict[int, dict]]] = []
    for epoch in range(epochs):
        active = {s: learners[s] for s in learners if not progress[s].stopped}
        if not active:
            break
        start = epoch * 0.6180339887498949 % 1.0
        sums = _pass(train, {s: learner.slim() for s, learner in active.items()}, column, whole, start, batch, few)
        losses = {}
        for s, learner in active.items():
            if s in sums:
                learner.restore(sums[s][1:-2] / sums[s][0])
                losses[s] = float(sums[s][-2] / sums[s][-1])
        last = epoch == epochs - 1
        if (epoch + 1) % eval_every and not last:
            continue
        waiting.append((
            epoch + 1, {s: learner.snapshot() for s, learner in active.items()},
            {s: {"loss": losses.get(s), **learner.report()} for s, learner in active.items()}))
        if len(waiting) >= pending or last:
            _replay(waiting, learners, progress, val, patience, margin, column, whole)
            waiting = []
    return progress


def _replay(waiting, learners, progress, val, patience, margin, column, whole) -> None:
    scorers = {}
    for i, (_, models, _) in enumerate(waiting):
        for s, model in models.items():
            scorers[(s, i)] = feature_scorer(learners[s], model)
    counts = count_model_scores(val, scorers, True, column, whole)
    ranked = curve.auroc(counts.select("model_id", "snapshot", "score", "pos", "neg"),
                         ["model_id", "snapshot"], len(scorers)).collect()
    found = {(r["model_id"], r["snapshot"]): r["auroc"] for r in ranked}
    for i, (epoch, models, reports) in enumerate(waiting):
        for s, model in models.items():
            state = progress[s]
            if state.stopped:
                continue
            auroc = found.get((s, i))
            state.history.append({"epoch": epoch, "val_auroc": auroc, **reports[s]})
            if auroc is not None and auroc > state.best_auroc + margin:
                state.best_auroc, state.best, state.misses = auroc, model, 0
            else:
                state.misses += 1
            if patience is not None and state.misses >= patience:
                state.stopped = True
                if state.best is None:
                    state.best = model


def feature_scorer(learner: Learner, model):
    slim = learner.slim()
    return lambda v: slim.feature_scores(model, v)


def final_models(learners: dict[int, Learner], progress: dict[int, Progress]) -> dict[int, object]:
    return {s: learners[s].whole_model(p.best) if p.best is not None else learners[s].model() for s, p in progress.items()}


def bias_from_counts(scores: np.ndarray, pos: np.ndarray, neg: np.ndarray, pos_weight: float,
                     epochs: int, optimiser: Optimiser) -> tuple[np.ndarray, np.ndarray]:
    """Bias and loss after each epoch when only the bias is trained.

    With fixed row weights the winner never changes, so the few distinct scores
    with their class counts hold everything a step needs.
    """
    from probewise.operators.learners import AdamW, _sigmoid, _softplus

    params, optimizer = {"bias": np.zeros(1)}, AdamW({"bias": optimiser})
    n = float(pos.sum() + neg.sum())
    biases, losses = [], []
    for _ in range(epochs):
        logits = scores + params["bias"][0]
        losses.append(float((pos_weight * pos * _softplus(-logits) + neg * _softplus(logits)).sum() / n))
        p = _sigmoid(logits)
        gradient = (neg * p - pos_weight * pos * (1.0 - p)).sum() / n
        optimizer.update(params, {"bias": np.array([gradient])})
        biases.append(float(params["bias"][0]))
    return np.array(biases), np.array(losses)
