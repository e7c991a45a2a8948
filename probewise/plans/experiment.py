"""Train every scope of a classifier family and evaluate it on every other scope."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

from probewise.config import COMBINED, GLOBAL_BANK, ExperimentSettings, Schedule
from probewise.operators import curve, probes, split as splits, training
from probewise.operators.learners import (
    HammingReadout, HashMatrixLearner, Learner, LearnedProjection, ProjectedReadout)
from probewise.operators.partials import FAN
from probewise.operators.probes import ScopeIndex
from probewise.operators.scopes import scopes_of, training_table
from probewise.operators.scoring import HammingModel, ProjectedModel
from probewise.operators.small import local_table
from probewise.plans.evaluate import cross_scope_metrics, metrics_union, scope_names
from probewise.schemas import ALPHA_HISTORY
from probewise.workspace import written


@dataclass
class Prepared:
    """What all classifier families share: split, banks and the tagged rows."""

    rows: DataFrame  # scope_id, domain, example_id, y, split, x; stored by split
    split: DataFrame
    bank: DataFrame
    deployment: DataFrame
    scopes: ScopeIndex
    matrices: dict[str, np.ndarray]
    n_train: dict[tuple[int, str], tuple[int, int]]  # (scope, split) -> (neg, pos)
    left_out: int = 0  # rows without a label of 0 or 1: they are split, but neither trained on nor evaluated

    @property
    def trained(self) -> list[str]:
        """Scopes with a bank, ``combined`` first."""
        return [s for s in self.scopes.names if s == COMBINED or s in self.matrices]


@dataclass
class Results:
    models: dict[tuple[str, str], object]  # (method, scope) -> model
    metrics: DataFrame
    artifact_metrics: DataFrame
    history: DataFrame
    learners: dict[tuple[str, str], Learner]


def prepare(means: DataFrame, settings: ExperimentSettings = ExperimentSettings(),
            tokens: DataFrame | None = None, bank: DataFrame | None = None) -> Prepared:
    """One split, then banks from its training examples, unless ``bank`` is given; tokens follow their example.

    Rows without a domain belong to the scope ``None``; rows without a label are counted and left out.
    """
    def placed(rows: DataFrame) -> DataFrame:
        return rows.withColumn("domain", splits.known(F.col("domain")))

    means = placed(means)
    tokens = None if tokens is None else placed(tokens)
    unique = written(splits.one_row_per_example(means), "examples")
    stratum = splits.stratum_key().alias("stratum")
    rule = splits.split_rule(unique.select("example_id", stratum), settings.split)
    split = rule.tag(unique).select("example_id", "split")
    by_rule = unique.filter("conflict").isEmpty()

    def tagged(rows: DataFrame) -> DataFrame:
        return rule.tag(rows) if by_rule and rows is means else splits.tag_split(rows, split)

    scopes = probes.index_scopes(unique)

    def stored(table: DataFrame, name: str) -> DataFrame:
        indexed = tagged(table).join(scopes.column(means.sparkSession), "domain").select(
            "scope_id", "domain", "example_id", F.col("y").cast("int").alias("y"), "split",
            F.col("x").cast("array<float>").alias("x"))
        return written(indexed.filter(F.col("y").isin(0, 1)), name, by=("split",))

    mean_rows = stored(means, "means")
    if bank is None:
        bank = written(probes.extract_banks(mean_rows.filter(F.col("split") == "train"), settings.probe), "bank")
    source = training_table(means, tokens, settings.train_on)
    rows = mean_rows if source is means else stored(source, "tokens")
    shape = rows.groupBy("scope_id", "split").agg(
        F.sum((F.col("y") == 0).cast("long")).alias("neg"), F.sum((F.col("y") == 1).cast("long")).alias("pos"))
    counts: dict[tuple[int, str], tuple[int, int]] = {}
    for r in shape.collect():
        for s in (r["scope_id"], 0):
            neg, pos = counts.get((s, r["split"]), (0, 0))
            counts[(s, r["split"])] = (neg + r["neg"], pos + r["pos"])
    left_out = source.filter(~F.coalesce(F.col("y").isin(0, 1), F.lit(False))).count()
    return Prepared(rows, split, bank, probes.deployment_bank(bank), scopes,
                    probes.bank_matrices(bank), counts, left_out)


def _usable(prepared: Prepared) -> list[int]:
    ids = prepared.scopes.ids
    return [ids[s] for s in prepared.trained
            if s in prepared.matrices and min(prepared.n_train.get((ids[s], "train"), (0, 0))) > 0]


def _history(spark: SparkSession, progress: dict, names: dict[int, str]) -> DataFrame:
    columns = [f.name for f in ALPHA_HISTORY.fields]
    rows = [tuple({"scope": names[s], **entry}.get(c) for c in columns)
            for s, state in progress.items() for entry in state.history]
    return local_table(spark, rows, ALPHA_HISTORY)


def _thresholds(counts: DataFrame, grid: str, metric: str, groups: int) -> DataFrame:
    points = curve.score_curve(counts, ["model_id"], groups)
    return curve.select_threshold(
        curve.candidate_thresholds(points, ["model_id"], curve.GRIDS[grid]), ["model_id"], metric)


@dataclass
class _Evaluation:
    own: DataFrame  # model_id, split, metric columns: val and test of the model's own scope
    cross: DataFrame  # model_id, eval_id, metric columns
    thresholds: dict[int, float]


@dataclass
class _Validation:
    """Rows the thresholds are chosen on, and how a model scores one of them."""

    rows: DataFrame
    column: str
    whole: tuple[int, ...]
    learners: dict[int, Learner]

    def counts(self, models: dict[int, object]) -> DataFrame:
        scorers = {(s, 0): training.feature_scorer(self.learners[s], m) if s in self.learners else m.scores
                   for s, m in models.items()}
        return training.count_model_scores(self.rows, scorers, True, self.column, self.whole)


def _evaluate(prepared: Prepared, models: dict[int, object], val: _Validation,
              whole: tuple[int, ...], grid: str, metric: str) -> _Evaluation:
    """Thresholds on val, metrics on val and test, every model on every test scope.

    Every test row is scored once for all models; each step after that works on
    counts of distinct scores.
    """
    spark = prepared.rows.sparkSession
    scorers = {(s, 0): model.scores for s, model in models.items()}
    test = prepared.rows.filter(F.col("split") == "test")
    val_counts = written(val.counts(models).select("model_id", "score", "pos", "neg"), "val-counts")
    test_counts = written(training.count_model_scores(test, scorers, False, "x"), "test-counts")
    found = {r["model_id"]: r["threshold"] for r in _thresholds(val_counts, grid, metric, len(models)).collect()}
    chosen = {s: float(found.get(s, 0.0)) for s in models}
    thresholds = local_table(spark, list(chosen.items()), "model_id int, threshold double")
    with_cut = val_counts.join(F.broadcast(thresholds), "model_id")
    on_val = curve.threshold_metrics(with_cut, ["model_id"], "threshold", len(models))
    eval_ids = [prepared.scopes.ids[s] for s in prepared.trained]
    cross = written(cross_scope_metrics(test_counts, thresholds, eval_ids, len(models) * len(eval_ids)), "metrics")
    own_scope = F.when(F.col("model_id").isin(*[int(w) for w in whole]), 0).otherwise(F.col("model_id"))
    on_test = cross.filter(F.col("eval_id") == own_scope).drop("eval_id")
    own = on_val.withColumn("split", F.lit("val")).unionByName(on_test.withColumn("split", F.lit("test")))
    others = cross.filter((F.col("eval_id") != own_scope) & F.col("auroc").isNotNull())
    return _Evaluation(own, others, chosen)


def _sizes(models: dict[int, object], top: int):
    rows = [len(models[i].rows) if i in models else 0 for i in range(top)]
    return F.element_at(F.lit(rows), F.col("model_id") + 1).alias("n_rows")


def run_projected(prepared: Prepared, settings: ExperimentSettings = ExperimentSettings(),
                  train_global_bank: bool = True) -> Results:
    """Projected, quantised winner-take-all classifiers for every scope."""
    cfg, spark = settings.projected, prepared.rows.sparkSession
    ids = prepared.scopes.ids
    usable = _usable(prepared)
    for s in usable:
        for name in splits.SPLITS:
            if not sum(prepared.n_train.get((s, name), (0, 0))):
                raise ValueError(f"scope {prepared.scopes.names[s]} has no rows in {name}")
    learned = cfg.projection is not None and cfg.projection.method in ("learned", "learned_supervised")
    kind = LearnedProjection if learned else ProjectedReadout
    names = {s: prepared.scopes.names[s] for s in usable}
    banks = {s: prepared.matrices[names[s]] for s in usable}
    whole: tuple[int, ...] = (0,)
    if train_global_bank and prepared.matrices and 0 in usable:
        global_id = len(prepared.scopes.names)
        names[global_id] = GLOBAL_BANK
        banks[global_id] = probes.bank_matrices(prepared.deployment)[GLOBAL_BANK]
        whole = (0, global_id)
    learners = {s: kind(rows, cfg) for s, rows in banks.items()}
    progress, val = _fit(prepared, learners, whole, learned, cfg.schedule, pending=50)
    models = training.final_models(learners, progress)
    checked = _evaluate(prepared, models, val, whole, "projected", "f1")
    for s, model in models.items():
        model.threshold = checked.thresholds[s]
    label = F.element_at(F.lit(prepared.scopes.names + [GLOBAL_BANK]), F.col("model_id") + 1)
    common = [
        "n", "precision", "recall", "f1", "accuracy", "auroc", "threshold",
        F.lit(cfg.distance).alias("eval_distance_mode"), F.lit(cfg.quantiser.bits).alias("lsq_bit_precision"),
        F.lit(cfg.projection.dim if cfg.projection else None).cast("int").alias("projection_dim"),
        F.lit(cfg.projection.method if cfg.projection else "none").alias("projection_method"),
        F.lit(bool(cfg.projection and cfg.projection.normalise)).alias("normalize_after_projection"),
        _sizes(models, len(prepared.scopes.names) + 1), F.lit(settings.train_on).alias("train_on")]
    own = checked.own.select(
        label.alias("train_scope"), label.alias("eval_scope"), "split", *common,
        F.lit("shared_example_split").alias("split_source"))
    cross = checked.cross.select(
        label.alias("train_scope"), scope_names(prepared.scopes, "eval_id").alias("eval_scope"),
        F.lit("cross_eval").alias("split"), *common, F.lit("shared_test").alias("source_split"))
    everything = metrics_union(own, cross)
    table = everything.filter(F.col("train_scope") != GLOBAL_BANK)
    named = {("projected", names[s]): m for s, m in models.items()}
    return Results(named, table, own, _history(spark, progress, names),
                   {("projected", names[s]): learner for s, learner in learners.items()})


def _fit(prepared: Prepared, learners: dict[int, Learner], whole, on_vectors: bool, plan: Schedule, **options):
    """Derive each scope's training columns once, then loop over them."""
    rows = prepared.rows.filter(F.col("split").isin("train", "val"))
    if on_vectors:
        table, column, all_rows = rows.select("scope_id", "split", "example_id", "y", "x"), "x", whole
    else:
        features = {s: learner.frozen().features for s, learner in learners.items()}
        table = written(training.scope_features(rows, features, whole), "features", by=("split",))
        column, all_rows = "v", ()
    everyone = sum(sum(prepared.n_train.get((s, "train"), (0, 0))) for s in range(1, len(prepared.scopes.names)))
    taken = everyone * (1 if on_vectors else 1 + len(set(whole) & set(learners)))
    parts = training.part_count(taken, max((learner.width for learner in learners.values()), default=1))
    apart = () if on_vectors else tuple(s for s in whole if s in learners)
    train = training.parted(table.filter(F.col("split") == "train").drop("split"), parts, apart).persist(StorageLevel.MEMORY_AND_DISK)
    val = table.filter(F.col("split") == "val").drop("split")
    kept = val.select("*").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        progress = training.fit_learners(
            learners, train, kept, plan.epochs, plan.score_every, plan.patience, batch=plan.batch, column=column,
            whole=all_rows, few=parts <= FAN, **options)
    finally:
        train.unpersist()
        kept.unpersist()
    return progress, _Validation(val, column, all_rows, learners)


def _fit_bias_only(prepared: Prepared, banks: dict[int, np.ndarray], cfg) -> tuple[dict, dict]:
    """Unweighted sign models: the few distinct similarities hold all that is needed."""
    scorers = {(s, 0): HammingModel(rows).scores for s, rows in banks.items()}
    plan = cfg.sign_schedule

    def counted(name: str) -> dict[int, tuple[np.ndarray, ...]]:
        rows = prepared.rows.filter(F.col("split") == name)
        counts = training.count_model_scores(rows, scorers, True, "x", whole=(0,))
        # At most one count per possible similarity and scope: width + 1 of them.
        table = counts.select("model_id", "score", "pos", "neg").toArrow().to_pandas()
        return {s: tuple(g[c].to_numpy() for c in ("score", "pos", "neg")) for s, g in table.groupby("model_id")}

    train, val = counted("train"), counted("val")
    models, progress = {}, {}
    for s, rows in banks.items():
        neg, pos = prepared.n_train[(s, "train")]
        biases, losses = training.bias_from_counts(
            *train[s], max(neg, 1) / max(pos, 1), plan.epochs, cfg.readout)
        score, p, n = val.get(s, (np.zeros(0), np.zeros(0), np.zeros(0)))
        order = np.argsort(score)
        p, n = p[order], n[order]
        pairs = float(p.sum()) * float(n.sum())
        auroc = float((p * (np.cumsum(n) - n / 2.0)).sum() / pairs) if pairs else None
        state = training.Progress()
        for epoch in range(plan.epochs):
            if (epoch + 1) % plan.score_every and epoch < plan.epochs - 1:
                continue
            state.history.append({"epoch": epoch + 1, "loss": float(losses[epoch]), "val_auroc": auroc,
                                  "identity_penalty": 0.0, "bit_balance_penalty": 0.0})
            model = HammingModel(rows, bias=float(biases[epoch]))
            if auroc is not None and auroc > state.best_auroc + 1e-5:
                state.best_auroc, state.best, state.misses = auroc, model, 0
            else:
                state.misses += 1
            if state.misses >= plan.patience:
                break
        models[s] = state.best or model
        progress[s] = state
    return models, progress


def run_hamming(prepared: Prepared, settings: ExperimentSettings = ExperimentSettings()) -> Results:
    """Binary-code winner-take-all classifiers: methods x scopes."""
    cfg, spark = settings.hamming, prepared.rows.sparkSession
    usable = _usable(prepared)
    names = {s: prepared.scopes.names[s] for s in usable}
    banks = {s: prepared.matrices[names[s]] for s in usable}
    pos_weight = {s: max(neg, 1) / max(pos, 1)
                  for s in usable for neg, pos in [prepared.n_train[(s, "train")]]}
    metrics, histories, all_models, all_learners = [], [], {}, {}
    for method in cfg.methods:
        learners: dict[int, Learner] = {}
        if method == "sign" and not cfg.weighted:
            models, progress = _fit_bias_only(prepared, banks, cfg)
            val = _Validation(prepared.rows.filter(F.col("split") == "val"), "x", (0,), {})
        elif method in ("sign", "learned_matrix"):
            matrix = method == "learned_matrix"
            plan = cfg.matrix_schedule if matrix else cfg.sign_schedule
            kind = HashMatrixLearner if matrix else HammingReadout
            learners = {s: kind(rows, cfg, pos_weight[s]) for s, rows in banks.items()}
            progress, val = _fit(
                prepared, learners, (0,), matrix, plan, margin=1e-5, pending=plan.patience or 8)
            models = training.final_models(learners, progress)
        else:
            raise ValueError(f"no Hamming method is called {method!r}")
        checked = _evaluate(prepared, models, val, (0,), "hamming", cfg.threshold_metric)
        for s, model in models.items():
            model.threshold = checked.thresholds[s]
        label = scope_names(prepared.scopes, "model_id")
        common = ["accuracy", "precision", "recall", "f1", "auroc", "threshold", "n",
                  F.lit(method).alias("method"), F.lit(cfg.weighted).alias("weighted_rows"),
                  _sizes(models, len(prepared.scopes.names)), F.lit(settings.train_on).alias("train_on")]
        own = checked.own.select(
            label.alias("train_scope"), label.alias("eval_scope"), "split",
            F.concat(F.lit("shared_"), F.col("split")).alias("source_split"), *common)
        cross = checked.cross.select(
            label.alias("train_scope"), scope_names(prepared.scopes, "eval_id").alias("eval_scope"),
            F.lit("cross_eval").alias("split"), F.lit("shared_test").alias("source_split"), *common)
        metrics.append(own.unionByName(cross))
        histories.append(_history(spark, progress, names).withColumn("method", F.lit(method)))
        all_models.update({(method, names[s]): m for s, m in models.items()})
        all_learners.update({(method, names[s]): learner for s, learner in learners.items()})
    table = metrics_union(*metrics)
    own_rows = table.filter(F.col("split") != "cross_eval")
    return Results(all_models, table, own_rows, metrics_union(*histories), all_learners)


def run_all(means: DataFrame, settings: ExperimentSettings = ExperimentSettings(),
            tokens: DataFrame | None = None) -> dict[str, Results]:
    """All three families from one preparation."""
    from dataclasses import replace

    prepared = prepare(means, settings, tokens)
    weighted = replace(settings, hamming=replace(settings.hamming, weighted=True))
    unweighted = replace(settings, hamming=replace(settings.hamming, weighted=False))
    return {
        "projected": run_projected(prepared, settings),
        "hamming_weighted": run_hamming(prepared, weighted),
        "hamming_unweighted": run_hamming(prepared, unweighted),
    }


def _nested(matrix: np.ndarray | None) -> list[list[float]]:
    return [] if matrix is None else [[float(v) for v in row] for row in matrix]


def projected_artifacts(prepared: Prepared, results: Results) -> DataFrame:
    """One row per trained scope with everything needed to deploy it."""
    rows = []
    for (_, scope), model in results.models.items():
        learner: ProjectedModel | Learner = results.learners[("projected", scope)]
        baked, constant = model.baked(True)
        low, high = _levels(model)
        projected = model.encoded_rows(False)
        rows.append((
            scope, _nested(model.rows), _nested(model.projection), _nested(projected),
            _nested(model.encoded_rows(True)), _nested(baked), constant,
            [float(a) for a in model.alphas], float(model.bias), float(model.threshold),
            model.projection is not None, int(projected.shape[1]), learner.metadata["method"],
            json.dumps(learner.metadata), model.normalize, model.quantize, model.bits, model.signed,
            low, high, float(model.act_scale), float(model.row_scale), model.eval_mode,
            "shared_example_split"))
    return local_table(prepared.rows.sparkSession, rows, (
        "scope string, rows array<array<double>>, projection_weight array<array<double>>, "
        "rows_projected array<array<double>>, rows_projected_quantized array<array<double>>, "
        "euclidean_baked_rows array<array<double>>, euclidean_constant double, alphas array<double>, "
        "bias double, threshold double, use_projection boolean, projection_dim int, "
        "projection_method string, projection_metadata string, normalize_after_projection boolean, "
        "use_lsq_qat boolean, lsq_bit_precision int, lsq_signed boolean, qmin int, qmax int, "
        "act_scale double, row_scale double, eval_distance_mode string, split_source string"))


def _levels(model: ProjectedModel) -> tuple[int, int]:
    from probewise.operators.scoring import qrange
    low, high = qrange(min(model.bits, 31), model.signed)
    return int(low), int(high)


def hamming_artifacts(prepared: Prepared, results: Results, save_matrices: bool = False) -> DataFrame:
    """One row per method and scope with codes, weights, bias and threshold."""
    reached = {(r["method"], r["scope"]): r["best"] for r in results.history.groupBy("method", "scope").agg(
        F.max("val_auroc").alias("best")).collect()}
    return hamming_rows(prepared.rows.sparkSession, results.models, reached, save_matrices)


def hamming_rows(spark: SparkSession, models: dict[tuple[str, str], HammingModel], reached: dict[tuple[str, str], float] | None = None,
                 save_matrices: bool = False) -> DataFrame:
    """Models by (method, scope) in the columns of a saved artifact."""
    rows = [(
        method, bool(model.weighted), scope, _nested(model.rows),
        [[int(c) for c in row] for row in model.row_codes], [float(a) for a in model.alphas],
        float(model.bias), float(model.threshold), (reached or {}).get((method, scope)), int(model.rows.shape[1]),
        _nested(model.matrix) if save_matrices and method == "learned_matrix" else None)
        for (method, scope), model in models.items()]
    return local_table(spark, rows, (
        "method string, weighted_rows boolean, scope string, rows array<array<double>>, "
        "binary_codes array<array<tinyint>>, alphas array<double>, bias double, threshold double, "
        "best_val_auroc double, code_length int, hash_matrix array<array<double>>"))


def artifact_examples(rows: DataFrame, trained: list[str]) -> DataFrame:
    """Distinct example ids per (scope, split) of the trained scopes."""
    table = rows.select("example_id", "split", F.explode(scopes_of()).alias("scope"))
    return table.filter(F.col("scope").isin(*trained)).distinct()
