"""Reports over scored rows and metric tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F

from probewise.functions import kernels
from probewise.operators import curve
from probewise.operators.probes import ScopeIndex
from probewise.operators.scoring import HammingModel
from probewise.operators.training import count_model_scores
from probewise.workspace import written

HELD_OUT = ("test", "cross_eval")


def scope_names(ids: ScopeIndex, column: str):
    return F.element_at(F.lit(ids.names), F.col(column) + 1)


def auroc_matrix(metrics: DataFrame, scopes: Sequence[str]) -> DataFrame:
    """train_scope x eval_scope AUROC of held-out rows; a repeated pair is an error."""
    held_out = metrics.filter(F.col("split").isin(*HELD_OUT))
    repeated = held_out.groupBy("train_scope", "eval_scope").count().filter("count > 1")
    if not repeated.isEmpty():
        raise ValueError("metrics hold a (train_scope, eval_scope) pair twice")
    return held_out.groupBy("train_scope").pivot("eval_scope", list(scopes)).agg(F.first("auroc"))


def same_domain_report(metrics: DataFrame) -> DataFrame:
    held_out = metrics.filter(F.col("split").isin(*HELD_OUT) & (F.col("train_scope") == F.col("eval_scope")))
    return held_out.select("method", "train_scope", "accuracy", "auroc", "n").orderBy("method", "train_scope")


def ordered_metrics(metrics: DataFrame) -> DataFrame:
    keys = [c for c in ("method", "train_scope", "eval_scope", "split") if c in metrics.columns]
    return metrics.orderBy(*keys)


def metrics_union(*tables: DataFrame) -> DataFrame:
    """One table from families with different columns; missing values are NULL."""
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table, allowMissingColumns=True)
    return out


def own_scope_counts(rows: DataFrame, scopes: ScopeIndex, scorers: dict[str, object]) -> DataFrame:
    """Score counts (scope, score, pos, neg) of each scope's scorer on its own rows."""
    ids = scopes.ids
    indexed = rows if "scope_id" in rows.columns else rows.join(scopes.column(rows.sparkSession), "domain")
    counts = count_model_scores(
        indexed, {(ids[s], 0): scorer for s, scorer in scorers.items()}, True, "x", whole=(0,))
    named = counts.select(scope_names(scopes, "model_id").alias("scope"), "score", "pos", "neg")
    return written(named, "score-counts")


def sanity_report(rows: DataFrame, scopes: ScopeIndex, banks: dict[str, np.ndarray]) -> DataFrame:
    """Best-threshold metrics of the largest cosine per scope, on the rows given."""
    def scorer(bank):
        unit = kernels.unit_rows(bank)
        return lambda x: (kernels.unit_rows(x) @ unit.T).max(axis=1)

    counts = own_scope_counts(rows, scopes, {s: scorer(b) for s, b in banks.items()})
    return sanity_metrics(counts, ["scope"], len(banks))


def sanity_metrics(counts: DataFrame, keys: Sequence[str], groups: int | None = None) -> DataFrame:
    points = curve.score_curve(counts, keys, groups)
    best = curve.sanity_threshold(
        curve.candidate_thresholds(points, keys, curve.GRIDS["sanity"]), keys)
    sizes = counts.groupBy(*keys).agg((F.sum("pos") + F.sum("neg")).alias("n"))
    return best.join(curve.auroc(counts, keys, groups), list(keys)).join(sizes, list(keys))


def sign_hash_report(rows: DataFrame, scopes: ScopeIndex, banks: dict[str, np.ndarray]) -> DataFrame:
    """AUROC of the largest raw sign similarity per scope, on the rows given."""
    counts = own_scope_counts(rows, scopes, {s: HammingModel(b).scores for s, b in banks.items()})
    ranks = curve.auroc(counts, ["scope"], len(banks))
    sizes = counts.groupBy("scope").agg((F.sum("pos") + F.sum("neg")).alias("n"))
    return sizes.join(ranks.withColumnRenamed("auroc", "raw_sign_hash_train_auroc"), "scope")


def cross_scope_metrics(counts: DataFrame, thresholds: DataFrame, eval_ids: Sequence[int],
                        groups: int) -> DataFrame:
    """Metrics per (model_id, eval_id) from counts per (model_id, group_id, score).

    A row counts for its own domain and for all rows together; the scores are
    counted first, so adding the second scope copies counts and not rows.
    """
    spread = counts.withColumn("eval_id", F.explode(F.array(F.lit(0), F.col("group_id"))))
    spread = spread.filter(F.col("eval_id").isin(*[int(i) for i in eval_ids]))
    summed = spread.groupBy("model_id", "eval_id", "score").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    cut = summed.join(F.broadcast(thresholds), "model_id")
    return curve.threshold_metrics(cut, ["model_id", "eval_id"], "threshold", groups)
