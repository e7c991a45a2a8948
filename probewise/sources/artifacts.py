"""Saving trained classifiers and their metrics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from probewise.config import GLOBAL_BANK
from probewise.functions.kernels import bounded_rows
from probewise.operators.scoring import HammingModel, ProjectedModel
from probewise.plans.experiment import Prepared, Results, artifact_examples, hamming_artifacts, projected_artifacts


def artifact_name(layer: int, mode: str) -> Column:
    """File-like name from scope, layer, mode, projection width, bits and eval mode."""
    label = F.when(F.col("scope") == GLOBAL_BANK, "GLOBAL_all_rows").otherwise(F.col("scope"))
    return F.format_string("wta_%s_L%d_%s_proj%d_lsq%dbit_%s", label, F.lit(layer), F.lit(mode),
                           "projection_dim", "lsq_bit_precision", "eval_distance_mode")


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Metrics as one CSV file with a header; the table has a row per pair of scopes."""
    metrics.coalesce(1).write.option("header", True).csv(path)


def save_projected(prepared: Prepared, results: Results, path: str, layer: int = 33,
                   mode: str = "post_layer") -> None:
    models = projected_artifacts(prepared, results).withColumn("artifact", artifact_name(layer, mode))
    models.write.partitionBy("scope").parquet(f"{path}/wta_model")
    _save_shared(prepared, results, path)


def save_hamming(prepared: Prepared, results: Results, path: str, save_matrices: bool = False) -> None:
    save_models(hamming_artifacts(prepared, results, save_matrices), path)
    _save_shared(prepared, results, path)


def save_models(models: DataFrame, path: str) -> None:
    models.write.partitionBy("method", "weighted_rows", "scope").parquet(f"{path}/wta_model")


def _matrix(values: list | None) -> np.ndarray | None:
    return np.array(values, dtype=np.float64) if values else None


def load_hamming(spark: SparkSession, path: str, *scopes: str) -> dict[tuple[str, str], HammingModel]:
    """Models by (method, scope) as ``save_hamming`` wrote them, of all scopes or those named.

    A learned hash matrix must have been saved with the models, or their codes cannot be formed: that is an error.
    """
    models = {}
    for r in _saved(spark, path, scopes):
        matrix = _matrix(r["hash_matrix"])
        if r["method"] == "learned_matrix" and matrix is None:
            raise ValueError(f"the hash matrix of {r['scope']} was not saved")
        models[r["method"], r["scope"]] = HammingModel(
            _matrix(r["rows"]), np.array(r["alphas"]), r["bias"], matrix, r["threshold"], r["method"], r["weighted_rows"])
    return models


def load_projected(spark: SparkSession, path: str, *scopes: str) -> dict[str, ProjectedModel]:
    """Models by scope as ``save_projected`` wrote them, of all scopes or those named."""
    return {r["scope"]: ProjectedModel(
        _matrix(r["rows"]), _matrix(r["projection_weight"]) if r["use_projection"] else None, np.array(r["alphas"]), r["bias"], r["threshold"],
        r["use_lsq_qat"], r["lsq_bit_precision"], r["lsq_signed"], r["act_scale"], r["row_scale"], r["normalize_after_projection"],
        r["eval_distance_mode"]) for r in _saved(spark, path, scopes)}


def _saved(spark: SparkSession, path: str, scopes: tuple[str, ...]) -> list:
    table = spark.read.parquet(f"{path}/wta_model")
    table = table.withColumn("scope", F.col("scope").cast("string"))
    return bounded_rows(table.filter(F.col("scope").isin(*scopes)) if scopes else table)


def _save_shared(prepared: Prepared, results: Results, path: str) -> None:
    prepared.bank.write.partitionBy("scope").parquet(f"{path}/bank")
    results.history.write.partitionBy("scope").parquet(f"{path}/wta_history")
    results.artifact_metrics.write.parquet(f"{path}/wta_metrics")
    artifact_examples(prepared.rows, prepared.trained).write.partitionBy("scope", "split").parquet(f"{path}/examples")
    write_metrics(results.metrics, f"{path}/metrics_csv")
