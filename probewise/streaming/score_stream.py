"""The scorers on a stream of activations; the bank and its weights stay fixed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from probewise.operators.scoring import HammingModel, ProjectedModel, hamming_scores, projected_scores


def score_stream(activations: DataFrame, model: HammingModel | ProjectedModel) -> DataFrame:
    """Add score, winner and the decision at the model's threshold; no state is kept."""
    scored = (hamming_scores(activations, model) if isinstance(model, HammingModel)
              else projected_scores(activations, model))
    return scored.withColumn("flagged", (F.col("score") >= F.lit(float(model.threshold))).cast("int"))
