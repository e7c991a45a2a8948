"""Assistant spans, the token cap and mean pooling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from probewise.operators.partials import vector_moments


def assistant_span(prefix_ids: Column, full_ids: Column, assistant_ids: Column, eos_id) -> Column:
    """struct(span_start, span_end), half open and zero based.

    The span runs from the end of the prefix to the end of the ids, without a
    closing end-of-text id. An empty span falls back to the last ids of the
    answer's own length; an empty answer has no span (NULL).
    """
    start, size = F.size(prefix_ids), F.size(full_ids)
    closes = (size > start) & (F.element_at(full_ids, -1) == F.lit(eos_id))
    end = F.when(F.coalesce(closes, F.lit(False)), size - 1).otherwise(size)
    own = F.size(assistant_ids)
    regular = F.struct(start.alias("span_start"), end.alias("span_end"))
    tail = F.struct(F.greatest(F.lit(0), size - own).alias("span_start"), size.alias("span_end"))
    return F.when(start < end, regular).when(own > 0, tail)


def span_tokens(full_ids: Column, span: Column) -> Column:
    return F.slice(full_ids, span["span_start"] + 1, span["span_end"] - span["span_start"])


def capped_tokens(rows: DataFrame, tokens: str = "tokens", cap: int = 64, *keep: str) -> DataFrame:
    """One row per span token, the first ``cap`` positions only (counted from 0)."""
    return rows.select(*keep, F.posexplode(F.slice(F.col(tokens), 1, cap)).alias("token_position", "token"))


def mean_pool(token_vectors: DataFrame, keys: tuple[str, ...] = ("example_id",),
              x: str = "x") -> DataFrame:
    """Mean vector per example over all of its token vectors.

    Vectors are added up whole inside each task, so a long example is not gathered in one place.
    """
    return vector_moments(token_vectors, keys, x, few=False).select(*keys, F.col("mean").alias("x"))
