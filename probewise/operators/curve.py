"""Exact ranking metrics from counts of distinct scores.

Scores are first counted per (group, score, class), which collapses ties before
any shuffle of rows. The distinct scores of one group are then spread over bins
with about as many scores each, whatever their distribution, so that no task ever
orders a whole group: running counts inside a bin come from a window over (group, bin),
and what lies below the bin from a window over the bin totals.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from probewise.workspace import written

STEPS = 32            # bins are found in two steps of so many; their square is the number of bins
SKETCH_SIZE = 2048    # of a score sketch: ranks are off by about a thousandth
MOST_RANGES = 1 << 13  # groups whose bin edges, 8 KB each, may be broadcast


def count_scores(df: DataFrame, keys: Sequence[str], score: str = "score", y: str = "y") -> DataFrame:
    """(keys, score, pos, neg): how often each score occurs in each class."""
    return df.groupBy(*keys, F.col(score).alias("score")).agg(
        F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).cast("long").alias("pos"),
        F.sum(F.when(F.col(y) == 0, 1).otherwise(0)).cast("long").alias("neg"),
    )


def stored_counts(df: DataFrame, keys: Sequence[str], score: str = "score", y: str = "y") -> DataFrame:
    """As ``count_scores``, but worked out once: a curve reads its counts several times."""
    return written(count_scores(df, keys, score, y), "score-counts")


def _binned(counts: DataFrame, keys: Sequence[str], groups: int | None) -> DataFrame:
    """Add n_pos, n_neg and a bin number that grows with the score.

    Edges are quantiles of the group's distinct scores from a mergeable sketch, so a bin holds
    at most about a 500th of them. ``groups`` is the number of groups when the caller knows
    it; a known small number lets the edges be broadcast.
    """
    bins = STEPS * STEPS
    edges = F.percentile_approx("score", [i / bins for i in range(1, bins)], 2 * bins)
    ranges = counts.groupBy(*keys).agg(
        edges.alias("_edges"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"),
    ).select(
        *keys, "n_pos", "n_neg", F.filter("_edges", lambda e, i: i % STEPS == STEPS - 1).alias("_coarse"),
        F.transform(F.sequence(F.lit(0), F.lit(STEPS - 1)), lambda c: F.slice("_edges", c * STEPS + 1, F.lit(STEPS - 1))).alias("_fine"))
    if groups is not None and groups <= MOST_RANGES:
        ranges = F.broadcast(ranges)

    return _in_bins(counts.join(ranges, list(keys)))


def _in_bins(rows: DataFrame) -> DataFrame:
    """``rows`` with the bin of ``score`` among edges that are given in two steps."""
    def reached(among: Column) -> Column:
        return F.size(F.filter(among, lambda e: e <= F.col("score")))

    placed = rows.withColumn("_step", reached(F.col("_coarse")))
    return placed.withColumn("_bin", F.col("_step") * STEPS + reached(F.get("_fine", F.col("_step")))).drop(
        "_step", "_coarse", "_fine")


def score_sketches(rows: DataFrame, keys: Sequence[str], score: str = "score") -> DataFrame:
    """(keys, sketch): a mergeable sketch of each group's scores, a few KB whatever the number of rows."""
    return rows.groupBy(*keys).agg(F.kll_sketch_agg_double(F.col(score).cast("double"), F.lit(SKETCH_SIZE)).alias("sketch"))


def merged_sketches(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, sketch): sketches of parts of a table as those of the whole."""
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def approximate_quantiles(sketches: DataFrame, keys: Sequence[str], grid: Sequence[float]) -> DataFrame:
    """(keys, quantiles): scores whose ranks are near ``grid``, in its order; the opt-in form of an exact quantile grid."""
    ranks = F.array(*[F.lit(float(p)) for p in grid])
    return sketches.select(*keys, F.kll_sketch_get_quantile_double("sketch", ranks).alias("quantiles"))


def auroc_bounds(rows: DataFrame, keys: Sequence[str], sketches: DataFrame | None = None, score: str = "score", y: str = "y",
                 groups: int | None = None) -> DataFrame:
    """(keys, low, high): bounds between which the exact AUROC lies, NULL for one class.

    For tables with too many distinct scores to count them all: rows are counted in bins whose edges come from the group's
    sketch, so what is shuffled are at most ``STEPS`` squared counts a group. Pairs in different bins are decided, those in one
    bin are all lost in ``low`` and all won in ``high``. Rows without a score or a label of 0 or 1 are left out.
    """
    keys = list(keys)
    known = rows.filter(F.col(score).isNotNull() & F.col(y).isin(0, 1)).select(*keys, F.col(score).cast("double").alias("score"), F.col(y).alias("y"))
    bins = STEPS * STEPS
    edges = approximate_quantiles(score_sketches(known, keys) if sketches is None else sketches, keys, [i / bins for i in range(1, bins)])
    ranges = edges.select(
        *keys, F.filter("quantiles", lambda e, i: i % STEPS == STEPS - 1).alias("_coarse"),
        F.transform(F.sequence(F.lit(0), F.lit(STEPS - 1)), lambda c: F.slice("quantiles", c * STEPS + 1, F.lit(STEPS - 1))).alias("_fine"))
    if groups is not None and groups <= MOST_RANGES:
        ranges = F.broadcast(ranges)
    counts = _in_bins(known.join(ranges, keys)).groupBy(*keys, "_bin").agg(
        F.sum((F.col("y") == 1).cast("long")).alias("pos"), F.sum((F.col("y") == 0).cast("long")).alias("neg"))
    below = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("under", F.coalesce(F.sum("neg").over(below), F.lit(0)))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    won, tied = F.sum(F.col("pos").cast("double") * F.col("under")), F.sum(F.col("pos").cast("double") * F.col("neg"))
    return placed.groupBy(*keys).agg(
        F.when(pairs > 0, won / pairs).alias("low"), F.when(pairs > 0, (won + tied) / pairs).alias("high"))


def auroc(counts: DataFrame, keys: Sequence[str], groups: int | None = None) -> DataFrame:
    """(keys, auroc): rank statistic with ties at half weight, NULL for one class."""
    keys = list(keys)
    below = Window.partitionBy(*keys, "_bin").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    lower_bins = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    ranked = _binned(counts, keys, groups).withColumn(
        "_below", F.coalesce(F.sum("neg").over(below), F.lit(0)))
    bins = ranked.groupBy(*keys, "_bin").agg(
        F.sum(F.col("pos") * (F.col("_below") + F.col("neg") / 2.0)).alias("_inside"),
        F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"),
        F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"))
    placed = bins.withColumn("_lower", F.coalesce(F.sum("_neg").over(lower_bins), F.lit(0)))
    pairs = F.max("n_pos").cast("double") * F.max("n_neg")
    wins = F.sum(F.col("_inside") + F.col("_pos").cast("double") * F.col("_lower"))
    return placed.groupBy(*keys).agg(F.when(pairs > 0, wins / pairs).alias("auroc"))


def score_curve(counts: DataFrame, keys: Sequence[str], groups: int | None = None) -> DataFrame:
    """Each distinct score with the counts below it and the next score above it."""
    keys = list(keys)
    binned = _binned(counts, keys, groups)
    by_bin = Window.partitionBy(*keys).orderBy("_bin")
    lower = by_bin.rowsBetween(Window.unboundedPreceding, -1)
    totals = binned.groupBy(*keys, "_bin").agg(
        F.sum("pos").alias("_p"), F.sum("neg").alias("_n"), F.min("score").alias("_first"))
    offsets = totals.select(
        *keys, "_bin",
        F.coalesce(F.sum("_p").over(lower), F.lit(0)).alias("_p0"),
        F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_n0"),
        F.lead("_first").over(by_bin).alias("_next"))
    inside = Window.partitionBy(*keys, "_bin").orderBy("score")
    below = inside.rowsBetween(Window.unboundedPreceding, -1)
    return binned.join(offsets, keys + ["_bin"]).select(
        *keys, "score", "pos", "neg", "n_pos", "n_neg",
        (F.col("_p0") + F.coalesce(F.sum("pos").over(below), F.lit(0))).alias("pos_below"),
        (F.col("_n0") + F.coalesce(F.sum("neg").over(below), F.lit(0))).alias("neg_below"),
        F.coalesce(F.lead("score").over(inside), F.col("_next")).alias("next_score"))


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def with_confusion_metrics(df: DataFrame) -> DataFrame:
    """accuracy, precision, recall and f1 from tp, fp, n_pos, n_neg; 0 where undefined."""
    tp, fp = F.col("tp"), F.col("fp")
    n_pos, n_neg = F.col("n_pos"), F.col("n_neg")
    return df.withColumns({
        "accuracy": safe_ratio(tp + n_neg - fp, n_pos + n_neg),
        "precision": safe_ratio(tp, tp + fp),
        "recall": safe_ratio(tp, n_pos),
        "f1": safe_ratio(2 * tp, tp + fp + n_pos),
    })


# Quantile grids of the three threshold searches.
GRIDS = {
    "hamming": np.linspace(0.0, 1.0, 201),
    "projected": np.linspace(0.01, 0.99, 99),
    "sanity": np.linspace(0.05, 0.95, 91),
}


def candidate_thresholds(curve: DataFrame, keys: Sequence[str], grid: np.ndarray) -> DataFrame:
    """Interpolated score quantiles of each group with the confusion counts at each.

    A distinct score knows the ranks it covers, so it can tell which quantile
    positions start at it; only those become rows.
    """
    probs = F.lit([float(p) for p in grid])
    start, step, last = float(grid[0]), float(grid[1] - grid[0]), len(grid) - 1
    n = F.col("n_pos") + F.col("n_neg")
    before = F.col("pos_below") + F.col("neg_below")
    end = before + F.col("pos") + F.col("neg") - 1
    span = F.greatest(n - 1, F.lit(1)).cast("double")
    low = F.greatest(F.lit(0), F.floor((before / span - start) / step) - 1)
    high = F.least(F.lit(last), F.ceil(((end + 1) / span - start) / step) + 1)
    low = F.when(n > 1, low).otherwise(F.lit(0)).cast("int")
    high = F.when(n > 1, high).otherwise(F.lit(last)).cast("int")

    def position(j: Column) -> Column:
        return F.element_at(probs, j + 1) * (n - 1)

    starts_here = F.filter(
        F.when(low <= high, F.sequence(low, high)),
        lambda j: (F.floor(position(j)) >= before) & (F.floor(position(j)) <= end))
    rows = curve.withColumn("candidate", F.explode(starts_here))
    rank = position(F.col("candidate"))
    upper = F.when(F.floor(rank) + 1 <= end, F.col("score")).otherwise(
        F.coalesce(F.col("next_score"), F.col("score")))
    rows = rows.withColumn(
        "threshold", F.col("score") + (rank - F.floor(rank)) * (upper - F.col("score")))
    above = F.col("threshold") > F.col("score")
    rows = rows.select(
        *keys, "candidate", "threshold", "n_pos", "n_neg",
        (F.col("n_pos") - F.col("pos_below") - F.when(above, F.col("pos")).otherwise(0)).alias("tp"),
        (F.col("n_neg") - F.col("neg_below") - F.when(above, F.col("neg")).otherwise(0)).alias("fp"))
    return with_confusion_metrics(rows)


def select_threshold(candidates: DataFrame, keys: Sequence[str], metric: str) -> DataFrame:
    """Best candidate per group; among equals the smallest threshold."""
    if metric not in ("accuracy", "f1"):
        raise ValueError(metric)
    best = F.struct(F.col(metric), -F.col("threshold"))
    return candidates.groupBy(*keys).agg(F.max_by("threshold", best).alias("threshold"))


def sanity_threshold(candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Largest (f1, accuracy, threshold, precision, recall) per group."""
    best = F.max(F.struct("f1", "accuracy", "threshold", "precision", "recall")).alias("_best")
    return candidates.groupBy(*keys).agg(best).select(*keys, "_best.*")


def threshold_metrics(counts: DataFrame, keys: Sequence[str], threshold: str | Column,
                      groups: int | None = None) -> DataFrame:
    """Confusion metrics and AUROC per group; predicted positive when score >= threshold."""
    keys = list(keys)
    cut = F.col(threshold) if isinstance(threshold, str) else threshold
    hit = F.col("score") >= cut
    table = counts.groupBy(*keys).agg(
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"),
        F.max(cut).alias("threshold"))
    table = with_confusion_metrics(table).withColumn("n", F.col("n_pos") + F.col("n_neg"))
    ranks = auroc(counts.select(*keys, "score", "pos", "neg"), keys, groups)
    return table.join(ranks, keys).select(
        *keys, "accuracy", "precision", "recall", "f1", "auroc", "threshold", "n")
