"""Seeded selection of a fixed number of rows per stratum without sorting strata.

Rows are ordered by the md5 of (seed, id). The rank-``quota`` row of a stratum is
found from counts per hash prefix plus one ordered look into a single prefix; the
selection itself is then a comparison with that row, with no shuffle of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from probewise.operators.small import pin, pinned

PREFIX = 4  # hex digits: 65,536 groups per stratum


def hash_order(seed: int, row_id: str = "example_id") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(row_id).cast("string")))


def find_cuts(rows: DataFrame, quotas: DataFrame, few: bool, seed: int, stratum: str = "stratum",
              row_id: str = "example_id") -> DataFrame:
    """(stratum, target, n, quota, cut_h, cut_id): the last row a stratum may take.

    ``quotas`` holds (stratum, target, n, quota) with the stratum sizes, one row per
    cut asked for; ``few`` tells that it was found to be small. Strata that take
    everything or nothing need no cut.
    """
    slim = rows.select(stratum, row_id, hash_order(seed, row_id).alias("_h")).withColumn(
        "_prefix", F.substring("_h", 1, PREFIX))
    lower = Window.partitionBy(stratum).orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    prefixes = slim.groupBy(stratum, "_prefix").agg(F.count(F.lit(1)).alias("_c")).withColumn(
        "_before", F.coalesce(F.sum("_c").over(lower), F.lit(0)))
    edge = prefixes.join(quotas, stratum).filter(
        (F.col("quota") > F.col("_before")) & (F.col("quota") <= F.col("_before") + F.col("_c"))
        & (F.col("quota") < F.col("n"))
    ).select(stratum, "target", "_prefix", (F.col("quota") - F.col("_before")).alias("_need"))
    if few:  # at most one prefix per cut
        edge = F.broadcast(edge)
    in_prefix = Window.partitionBy(stratum, "target").orderBy("_h", row_id)
    cuts = (slim.join(edge, [stratum, "_prefix"])
            .withColumn("_rank", F.row_number().over(in_prefix))
            .filter(F.col("_rank") == F.col("_need"))
            .select(stratum, "target", F.col("_h").alias("cut_h"), F.col(row_id).alias("cut_id")))
    return pinned(quotas.join(cuts, [stratum, "target"], "left"))


def is_taken(order: Column, row_id: Column, cut: str = "") -> Column:
    """Whether a row joined with its stratum's cut is among the taken ones."""
    quota, n = F.col(f"{cut}quota"), F.col(f"{cut}n")
    last, last_id = F.col(f"{cut}cut_h"), F.col(f"{cut}cut_id")
    within = (order < last) | ((order == last) & (row_id <= last_id))
    return F.when(quota >= n, F.lit(True)).when(quota <= 0, F.lit(False)).otherwise(within)


def take_per_stratum(rows: DataFrame, quotas: DataFrame, seed: int, stratum: str = "stratum",
                     row_id: str = "example_id") -> DataFrame:
    """The first ``quota`` rows of every stratum in hash order."""
    small, few = pin(quotas.select(stratum, F.lit("").alias("target"), "n", "quota"))
    cuts = find_cuts(rows, small, few is not None, seed, stratum, row_id)
    taken = is_taken(hash_order(seed, row_id), F.col(row_id))
    return rows.join(cuts, stratum).filter(taken).drop("target", "n", "quota", "cut_h", "cut_id")


def balanced_cap(df: DataFrame, cap: int | None, seed: int = 0, row_id: str = "example_id",
                 domain: str = "domain", label: str = "label") -> DataFrame:
    """Domains with more than ``cap`` rows keep max(1, cap // 2) rows per label."""
    if cap is None:
        return df
    keyed = df.withColumn("stratum", F.concat_ws("\u0001", F.col(domain), F.col(label).cast("string")))
    sizes = keyed.groupBy(domain, "stratum").agg(F.count(F.lit(1)).alias("n"))
    in_domain = F.sum("n").over(Window.partitionBy(domain))
    quota = F.when(in_domain > cap, F.least(F.col("n"), F.lit(max(1, cap // 2)))).otherwise(F.col("n"))
    quotas = sizes.withColumn("quota", quota)
    return take_per_stratum(keyed, quotas, seed, row_id=row_id).drop("stratum")


def exact_per_class(df: DataFrame, per_class: int, seed: int = 0, row_id: str = "example_id",
                    label: str = "label") -> DataFrame:
    """Exactly ``per_class`` rows of each label; an error when a class is smaller."""
    keyed = df.withColumn("stratum", F.col(label).cast("string"))
    sizes = keyed.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    short = [r["stratum"] for r in sizes.filter(F.col("n") < per_class).collect()]
    if short:
        raise ValueError(f"fewer than {per_class} rows for label(s) {sorted(short)}")
    quotas = sizes.withColumn("quota", F.lit(per_class).cast("long"))
    return take_per_stratum(keyed, quotas, seed, row_id=row_id).drop("stratum")
