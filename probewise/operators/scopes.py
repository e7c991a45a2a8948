"""Scopes: all rows together (``combined``) and each domain on its own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from probewise.config import COMBINED, PREFERRED_DOMAINS
from probewise.operators.split import rows_in_split


def scopes_of(domain: str = "domain") -> Column:
    """The scopes a row belongs to."""
    return F.array(F.lit(COMBINED), F.col(domain))


def in_scope(rows: DataFrame, scope: str) -> DataFrame:
    return rows if scope == COMBINED else rows.filter(F.col("domain") == scope)


def spread_scopes(rows: DataFrame) -> DataFrame:
    """Every row once per scope it belongs to, with the scope's name."""
    return rows.withColumn("scope", F.explode(scopes_of()))


def scope_view(means: DataFrame, tokens: DataFrame | None, scope: str, split: DataFrame,
               train_on: str = "means", name: str | None = None) -> DataFrame:
    """Rows of one scope (and one split), from example means or from tokens."""
    rows = in_scope(training_table(means, tokens, train_on), scope)
    return rows if name is None else rows_in_split(rows, split, name)


def training_table(means: DataFrame, tokens: DataFrame | None, train_on: str) -> DataFrame:
    if train_on == "means":
        return means
    if train_on != "tokens":
        raise ValueError(train_on)
    required = {"x", "y", "domain", "example_id"}
    missing = sorted(required.difference(tokens.columns if tokens is not None else ()))
    if missing or tokens.isEmpty():
        raise ValueError(f"no token activations to train on: missing or empty {missing or ['x']}")
    return tokens


def domain_order(acts: DataFrame, preferred: Sequence[str] = PREFERRED_DOMAINS) -> DataFrame:
    """(domain, place): preferred domains first, the others by first appearance."""
    rank = F.array_position(F.lit(list(preferred)), F.col("domain"))
    seen = acts.groupBy("domain").agg(F.min("example_id").alias("first_id"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.when(rank > 0, rank).otherwise(F.lit(len(preferred) + 1)), "first_id")
    return seen.select("domain", F.row_number().over(order).alias("place"))


def scope_list(bank: DataFrame) -> DataFrame:
    """(scope, n_rows) of non-empty banks, ``combined`` first, then by name."""
    return bank.groupBy("scope").agg(F.count(F.lit(1)).cast("int").alias("n_rows")).orderBy(
        (F.col("scope") != COMBINED), "scope")


def class_coverage(rows: DataFrame, keys: Sequence[str], y: str = "y") -> DataFrame:
    """Distinct classes per group and whether both are there."""
    seen = rows.groupBy(*keys).agg(
        (F.max((F.col(y) == 0).cast("int")) + F.max((F.col(y) == 1).cast("int"))).alias("n_classes"))
    return seen.withColumn("usable", F.col("n_classes") >= 2)


def balanced_weights(rows: DataFrame, keys: Sequence[str] = ("scope",), y: str = "y") -> DataFrame:
    """Class weights n / (2 n_class) and the positive weight n_neg / n_pos per group."""
    pos, neg = F.sum((F.col(y) == 1).cast("long")), F.sum((F.col(y) == 0).cast("long"))
    table = rows.groupBy(*keys).agg(pos.alias("n_pos"), neg.alias("n_neg"))
    n = (F.col("n_pos") + F.col("n_neg")).cast("double")
    return table.withColumns({
        "weight_neg": F.try_divide(n, 2.0 * F.col("n_neg")),
        "weight_pos": F.try_divide(n, 2.0 * F.col("n_pos")),
        "pos_weight": F.greatest(F.col("n_neg"), F.lit(1)) / F.greatest(F.col("n_pos"), F.lit(1)),
    })


def flip_labels(rows: DataFrame, domains: Sequence[str], label: str = "label") -> DataFrame:
    """1 - label on the given domains."""
    if not domains:
        return rows
    flipped = F.when(F.col("domain").isin(*domains), 1 - F.col(label)).otherwise(F.col(label))
    return rows.withColumn(label, flipped.cast(rows.schema[label].dataType))


def flip_report(rows: DataFrame, domains: Sequence[str], label: str = "label") -> DataFrame:
    """Label counts before and after a flip, on the flipped domains."""
    return rows.filter(F.col("domain").isin(*domains)).groupBy("domain").agg(
        F.sum((F.col(label) == 0).cast("long")).alias("zeros_before"),
        F.sum((F.col(label) == 1).cast("long")).alias("ones_before"),
    ).withColumns({"zeros_after": F.col("ones_before"), "ones_after": F.col("zeros_before")})


def refresh_labels(acts: DataFrame, examples: DataFrame) -> DataFrame:
    """Replace cached labels by current ones, if every cached id is still known."""
    current = examples.select("example_id", F.col("label").cast("int").alias("_label"))
    if examples.isEmpty() or not acts.join(current, "example_id", "left_anti").isEmpty():
        return acts
    joined = acts.join(current, "example_id")
    return joined.withColumn("y", F.col("_label")).select(*acts.columns)


def domain_counts(rows: DataFrame, label: str = "label") -> DataFrame:
    return rows.groupBy("domain", label).agg(F.count(F.lit(1)).alias("n"))
