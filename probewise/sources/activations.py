"""Activation tables: reading, checking, writing and describing them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from probewise.functions.kernels import matrix_udf
from probewise.operators.small import local_table
from probewise.schemas import MEAN_COLUMNS, TOKEN_COLUMNS

VERSIONS = "number long, folder string"


def read_activations(spark: SparkSession, path: str, tokens: bool = False) -> DataFrame:
    """An activation table with all required columns: the newest version of a store, or a plain folder of files."""
    newest = newest_version(spark, path)
    table = spark.read.parquet(path if newest is None else f"{path}/{newest[1]}")
    return require_columns(table, TOKEN_COLUMNS if tokens else MEAN_COLUMNS)


def newest_version(spark: SparkSession, path: str) -> tuple[int, str] | None:
    """Number and folder of the newest complete version of a store; None if it has no list of versions."""
    try:
        row = spark.read.schema(VERSIONS).parquet(f"{path}/versions").orderBy(F.desc("number"), "folder").first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return None if row is None else (row["number"], row["folder"])


def require_columns(table: DataFrame, required: tuple[str, ...] = MEAN_COLUMNS) -> DataFrame:
    missing = sorted(set(required) - set(table.columns))
    if missing:
        raise KeyError(f"the stored activations lack the columns {missing}")
    return table


def half_precision(x):
    """Round vectors through 16-bit floats, as a compact store would."""
    return matrix_udf(lambda m: m.astype(np.float16).astype(np.float64))(x)


def write_activations(rows: DataFrame, path: str, half: bool = False, replace: bool = False) -> None:
    """Store activations by domain as a new version; an existing store is only replaced on request.

    Rows go to a folder of their own, and one small row naming it is added to the list of versions when all are written. So readers keep the
    version before until then, also where ``rows`` come from the store itself or the writer fails. Older versions stay.
    """
    spark, before = rows.sparkSession, newest_version(rows.sparkSession, path)
    if not replace and (before is not None or _has_files(spark, path)):
        raise FileExistsError(f"there is a store in {path}; pass replace to write a new version")
    if half:
        rows = rows.withColumn("x", half_precision(F.col("x")))
    folder = f"version-{uuid.uuid4().hex}"
    rows.withColumn("x", F.col("x").cast("array<float>")).write.partitionBy("domain").parquet(f"{path}/{folder}")
    number = 1 if before is None else before[0] + 1
    local_table(spark, [(number, folder)], VERSIONS).coalesce(1).write.mode("append").parquet(f"{path}/versions")


def _has_files(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise
    return True


def stored_or_made(spark: SparkSession, path: str, make: Callable[[], DataFrame], force: bool = False,
                   half: bool = False) -> DataFrame:
    """Use the store if there is one; make and write it otherwise or when forced."""
    if not force:
        try:
            return read_activations(spark, path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    write_activations(make(), path, half, replace=force)
    return read_activations(spark, path)


def manifest(table: DataFrame) -> DataFrame:
    """One row: counts, vector width and longest domain name."""
    width = F.size("x")
    return table.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("example_id").alias("n_examples"),
        F.min(width).alias("min_width"), F.max(width).alias("max_width"),
        F.max(F.length("domain")).alias("longest_domain"))


def vector_width(table: DataFrame) -> int:
    """Common width of all vectors; differing widths are an error."""
    row = table.agg(F.min(F.size("x")).alias("lo"), F.max(F.size("x")).alias("hi")).first()
    if row["lo"] is None or row["lo"] != row["hi"]:
        raise ValueError(f"vectors have widths from {row['lo']} to {row['hi']}")
    return int(row["lo"])


def inspect(table: DataFrame) -> DataFrame:
    """Rows per (domain, y)."""
    return table.groupBy("domain", "y").agg(F.count(F.lit(1)).alias("n"))
