"""Size-checked small tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SMALL_ROWS = 100_000


def pin(df: DataFrame, max_rows: int = SMALL_ROWS) -> tuple[DataFrame, pa.Table | None]:
    """Turn a table of at most ``max_rows`` rows into broadcast local rows.

    A larger table is returned as it is, and Spark picks the join; the rows come
    along only where the table is small.
    """
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows:
        return df, None
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)), rows


def pinned(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    return pin(df, max_rows)[0]


def local_table(spark: SparkSession, rows: list[tuple], schema: T.StructType | str) -> DataFrame:
    """A table from a few driver-side rows, kept in the plan itself."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    names = schema.fieldNames()
    table = pa.Table.from_pylist([dict(zip(names, row)) for row in rows], schema=to_arrow_schema(schema))
    return spark.createDataFrame(table, schema)
