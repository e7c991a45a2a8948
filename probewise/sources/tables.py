"""Reading one raw file of any supported format as a DataFrame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from probewise.config import JSON_WRAPPER_KEYS


def _is_row_list(kind: T.DataType) -> bool:
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType)


def _document_layout(df: DataFrame, path: str) -> DataFrame:
    """Rows of a JSON document: a wrapped list, equally long lists as columns (also lists of records), or lists of records by key."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    for key in JSON_WRAPPER_KEYS:
        if isinstance(fields.get(key), T.ArrayType):
            if not _is_row_list(fields[key]):
                raise ValueError(f"{path} is neither a list of records nor equally long keyed lists")
            return df.select(F.inline(f"`{key}`"))
    lists = [n for n, kind in fields.items() if isinstance(kind, T.ArrayType)]
    keyed = [n for n in lists if _is_row_list(fields[n])]
    single = [n for n in fields if n not in lists]
    if lists and not any(isinstance(fields[n], (T.StructType, T.MapType)) for n in single):
        sizes = df.select(*[F.size(f"`{n}`").alias(f"c{i}") for i, n in enumerate(lists)]).first()
        if len(set(sizes)) == 1:  # a single value stands for every row
            return df.select(*[F.col(f"`{n}`") for n in single],
                             F.inline(F.arrays_zip(*[F.col(f"`{n}`") for n in lists])))
    if keyed:
        parts = [df.select(F.inline(f"`{n}`")).withColumn("_split_or_key", F.lit(n)) for n in keyed]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    raise ValueError(f"{path} is neither a list of records nor equally long keyed lists")


def read_json_document(spark: SparkSession, path: str) -> DataFrame:
    opening = spark.read.text(path).select(F.ltrim("value").alias("value")).filter(F.length("value") > 0).first()
    df = spark.read.option("multiLine", True).json(path)
    if opening is not None and opening["value"].startswith("["):
        return df
    return _document_layout(df, path)


def read_shapeless(spark: SparkSession, path: str) -> DataFrame:
    """(record): each line of a JSON Lines file as a VARIANT, so a field may have another type in every row."""
    return spark.read.format("json").option("singleVariantColumn", "record").load(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Dispatch by suffix: jsonl, json, csv or parquet."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix == "jsonl":
        return spark.read.json(path)
    if suffix == "json":
        return read_json_document(spark, path)
    if suffix == "csv":
        return spark.read.csv(path, header=True, inferSchema=True, multiLine=True, escape='"')
    if suffix == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"no reader for the suffix of {path}")
