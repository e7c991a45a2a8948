"""A pipeline over ``documents``: each stage works on all that the stage before it kept.

Without rows, stages pass none on; missing texts count as empty, missing ids stay missing, repeated
rows are copies of which the second stage keeps one, and columns beyond those of
``documents`` travel along up to the last stage, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probewise.llm import exact, mixing, nearcopies, packing, toxicity
from probewise.llm.shared import row_of, table, unpacked, without
from probewise.workspace import shared_folder, ship, written

#: The classifier has no SQL form; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    ship(spark)
    model = toxicity.fitted(docs, table(spark, sf_dir, "labels"))
    key = F.xxhash64("doc_id", "text")  # the same id and text score alike, so the key names what is rejected
    scores = toxicity.scored(docs.select(key.alias("doc_id"), "text"), model)
    rejected = scores.filter("predicted = 1").select(F.col("doc_id").alias("row_key")).distinct()
    keyed = docs.select(key.alias("row_key"), row_of(docs.columns).alias("row"))
    return without(keyed, written(rejected, "rejected"), "row_key").select(*unpacked(docs.columns))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row stays of texts that are equal without white space."""
    return exact.exact_groups(docs, carry=docs.columns).filter("kept").select(*unpacked(docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each class of near duplicates."""
    ship(spark)
    return nearcopies.one_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words, rounded: a row for each time, none for none."""
    mix = mixing.mixed(docs, carry=docs.columns)
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    return mix.withColumn("turn", F.explode(F.array_repeat(F.lit(1), times))).select(*unpacked(docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, as ``op8_vector_packing`` returns them."""
    ship(spark)
    return packing.packed(docs)


STAGES = [
    ("toxicity", toxicity_filter),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("source mix", source_mix),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    docs = table(spark, sf_dir)
    for number, (_, stage) in enumerate(STAGES):
        path = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}-{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
