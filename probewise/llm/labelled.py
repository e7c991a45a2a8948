"""Bounded samples of labelled texts for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probewise.llm.shared import whole_text

MOST_LABELS = 20_000


def remainder(modulus: int) -> Column:
    """crc32 of the id as text, modulo; a missing id counts as empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")), F.lit(modulus))


def sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, most: int = MOST_LABELS) -> DataFrame:
    """(text, label) of at most ``most`` labelled documents, chosen by a hash of the id.

    The bound is on rows of ``labels``, so the ids can be broadcast and texts stay where
    they are. Only rows where ``usable`` holds and the label is 0 or 1 are read.
    """
    ids = (
        labels.filter(usable & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
        .select("doc_id", F.col(label).cast("int").alias("label")).dropDuplicates(["doc_id"])
        .orderBy(F.xxhash64(F.lit("labels"), "doc_id"), "doc_id").limit(most))
    return docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(ids), "doc_id").select("text", "label")
