"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probewise.llm.shared import BLANKS, row_of, sieve, sifted, whole_text
from probewise.workspace import written

PREFIX = 256


def normalised():
    return F.translate(whole_text(), BLANKS, "")


def exact_groups(docs: DataFrame, carry: list[str] = (), prefix: int = PREFIX) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): keep_id, group_size, kept, and ``row``.

    Texts are equal when identical without ASCII white space. Lengths that occur once are
    out after one narrow count, then (length, hash of the first ``prefix`` characters);
    the full text is hashed only for rows whose pair occurs again. That set is known at
    the scan by a bitmap of bounded size; texts never move for it. The row with the most code
    points stays, then the smallest doc_id, then the first read; null ids come last.

    A missing text counts as empty; rows repeated whole are separate rows of which one
    stays. ``carry`` names columns to bring along in the struct ``row``; other columns
    are not read. No input rows give no rows.
    """
    text = normalised()
    pairs = written(
        docs.select(F.length(text).alias("norm_len"), F.xxhash64(F.substring(text, 1, prefix)).alias("head"))
        .groupBy("norm_len", "head").agg(F.count("*").alias("n")), "lengths-heads")
    lengths = pairs.groupBy("norm_len").agg(F.sum("n").alias("rows")).filter("rows > 1").select("norm_len")
    again = pairs.filter("n > 1").join(lengths, "norm_len", "left_semi").select("norm_len", "head")
    words, bits = sieve(again)

    read = docs.select(
        "doc_id", F.length(whole_text()).alias("chars"), text.alias("norm"), row_of(list(carry)).alias("row"))
    keys = [F.length("norm"), F.xxhash64(F.substring("norm", 1, prefix))]
    hashed = written(
        sifted(read, words, bits, keys)
        .withColumn("full", F.when(F.col("candidate"), F.sha2("norm", 256)))
        .withColumn("rank", F.struct(-F.col("chars"), F.col("doc_id").isNull(), F.col("doc_id"),
                                     F.monotonically_increasing_id().alias("read")))
        .drop("norm", "chars", "candidate"), "full-hashes")

    alone = hashed.filter("full is null").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "row")
    shared = hashed.filter("full is not null")
    groups = shared.groupBy("full").agg(F.min("rank").alias("first"), F.count("*").alias("group_size"))
    return alone.unionByName(shared.join(groups, "full").select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size",
        (F.col("rank") == F.col("first")).alias("kept"), "row"))
