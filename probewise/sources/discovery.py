"""Finding the data files of a domain."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from probewise.config import DATASET_ALIASES, SKIPPED_NAME_PARTS, TABLE_SUFFIXES


def listed_files(spark: SparkSession, root: str) -> DataFrame:
    """(path) of all files below ``root``; their content is not read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
            .select(F.regexp_replace("path", "^file:/+", "/").alias("path")))


def matching_files(files: DataFrame, domain: str,
                   aliases: Mapping[str, Sequence[str]] = DATASET_ALIASES) -> DataFrame:
    """Files whose name holds an alias of the domain, shortest path first."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    suffix = F.regexp_extract(name, r"\.([^.]*)$", 1)
    wanted = F.lit(False)
    for alias in aliases[domain]:
        wanted = wanted | name.contains(alias)
    for part in SKIPPED_NAME_PARTS:
        wanted = wanted & ~name.contains(part)
    return files.filter(suffix.isin(*TABLE_SUFFIXES) & wanted).distinct().orderBy(F.length("path"), "path")


def find_files(spark: SparkSession, root: str, domain: str,
               aliases: Mapping[str, Sequence[str]] = DATASET_ALIASES) -> list[str]:
    return [r["path"] for r in matching_files(listed_files(spark, root), domain, aliases).collect()]
