"""Small helpers several text operators use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: ASCII white space, as the contracts of the queries count it.
BLANKS = " \t\n\x0b\x0c\r"
WORD = "[^ \t\n\x0b\x0c\r]+"
MOST_FILTER_BITS = 1 << 24


def table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, a missing one as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def row_of(columns: list[str]) -> Column:
    """Columns that travel along under one name, so that none can clash with an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in columns]) if columns else F.struct(F.lit(0).alias("none"))


def with_row(schema: str, source: DataFrame) -> StructType:
    """``schema`` with the field ``row`` of ``source`` at its end, if there is one."""
    fields = StructType.fromDDL(schema)
    return fields.add(source.schema["row"]) if "row" in source.columns else fields


def unpacked(columns: list[str]) -> list[Column]:
    return [F.col("row").getField(c).alias(c) for c in columns]


def _slot(keys: list[Column], bits: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(bits))


def sieve(keys: DataFrame, bits: int | None = None) -> tuple[DataFrame, int]:
    """A bitmap of hashed ``keys`` (all its columns), of at most ``MOST_FILTER_BITS`` bits.

    It is a table of 64-bit words, so at most 262,144 rows whatever the input: small
    enough to broadcast. A row that passes is a candidate only; the caller decides with
    an exact join later. When there are far more keys than bits it lets everything pass.
    """
    if bits is None:
        bits, n = 1 << 16, keys.count()
        while bits < min(16 * n, MOST_FILTER_BITS):
            bits *= 2
    at = _slot([F.col(c) for c in keys.columns], bits)
    words = (
        keys.select(at.alias("at"))
        .groupBy(F.shiftright("at", 6).alias("sieve_word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, int(at & 63))")).alias("sieve_bits")))
    return words, bits


def sifted(df: DataFrame, words: DataFrame, bits: int, keys: list[Column]) -> DataFrame:
    """``df`` with a boolean ``candidate``; only the bitmap moves."""
    at = _slot(keys, bits)
    return (
        df.withColumn("sieve_at", at)
        .join(F.broadcast(words), F.shiftright("sieve_at", 6) == F.col("sieve_word"), "left")
        .withColumn("candidate", F.coalesce(
            F.expr("shiftrightunsigned(sieve_bits, int(sieve_at & 63)) & 1L = 1L"), F.lit(False)))
        .drop("sieve_at", "sieve_word", "sieve_bits"))


def without(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """``df`` whose ``key`` is not in ``ids`` (that one column); only rows that a bitmap cannot clear are shuffled."""
    words, bits = sieve(ids)
    marked = sifted(df, words, bits, [F.col(key)])
    clear, rest = marked.filter("not candidate"), marked.filter("candidate")
    return clear.drop("candidate").unionByName(rest.drop("candidate").join(ids, key, "left_anti").select(*df.columns))
