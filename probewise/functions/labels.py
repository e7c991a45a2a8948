"""Binary label rules on typed cells."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from probewise.config import DECEPTIVE_WORDS, LABEL_COLUMNS, TRUTH_COLUMNS, TRUTHFUL_WORDS
from probewise.functions.cells import CELL, Cells, strip


def truthiness(c: Column) -> Column:
    """Truth of a usable value: any non-empty text, any number but zero."""
    return F.when(c["kind"].isin("b", "n"), c["number"] != 0).otherwise(F.length(c["text"]) > 0)


def word_label(text: Column) -> Column:
    word = F.lower(strip(text))
    return F.when(word.isin(*TRUTHFUL_WORDS), 0).when(word.isin(*DECEPTIVE_WORDS), 1)


def label_parts(cells: Cells) -> dict[str, Column]:
    """The three cells the label rule looks at, to be worked out once per row."""
    nothing = F.lit(None).cast(CELL)
    fallback = cells["is_true"]
    return {"_value": cells.first(LABEL_COLUMNS), "_truth": cells.first(TRUTH_COLUMNS),
            "_is_true": nothing if fallback is None else _certain(fallback, cells.is_numeric("is_true"))}


def _certain(c: Column, numeric: bool) -> Column:
    """A cell with an empty value made definite: a missing number is NaN, which counts as true; anything else as false."""
    value = F.lit(float(numeric))
    return F.when(c["kind"] == "z", F.struct(F.lit("b").alias("kind"), c["text"].alias("text"), value.alias("number"))).otherwise(c)


def whole_number(c: Column) -> Column:
    """The number without its fraction; 2, which is no label, for any too large; NULL for infinite ones."""
    return F.when(F.abs(c) < 2.0, c.cast("int")).when(F.abs(c) < float("inf"), F.lit(2))


def label(value: Column, truth: Column, fallback: Column) -> Column:
    """0 truthful, 1 deceptive, 2 for any other number, NULL where nothing fits.

    A flag (or the texts true and false) is inverted only by a truth column; numbers
    are never inverted; other texts go through the word lists. Where that fails, ``is_true``
    decides if the row has it, even empty.
    """
    word = F.lower(strip(value["text"]))
    spelled = (value["kind"] == "s") & word.isin("true", "false")
    flag = F.when(value["kind"] == "b", value["number"] != 0).when(spelled, word == "true")
    from_flag = F.when(truth.isNotNull(), F.when(truthiness(truth), 0).otherwise(1)).otherwise(flag.cast("int"))
    inferred = (
        F.when(flag.isNotNull(), from_flag)
        .when(value["kind"] == "n", whole_number(value["number"]))
        .otherwise(word_label(value["text"])))
    decided = F.when(fallback.isNotNull(), F.when(truthiness(fallback), 0).otherwise(1))
    return F.coalesce(inferred, decided)
