"""Text quality from surface statistics, scored by an additive model."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probewise.llm import gam
from probewise.llm.labelled import MOST_LABELS, remainder, sample
from probewise.llm.shared import whole_text

FOLDS = 5         # rows whose remainder is 0 are held out
THRESHOLD = 0.3
_LETTERS = re.compile(r"[^\W\d_]+")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]+")
_ENDS = re.compile(r"[.!?]+")
NAMES = ("log_words", "word_length", "letters", "upper", "digits", "symbols", "marks", "pipes", "same_as_before",
         "distinct", "commonest", "long_words", "repeated_lines", "line_length", "ends", "capital_starts", "repeated_runs")


def describe(text: str) -> tuple[float, ...]:
    """The features ``NAMES`` of a whole text; an empty one has zeros."""
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return (0.0,) * len(NAMES)
    letters = sum(map(len, _LETTERS.findall(text)))
    upper = sum(map(len, _UPPER.findall(text)))
    digits = sum(text.count(d) for d in "0123456789")
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x]
    seen, again = set(), 0
    for line in lines:
        again += len(line) if line in seen else 0
        seen.add(line)
    runs = list(zip(words, words[1:], words[2:], words[3:]))
    solid = max(1, chars - text.count(" ") - text.count("\n"))
    marks = text.count("!") + text.count("?")
    plain = text.count(".") + text.count(",")
    return (
        math.log1p(n), solid / n, letters / solid, upper / max(1, letters), digits / solid,
        max(0, solid - letters - digits - plain) / solid, marks / n, text.count("|") / n,
        sum(map(str.__eq__, words, words[1:])) / n, len(counts) / n, max(counts.values()) / n,
        sum(len(w) > 14 for w in counts) / len(counts), again / chars, math.log1p(chars / max(1, len(lines))),
        len(_ENDS.findall(text)) / n, sum(w[0].isupper() for w in words) / n,
        1 - len(set(runs)) / len(runs) if runs else 0.0)


def _features(batch: pa.RecordBatch) -> np.ndarray:
    return np.array([describe(t.as_py()) for t in batch.column("text")], dtype=float).reshape(-1, len(NAMES))


def fitted(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELS) -> gam.AdditiveModel:
    """The model from at most ``most`` labelled rows, none of the held-out ones; their features,
    not their texts, come to the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(_features(batch)), type=pa.list_(pa.float64())), batch.column("label")],
                names=["features", "label"])

    rows = sample(docs, labels, "quality", remainder(FOLDS) != 0, most).mapInArrow(run, "features array<double>, label int")
    table = rows.toPandas().sort_values("features", key=lambda s: s.map(tuple))  # the order of rows must not matter
    features = np.array(table["features"].tolist(), dtype=float).reshape(-1, len(NAMES))
    return gam.fit(features, table["label"].to_numpy(dtype=float))


def scored(docs: DataFrame, model: gam.AdditiveModel) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; nothing is shuffled.

    A missing text scores as an empty one; a missing id is kept; repeated rows score
    alike; no rows give none. Other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.scores(_features(batch))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score),
                 pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    source = docs.select("doc_id", (remainder(FOLDS) == 0).alias("held_out"), whole_text().alias("text"))
    return source.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
