"""From normalised examples to activation tables with a caller's encoder."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from probewise.workspace import written

# [(user_prompt, assistant_text), ...] -> for each, one vector per token of the answer
Encoder = Callable[[list[tuple[str, str]]], list[np.ndarray]]


@dataclass(frozen=True)
class Extracted:
    means: DataFrame   # example_id, domain, y, x
    tokens: DataFrame  # example_id, domain, y, token_position, x: the first tokens of each answer
    errors: DataFrame  # example_id, error: examples that gave no vectors


def hash_vector(token: str, width: int) -> np.ndarray:
    """Deterministic stand-in for a model: components from md5 of (token, position)."""
    parts = [int(hashlib.md5(f"{token}|{i}".encode()).hexdigest()[:4], 16) for i in range(width)]
    return np.array(parts, dtype=np.float64) / 32768.0 - 1.0


def hash_encoder(width: int = 8) -> Encoder:
    def encode(pairs: list[tuple[str, str]]) -> list[np.ndarray]:
        return [np.stack([hash_vector(t, width) for t in answer.split(" ")]) for _, answer in pairs]
    return encode


def _encoded(encoder: Encoder, pairs: list[tuple[str, str]]) -> list[np.ndarray | str]:
    """Vectors or, as text, what went wrong; a batch that fails is tried again pair by pair."""
    try:
        found = list(encoder(pairs))
        if len(found) != len(pairs):
            raise ValueError(f"{len(found)} results for {len(pairs)} pairs")
    except MemoryError:
        raise
    except Exception as error:
        if "out of memory" in str(error).lower():
            raise
        if len(pairs) > 1:
            return [_encoded(encoder, [pair])[0] for pair in pairs]
        return [f"{type(error).__name__}: {error}"]
    vectors = [np.asarray(v, dtype=np.float64) for v in found]
    return [v if v.ndim == 2 and len(v) else "no token vectors" for v in vectors]


_EXTRACTED = "example_id long, domain string, y int, token_position int, x array<double>, error string"


def extract(examples: DataFrame, encoder: Encoder, cap: int = 64, batch: int = 32) -> Extracted:
    """Mean activations over all answer tokens and the vectors of the first ``cap``, from one run of the encoder.

    The encoder gets ``batch`` pairs at a time. An example without vectors is listed with its
    error; running out of memory ends the job. An example is pooled in the task that
    encodes it, and the result is written once.
    """
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                some = rows.slice(at, batch)
                pairs = list(zip(some.column("user_prompt").to_pylist(), some.column("assistant_text").to_pylist()))
                found = _encoded(encoder, pairs)
                source, position, vectors, errors = [], [], [], []
                for i, v in enumerate(found):
                    failed = isinstance(v, str)
                    block = [None] if failed else [v.mean(axis=0), *v[:cap]]
                    source += [i] * len(block)
                    position += [None] if failed else [-1, *range(len(block) - 1)]
                    vectors += block
                    errors += [v if failed else None] * len(block)
                took = pa.array(source, type=pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [some.column("example_id").take(took), some.column("domain").take(took), some.column("y").take(took),
                     pa.array(position, type=pa.int32()), pa.array(vectors, type=pa.list_(pa.float64())),
                     pa.array(errors, type=pa.string())],
                    ["example_id", "domain", "y", "token_position", "x", "error"])

    slim = examples.select(F.col("example_id").cast("long").alias("example_id"), "domain",
                           F.col("label").cast("int").alias("y"), "user_prompt", "assistant_text")
    rows = written(slim.mapInArrow(encode, _EXTRACTED), "activations")
    return Extracted(
        rows.filter("token_position = -1").select("example_id", "domain", "y", "x"),
        rows.filter("token_position >= 0").select("example_id", "domain", "y", "token_position", "x"),
        rows.filter("error is not null").select("example_id", "error"))


def extracted_or_fail(found: Extracted) -> Extracted:
    """``found``, unless no example gave vectors."""
    if found.means.isEmpty():
        reasons = [r["error"] for r in found.errors.select("error").distinct().limit(3).collect()]
        raise ValueError(f"no example could be encoded; among the errors: {reasons}")
    return found


def hashed_tokens(rows: DataFrame, width: int, token: str = "token") -> DataFrame:
    """The stand-in vectors in the JVM: (…, x) for one token per row."""
    components = [
        F.conv(F.substring(F.md5(F.concat(F.col(token), F.lit(f"|{i}"))), 1, 4), 16, 10).cast("double")
        / F.lit(32768.0) - F.lit(1.0) for i in range(width)]
    return rows.withColumn("x", F.array(*components))
