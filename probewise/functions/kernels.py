"""Arrow-batch scoring functions: one matrix product per batch, bank in the closure.

``bounded_bank`` checks the size of a bank before it is shipped to the tasks; larger ones are
scored in blocks (``scoring.blocked_winners``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import arrow_udf

MAX_BANK_BYTES = 256 << 20


def as_matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    """Rows of a list column as a matrix; every row must have the same length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(column) == 0:
        return np.empty((0, 0), dtype=dtype)
    if column.null_count or len(flat) % len(column):
        raise ValueError("vectors must be present and of one length")
    width = len(flat) // len(column)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes != width).any():
        raise ValueError("vectors must be present and of one length")
    return flat.reshape(len(column), width).astype(dtype, copy=False)


def as_list_column(matrix: np.ndarray) -> pa.Array:
    n, width = matrix.shape
    offsets = pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32)[: n + 1] if width
                       else np.zeros(n + 1, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(matrix).ravel()))


def bank_bytes(bank: DataFrame) -> int:
    """Size of a bank's arrays as doubles, with something for every row."""
    arrays = [F.coalesce(F.size(f.name), F.lit(0)) for f in bank.schema.fields if isinstance(f.dataType, T.ArrayType)]
    numbers = sum(arrays[1:], arrays[0]) if arrays else F.lit(0)
    return int(bank.agg(F.coalesce(F.sum(numbers * 8 + 64), F.lit(0))).first()[0])


def bounded_rows(bank: DataFrame) -> list:
    """Collect a bank of at most ``MAX_BANK_BYTES``; a larger one is an error."""
    size = bank_bytes(bank)
    if size > MAX_BANK_BYTES:
        raise ValueError(f"a bank of {size >> 20} MB is too large to ship to every task")
    return bank.collect()


def bounded_bank(bank: DataFrame, order: str = "row_id", column: str = "row") -> np.ndarray:
    """Bank rows as a matrix, in the order of ``order``."""
    rows = sorted(bounded_rows(bank.select(order, column)), key=lambda r: r[order])
    return np.array([r[column] for r in rows], dtype=np.float64)


def signs(matrix: np.ndarray) -> np.ndarray:
    return np.where(matrix >= 0, 1.0, -1.0)


def packed_signs(matrix: np.ndarray) -> np.ndarray:
    """Sign codes as 64-bit words, one bit per component (set where it is at least zero)."""
    bits = np.packbits(matrix >= 0, axis=1, bitorder="little")
    words = np.zeros((len(matrix), -(-matrix.shape[1] // 64) * 8), dtype=np.uint8)
    words[:, :bits.shape[1]] = bits
    return words.view("<i8")


def differing_bits(words: np.ndarray, row: np.ndarray) -> np.ndarray:
    """In how many components each row of words differs from one row's words."""
    return np.bitwise_count((words ^ row).view(np.uint64)).sum(axis=1, dtype=np.int64)


def sign_words(x: Column) -> Column:
    """``packed_signs`` of a vector column: a thirty-second of its size as floats."""

    @arrow_udf("array<long>")
    def pack(column: pa.Array) -> pa.Array:
        if not len(column):
            return pa.array([], pa.list_(pa.int64()))
        return as_list_column(packed_signs(as_matrix(column)))

    return pack(x)


def unpacked_signs(words: Column, width: int) -> Column:
    """The codes of ``sign_words`` as vectors of ``width`` ones and minus ones."""

    @arrow_udf("array<float>")
    def unpack(column: pa.Array) -> pa.Array:
        if not len(column):
            return pa.array([], pa.list_(pa.float32()))
        bits = np.unpackbits(as_matrix(column, np.int64).view(np.uint8), axis=1, count=width, bitorder="little")
        return as_list_column(bits.astype(np.float32) * 2 - 1)

    return unpack(words)


def unit_rows(matrix: np.ndarray, eps: float = 1e-8) -> np.ndarray:
    return matrix / (np.linalg.norm(matrix, axis=1, keepdims=True) + eps)


def quantized_steps(matrix: np.ndarray, scale: float, qmin: int, qmax: int) -> np.ndarray:
    """Integer levels of the uniform quantiser (numpy rounds halves to even)."""
    return np.clip(np.rint(matrix / scale), qmin, qmax)


def winners(scores: np.ndarray, bias: float) -> pa.Array:
    best = scores.argmax(axis=1)
    top = scores[np.arange(len(best)), best] + bias
    return pa.StructArray.from_arrays(
        [pa.array(top.astype(np.float64)), pa.array(best.astype(np.int32))], ["score", "winner"]
    )


def _empty_winner() -> pa.Array:
    return winners(np.empty((0, 1)), 0.0)


def winner_udf(similarity, bias: float = 0.0):
    """A column function (x) -> struct(score, winner) from a batch similarity."""

    @arrow_udf("struct<score double, winner int>")
    def best_row(x: pa.Array) -> pa.Array:
        return winners(similarity(as_matrix(x)), bias) if len(x) else _empty_winner()

    return best_row


def matrix_udf(transform):
    """A column function (x) -> array<double> from a batch transform."""

    @arrow_udf("array<double>")
    def apply(x: pa.Array) -> pa.Array:
        if not len(x):
            return pa.array([], pa.list_(pa.float64()))
        return as_list_column(transform(as_matrix(x)))

    return apply


def linear_map(x: Column, weight: np.ndarray) -> Column:
    """``weight @ x`` for every row."""
    transposed = np.ascontiguousarray(weight.T)
    return matrix_udf(lambda m: m @ transposed)(x)


def null_space(x: Column, basis: np.ndarray | None) -> Column:
    """``x`` without its part in the span of orthonormal ``basis`` rows."""
    if basis is None or not len(basis):
        return x.cast("array<double>")
    return matrix_udf(lambda m: m - (m @ basis.T) @ basis)(x)
