"""Winner-take-all scorers over a small row bank.

Every scorer adds ``score`` and ``winner`` (lowest index on ties). The Arrow
forms multiply whole batches with the bank; the column forms give the same
values inside the JVM, for streams and for wide plans without Python workers.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from probewise.functions import kernels, vectors
from probewise.operators.partials import vector_moments
from probewise.workspace import written

BLOCK_BYTES = 32 << 20  # of a bank that is multiplied at once
TOGETHER = 8            # blocks of a bank that are held at the same time


def qrange(bits: int, signed: bool = True) -> tuple[int, int]:
    """Smallest and largest level of a ``bits`` wide quantiser."""
    return (-(2 ** (bits - 1)), 2 ** (bits - 1) - 1) if signed else (0, 2 ** bits - 1)


def default_scale(dim: int, bits: int, signed: bool = True, eps: float = 1e-8) -> float:
    low, high = qrange(bits, signed)
    return max(1.0 / (np.sqrt(max(dim, 1)) * max(abs(low), abs(high), 1)), eps)


@dataclass
class HammingModel:
    """Sign codes of a bank with row weights, a bias and optionally a hash matrix."""

    rows: np.ndarray
    alphas: np.ndarray | None = None
    bias: float = 0.0
    matrix: np.ndarray | None = None
    threshold: float = 0.0
    method: str = "sign"
    weighted: bool = False
    row_codes: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.rows = np.asarray(self.rows, dtype=np.float64)
        self.row_codes = self.codes(self.rows)
        if self.alphas is None:
            self.alphas = np.ones(len(self.rows))

    def codes(self, x: np.ndarray) -> np.ndarray:
        return kernels.signs(x if self.matrix is None else x @ self.matrix.T)

    def matches(self, x: np.ndarray) -> np.ndarray:
        """Similarity of every row to every bank row, from -1 to 1."""
        return (self.codes(x) @ self.row_codes.T) / self.row_codes.shape[1]

    def weighted_scores(self, x: np.ndarray) -> np.ndarray:
        return self.matches(x) * self.alphas

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.weighted_scores(x).max(axis=1) + self.bias


@dataclass
class ProjectedModel:
    """Unit rows, an optional projection, two quantisers, row weights and a bias."""

    rows: np.ndarray
    projection: np.ndarray | None = None
    alphas: np.ndarray | None = None
    bias: float = 0.0
    threshold: float = 0.0
    quantize: bool = True
    bits: int = 3
    signed: bool = True
    act_scale: float | None = None
    row_scale: float | None = None
    normalize: bool = False
    eval_mode: str = "euclidean"

    def __post_init__(self) -> None:
        self.rows = np.asarray(self.rows, dtype=np.float64)
        if self.alphas is None:
            self.alphas = np.full(len(self.rows), np.log(2.0))
        dim = len(self.projection) if self.projection is not None else self.rows.shape[1]
        start = default_scale(dim, self.bits, self.signed)
        self.act_scale = start if self.act_scale is None else self.act_scale
        self.row_scale = start if self.row_scale is None else self.row_scale

    def project(self, x: np.ndarray) -> np.ndarray:
        z = x if self.projection is None else x @ self.projection.T
        if self.normalize:
            z = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
        return z

    def _levels(self, z: np.ndarray, scale: float, quantize: bool) -> tuple[np.ndarray, float]:
        if quantize and self.bits < 32:
            return kernels.quantized_steps(z, scale, *qrange(self.bits, self.signed)), scale
        return z, 1.0

    def encoded_rows(self, quantize: bool) -> np.ndarray:
        levels, step = self._levels(self.project(self.rows), self.row_scale, quantize)
        return levels * step

    def dots(self, z: np.ndarray, quantize: bool | None = None) -> np.ndarray:
        """q·r for projected queries; the integer levels are multiplied exactly."""
        quantize = self.quantize if quantize is None else quantize
        q, step = self._levels(z, self.act_scale, quantize)
        r, row_step = self._levels(self.project(self.rows), self.row_scale, quantize)
        return (q @ r.T) * (step * row_step)

    def baked(self, quantize: bool) -> tuple[np.ndarray, float]:
        """Weighted rows with the extra coordinate that gives all of them norm sqrt(C)."""
        weighted = self.encoded_rows(quantize) * self.alphas[:, None]
        square = (weighted ** 2).sum(axis=1)
        constant = float(square.max() + 1e-8)
        extra = np.sqrt(np.maximum(constant - square, 0.0))
        return np.hstack([weighted, extra[:, None]]), constant

    def weighted_scores(self, x: np.ndarray) -> np.ndarray:
        return self.dots(self.project(x)) * self.alphas

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Squared distances to the baked rows, the query norms and the constant."""
        q, step = self._levels(self.project(x), self.act_scale, self.quantize)
        q = q * step
        baked, constant = self.baked(self.quantize)
        square = (q ** 2).sum(axis=1, keepdims=True)
        return square + constant - 2.0 * (q @ baked[:, :-1].T), square[:, 0], constant

    def winner_scores(self, x: np.ndarray, mode: str | None = None) -> tuple[np.ndarray, np.ndarray]:
        mode = mode or self.eval_mode
        if mode == "dot":
            scores = self.weighted_scores(x)
            best = scores.argmax(axis=1)
            return scores[np.arange(len(best)), best] + self.bias, best
        if mode == "euclidean":
            distance, square, constant = self.distances(x)
            best = distance.argmin(axis=1)
            nearest = distance[np.arange(len(best)), best]
            return -0.5 * (nearest - square - constant) + self.bias, best
        raise ValueError(f"rows are scored by dot or euclidean, not {mode!r}")

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Scores from exact level products; both modes rank rows this way."""
        return self.weighted_scores(x).max(axis=1) + self.bias


def _with_winner(rows: DataFrame, column: Column) -> DataFrame:
    return rows.withColumn("_best", column).withColumns(
        {"score": F.col("_best.score"), "winner": F.col("_best.winner")}).drop("_best")


def cosine_scores(rows: DataFrame, bank: np.ndarray, x: str = "x") -> DataFrame:
    unit = np.ascontiguousarray(kernels.unit_rows(bank).T)
    best = kernels.winner_udf(lambda m: kernels.unit_rows(m) @ unit)
    return _with_winner(rows, best(x))


def hamming_scores(rows: DataFrame, model: HammingModel, x: str = "x") -> DataFrame:
    best = kernels.winner_udf(model.weighted_scores, model.bias)
    return _with_winner(rows, best(x))


def projected_scores(rows: DataFrame, model: ProjectedModel, mode: str | None = None,
                     x: str = "x") -> DataFrame:
    if (mode or model.eval_mode) not in ("dot", "euclidean"):
        raise ValueError(f"rows are scored by dot or euclidean, not {mode!r}")

    @arrow_udf("struct<score double, winner int>")
    def best(column: pa.Array) -> pa.Array:
        width = model.rows.shape[1]
        matrix = kernels.as_matrix(column) if len(column) else np.empty((0, width))
        score, winner = model.winner_scores(matrix, mode)
        return pa.StructArray.from_arrays(
            [pa.array(score), pa.array(winner.astype(np.int32))], ["score", "winner"])

    return _with_winner(rows, best(x))


def row_similarities(rows: DataFrame, model: HammingModel, x: str = "x") -> DataFrame:
    """Add ``similarities``: one Hamming similarity per bank row."""
    return rows.withColumn("similarities", kernels.matrix_udf(model.matches)(F.col(x)))


def _best_of(scores: Column, bias: float) -> tuple[Column, Column]:
    return F.array_max(scores) + F.lit(float(bias)), vectors.first_argmax(scores)


def hamming_scores_in_jvm(rows: DataFrame, model: HammingModel, x: str = "x") -> DataFrame:
    """Column form of ``hamming_scores`` for models without a hash matrix."""
    if model.matrix is not None:
        raise ValueError("a hash matrix needs the Arrow form")
    code = vectors.sign_code(F.col(x))
    similarities = [vectors.hamming_similarity(F.col("_code"), F.lit([int(v) for v in row]))
                    * F.lit(float(a)) for row, a in zip(model.row_codes, model.alphas)]
    scored = rows.withColumn("_code", code).withColumn("_scores", F.array(*similarities))
    score, winner = _best_of(F.col("_scores"), model.bias)
    return scored.withColumns({"score": score, "winner": winner}).drop("_code", "_scores")


def hamming_scores_packed(rows: DataFrame, model: HammingModel, words: str = "words") -> DataFrame:
    """``hamming_scores`` from stored sign words, by counting differing bits.

    Codes are packed once (``kernels.sign_words``); any bank without a hash matrix
    is then scored without reading the vectors again.
    """
    if model.matrix is not None:
        raise ValueError("a hash matrix needs the vectors")
    width = model.row_codes.shape[1]
    row_words = kernels.packed_signs(model.row_codes)
    alphas, bias = model.alphas, model.bias

    @arrow_udf("struct<score double, winner int>")
    def best(column: pa.Array) -> pa.Array:
        codes = kernels.as_matrix(column, np.int64) if len(column) else np.empty((0, row_words.shape[1]), np.int64)
        differing = np.stack([kernels.differing_bits(codes, row) for row in row_words], axis=1)
        scores = (width - 2.0 * differing) / width * alphas
        return kernels.winners(scores, bias)

    return _with_winner(rows, best(words))


def cosine_scores_in_jvm(rows: DataFrame, bank: np.ndarray, x: str = "x") -> DataFrame:
    """Column form of ``cosine_scores``."""
    unit = vectors.l2_normalize(vectors.as_doubles(F.col(x)))
    dots = [vectors.dot(F.col("_unit"), vectors.literal_vector(row)) for row in kernels.unit_rows(bank)]
    scored = rows.withColumn("_unit", unit).withColumn("_scores", F.array(*dots))
    score, winner = _best_of(F.col("_scores"), 0.0)
    return scored.withColumns({"score": score, "winner": winner}).drop("_unit", "_scores")


def bit_balance(rows: DataFrame, model: HammingModel, x: str = "x") -> DataFrame:
    """One row (n, mean_code): the mean code of every bit; the balance penalty is the mean of its squares."""
    coded = rows.select(kernels.matrix_udf(model.codes)(F.col(x)).alias("code"))
    return vector_moments(coded, (), "code").select("n", F.col("mean").alias("mean_code"))


def sign_similarity(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Hamming similarity of the signs of ``x`` and of ``rows``, for ``blocked_winners``."""
    return kernels.signs(x) @ kernels.signs(rows).T / max(1, rows.shape[1])


def cosine_similarity(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return kernels.unit_rows(x) @ kernels.unit_rows(rows).T


def blocked_winners(rows: DataFrame, bank: DataFrame, similarity=sign_similarity, x: str = "x",
                    block_bytes: int = BLOCK_BYTES, together: int = TOGETHER) -> DataFrame:
    """``rows`` with the score and ``winner`` (row_id) of the best of any number of bank rows (row_id, row[, alpha]).

    Signs without weights: rows that have the code of a bank row are settled by a join, as no similarity is above 1; the others
    meet each different code once. The bank is dealt to blocks of about ``block_bytes`` by row_id and stored so. A task multiplies a batch
    with one block after the other and keeps the best so far, the lowest row_id among equals; rows in this loop never move. Driver and tasks
    hold ``together`` blocks at most: after so many, what has been reached is written and the next pass reads it.
    An empty bank gives a NULL score and winner.
    """
    weighted = "alpha" in bank.columns
    wanted = bank.select("row_id", "row", *(["alpha"] if weighted else []))
    out = rows.withColumn("_best", F.lit(None).cast("struct<score: double, winner: int>"))
    if similarity is sign_similarity and not weighted:
        codes = _distinct_codes(wanted)
        found = codes.agg(F.count(F.lit(1)), F.min("width"), F.max("width")).first()
        if found[0]:
            out = written(_with_equal_code(rows, codes, x), "equal-codes")
            left = out.filter(F.col("_best").isNull())
            if not left.isEmpty():
                if found[1] != found[2]:
                    raise ValueError("vectors must be present and of one length")
                rest = codes.select("row_id", kernels.unpacked_signs(F.col("words"), found[1]).alias("row"))
                size = found[0] * (8 * found[1] + 64)
                out = out.filter(F.col("_best").isNotNull()).unionByName(
                    _best_of_blocks(left, rest, -(-size // block_bytes), similarity, x, together))
    else:
        out = _best_of_blocks(out, wanted, -(-kernels.bank_bytes(wanted) // block_bytes), similarity, x, together)
    return out.withColumns({"score": F.col("_best.score"), "winner": F.col("_best.winner")}).drop("_best")


def _distinct_codes(bank: DataFrame) -> DataFrame:
    """(width, words, row_id): each sign code of a bank once, with the lowest row_id that has it."""
    coded = bank.select("row_id", F.size("row").alias("width"), kernels.sign_words(F.col("row")).alias("words"))
    return written(coded.groupBy("width", "words").agg(F.min("row_id").alias("row_id")), "codes")


def _with_equal_code(rows: DataFrame, codes: DataFrame, x: str) -> DataFrame:
    """``rows`` with ``_best`` where a bank row has the same signs in all places: score 1 and that row_id."""
    same = codes.filter("width > 0").select(F.col("width").alias("_width"), F.col("words").alias("_words"), F.struct(
        F.lit(1.0).alias("score"), F.col("row_id").cast("int").alias("winner")).alias("_best"))
    coded = rows.withColumns({"_width": F.size(x), "_words": kernels.sign_words(F.col(x))})
    return coded.join(same, ["_width", "_words"], "left").select(*rows.columns, "_best")


def _best_of_blocks(out: DataFrame, bank: DataFrame, count: int, similarity, x: str, together: int) -> DataFrame:
    """``out`` with ``_best`` after all ``count`` blocks of ``bank``."""
    if not count:
        return out
    spark, shared = out.sparkSession, []
    stored = written(bank.withColumn("block", F.pmod(F.xxhash64("row_id"), F.lit(count)).cast("int")).repartition("block"),
                     "bank-blocks", by=("block",))
    for number in range(count):
        mine = stored.filter(F.col("block") == number).drop("block").sort("row_id").toArrow().combine_chunks()
        if not mine.num_rows:
            continue
        ids = mine.column("row_id").to_numpy().astype(np.int64)
        matrix = kernels.as_matrix(mine.column("row").combine_chunks())
        alphas = mine.column("alpha").to_numpy() if "alpha" in bank.columns else np.ones(len(ids))
        shared.append(spark.sparkContext.broadcast((ids, matrix, alphas)))
        out = out.withColumn("_best", _better(shared[-1], similarity)(F.col(x), F.col("_best")))
        if len(shared) % together == 0 and number + 1 < count:
            out = written(out, "best-so-far")
            for block in shared[-together:]:
                block.destroy()
    return out


def _better(block, similarity):
    """The better one of what is held so far and the best row of a block."""
    @arrow_udf("struct<score double, winner int>")
    def better(column: pa.Array, held: pa.Array) -> pa.Array:
        if not len(column):
            return pa.array([], pa.struct([("score", pa.float64()), ("winner", pa.int32())]))
        ids, matrix, alphas = block.value
        scores = similarity(kernels.as_matrix(column), matrix) * alphas
        best = scores.argmax(axis=1)
        score, winner = scores[np.arange(len(best)), best], ids[best]
        old = held.field("score").to_numpy(zero_copy_only=False).astype(np.float64)
        old_winner = held.field("winner").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        none = np.asarray(held.is_null())
        keep = ~none & ((old > score) | ((old == score) & (old_winner < winner)))
        return pa.StructArray.from_arrays(
            [pa.array(np.where(keep, old, score)), pa.array(np.where(keep, old_winner, winner).astype(np.int32))], ["score", "winner"])

    return better
