"""Hard negatives of anchor vectors: Strassen products of integer tiles, then mergeable heaps."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probewise.workspace import written

SCALE = 256           # components become floor(SCALE * x)
POSITIVES = 5         # best rows of the anchor's label
NEGATIVES = 5         # best rows of other labels in a positive's window
LEAST_SHARE = 80      # a window reaches from this percentage of the positive's score to all of it
TILE = 1024           # candidates multiplied at once
ANCHORS = 256         # anchors multiplied at once
LEAF = 32             # sides up to this are multiplied directly
BLOCK_BYTES = 32 << 20  # anchors of one pass, as int64 components: what is broadcast
SAFE = 1 << 60        # scores stay below, so that windows fit 64 bits


def _even(x: np.ndarray) -> np.ndarray:
    return np.pad(x, ((0, x.shape[0] % 2), (0, x.shape[1] % 2))) if x.shape[0] % 2 or x.shape[1] % 2 else x


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` of int64 matrices by seven half-size products a level; odd sides get a row or column of zeros.

    Sums may pass 64 bits on the way: they wrap, and since only sums, differences and products
    occur, the result is exact whenever it fits 64 bits itself.
    """
    if min(*a.shape, b.shape[1]) <= leaf:
        return a @ b
    rows, columns = a.shape[0], b.shape[1]
    a, b = _even(a), _even(b)
    i, k, j = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :k], a[:i, k:], a[i:, :k], a[i:, k:]
    b11, b12, b21, b22 = b[:k, :j], b[:k, j:], b[k:, :j], b[k:, j:]
    m1 = strassen(a11 + a22, b11 + b22, leaf)
    m2 = strassen(a21 + a22, b11, leaf)
    m3 = strassen(a11, b12 - b22, leaf)
    m4 = strassen(a22, b21 - b11, leaf)
    m5 = strassen(a11 + a12, b22, leaf)
    m6 = strassen(a21 - a11, b11 + b12, leaf)
    m7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * j), dtype=np.int64)
    out[:i, :j] = m1 + m4 - m5 + m7
    out[:i, j:] = m3 + m5
    out[i:, :j] = m2 + m4
    out[i:, j:] = m1 - m2 + m3 + m6
    return out[:rows, :columns]


class Heaps:
    """For each of ``n`` owners the best ``k`` (score, id): higher scores first, ties by smaller id.

    An (owner, score, id) given twice counts once, so heaps of any stretches of rows merge, in any order and
    also where stretches overlap.
    """

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.score = np.zeros((n, k), dtype=np.int64)
        self.id = np.zeros((n, k), dtype=np.int64)
        self.used = np.zeros(n, dtype=np.int64)

    def admits(self, owners: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which entries may enter: those of owners with room, or ahead of the last one held."""
        last, at = self.score[owners, -1], self.id[owners, -1]
        return (self.used[owners] < self.k) | (scores > last) | (scores == last) & (ids < at)

    def floors(self) -> np.ndarray:
        """The least score that can still enter, by owner."""
        return np.where(self.used < self.k, np.iinfo(np.int64).min, self.score[:, -1])

    def add(self, owners: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = self.admits(owners, scores, ids)
        owners, scores, ids = owners[keep], scores[keep], ids[keep]
        if not len(owners):
            return
        touched = np.unique(owners)
        held = np.arange(self.k)[None, :] < self.used[touched][:, None]
        owners = np.concatenate((np.repeat(touched, held.sum(axis=1)), owners))
        scores = np.concatenate((self.score[touched][held], scores))
        ids = np.concatenate((self.id[touched][held], ids))
        order = np.lexsort((ids, -scores, owners))
        owners, scores, ids = owners[order], scores[order], ids[order]
        new = np.ones(len(owners), dtype=bool)
        new[1:] = (owners[1:] != owners[:-1]) | (scores[1:] != scores[:-1]) | (ids[1:] != ids[:-1])
        owners, scores, ids = owners[new], scores[new], ids[new]
        first = np.searchsorted(owners, touched)
        place = np.arange(len(owners)) - np.repeat(first, np.diff(np.append(first, len(owners))))
        best = place < self.k
        self.score[owners[best], place[best]] = scores[best]
        self.id[owners[best], place[best]] = ids[best]
        self.used[touched] = np.minimum(self.k, np.diff(np.append(first, len(owners))))

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(owner, score, id) of all that is held."""
        owner, place = np.nonzero(np.arange(self.k)[None, :] < self.used[:, None])
        return owner, self.score[owner, place], self.id[owner, place]


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of an int64 list array, filled up with zeros to ``width``."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def usable_rows(vectors: DataFrame, relabelled: Column | None = None) -> DataFrame:
    """(vec_id, label, q): integer components of the rows that take part.

    ``relabelled`` is the label to use instead of the one given.
    """
    x = F.transform("embedding", lambda v: v.cast("double"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    label = F.col("label") if relabelled is None else relabelled
    return (
        vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
        .select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"),
                F.transform(x, lambda v: F.floor(v * SCALE)).alias("q")))


def _blocks(rows: DataFrame, anchors: Column, block_bytes: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, components) of the anchors, in blocks of about ``block_bytes``, each id once.

    Anchors are dealt to blocks by a hash, so the driver holds one block at a time.
    """
    size = F.size("q")
    most = F.max(F.greatest(F.array_max(F.transform("q", lambda v: F.abs(v))), F.lit(0)))
    known = rows.agg(F.max(size).alias("width"), most.alias("most")).first()
    width = max(1, known["width"] or 0)
    if width * (known["most"] or 0) ** 2 >= SAFE:
        raise ValueError(f"components up to {known['most']} in {width} dimensions: scores would pass 64 bits")
    own = written(rows.filter(anchors).groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("one")).select("vec_id", "one.*"), "anchors")
    count = -(-own.count() * width * 8 // block_bytes)
    for block in range(count):
        mine = F.pmod(F.xxhash64("vec_id"), F.lit(count)) == block
        got = own.filter(mine).sort("vec_id").toArrow().combine_chunks().to_batches()
        if got:
            batch = got[0]
            yield batch.column("vec_id").to_numpy(), batch.column("label").to_numpy(), _matrix(batch.column("q"), width)


def _tiles(batches: Iterator[pa.RecordBatch], block) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchors, candidate ids, labels, scores) of every tile of a task's rows."""
    _, _, own = block
    for batch in batches:
        for low in range(0, batch.num_rows, TILE):
            part = batch.slice(low, TILE)
            ids, labels = part.column("vec_id").to_numpy(), part.column("label").to_numpy()
            q = np.ascontiguousarray(_matrix(part.column("q"), own.shape[1]).T)
            for at in range(0, len(own), ANCHORS):
                yield slice(at, min(at + ANCHORS, len(own))), ids, labels, strassen(own[at:at + ANCHORS], q)


def _positives(rows: DataFrame, block, k: int) -> DataFrame:
    """(anchor, score, vec_id): the first ``k`` other rows of each anchor's label, from heaps of each task."""
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_ids, own_labels, _ = shared.value
        heaps = Heaps(len(own_ids), k)
        for at, ids, labels, scores in _tiles(batches, shared.value):
            fits = (scores >= heaps.floors()[at, None]) & (labels[None, :] == own_labels[at, None]) & (ids[None, :] != own_ids[at, None])
            owner, column = np.nonzero(fits)
            heaps.add(owner + at.start, scores[owner, column], ids[column])
        owner, score, ids = heaps.entries()
        yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(score), pa.array(ids)], names=["anchor", "score", "vec_id"])

    best = rows.mapInArrow(run, "anchor long, score long, vec_id long").distinct()
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def _negatives(rows: DataFrame, block, positives: pa.Table, k: int, least_share: int) -> DataFrame:
    """(pair, score, vec_id, rank): the first ``k`` rows of another label in the window of each of ``positives``.

    ``positives`` (anchor, score, vec_id) belongs to the block and is as bounded as the block; pairs are numbered in its order.
    """
    anchor, top = positives.column("anchor").to_numpy(), positives.column("score").to_numpy()
    least = -(-top * least_share // 100)
    open_ = np.flatnonzero(least <= top)  # below zero the window is empty
    shared = rows.sparkSession.sparkContext.broadcast((block, anchor[open_], least[open_], top[open_], open_))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given, owners, low, high, numbers = shared.value
        heaps = Heaps(len(owners), k)
        order = np.argsort(owners, kind="stable")
        starts = np.searchsorted(owners[order], np.arange(len(given[0]) + 1))
        widest = np.full(len(given[0]), np.iinfo(np.int64).max)
        np.minimum.at(widest, owners, low)
        highest = np.full(len(given[0]), np.iinfo(np.int64).min)
        np.maximum.at(highest, owners, high)
        for at, ids, labels, scores in _tiles(batches, given):
            near = (scores >= widest[at, None]) & (scores <= highest[at, None]) & (labels[None, :] != given[1][at, None])
            owner, column = np.nonzero(near)
            if not len(owner):
                continue
            found, pair_count = scores[owner, column], starts[owner + at.start + 1] - starts[owner + at.start]
            which = np.repeat(np.arange(len(owner)), pair_count)
            pair = order[np.arange(len(which)) - np.repeat(np.cumsum(pair_count) - pair_count, pair_count)
                         + np.repeat(starts[owner + at.start], pair_count)]
            inside = (found[which] >= low[pair]) & (found[which] <= high[pair])
            heaps.add(pair[inside], found[which][inside], ids[column][which][inside])
        pair, score, ids = heaps.entries()
        yield pa.RecordBatch.from_arrays([pa.array(numbers[pair]), pa.array(score), pa.array(ids)], names=["pair", "score", "vec_id"])

    best = rows.mapInArrow(run, "pair long, score long, vec_id long").distinct()
    order = Window.partitionBy("pair").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchors: Column, relabelled: Column | None = None, positives: int = POSITIVES,
                   negatives: int = NEGATIVES, least_share: int = LEAST_SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors`` picks the anchors by ``vec_id``. Scores are integer inner products of floor(256 x). Each task multiplies tiles of its rows with
    the anchors and keeps heaps only, so what is shuffled are the ``positives`` (then ``negatives``) best of each task and anchor; the
    vectors never move. Anchors take turns in blocks of ``block_bytes``, the only thing broadcast or brought to the driver
    besides a block's positives, and each block's result is written.

    Rows without id, label, vector or with a missing or non-finite component take no part. Vectors may differ in
    length: missing components count as zero, and an empty vector scores 0 with all. Equal scores go by smaller id.
    ``vec_id`` names a row: a row repeated whole counts once, and no row with the anchor's id is its positive or negative
    (of several vectors under one anchor's id, the least is taken). An anchor without a row of its label, and a positive
    whose window is empty (always below zero), give no rows; no rows give none. Components so large that
    a score could pass 2^60 are refused. Columns other than vec_id, label and embedding are not read.
    """
    spark = vectors.sparkSession
    rows = written(usable_rows(vectors, relabelled), "vectors")
    results = []
    for block in _blocks(rows, anchors, block_bytes):
        found = _positives(rows, block, positives).select("anchor", "score", "vec_id").toArrow().sort_by([("anchor", "ascending")])
        ids = pa.array(block[0])
        pairs = pa.table({
            "pair": np.arange(found.num_rows), "anchor_id": ids.take(found.column("anchor").combine_chunks()),
            "positive_id": found.column("vec_id"), "positive_score": found.column("score")})
        named = spark.createDataFrame(pairs)
        best = _negatives(rows, block, found, negatives, least_share)
        results.append(written(
            best.join(F.broadcast(named), "pair").select(
                "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
                "positive_score", F.col("score").alias("negative_score")), "negatives"))
    if not results:
        none = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        return spark.createDataFrame([], none)
    return reduce(DataFrame.unionByName, results)
