"""Repeated passages: fixed-block anchors, probed by every rolling window, then extended."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probewise.llm import words as w
from probewise.llm.shared import sieve, sifted, whole_text, without
from probewise.workspace import written

WINDOW = 50           # words of a passage that counts as repeated
PER_BUCKET = 1 << 20  # hashes that one bucket gathers on average
PER_ROW = 1 << 19     # words that a task packs into one row per bucket
LAST = (1 << 63) - 1
NO_ID = 1 << 62       # missing ids are numbered from here by a hash of the text, after all others


def _anchor(window: int) -> int:
    """Words of a block: the largest size of which any window holds one whole aligned block."""
    return (window + 1) // 2


class _Packs:
    """Hashes of many documents as one row per bucket: (bucket, ids, counts, hashes, extra)."""

    FIELDS = pa.schema([("bucket", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary()),
                        ("hashes", pa.binary()), ("extra", pa.binary())])
    SCHEMA = "bucket int, ids binary, counts binary, hashes binary, extra binary"

    def __init__(self, buckets: int):
        self.buckets, self.parts, self.size = buckets, [], 0

    def add(self, doc_id: int, keys: np.ndarray, rest: np.ndarray, extra: np.ndarray) -> None:
        """``keys`` decide the bucket; ``rest`` and ``extra`` are what the bucket sees of each hash."""
        self.parts.append((doc_id, keys, rest, extra))
        self.size += len(keys)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        ids = np.array([p[0] for p in self.parts], dtype=np.int64)
        of = np.repeat(np.arange(len(ids)), [len(p[1]) for p in self.parts])
        keys, rest, extra = (np.concatenate([p[k] for p in self.parts]) for k in (1, 2, 3))
        bucket = ((keys & np.uint64(0xFFFFFFFF)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(bucket.astype(np.uint16) if self.buckets <= 1 << 16 else bucket, kind="stable")
        bucket, of, rest, extra = bucket[order], of[order], rest[order], extra[order]
        cuts = np.concatenate((np.flatnonzero(np.diff(bucket, prepend=-1)), [len(bucket)]))
        columns = ([], [], [], [], [])
        for low, high in zip(cuts, cuts[1:]):
            run = np.concatenate((np.flatnonzero(np.diff(of[low:high], prepend=-1)), [high - low]))
            values = (int(bucket[low]), ids[of[low:high][run[:-1]]].tobytes(), np.diff(run).astype(np.uint32).tobytes(),
                      rest[low:high].tobytes(), extra[low:high].tobytes())
            for column, value in zip(columns, values):
                column.append(value)
        self.parts, self.size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, self.FIELDS)], schema=self.FIELDS)


def _opened(table: pa.Table, rest: type, extra: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, hashes and extras of one bucket, a value for each hash."""
    def joined(name: str, kind: type) -> np.ndarray:
        return np.concatenate([np.frombuffer(x.as_py(), dtype=kind) for x in table.column(name)])

    return np.repeat(joined("ids", np.int64), joined("counts", np.uint32)), joined("hashes", rest), joined("extra", extra)


def _digest(words: list[str]) -> str:
    return hashlib.sha256(" ".join(words).encode("utf-8", "surrogatepass")).hexdigest()


def _sequences(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, whole): whole texts as word sequences, by hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests = [], []
            for text in batch.column("text"):  # one text's words at a time
                words = w.words_of(text.as_py())
                sizes.append(len(words))
                digests.append(_digest(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, type=pa.int64()), pa.array(digests, type=pa.string())],
                names=["doc_id", "n_words", "whole"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, whole string")


def _with(docs: DataFrame, values: DataFrame) -> DataFrame:
    """Inner join of ``docs`` and ``values`` on doc_id; texts that cannot match stay where they are."""
    words, bits = sieve(values.select("doc_id"))
    return sifted(docs, words, bits, [F.col("doc_id")]).filter("candidate").drop("candidate").join(values, "doc_id")


def _anchor_hits(docs: DataFrame, window: int, buckets: int) -> DataFrame:
    """(doc_id, hashes): anchors of each document that tie it to another.

    Every run of ``anchor`` words is a probe; those at multiples of the block are the index
    too. A document keeps a probe if the same block is indexed by a smaller id, and a block of
    its own if a larger id probes it.
    """
    size = _anchor(window)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs = _Packs(buckets)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                hashes = w.runs(w.hashed(w.words_of(text.as_py())), size)
                if len(hashes) > window - size:
                    block = np.zeros(len(hashes), dtype=np.uint8)
                    block[::size] = 1
                    packs.add(doc_id, hashes, (hashes >> np.uint64(32)).astype(np.uint32), block)
                if packs.size >= PER_ROW:
                    yield from packs.rows()
        yield from packs.rows()

    def meet(table: pa.Table) -> pa.Table:
        ids, rest, block = _opened(table, np.uint32, np.uint8)
        order = np.argsort(rest, kind="stable")
        ids, rest, block = ids[order], rest[order], block[order] == 1
        starts = np.flatnonzero(np.diff(rest, prepend=rest[0] ^ np.uint32(1)))
        sizes = np.diff(np.append(starts, len(rest)))
        owner = np.repeat(np.minimum.reduceat(np.where(block, ids, LAST), starts), sizes)
        latest = np.repeat(np.maximum.reduceat(ids, starts), sizes)
        hit = (owner < ids) | block & (latest > ids)
        ids, rest = ids[hit], rest[hit].astype(np.int64) << np.int64(31)
        order = np.argsort(ids, kind="stable")
        ids, rest = ids[order], rest[order]
        starts = np.concatenate((np.flatnonzero(np.diff(ids, prepend=-1)), [len(ids)])) if len(ids) else np.zeros(1, np.int64)
        key = rest | np.int64(table.column("bucket")[0].as_py())
        lists = pa.ListArray.from_arrays(pa.array(starts, type=pa.int32()), pa.array(key, type=pa.int64()))
        return pa.table({"doc_id": pa.array(ids[starts[:-1]], type=pa.int64()), "anchors": lists})

    return docs.select("doc_id", "text").mapInArrow(pack, _Packs.SCHEMA).groupBy("bucket").applyInArrow(
        meet, "doc_id long, anchors array<long>")


def _window_hits(docs: DataFrame, window: int, buckets: int, anchor_buckets: int) -> DataFrame:
    """(doc_id, starts): windows around the anchors of ``docs`` (doc_id, text, anchors) that also start in a
    document with a smaller id. Both documents of a repeat have anchors in it, so the extension
    compares windows by hash and needs no pairs of documents."""
    size = _anchor(window)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs = _Packs(buckets)
        for batch in batches:
            for doc_id, text, anchors in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("anchors")):
                hashes = w.hashed(w.words_of(text.as_py()))
                probes = w.runs(hashes, size)
                bucket = (probes & np.uint64(0xFFFFFFFF)) * np.uint64(anchor_buckets) >> np.uint64(32)
                keys = (probes >> np.uint64(32)).astype(np.int64) << np.int64(31) | bucket.astype(np.int64)
                at = np.flatnonzero(np.isin(keys, np.concatenate([x.values.to_numpy() for x in anchors if x.is_valid])))
                marks = np.zeros(len(hashes) + 2, dtype=np.int64)
                np.add.at(marks, np.maximum(at - (window - size), 0), 1)
                np.add.at(marks, at + 1, -1)
                starts = np.flatnonzero(np.cumsum(marks)[:max(0, len(hashes) - window + 1)] > 0)
                if len(starts):
                    one = w.runs(hashes, window)[starts]
                    other = w.runs(w.mixed(hashes ^ np.uint64(0x5851F42D4C957F2D)), window)[starts]
                    extra = np.empty(len(starts), dtype=[("more", np.uint64), ("at", np.uint32)])
                    extra["more"], extra["at"] = other, starts
                    packs.add(doc_id, one, one, extra)
                if packs.size >= PER_ROW:
                    yield from packs.rows()
        yield from packs.rows()

    def meet(table: pa.Table) -> pa.Table:
        ids, one, extra = _opened(table, np.uint64, [("more", np.uint64), ("at", np.uint32)])
        order = np.lexsort((extra["more"], one))
        ids, one, more, at = ids[order], one[order], extra["more"][order], extra["at"][order]
        new = np.ones(len(one), dtype=bool)
        new[1:] = (one[1:] != one[:-1]) | (more[1:] != more[:-1])
        starts = np.flatnonzero(new)
        first = np.repeat(np.minimum.reduceat(ids, starts), np.diff(np.append(starts, len(one))))
        hit = first < ids
        ids, at = ids[hit], at[hit]
        order = np.argsort(ids, kind="stable")
        ids, at = ids[order], at[order]
        starts = np.concatenate((np.flatnonzero(np.diff(ids, prepend=-1)), [len(ids)])) if len(ids) else np.zeros(1, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(starts, type=pa.int32()), pa.array(at.astype(np.int32), type=pa.int32()))
        return pa.table({"doc_id": pa.array(ids[starts[:-1]], type=pa.int64()), "starts": lists})

    return docs.mapInArrow(pack, _Packs.SCHEMA).groupBy("bucket").applyInArrow(meet, "doc_id long, starts array<int>")


def _kept(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, n_removed, kept) of ``docs`` (doc_id, text, starts): maximal repeats are taken out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, kept = [], []
            for text, lists in zip(batch.column("text"), batch.column("starts")):
                words = w.words_of(text.as_py())
                cover = np.zeros(len(words) + 1, dtype=np.int64)
                for starts in lists:
                    at = starts.values.to_numpy()
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + window, -1)
                gone = np.cumsum(cover[:-1]) > 0
                removed.append(int(gone.sum()))
                kept.append(_digest([x for x, g in zip(words, gone.tolist()) if not g]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(removed, type=pa.int64()), pa.array(kept, type=pa.string())],
                names=["doc_id", "n_removed", "kept"])

    return docs.mapInArrow(run, "doc_id long, n_removed long, kept string")


def repeats_removed(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of ``docs``.

    A word goes if a window of ``window`` words over it also starts in a document with a
    smaller doc_id. Texts with equal word sequences are settled first: all but the smallest id
    lose every word (if they have a window at all) and take no part in the search. The others
    are cut into hashes that meet in buckets, as packed arrays; buckets grow in number with the input.

    A missing text has no words. A missing id comes after all others, by a hash of the text among
    themselves; rows with equal id and words are alike, and none of them is smaller, so
    they remove nothing from each other. Different texts must not share an id, and ids are
    below 2^62. No rows give none. Other columns are not read.
    """
    no_id = F.lit(NO_ID) + F.pmod(F.xxhash64("text"), F.lit(NO_ID))
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), no_id).alias("doc_id"), whole_text().alias("text"))
    rows = written(_sequences(texts), "sequences")
    long = rows.filter(F.col("n_words") >= window)
    firsts = written(long.groupBy("whole").agg(F.min("doc_id").alias("first")), "first-sequences")
    judged = rows.join(firsts, "whole", "left")
    copies = judged.filter("first < doc_id").select("doc_id").distinct()
    originals = without(texts, written(copies, "copied-sequences"), "doc_id")

    total = int(long.agg(F.sum("n_words")).first()[0] or 0)
    buckets = total // PER_BUCKET + 1
    anchors = written(_anchor_hits(originals, window, buckets), "anchors")
    hits = int(anchors.agg(F.sum(F.size("anchors"))).first()[0] or 0)
    by_doc = anchors.groupBy("doc_id").agg(F.collect_list("anchors").alias("anchors"))
    tied = _with(originals, by_doc).select("doc_id", "text", "anchors")
    starts = written(_window_hits(tied, window, hits // PER_BUCKET * 2 + 1, buckets), "repeated-windows")
    covered = starts.groupBy("doc_id").agg(F.collect_list("starts").alias("starts"))
    cut = written(_kept(_with(originals, covered).select("doc_id", "text", "starts"), window).dropDuplicates(["doc_id"]), "cut")
    is_copy = F.col("first").isNotNull() & (F.col("first") < F.col("doc_id"))
    return judged.join(cut, "doc_id", "left").select(
        F.when(F.col("doc_id") < NO_ID, F.col("doc_id")).alias("doc_id"), "n_words",
        F.when(is_copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(is_copy, F.lit(_digest([]))).otherwise(F.coalesce("kept", "whole")).alias("kept_sha256"))
