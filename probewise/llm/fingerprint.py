"""Context-triggered piecewise hashes: chunk signatures at content-defined boundaries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from probewise.llm.shared import whole_text
from probewise.workspace import written

WINDOW = 7      # code points that decide a boundary
LONGEST = 64    # characters of a signature at most
RUN = 3         # equal chunks in a row that a signature shows
GRAM = 4        # signatures that share no run of so many chunks are unlike
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_CODES = np.frombuffer(ALPHABET.encode(), dtype=np.uint8)
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, grown as texts need them."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            size = 1 << (n + 1).bit_length()
            inverse = pow(_BASE, -1, 1 << 64)
            ones = np.ones(size, dtype=np.uint64)
            self.up, self.down = ones.copy(), ones.copy()
            self.up[1:], self.down[1:] = np.uint64(_BASE), np.uint64(inverse)
            np.multiply.accumulate(self.up, out=self.up)
            np.multiply.accumulate(self.down, out=self.down)
        return self.up, self.down


_POWERS = _Powers()


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def fingerprint(points: np.ndarray) -> str:
    """``block:signature:signature of twice the block`` of the whole text.

    A boundary follows each place where the hash of the last seven code points ends in
    enough one bits, so boundaries of a block size include those of twice that size. Longer runs
    of one chunk count as three. The block is the smallest of at least a 128th of the
    text whose signature has at most 64 characters.
    """
    n = len(points)
    if not n:
        return "1::"
    mixed = points * np.uint32(2654435761)
    mixed ^= mixed >> np.uint32(15)
    roll, factor = mixed.copy(), 1
    for back in range(1, min(WINDOW, n)):
        factor = factor * 0x01000193 & 0xFFFFFFFF
        roll[back:] += mixed[:-back] * np.uint32(factor)
    roll ^= roll >> np.uint32(16)
    roll *= np.uint32(0x85EBCA6B)
    roll ^= roll >> np.uint32(13)
    up, down = _POWERS.upto(n)
    sums = np.cumsum(mixed.astype(np.uint64) * up[:n], dtype=np.uint64)

    def cuts(size: int) -> np.ndarray:
        ends = roll[:-1] & np.uint32(size - 1) == size - 1
        return np.flatnonzero(ends) if size < 1 << 31 else np.zeros(0, dtype=np.int64)

    def signature(at: np.ndarray) -> str:
        ends = np.append(at, n - 1)
        begins = np.concatenate((np.zeros(1, dtype=np.int64), at + 1))
        before = np.where(begins > 0, sums[begins - 1], np.uint64(0))
        chunk = (sums[ends] - before) * down[begins]
        chunk ^= chunk >> np.uint64(29)
        chunk *= np.uint64(0xBF58476D1CE4E5B9)
        shown = (chunk >> np.uint64(58)).astype(np.int64)
        if len(shown) > RUN:
            equal = shown[1:] == shown[:-1]
            run = np.ones(len(shown), dtype=bool)
            run[RUN:] = ~(equal[RUN - 1:] & equal[RUN - 2:-1] & equal[RUN - 3:-2])
            shown = shown[run]
        return _CODES[shown].tobytes().decode()

    block = 1 << max(0, (n // (2 * LONGEST)).bit_length())
    first = signature(cuts(block))
    while len(first) > LONGEST:
        block *= 2
        first = signature(cuts(block))
    return f"{block}:{first}:{signature(cuts(2 * block))}"


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest one, a word of bits for each step."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def _score(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    if min(len(a), len(b)) >= GRAM:
        grams = {a[i:i + GRAM] for i in range(len(a) - GRAM + 1)}
        if not any(b[i:i + GRAM] in grams for i in range(len(b) - GRAM + 1)):
            return 0.0
    return 2.0 * common_subsequence(a, b) / (len(a) + len(b))


def likeness(one: str, other: str) -> float:
    """1 less the share of chunks an edit from one signature to the other inserts or deletes,
    at the block sizes both have; 0 when they have none in common."""
    if one == other:
        return 1.0
    (x, x1, x2), (y, y1, y2) = one.split(":"), other.split(":")
    x, y = int(x), int(y)
    if x == y:
        return max(_score(x1, y1), _score(x2, y2))
    if x == 2 * y:
        return _score(x1, y2)
    return _score(x2, y1) if y == 2 * x else 0.0


def edited(points: np.ndarray, following: np.ndarray) -> np.ndarray:
    """The last third replaced by as many of the first code points of ``following``."""
    third = len(points) // 3
    return np.concatenate((points[:len(points) - third], following[:third]))


def _described(doc_id, text: str, own: str, after: str, after_print: str) -> tuple:
    points = codes(text)
    changed = edited(points, codes(after))
    changed_print = fingerprint(changed)
    digest = hashlib.sha256(changed.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "replace")).hexdigest()
    return (doc_id, len(points), digest, own, changed_print, likeness(own, changed_print), likeness(own, after_print))


_RESULT = ("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, with their likeness and that to the next document.

    Documents are dealt by range of descending doc_id and sorted inside a partition, so each
    finds its successor in the row after it; only the last row of a partition needs the
    first of the next, and those few are joined afterwards. Texts move once.

    A missing text is empty; ids may be missing (they come last) or repeat (then the order
    among them is by text); a single document follows itself; no rows give none.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    ordered = (
        docs.select("doc_id", whole_text().alias("text"), F.xxhash64("text").alias("tie"))
        .repartitionByRange(F.col("doc_id").desc_nulls_last(), F.col("tie").desc())
        .sortWithinPartitions(F.col("doc_id").desc_nulls_last(), F.col("tie").desc()).drop("tie"))
    schema = f"doc_id {kind}, {_RESULT}, part int, edge string, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, out, fields = TaskContext.get().partitionId(), None, [], None
        for batch in batches:
            if fields is None:
                fields = _fields(batch.schema.field("doc_id").type, edges=True)
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py()
                own = fingerprint(codes(text))
                if held is None:
                    out.append((doc_id, None, None, own, None, None, None, part, "first", text))
                else:
                    out.append((*_described(*held, text, own), part, None, None))
                held = (doc_id, text, own)
            yield _batch(out, fields)
            out = []
        if held is not None:
            yield _batch([(held[0], None, None, held[2], None, None, None, part, "last", held[1])], fields)

    rows = written(ordered.mapInArrow(run, schema), "fingerprints")
    edges = rows.filter("edge is not null")
    by_part = written(edges.groupBy("part").agg(  # one row per partition
        F.first(F.when(F.col("edge") == "last", F.struct("doc_id", "text", "fingerprint")), True).alias("last"),
        F.first(F.when(F.col("edge") == "first", F.struct("text", "fingerprint")), True).alias("head")), "fingerprint-edges")
    order = W.orderBy("part")
    following = by_part.select("part").withColumn("next_part", F.coalesce(  # numbers only are put in order; texts are joined by them
        F.lead("part").over(order), F.first("part").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))))
    heads = by_part.select(F.col("part").alias("next_part"), F.col("head").alias("after"))
    seams = by_part.select("part", "last").join(following, "part").join(heads, "next_part")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = _fields(batch.schema.field("doc_id").type, edges=False)
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "text", "own", "next_text", "next_own")]
            yield _batch([_described(*row) for row in zip(*columns)], fields)

    finished = seams.select(
        F.col("last.doc_id").alias("doc_id"), "last.text", F.col("last.fingerprint").alias("own"),
        F.col("after.text").alias("next_text"), F.col("after.fingerprint").alias("next_own"),
    ).mapInArrow(finish, f"doc_id {kind}, {_RESULT}")
    return rows.filter("edge is null").drop("part", "edge", "text").unionByName(finished)


def _fields(doc_id: pa.DataType, edges: bool) -> pa.Schema:
    fields = [("doc_id", doc_id), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
              ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
    return pa.schema(fields + [("part", pa.int32()), ("edge", pa.string()), ("text", pa.string())] * edges)


def _batch(rows: list[tuple], fields: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, fields)], schema=fields)
