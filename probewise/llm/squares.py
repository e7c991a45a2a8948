"""Periodic runs of words, found online: catchers over power-of-two blocks meet the words appended after them."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from probewise.llm import words as w
from probewise.llm.shared import whole_text

LEAST = 6             # words of a run, at least
EXPONENT = 4          # periods of a run, at least
STREAM = 1 << 16      # words of short texts that are read as one sequence, and of one append to a long text
_SEPARATOR = 1 << 40  # numbers from here stand between texts, each once

Looped = Callable[[object, int], "np.ndarray | None"]


class Catchers:
    """Squares of a growing sequence of numbered words, merged into runs.

    For each power of two B, every completed block of B words at a multiple of B catches squares whose period
    is 2B-1 to 4B-2: the left half of such a square holds a complete block, which comes
    again one period later. So each appended word ends two comparisons a level, of the B words before it with the
    blocks of that distance. A block that comes again is extended to the left and to the right by comparing suffixes and
    prefixes in halving steps; if equal words reach at least a period, squares have been caught, and as all squares of
    one unbroken stretch have the same ends, they are one run. Stretches that reach the last word stay open,
    and the next append goes on from there.

    Every level keeps one hash for each position: memory is 8 bytes times words times levels of one sequence.
    """

    def __init__(self, least: int = LEAST, exponent: int = EXPONENT, longest: int | None = None) -> None:
        """``longest`` bounds the length of a text in the sequence, if known: it limits the levels."""
        self.least, self.exponent, self.longest = least, max(2, exponent), longest
        self.size, self.watched = 0, 0  # words, levels whose catchers have met all of them
        self.levels: list[np.ndarray] = [np.zeros(0, dtype=np.uint64)]
        self.open = np.zeros((0, 3), dtype=np.int64)   # start, end, period
        self.closed: list[np.ndarray] = []

    def append(self, values: np.ndarray, upto: Callable[[int], int] | None = None) -> None:
        """Append numbered words; ``upto(words)`` says where texts of at least so many words end, if short texts follow long ones."""
        before, self.size = self.size, self.size + len(values)
        self.levels[0] = np.concatenate((self.levels[0], w.mixed(values.astype(np.uint64) + w.ODD)))
        most = self.size if self.longest is None else min(self.size, self.longest)
        hits, block, level = [np.zeros((0, 2), dtype=np.int64)], 1, 0
        while self.exponent * (2 * block - 1) <= most:
            if level == len(self.levels):
                self.levels.append(np.zeros(0, dtype=np.uint64))
            self._grow(level, block)
            end = self.size if upto is None else upto(self.exponent * (2 * block - 1))
            since = max(0, before - block + 1) if level < self.watched else 0
            hits.append(self._caught(level, block, since, min(self.size, end) - block + 1))
            block, level = 2 * block, level + 1
        self.watched = level
        stretches = np.unique(np.concatenate((self._continued(before), self._extended(np.concatenate(hits)))), axis=0)
        reaches = stretches[:, 1] == self.size
        self.open = stretches[reaches]
        self.closed.append(self._runs_among(stretches[~reaches]))

    def runs(self) -> np.ndarray:
        """(start, length, period) of all runs so far, by start, then period.

        Stretches with the same ends are one run under multiples of its period: the smallest stays.
        """
        all_of = np.concatenate((*self.closed, self._runs_among(self.open)))
        order = np.lexsort((all_of[:, 2], all_of[:, 1], all_of[:, 0]))
        all_of = all_of[order]
        first = np.ones(len(all_of), dtype=bool)
        first[1:] = (all_of[1:, :2] != all_of[:-1, :2]).any(axis=1)
        out = all_of[first]
        out = np.column_stack((out[:, 0], out[:, 1] - out[:, 0], out[:, 2]))
        return out[np.lexsort((out[:, 2], out[:, 0]))]

    def _runs_among(self, stretches: np.ndarray) -> np.ndarray:
        length = stretches[:, 1] - stretches[:, 0]
        return stretches[length >= np.maximum(self.least, self.exponent * stretches[:, 2])]

    def _grow(self, level: int, block: int) -> None:
        """Hashes of the new runs of ``block`` words, each from two of half the size."""
        if level == 0:
            return
        have, half, total = len(self.levels[level]), block // 2, self.size - block + 1
        if total > have:
            below = self.levels[level - 1]
            fresh = w.mixed(below[have:total] * w.ODD + below[have + half:total + half])
            self.levels[level] = np.concatenate((self.levels[level], fresh))

    def _caught(self, level: int, block: int, low: int, high: int) -> np.ndarray:
        """(position, period) where a block comes again, at positions from ``low`` to ``high``."""
        hashes, found = self.levels[level], []
        at = np.arange(max(low, 2 * block - 1), max(low, 2 * block - 1, high))
        nearest = (at - (2 * block - 1)) // block * block
        for back in (0, block):
            catcher = nearest - back
            hit = hashes[at] == hashes[np.maximum(catcher, 0)]
            if back:
                hit &= catcher >= 0
            hit = np.flatnonzero(hit)
            found.append(np.column_stack((at[hit], at[hit] - catcher[hit])))
        return np.concatenate(found)

    def _continued(self, before: int) -> np.ndarray:
        held = self.open
        ahead = self._alike_after(np.full(len(held), before) - held[:, 2], np.full(len(held), before))
        return np.column_stack((held[:, 0], held[:, 1] + ahead, held[:, 2]))

    def _extended(self, hits: np.ndarray) -> np.ndarray:
        """(start, end, period) of the stretches around ``hits`` that hold a square, or reach the last word."""
        at, period = hits[:, 0], hits[:, 1]
        ends = at + self._alike_after(at - period, at)
        starts = at - period - self._alike_before(at - period, at)
        some = (ends - starts >= 2 * period) | (ends == self.size)
        return np.column_stack((starts, ends, period))[some]

    def _alike_after(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        """How many words from ``one`` equal those from ``other`` (the later position)."""
        out = np.zeros(len(one), dtype=np.int64)
        for level, again in self._steps():
            hashes, step = self.levels[level], 1 << level
            live = np.arange(len(one))
            while len(live):
                live = live[other[live] + out[live] + step <= self.size]
                live = live[hashes[one[live] + out[live]] == hashes[other[live] + out[live]]]
                out[live] += step
                if not again:
                    break
        return out

    def _alike_before(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        """How many words before ``one`` (the earlier position) equal those before ``other``."""
        out = np.zeros(len(one), dtype=np.int64)
        for level, again in self._steps():
            hashes, step = self.levels[level], 1 << level
            live = np.arange(len(one))
            while len(live):
                live = live[one[live] - out[live] >= step]
                live = live[hashes[one[live] - out[live] - step] == hashes[other[live] - out[live] - step]]
                out[live] += step
                if not again:
                    break
        return out

    def _steps(self) -> Iterator[tuple[int, bool]]:
        """Levels from the highest, which may be used again and again, down to single words."""
        full = [k for k, hashes in enumerate(self.levels) if len(hashes) == self.size - (1 << k) + 1]
        for k in reversed(full):
            yield k, k == full[-1]


def runs_of(texts: list[np.ndarray], least: int = LEAST, exponent: int = EXPONENT) -> list[np.ndarray]:
    """Runs (start, length, period) of each of ``texts`` (numbered words), longest texts first.

    All are one sequence; a number that occurs once stands between two texts, so no run reaches across.
    """
    if len(texts) == 1:
        catchers = Catchers(least, exponent)
        for low in range(0, len(texts[0]), STREAM):
            catchers.append(texts[0][low:low + STREAM])
        return [catchers.runs()]
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    joined = np.concatenate([x for k, t in enumerate(texts) for x in (t, [_SEPARATOR + k])]) if texts else np.zeros(0, dtype=np.int64)
    ends = np.append(0, starts + sizes)

    def upto(words: int) -> int:
        return int(ends[np.searchsorted(-sizes, -words, side="right")])

    catchers = Catchers(least, exponent, int(sizes.max(initial=0)))
    catchers.append(joined.astype(np.int64), upto)
    runs = catchers.runs()
    owner = np.searchsorted(starts, runs[:, 0], side="right") - 1
    runs[:, 0] -= starts[owner]
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [runs[a:b] for a, b in zip(cuts, cuts[1:])]


def looped(doc_id: object, n: int) -> np.ndarray | None:
    """Which word stands at each place after the end of a text has been made periodic; None where it stays.

    A tenth of the ids (by crc32) is changed; a missing id never.
    """
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % p
    return places


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _described(doc_id: object, words: list[str], runs: np.ndarray) -> tuple:
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs.tolist())
    if not len(runs):
        return doc_id, 0, None, None, None, None, _sha(listed), _sha(" ".join(words))
    start, length, period = min(runs.tolist(), key=lambda r: (-r[1], r[0], r[2]))
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(change)[:-1] == 0
    text = " ".join([word for word, stays in zip(words, kept.tolist()) if stays])
    return doc_id, len(runs), start, length, period, 1000 * length // period, _sha(listed), _sha(text)


def periodic_runs(docs: DataFrame, places: Looped | None = None, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256 for every row of ``docs``.

    A run is a stretch of words with smallest period q, of at least ``least`` words and ``exponent`` times q, that no
    neighbouring word extends. The longest is given (of equally long ones the first, then that of the smaller period), the others go into
    the digest; the collapsed text keeps the first period of each run only. ``places(doc_id, n)`` may rearrange the
    words of a text before it is read. Nothing is shuffled; a task holds ``STREAM`` words of
    short texts, or one long text.

    A missing text is empty, a text without words or runs has no run (four nulls and the digest of nothing); a missing id stays missing;
    rows repeated whole give equal rows; no rows give none. Other columns are not read.
    """
    def numbered(rows: list[tuple]) -> Iterator[tuple]:
        rows.sort(key=lambda r: -len(r[1]))
        numbers: dict[str, int] = {}
        texts = [np.fromiter((numbers.setdefault(x, len(numbers)) for x in words), dtype=np.int64, count=len(words)) for _, words in rows]
        for (doc_id, words), runs in zip(rows, runs_of(texts, least, exponent)):
            yield _described(doc_id, words, runs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def result(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(column, type=field.type) for column, field in zip(zip(*numbered(rows)), fields)], schema=fields)

        for batch in batches:
            fields = pa.schema([batch.schema.field("doc_id"), *_FIELDS])
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                words = w.words_of(text.as_py())
                moved = places(doc_id, len(words)) if places else None
                if moved is not None:
                    words = [words[i] for i in moved.tolist()]
                if len(words) >= STREAM:
                    yield result([(doc_id, words)])
                    continue
                held.append((doc_id, words))
                count += len(words) + 1
                if count >= STREAM:
                    yield result(held)
                    held, count = [], 0
        if held:
            yield result(held)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_runs long, start long, length long, period long, exponent_milli long, "
             "runs_sha256 string, collapsed_sha256 string")


_FIELDS = [
    *(pa.field(name, pa.int64()) for name in ("n_runs", "start", "length", "period", "exponent_milli")),
    pa.field("runs_sha256", pa.string()), pa.field("collapsed_sha256", pa.string())]
