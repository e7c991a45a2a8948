"""Near duplicates by Order MinHash, verified by banded alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probewise.llm import words as w
from probewise.llm.components import components
from probewise.llm.shared import row_of, sieve, sifted, unpacked, whole_text, without
from probewise.workspace import written

SHINGLE = 5      # words of a k-mer
SIMILAR = 0.8    # share of k-mers that must align
SKETCHES = 16
TAKEN = 3        # k-mers of a sketch, in text order
BLOCK = 4096     # texts of a bucket that are compared with each other in one task
BLOCK_WORDS = 1 << 22  # words of such texts
RARE = 8         # k-mers of up to so many texts are counted pair by pair, others by matrix products
NO_ID = 1 << 62  # missing ids are numbered from here by a hash of the text

_SEEDS = w.mixed(np.arange(1, SKETCHES + 1, dtype=np.uint64) * w.ODD)


def shingles(words: list[str], size: int = SHINGLE) -> np.ndarray:
    """Hashes of the runs of ``size`` words; a shorter text is one run."""
    hashes = w.hashed(words)
    return w.runs(hashes, size if len(hashes) >= size else max(1, len(hashes)))


def labelled(kmers: np.ndarray) -> np.ndarray:
    """Each k-mer with the number of its occurrence, as one hash."""
    order = np.argsort(kmers, kind="stable")
    ordered = kmers[order]
    new = np.ones(len(kmers), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    if new.all():
        return w.mixed(kmers)
    starts = np.flatnonzero(new)
    turn = np.empty(len(kmers), dtype=np.uint64)
    turn[order] = np.arange(len(kmers)) - np.repeat(starts, np.diff(np.append(starts, len(kmers))))
    return w.mixed(kmers + turn * w.ODD)


def sketch(kmers: np.ndarray) -> np.ndarray:
    """Bucket keys of a text with at least one k-mer.

    For each seed the ``TAKEN`` labelled k-mers with the least hash are put in text order;
    the key is a hash of that row.
    """
    values = w.mixed(labelled(kmers)[None, :] ^ _SEEDS[:, None])
    if len(kmers) > TAKEN:
        at = np.sort(np.argpartition(values, TAKEN - 1, axis=1)[:, :TAKEN], axis=1)
    else:
        at = np.broadcast_to(np.arange(len(kmers)), (SKETCHES, len(kmers)))
    keys = _SEEDS.copy()
    for column in range(at.shape[1]):
        keys = w.mixed(keys * w.ODD + kmers[at[:, column]])
    return keys


def common(marks: list[np.ndarray]) -> np.ndarray:
    """How many labelled k-mers each two texts share, which is no less than how many align."""
    n = len(marks)
    owner = np.repeat(np.arange(n), [len(m) for m in marks])
    _, kind, often = np.unique(np.concatenate(marks), return_inverse=True, return_counts=True)
    out = np.zeros(n * n, dtype=np.float32)
    order = np.argsort(kind, kind="stable")
    owner, starts = owner[order], np.cumsum(often) - often
    for k in range(2, min(RARE, n) + 1):
        at = starts[often == k]
        for i in range(k):
            for j in range(k):
                if i != j:
                    out += np.bincount(owner[at + i] * n + owner[at + j], minlength=n * n)
    out = out.reshape(n, n)
    frequent = np.flatnonzero(often > RARE)
    for low in range(0, len(frequent), 4096):
        some = frequent[low:low + 4096]
        held = np.zeros((n, len(some)), dtype=np.float32)
        at = np.repeat(starts[some], often[some]) + np.arange(often[some].sum()) - np.repeat(np.cumsum(often[some]) - often[some], often[some])
        held[owner[at], np.repeat(np.arange(len(some)), often[some])] = 1
        out += held @ held.T
    return out


def strongest_tree(similar: np.ndarray) -> list[tuple[int, int]]:
    """Edges of the maximum spanning forest of pairs above 0."""
    n = len(similar)
    best, source = similar[0].copy(), np.zeros(n, dtype=np.int64)
    open_ = np.ones(n, dtype=bool)
    open_[0], edges = False, []
    for _ in range(n - 1):
        at = int(np.where(open_, best, -2.0).argmax())
        if best[at] > 0:
            edges.append((int(source[at]), at))
        open_[at] = False
        closer = similar[at] > best
        best[closer], source[closer] = similar[at][closer], at
    return edges


def links_within(kmers: list[np.ndarray], enough: float = SIMILAR) -> list[tuple[int, int]]:
    """Pairs of texts that align well enough and connect all texts that any such pairs connect.

    Pairs that share too few k-mers in any order are out. Of the others, the strongest spanning forest between
    texts not yet connected is aligned, again and again, until it is empty: then
    every pair left is connected, or has been aligned and failed, or is out. After a failure, one text is aligned with all that have open
    pairs, as a pivot: unaligned k-mers are a metric, so two texts whose distances to the pivot differ by more
    than an aligning pair may leave are out as well.
    """
    n = len(kmers)
    sizes = np.array([len(x) for x in kmers], dtype=np.float32)
    both = sizes[:, None] + sizes[None, :]
    shared = common([labelled(x) for x in kmers])
    share = shared / (both - shared)
    share[share < enough - 1e-6] = -1.0
    np.fill_diagonal(share, -1.0)
    apart = both * ((1 - enough) / (1 + enough)) + 1e-3
    root, pivots, found = np.arange(n), np.zeros(n, dtype=bool), []
    while (share > 0).any():
        trial = share.copy()
        trial[(root[:, None] == root[None, :])] = 2.0
        edges = [(i, j) for i, j in strongest_tree(trial) if root[i] != root[j]]
        if not edges:
            break
        failed = False
        for i, j in edges:
            if similarity(kmers[i], kmers[j], enough) >= enough:
                found.append((i, j))
                root[root == root[j]] = root[i]
            else:
                share[i, j] = share[j, i] = -1.0
                failed = True
        share[root[:, None] == root[None, :]] = -1.0
        open_ = (share > 0).sum(axis=1)
        open_[pivots] = 0
        if failed and open_.any():
            pivot = int(open_.argmax())
            pivots[pivot] = True
            at = np.flatnonzero((share > 0).any(axis=1))
            far = np.array([sizes[pivot] + sizes[i] - 2 * aligned(kmers[pivot], kmers[i]) for i in at])
            out = np.abs(far[:, None] - far[None, :]) > apart[np.ix_(at, at)]
            share[np.ix_(at, at)] = np.where(out, -1.0, share[np.ix_(at, at)])
    return found


def aligned(one: np.ndarray, other: np.ndarray) -> int:
    """K-mers of the longest common subsequence."""
    where: dict[int, int] = {}
    for i, x in enumerate(one.tolist()):
        where[x] = where.get(x, 0) | 1 << i
    state = full = (1 << len(one)) - 1
    for x in other.tolist():
        hit = where.get(x, 0) & state
        if hit:
            state = (state + hit | state - hit) & full
    return len(one) - state.bit_count()


def similarity(one: np.ndarray, other: np.ndarray, enough: float = SIMILAR) -> float:
    """Aligned k-mers over all k-mers of two texts, if that is at least ``enough``; else a lower value.

    The alignment keeps the order of both texts. It stays within a band: aligned positions
    cannot be further apart than the k-mers that texts so similar leave unaligned.
    """
    all_of = len(one) + len(other)

    def share(m: int) -> float:
        return m / (all_of - m)

    a, b = np.sort(one), np.sort(other)
    if share(min(len(a), len(b))) < enough:
        return 0.0
    a, b = labelled(one), labelled(other)
    common = len(np.intersect1d(a, b, assume_unique=True))
    if share(common) < enough:
        return 0.0  # even without regard to order
    least = min(len(one), len(other))
    differ = np.flatnonzero(one[:least] != other[:least])
    front = int(differ[0]) if len(differ) else least
    differ = np.flatnonzero(one[::-1][:least - front] != other[::-1][:least - front])
    back = int(differ[0]) if len(differ) else least - front
    if share(front + back) >= enough:
        return share(front + back)
    rows, columns = one[front:len(one) - back].tolist(), other[front:len(other) - back].tolist()
    band = int((1 - enough) / (1 + enough) * all_of) + 1
    where: dict[int, int] = {}
    for i, x in enumerate(rows):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(rows)) - 1
    state, strip = full, (1 << 2 * band + 1) - 1
    for j, x in enumerate(columns):
        hit = where.get(x)
        if hit:
            hit &= strip << j - band if j >= band else strip >> band - j
            hit &= state
            state = (state + hit | state - hit) & full
    return share(front + back + len(rows) - state.bit_count())


def _inner_id() -> Column:
    no_id = F.lit(NO_ID) + F.pmod(F.xxhash64("text"), F.lit(NO_ID))
    return F.coalesce(F.col("doc_id").cast("long"), no_id)


def _sequences(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_whole(w.words_of(t.as_py())) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([r[0] for r in rows], type=pa.int64()), pa.array([r[1] for r in rows], type=pa.int64())],
                names=["doc_id", "one", "two"])

    def _whole(words: list[str]) -> tuple[int, int]:
        digest = w.xxhash.xxh3_128_intdigest(" ".join(words).encode("utf-8", "surrogatepass"))
        return (digest >> 64) - (1 << 63), (digest & (1 << 64) - 1) - (1 << 63)

    return texts.mapInArrow(run, "doc_id long, one long, two long")


def _sketches(texts: DataFrame) -> DataFrame:
    """(doc_id, words, keys) of the texts with a whole k-mer."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts, keys = [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                words = w.words_of(text.as_py())
                if len(words) >= SHINGLE:
                    ids.append(doc_id)
                    counts.append(len(words))
                    keys.append(sketch(shingles(words)).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, type=pa.int64()), pa.array(counts, type=pa.int64()), pa.array(keys, type=pa.list_(pa.int64()))],
                names=["doc_id", "words", "keys"])

    return texts.mapInArrow(run, "doc_id long, words long, keys array<long>")


def _blocks(sketches: DataFrame) -> DataFrame:
    """(doc_id, block) of the texts that share a bucket with another.

    Buckets with one member end here, and of buckets with the same members one is kept. A bucket of more than ``BLOCK``
    texts or ``BLOCK_WORDS`` words is dealt to several parts by a hash, and each two parts are a block.
    """
    members = sketches.select("doc_id", "words", F.explode("keys").alias("key"))
    buckets = (
        members.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"),
                                   F.bit_xor(F.xxhash64("doc_id")).alias("set"), F.sum("words").alias("words"))
        .filter("n > 1").groupBy("n", "low", "high", "set").agg(F.min("key").alias("key"), F.max("words").alias("words")))
    parts = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("words") / BLOCK_WORDS))
    chosen = written(buckets.select("key", parts.alias("parts")), "buckets")
    own = F.pmod(F.xxhash64("doc_id", "key"), F.col("parts"))
    return (
        members.select("doc_id", "key").join(chosen, "key").withColumn("own", own)
        .select("doc_id", "key", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
        .select("doc_id", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("block")))


def _links(rows: DataFrame) -> DataFrame:
    """(a, b) from ``rows`` (block, doc_id, text) that are sorted by block: links that connect what is linked within a block."""
    def solved(ids: list[int], texts: list[str]) -> tuple[list[int], list[int]]:
        pairs = links_within([shingles(w.words_of(t)) for t in texts])
        return [ids[i] for i, _ in pairs], [ids[j] for _, j in pairs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids, texts = None, [], []
        for batch in batches:
            one, other = [], []
            for block, doc_id, text in zip(batch.column("block").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text")):
                if block != last:
                    a, b = solved(ids, texts) if len(ids) > 1 else ([], [])
                    one += a
                    other += b
                    last, ids, texts = block, [], []
                ids.append(doc_id)
                texts.append(text.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(other, pa.int64())], names=["a", "b"])
        if len(ids) > 1:
            a, b = solved(ids, texts)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _linked(texts: DataFrame, sketches: DataFrame) -> DataFrame:
    """(node, root) of the texts that links connect; every two texts of a bucket are compared in some block."""
    blocks = written(_blocks(sketches).groupBy("doc_id").agg(F.collect_set("block").alias("blocks")), "near-blocks")
    words, bits = sieve(blocks.select("doc_id"))
    wanted = sifted(texts, words, bits, [F.col("doc_id")]).filter("candidate").groupBy("doc_id").agg(F.min("text").alias("text"))
    rows = wanted.join(blocks, "doc_id").select("doc_id", "text", F.explode("blocks").alias("block"))
    links = written(_links(rows.repartition("block").sortWithinPartitions("block")).distinct(), "near-links")
    return components(links)


def _placed(texts: DataFrame) -> DataFrame:
    """(doc_id, class) for every row of ``texts`` (doc_id never missing, text never missing)."""
    rows = written(_sequences(texts), "near-sequences")
    firsts = written(rows.groupBy("one", "two").agg(F.min("doc_id").alias("first")), "near-firsts")
    copies = written(rows.join(firsts, ["one", "two"]).filter("first < doc_id").select("doc_id").distinct(), "near-copies")
    distinct = without(texts, copies, "doc_id")
    sketches = written(_sketches(distinct).dropDuplicates(["doc_id"]), "sketches")
    roots = _linked(texts, sketches)

    classes = written(
        firsts.join(roots, F.col("first") == F.col("node"), "left")
        .select("one", "two", F.coalesce("root", "first").alias("class")), "near-classes")
    return written(rows.join(classes, ["one", "two"]).select("doc_id", "class"), "near-rows")


def near_classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, class_size, kept for every row of ``docs``.

    Two texts are linked if, of their runs of five words (repeats counted), at least 0.8 of those
    in either align in the order of both texts; classes are what links connect. ``class_id`` is
    the smallest doc_id of the class, and that row is ``kept``. Texts with equal words are one
    from the start, so copies meet no sketch and make no pairs.

    A missing text is empty, and empty texts are equal; texts under five words are linked
    only to equal ones. A missing id comes after all others, by a hash of the text (its class_id
    is missing if no member has an id). Rows repeated whole share a class and are kept together, ids
    being unique otherwise and below 2^62. No rows give none. Other columns are not read.
    """
    placed = _placed(docs.select(_inner_id().alias("doc_id"), whole_text().alias("text")))
    sizes = placed.groupBy("class").agg(F.count("*").alias("class_size"))
    known = F.col("class") < NO_ID
    return placed.join(sizes, "class").select(
        F.when(F.col("doc_id") < NO_ID, F.col("doc_id")).alias("doc_id"), F.when(known, F.col("class")).alias("class_id"),
        "class_size", (F.col("doc_id") == F.col("class")).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``near_classes`` does not keep; all columns stay."""
    keyed = docs.select(row_of(docs.columns).alias("row"), _inner_id().alias("near_id"))
    placed = _placed(docs.select(_inner_id().alias("doc_id"), whole_text().alias("text")))
    dropped = placed.filter("doc_id != class").select(F.col("doc_id").alias("near_id")).distinct()
    return without(keyed, written(dropped, "near-dropped"), "near_id").select(*unpacked(docs.columns))
