"""Packing token pieces into sequences under limits on tokens, segments and loss-bearing tokens."""

from __future__ import annotations

import base64
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probewise.llm.shared import row_of, whole_text, with_row

LIMITS = (1024, 64, 1024)  # tokens, segments, loss-bearing tokens of a sequence
END = 0                    # the id that closes a document
WAITING = 1024             # pieces a task gathers before it packs them
ROWS = 2048                # pieces of an output batch
KEPT_BACK = 128            # of these, left for the next round so that late pieces find company
VOCABULARY = "byte_bpe_50k.tiktoken"  # the ranks of byte_bpe_50k.json; gives the same ids, several times faster


@functools.lru_cache(maxsize=2)
def encoder(path: str | None):
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path(VOCABULARY), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
        special_tokens={"<|endoftext|>": len(ranks)})


class Document:
    """The ids of one document; its first ``prompt`` ids bear no loss."""

    __slots__ = ("doc_id", "ids", "prompt", "row")

    def __init__(self, doc_id, ids: np.ndarray, prompt: int, row):
        self.doc_id, self.ids, self.prompt, self.row = doc_id, ids, prompt, row

    def loss(self, start: int, end: int) -> int:
        return max(0, end - max(start, self.prompt))

    def reach(self, start: int, tokens: int, loss: int) -> int:
        """The furthest end of a piece from ``start`` within both limits."""
        return min(len(self.ids), start + tokens, max(start, self.prompt) + loss)


class Packer:
    """Vector bin packing of waiting pieces, one sequence at a time.

    Into the open sequence goes the piece that fits and whose demand has the largest dot
    product with what is left of every limit. When none fits, the largest piece is cut to
    fill the sequence and its rest waits on. Memory: the waiting pieces only.
    """

    def __init__(self, limits: tuple[int, int, int], first_sequence: int):
        self.limits, self.sequence = limits, first_sequence
        self.waiting: list[tuple[Document, int]] = []
        self.done: list[tuple[Document, int, int, int, int]] = []

    def add(self, doc: Document) -> None:
        start, (tokens, _, loss) = 0, self.limits
        while (end := doc.reach(start, tokens, loss)) < len(doc.ids) or end - start == tokens:
            self.done.append((doc, start, end, self.sequence, 0))
            self.sequence, start = self.sequence + 1, end
            if start == len(doc.ids):
                return
        self.waiting.append((doc, start))
        if len(self.waiting) >= WAITING:
            self.pack(KEPT_BACK)

    def pack(self, leave: int = 0) -> None:
        items, caps = self.waiting, np.array(self.limits, dtype=float)
        start = np.array([s for _, s in items], dtype=np.int64)
        need = np.array([[len(d.ids) - s, 1, d.loss(s, len(d.ids))] for d, s in items], dtype=float).reshape(-1, 3)
        live, count = np.ones(len(items), dtype=bool), len(items)
        while count > leave:
            left, offset = caps.copy(), 0
            while count:
                fits = live & (need <= left).all(axis=1)
                if not fits.any():
                    break
                at = int(np.where(fits, (need / caps) @ (left / caps), -1.0).argmax())
                doc, size = items[at][0], int(need[at, 0])
                self.done.append((doc, int(start[at]), len(doc.ids), self.sequence, offset))
                left, offset, live[at], count = left - need[at], offset + size, False, count - 1
            if count and left[1] >= 1 and left[0] >= 1:
                at = int(np.where(live, need[:, 0], -1.0).argmax())
                doc, begin = items[at][0], int(start[at])
                end = doc.reach(begin, int(left[0]), int(left[2]))
                if end > begin:
                    self.done.append((doc, begin, end, self.sequence, offset))
                    start[at] = end
                    need[at] = len(doc.ids) - end, 1, doc.loss(end, len(doc.ids))
            self.sequence += 1
        self.waiting = [(items[i][0], int(start[i])) for i in np.flatnonzero(live)]


def packed(docs: DataFrame, limits: tuple[int, int, int] = LIMITS, vocabulary: str | None = None,
           prompt: str | None = None, with_ids: bool = False, carry: list[str] = ()) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens.

    Each document is tokenised whole and closed by id 0, cut into full sequences, and the
    rest is packed with others of its task: nothing is shuffled. Each task leaves at most a few
    sequences partly filled, and those that reach the segment limit. ``prompt`` names a text
    column whose tokens come first and bear no loss (instruction data). ``with_ids`` adds the
    ids themselves; ``carry`` brings columns along in ``row``. ``sequence_id`` is the task's
    number and a counter, so a task run again gives the same ids.

    A missing or empty text is the closing id alone; a missing doc_id stays missing; rows
    repeated whole are packed each on its own; no rows give no sequences.
    """
    ask = F.coalesce(F.col(prompt), F.lit("")) if prompt else F.lit("")
    source = docs.select("doc_id", ask.alias("prompt"), whole_text().alias("text"), row_of(list(carry)).alias("row"))
    if not carry:
        source = source.drop("row")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
              "loss_tokens long" + (", ids array<int>" if with_ids else ""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_to_numpy
        packer = Packer(limits, TaskContext.get().partitionId() << 32)
        ends = np.array([END], dtype=np.uint32)

        def rows(fields: pa.Schema) -> Iterator[pa.RecordBatch]:
            done, packer.done = packer.done, []
            for at in range(0, len(done), ROWS):
                some = done[at:at + ROWS]
                cut = [d.ids[s:e].astype("<u4") for d, s, e, _, _ in some]
                columns = [
                    [d.doc_id for d, *_ in some], [s for _, s, *_ in some], [e - s for _, s, e, *_ in some],
                    [zlib.crc32(x.tobytes()) for x in cut], [len(d.ids) for d, *_ in some],
                    [q for *_, q, _ in some], [o for *_, o in some], [d.loss(s, e) for d, s, e, *_ in some]]
                if with_ids:
                    columns.append([x.astype(np.int32) for x in cut])
                if carry:
                    columns.append([d.row for d, *_ in some])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=f.type) for c, f in zip(columns, fields)], schema=fields)

        fields = None
        for batch in batches:
            if fields is None:
                fields = _arrow_fields(batch.schema, with_ids)
            extra = batch.column("row") if carry else None
            for i, (doc_id, ask_text, text) in enumerate(zip(
                    batch.column("doc_id").to_pylist(), batch.column("prompt"), batch.column("text"))):
                first = encode(ask_text.as_py(), allowed_special="all") if prompt else ()
                ids = encode(text.as_py(), allowed_special="all")
                ids = np.concatenate((first, ids, ends)).astype(np.uint32) if prompt else np.append(ids, ends)
                packer.add(Document(doc_id, ids, len(first), extra[i].as_py() if carry else None))
                if len(packer.done) >= ROWS:  # so that the ids of documents packed already can go
                    yield from rows(fields)
            yield from rows(fields)
        if fields is not None:
            packer.pack()
            yield from rows(fields)

    return source.mapInArrow(run, with_row(schema, source))


def _arrow_fields(given: pa.Schema, with_ids: bool) -> pa.Schema:
    names = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens")
    fields = [pa.field("doc_id", given.field("doc_id").type)] + [pa.field(n, pa.int64()) for n in names]
    if with_ids:
        fields.append(pa.field("ids", pa.list_(pa.int32())))
    if "row" in given.names:
        fields.append(pa.field("row", given.field("row").type))
    return pa.schema(fields)
