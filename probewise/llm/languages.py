"""Languages of the words of code-switched text by a linear-chain conditional random field."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probewise.llm import words as w
from probewise.llm.labelled import remainder
from probewise.llm.shared import whole_text
from probewise.workspace import written

FOLDS = 3
MOST_ROWS = 8000        # labelled rows the model is fitted on, shared alike among languages
MOST_LANGUAGES = 200    # languages that are learnt, those with most labelled rows
MOST_LEXICON = 1 << 15  # words of the lexicon, the most frequent of the sample
LEAST_TEXTS = 3         # texts of the sample that a word of the lexicon occurs in
TABLE_BYTES = 32 << 20  # weights of affixes and n-grams
PIECES = 2              # stretches of words taken from each text of the sample
SIZES = (3, 16)         # words of a stretch, from and below
SEQUENCE = 64           # words of a training sequence, joined from stretches
BATCH = 100             # sequences of a step
EPOCHS = 8
RATE = 0.3
RIDGE = 1e-5
PIECE = 32              # words that are multiplied together when a text is scored
GROUP = 1 << 15         # words that are scored at once
GRAMS = (2, 3, 4)       # characters, word boundaries counted
UNKNOWN = "und"
_WORD = regex.compile(r"\p{L}+")
_EDGE = np.uint64(10)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Features:
    """Weight rows of the characters and words of ``words``.

    Words are written one after the other with an edge between two; every run of 2 to 4 characters with no edge inside is one
    feature: with an edge at its beginning or end it is an affix, otherwise an n-gram. Rows of other runs
    are ``1 << bits``, the row of zeros.
    """

    def __init__(self, words: list[str], bits: int) -> None:
        text = "\n" + "\n".join(words) + "\n"
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        edge = codes == _EDGE
        edges = np.flatnonzero(edge)
        n = len(codes) - 1
        self.starts = edges[:-1]
        self.grams: list[np.ndarray] = []
        value, inside = codes, np.zeros(len(codes), dtype=bool)
        for size in range(2, max(GRAMS) + 1):
            if len(value) < 2:
                break
            value = value[:-1] * w.ODD + codes[size - 1:]
            inside = inside[:len(value)] | (edge[size - 2:size - 2 + len(value)] if size > 2 else False)
            rows = (w.mixed(value + np.uint64(size)) >> np.uint64(64 - bits)).astype(np.int64)
            rows[inside] = 1 << bits
            self.grams.append(np.append(rows, np.full(n - len(rows), 1 << bits)))
        place = (np.arange(n) - np.repeat(self.starts, np.diff(edges))).astype(np.uint64)
        self.words = np.add.reduceat(w.mixed(codes[:-1] + place * w.ODD), self.starts) if words else np.zeros(0, np.uint64)
        self.owner = np.repeat(np.arange(len(words)), np.diff(edges))


class Chain:
    """Weights of affixes and n-grams, of words of the lexicon, of neighbouring languages and of the first word's language."""

    def __init__(self, languages: list[str], bits: int, lexicon: np.ndarray) -> None:
        n = len(languages)
        self.languages, self.bits, self.lexicon = languages, bits, lexicon
        self.grams = np.zeros(((1 << bits) + 1, n), dtype=np.float32)
        self.entries = np.zeros((len(lexicon) + 1, n), dtype=np.float32)
        self.neighbours, self.first = np.zeros((n, n)), np.zeros(n)

    def looked_up(self, hashes: np.ndarray) -> np.ndarray:
        """Row of each word in the lexicon, its last row (zeros) for others."""
        if not len(self.lexicon):
            return np.zeros(len(hashes), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.lexicon, hashes), len(self.lexicon) - 1)
        return np.where(self.lexicon[at] == hashes, at, len(self.lexicon))

    def scores(self, rows: list[np.ndarray], starts: np.ndarray, entries: np.ndarray) -> np.ndarray:
        """Score of each language for each word."""
        by_character = self.grams[rows[0]]
        for more in rows[1:]:
            by_character += self.grams[more]
        return np.add.reduceat(by_character, starts, axis=0).astype(np.float64) + self.entries[entries]

    def emissions(self, words: list[str]) -> np.ndarray:
        found = Features(words, self.bits)
        return self.scores(found.grams, found.starts, self.looked_up(found.words))

    def marginals(self, words: list[str], sizes: np.ndarray) -> np.ndarray:
        """Probability of each language for each word, given all words of its text, by forward-backward.

        ``sizes`` are the words of each text, none of them 0. Texts are cut into pieces of ``PIECE`` words; the products of
        all pieces are formed together, word by word; messages then pass from piece to piece of each text, and
        once more through all pieces together.
        """
        n, kinds = len(words), len(self.languages)
        emitted = self.emissions(words)
        emitted = np.exp(emitted - emitted.max(axis=1, keepdims=True))
        step = np.exp(self.neighbours - self.neighbours.max())
        pieces = -(-sizes // PIECE)
        first_piece = np.cumsum(pieces) - pieces
        offset = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        piece, place = np.repeat(first_piece, sizes) + offset // PIECE, offset % PIECE
        e = np.ones((PIECE, int(pieces.sum()), kinds))
        e[place, piece] = emitted
        onward = np.zeros((PIECE, e.shape[1], 1), dtype=bool)  # a word that another follows
        onward[place, piece, 0] = offset < np.repeat(sizes, sizes) - 1

        whole = np.broadcast_to(np.eye(kinds), (e.shape[1], kinds, kinds))
        for t in range(PIECE):
            whole = whole * e[t][:, None, :]
            whole = np.where(onward[t][:, :, None], whole @ step, whole)
            whole = whole / whole.max(axis=(1, 2), keepdims=True)
        order = np.argsort(-pieces, kind="stable")
        ahead, behind = np.ones((e.shape[1], kinds)), np.ones((e.shape[1], kinds))
        message = np.broadcast_to(np.exp(self.first - self.first.max()), (len(sizes), kinds)).copy()
        longest = int(pieces.max(initial=0))
        live_at = np.searchsorted(-pieces[order], -np.arange(1, longest + 1), side="right")
        for k in range(longest):
            texts = order[:live_at[k]]
            at = first_piece[texts] + k
            ahead[at] = message[texts]
            passed = np.einsum("dl,dlm->dm", message[texts], whole[at])
            message[texts] = passed / passed.max(axis=1, keepdims=True)
        for k in reversed(range(longest - 1)):
            at = first_piece[order[:live_at[k + 1]]] + k
            passed = np.einsum("dlm,dm->dl", whole[at + 1], behind[at + 1])
            behind[at] = passed / passed.max(axis=1, keepdims=True)

        forward = np.empty_like(e)
        for t in range(PIECE):
            forward[t] = ahead
            ahead = ahead * e[t]
            ahead = np.where(onward[t], ahead @ step, ahead)
            ahead = ahead / ahead.max(axis=1, keepdims=True)
        for t in reversed(range(PIECE)):
            behind = e[t] * np.where(onward[t], behind @ step.T, behind)
            behind = behind / behind.max(axis=1, keepdims=True)
            forward[t] *= behind
        out = forward[place, piece]
        return out / out.sum(axis=1, keepdims=True)


def _expected(chain: Chain, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals and expected counts of neighbours of sequences of one length (sequences x words x languages)."""
    e = np.exp(scores - scores.max(axis=2, keepdims=True))
    step = np.exp(chain.neighbours - chain.neighbours.max())
    forward, backward = np.empty_like(e), np.empty_like(e)
    message = np.exp(chain.first - chain.first.max()) * e[:, 0]
    for t in range(e.shape[1]):
        message = message if t == 0 else message @ step * e[:, t]
        forward[:, t] = message = message / message.max(axis=1, keepdims=True)
    message = np.ones_like(e[:, 0])
    for t in reversed(range(e.shape[1])):
        backward[:, t] = message
        message = (message * e[:, t]) @ step.T
        message = message / message.max(axis=1, keepdims=True)
    marginal = forward * backward
    marginal /= marginal.sum(axis=2, keepdims=True)
    pairs = np.zeros_like(step)
    for t in range(e.shape[1] - 1):
        both = forward[:, t, :, None] * step * (e[:, t + 1] * backward[:, t + 1])[:, None, :]
        pairs += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return marginal, pairs


def fit(pieces: list[tuple[str, list[str]]], lexicon: list[str]) -> Chain:
    """The chain from stretches (language, words), which are joined into sequences in an order of their own.

    So sequences change language as often as stretches end, and the weights of neighbours are learnt with the
    others: steps of gradient ascent on the likelihood, each weight with a rate of its own.
    """
    languages = sorted({language for language, _ in pieces})
    bits = 18
    while bits > 8 and (4 << bits) * max(1, len(languages)) > TABLE_BYTES:
        bits -= 1
    hashes = np.unique(Features(lexicon, bits).words)
    chain = Chain(languages, bits, hashes)
    if not pieces:
        return chain
    order = np.random.default_rng(7).permutation(len(pieces))
    words = [x for k in order for x in pieces[k][1]]
    labels = np.array([languages.index(pieces[k][0]) for k in order for _ in pieces[k][1]])
    length = min(SEQUENCE, len(words))
    count = len(words) // length
    words, labels = words[:count * length], labels[:count * length]
    kinds = len(languages)
    truth = np.eye(kinds)[labels].reshape(count, length, kinds)
    found = Features(words, bits)
    entries = chain.looked_up(found.words)
    edges = np.append(found.starts, len(found.owner))
    weights = [chain.grams, chain.entries, chain.neighbours, chain.first]
    seen = [np.full(x.shape, 1e-2, dtype=x.dtype) for x in weights]
    for _ in range(EPOCHS):
        for low in range(0, count, BATCH):
            high = min(low + BATCH, count)
            a, b = low * length, high * length
            rows = [x[edges[a]:edges[b]] for x in found.grams]
            scores = chain.scores(rows, found.starts[a:b] - edges[a], entries[a:b])
            marginal, pairs = _expected(chain, scores.reshape(-1, length, kinds))
            own = truth[low:high]
            missing = (own - marginal).reshape(-1, kinds)
            by_character = missing[found.owner[edges[a]:edges[b]] - a]
            gradients = [np.zeros(x.shape, dtype=x.dtype) for x in weights]
            for kind in range(kinds):
                for at in rows:
                    gradients[0][:, kind] += np.bincount(at, by_character[:, kind], len(chain.grams))
                gradients[1][:, kind] = np.bincount(entries[a:b], missing[:, kind], len(chain.entries))
            gradients[2] += np.einsum("stl,stm->lm", own[:, :-1], own[:, 1:]) - pairs
            gradients[3] += (own[:, 0] - marginal[:, 0]).sum(axis=0)
            gradients[0][-1], gradients[1][-1] = 0, 0  # rows of zeros
            for value, gradient, past in zip(weights, gradients, seen):
                gradient /= high - low
                gradient -= RIDGE * value
                past += gradient * gradient
                value += RATE * gradient / np.sqrt(past)
    return chain


def _sampled(docs: DataFrame, most: int) -> DataFrame:
    """(doc_id, lang, text) of the rows that are learnt from, each once, as many of each language."""
    usable = docs.filter((remainder(FOLDS) != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    named = usable.select("doc_id", "lang")
    languages = [r["lang"] for r in named.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()]
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64(F.lit("languages"), "doc_id"), "doc_id")
    ids = (
        named.filter(F.col("lang").isin(languages)).withColumn("turn", F.dense_rank().over(by_hash))
        .filter(F.col("turn") <= max(1, most // max(1, len(languages)))).select("doc_id", "lang").distinct())
    return usable.select("doc_id", "lang", "text").join(F.broadcast(ids), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))


def fitted(docs: DataFrame, most: int = MOST_ROWS) -> Chain:
    """The chain from at most ``most`` rows of ``docs`` that are not held out and have an id, a text and a language.

    The lexicon counts every word of these texts; from each come ``PIECES`` stretches of a few
    words, at places drawn by its id. Only stretches and the lexicon reach the driver.
    """
    rows = written(_sampled(docs, most), "language-sample")

    def vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text"):
                yield pa.RecordBatch.from_arrays([pa.array(sorted(set(words_of(text.as_py()))), type=pa.string())], names=["word"])

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, languages, taken = [], [], []
            for doc_id, language, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "lang", "text"))):
                words, draw = words_of(text), np.random.default_rng(abs(hash_of(doc_id)))
                for _ in range(PIECES if words else 0):
                    size = min(len(words), int(draw.integers(*SIZES)))
                    low = int(draw.integers(0, len(words) - size + 1))
                    ids.append(str(doc_id))
                    languages.append(language)
                    taken.append(words[low:low + size])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array(languages, pa.string()), pa.array(taken, pa.list_(pa.string()))],
                names=["doc_id", "lang", "words"])

    counted = rows.select("text").mapInArrow(vocabulary, "word string").groupBy("word").count().filter(F.col("count") >= LEAST_TEXTS)
    lexicon = [r["word"] for r in counted.orderBy(F.desc("count"), "word").limit(MOST_LEXICON).collect()]
    found = rows.mapInArrow(stretches, "doc_id string, lang string, words array<string>").collect()
    return fit([(r["lang"], r["words"]) for r in sorted(found)], lexicon)


def hash_of(doc_id: object) -> int:
    return w.xxhash.xxh3_64_intdigest(str(doc_id).encode())


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[str]]]]:
    """Rows with their words, about ``GROUP`` words at a time; a longer text comes whole."""
    for batch in batches:
        low, count, held = 0, 0, []
        for at, text in enumerate(batch.column("text")):
            words = words_of(text.as_py())
            held.append(words)
            count += len(words)
            if count >= GROUP:
                yield batch.slice(low, at + 1 - low), held
                low, count, held = at + 1, 0, []
        if held:
            yield batch.slice(low), held


def labelled(docs: DataFrame, chain: Chain, stretches: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_words, n_switches for every row of ``docs``; nothing is shuffled.

    ``lang_pred`` is the language with the greatest mean probability over all words (runs of letters) of the whole text, the first in
    order among equals, ``score`` that mean; ``n_switches`` counts the words whose likeliest language is another than that of
    the word before. With ``stretches`` a further column lists (lang, start, words) of these stretches, in words.

    A text that is missing, or without a letter, has language ``und`` and score 0; so have all texts when
    nothing could be learnt. A missing id is kept; rows repeated whole score alike; no rows give none. Columns other
    than doc_id and text are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    schema = f"doc_id {kind}, held_out boolean, lang_pred string, score double, n_words long, n_switches long"
    listed = "array<struct<lang string, start long, words long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, UNKNOWN], dtype=object)
        for batch, texts in _grouped(batches):
            sizes = np.array([len(words) for words in texts], dtype=np.int64)
            best, score = np.full(len(texts), len(names) - 1), np.zeros(len(texts))
            switches, parts = np.zeros(len(texts), dtype=np.int64), [[] for _ in texts]
            some = np.flatnonzero(sizes) if model.languages else np.zeros(0, dtype=np.int64)
            if len(some):
                given = sizes[some]
                starts = np.cumsum(given) - given
                likely = model.marginals([x for k in some for x in texts[k]], given)
                mean = np.add.reduceat(likely, starts, axis=0) / given[:, None]
                best[some] = mean.argmax(axis=1)
                score[some] = np.minimum(1.0, mean.max(axis=1))
                label = likely.argmax(axis=1)
                new = np.ones(len(label), dtype=bool)
                new[1:] = label[1:] != label[:-1]
                new[starts] = True
                switches[some] = np.add.reduceat(new.astype(np.int64), starts) - 1
                if stretches:
                    cuts = np.flatnonzero(new)
                    owner = np.searchsorted(starts, cuts, side="right") - 1
                    for cut, n, k in zip(cuts, np.diff(np.append(cuts, len(label))), owner):
                        parts[some[k]].append({"lang": names[label[cut]], "start": int(cut - starts[k]), "words": int(n)})
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(names[best], type=pa.string()), pa.array(score),
                       pa.array(sizes), pa.array(switches)]
            fields = ["doc_id", "held_out", "lang_pred", "score", "n_words", "n_switches"]
            if stretches:
                struct = pa.struct([("lang", pa.string()), ("start", pa.int64()), ("words", pa.int64())])
                columns.append(pa.array(parts, type=pa.list_(struct)))
                fields.append("stretches")
            yield pa.RecordBatch.from_arrays(columns, names=fields)

    source = docs.select("doc_id", (remainder(FOLDS) == 1).alias("held_out"), whole_text().alias("text"))
    return source.mapInArrow(run, schema + (f", stretches {listed}" if stretches else ""))
