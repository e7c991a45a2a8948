"""Toxic terms, also misspelt, found by an automaton over a learnt lexicon and weighed in context."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probewise.llm.labelled import MOST_LABELS, remainder, sample
from probewise.llm.shared import row_of, whole_text, with_row
from probewise.workspace import written

FOLDS = 3            # rows whose remainder is 1 are held out
THRESHOLD = 0.7
STEMS = (4, 5, 6)    # lengths of word beginnings that may enter the lexicon
MOST_CANDIDATES = 20_000  # bounds of the fit: pieces looked up, and terms and stems of the lexicon
MOST_TERMS = 400
NEAR = 12            # words on either side that make the context of a hit
REMEMBERED = 150_000  # words whose match a task keeps
COUNTED = 100_000     # pieces a task counts before it sends them on
_WORD = re.compile(r"\w+")
_QUOTES = "\"“”„«»‹›"


def _accepts(term: str) -> int:
    """Edits a misspelling of ``term`` may have."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Automaton:
    """The Levenshtein automata of all terms, walked together over the trie of the lexicon.

    A state is the set of (trie node, edits so far) that a word's beginning can lead to. States
    and their transitions are made when first met and kept, so a word costs one lookup
    per character. A stem matches every word that begins with it, without edits.
    """

    def __init__(self, terms: list[str], stems: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]     # edits allowed where a term ends
        self.stem: list[bool] = [False]
        self.best: list[int] = [0]      # most edits allowed below
        for text, is_stem in [(t, False) for t in terms] + [(s, True) for s in stems]:
            node, allowed = 0, 0 if is_stem else _accepts(text)
            for c in text:
                self.best[node] = max(self.best[node], allowed)
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(-1)
                    self.stem.append(False)
                    self.best.append(0)
                node = self.children[node][c]
            self.best[node] = max(self.best[node], allowed)
            if is_stem:
                self.stem[node] = True
            else:
                self.ends[node] = max(self.ends[node], allowed)
        self.states: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.number: dict[frozenset, int] = {}
        self.found: list[int] = []
        self.start = self._state({(0, 0)})

    def _state(self, nodes: set[tuple[int, int]]) -> int:
        todo, least = list(nodes), {}
        while todo:
            node, edits = todo.pop()
            if edits > self.best[node] or least.get(node, 9) <= edits:
                continue
            least[node] = edits
            todo += [(child, edits + 1) for child in self.children[node].values()]  # a character left out
        key = frozenset(least.items())
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            ends = [e for n, e in least.items() if 0 <= e <= self.ends[n]]
            self.found.append(min(ends) if ends else -1)
        return self.number[key]

    def _move(self, state: int, c: str) -> int:
        after = set()
        for node, edits in self.states[state]:
            for label, child in self.children[node].items():
                after.add((child, edits if label == c else edits + 1))
            after.add((node, edits + 1))
        target = self._state(after)
        if any(e == 0 and self.stem[n] for n, e in self.states[target]):
            target = -2
        elif not self.states[target]:
            target = -1
        self.moves[state][c] = target
        return target

    def look(self, word: str) -> int:
        """Edits to the nearest term, 0 also for a stem that begins the word; -1 for no match."""
        state = self.start
        for c in word:
            state = self.moves[state].get(c) if c in self.moves[state] else self._move(state, c)
            if state < 0:
                return 0 if state == -2 else -1
        return self.found[state]


FEATURES = ("any", "exact", "near", "quoted", "dense", "share", "log_words")


@dataclass
class ToxicModel:
    terms: list[str]
    stems: list[str]
    weights: np.ndarray
    base: float
    automaton: Automaton | None = field(default=None, repr=False)
    known: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "automaton": None, "known": {}}

    def describe(self, text: str) -> tuple[float, ...]:
        """The features of a whole text. A hit inside quotation marks counts apart from abuse."""
        if self.automaton is None:
            self.automaton = Automaton(self.terms, self.stems)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, look = self.known, self.automaton.look
        lowered = text.lower()
        words = _WORD.findall(lowered)
        for word in set(words).difference(known):
            known[word] = look(word)
        hits = [i for i, word in enumerate(words) if known[word] >= 0]
        if not hits:
            return (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, math.log1p(len(words)))
        quoted = self._quoted(lowered, set(hits)) if any(q in lowered for q in _QUOTES) else set()
        exact = sum(known[words[i]] == 0 for i in hits if i not in quoted)
        near = len(hits) - len(quoted) - exact
        own = [i for i in hits if i not in quoted]
        dense, first = 0, 0
        for last, at in enumerate(own):
            while at - own[first] > NEAR:
                first += 1
            dense = max(dense, last - first + 1)
        return (float(bool(own)), math.log1p(exact), math.log1p(near), math.log1p(len(quoted)), math.log1p(dense),
                100.0 * len(own) / (len(words) + 20), math.log1p(len(words)))

    @staticmethod
    def _quoted(text: str, hits: set[int]) -> set[int]:
        """Hits with a quotation mark within the window on both sides, the nearer one an opening."""
        found, marks, spans = set(), [m.start() for m in re.finditer(f"[{_QUOTES}]", text)], list(_WORD.finditer(text))
        places = np.array(marks)
        for i in hits:
            low = spans[max(0, i - NEAR)].start() - 1
            high = spans[min(len(spans) - 1, i + NEAR)].end() + 1
            before = np.searchsorted(places, spans[i].start())
            inside = before % 2 == 1  # an odd number of marks stand before: a quotation is open
            if inside and before < len(places) and places[before - 1] >= low and places[before] <= high:
                found.add(i)
        return found

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(features @ self.weights + self.base, -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, steps: int = 60) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps; few columns, a bounded number of rows."""
    n = len(y)
    start = math.log((y.sum() + 0.5) / (n - y.sum() + 0.5)) if n else 0.0
    w = np.append(np.zeros(x.shape[1]), start)
    if n == 0 or y.min() == y.max():
        return w[:-1], float(w[-1])
    full = np.column_stack((x, np.ones(n)))
    penalty = np.append(np.full(x.shape[1], ridge), 1e-6)
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(full @ w, -40, 40)))
        gradient = full.T @ (y - p) - penalty * w
        curvature = (full * (p * (1 - p))[:, None]).T @ full + np.diag(penalty)
        step = np.linalg.solve(curvature, gradient)
        w = w + step * min(1.0, 4.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def _pieces(words: set[str]) -> set[str]:
    """Whole words, and beginnings marked by a trailing ``*``."""
    out = set(words)
    for size in STEMS:
        out.update(w[:size] + "*" for w in words if len(w) > size)
    return out


def _partial_counts(rows: DataFrame, wanted=None) -> DataFrame:
    """(piece, n): documents of each task that hold a piece; ``wanted`` limits the pieces."""
    def counted(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), type=pa.string()), pa.array(list(counts.values()), type=pa.int64())], names=["piece", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column("text"):
                found = _pieces(set(_WORD.findall(text.as_py().lower())))
                counts.update(found if wanted is None else found & wanted.value)
                if len(counts) > COUNTED:
                    yield counted(counts)
                    counts.clear()
        yield counted(counts)

    return rows.select("text").mapInArrow(run, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def learnt_lexicon(rows: DataFrame) -> tuple[list[str], list[str]]:
    """Terms and stems that mark label 1 in ``rows`` (text, label), a bounded sample.

    Pieces of texts with label 1 are counted first; the ``MOST_CANDIDATES`` most frequent are then looked up in the
    others. A piece enters by its log odds times the root of its count, a stem only if no stem already chosen covers
    it; whole words under a stem follow, so that their misspellings are caught. There are ``MOST_TERMS`` at most.
    """
    spark = rows.sparkSession
    ones = rows.filter("label = 1").count()
    zeros = rows.filter("label = 0").count()
    least = max(3, ones // 300)
    top = (_partial_counts(rows.filter("label = 1")).filter(F.col("n") >= least)
           .orderBy(F.desc("n"), "piece").limit(MOST_CANDIDATES).collect())
    positive = {r["piece"]: r["n"] for r in top}
    if not positive or not zeros:
        return [], []
    wanted = spark.sparkContext.broadcast(frozenset(positive))
    negative = {r["piece"]: r["n"] for r in _partial_counts(rows.filter("label = 0"), wanted).collect()}

    def worth(piece: str) -> tuple[float, float]:
        p, q = positive[piece], negative.get(piece, 0)
        odds = math.log((p + 0.5) / (ones + 1)) - math.log((q + 0.5) / (zeros + 1))
        return (odds * math.sqrt(p), odds)

    terms: list[str] = []
    stems: list[str] = []
    ranked = sorted(((worth(p), p) for p in positive), key=lambda x: (-x[0][0], x[1]))
    for (value, odds), piece in ranked:
        rate = positive[piece] / (positive[piece] + negative.get(piece, 0))
        if odds < 3.0 or value < 6.0 or rate < 0.5 or len(terms) + len(stems) >= MOST_TERMS:
            continue
        text = piece.removesuffix("*")
        if any(text.startswith(s) for s in stems) and piece.endswith("*"):
            continue
        if piece.endswith("*"):
            same = [w for w in positive if not w.endswith("*") and w.startswith(text)]
            if any(positive[w] >= 0.9 * positive[piece] for w in same):
                continue  # one word explains the stem
            stems.append(text)
        else:
            terms.append(text)
    # A stem takes no edits, so the words it stands for are terms too: they catch their own misspellings.
    for (_, odds), piece in ranked:
        if len(terms) + len(stems) >= MOST_TERMS:
            break
        if odds >= 3.0 and not piece.endswith("*") and piece not in terms and any(piece.startswith(s) for s in stems):
            terms.append(piece)
    return terms, stems


def fitted(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELS) -> ToxicModel:
    """Lexicon and weights from at most ``most`` labelled rows, none of the held-out ones.

    The lexicon is learnt from one half of the sample (by a hash of the text), the weights from
    the other, so that they see terms as new texts show them.
    """
    rows = written(sample(docs, labels, "toxic", remainder(FOLDS) != 1, most), "toxic-sample")
    half = F.pmod(F.xxhash64(F.lit("half"), "text"), F.lit(10))
    terms, stems = learnt_lexicon(rows.filter(half < 7))
    empty = ToxicModel(terms, stems, np.zeros(len(FEATURES)), 0.0)
    shared = docs.sparkSession.sparkContext.broadcast(empty)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [shared.value.describe(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(values, type=pa.list_(pa.float64())), batch.column("label")], names=["features", "label"])

    table = rows.filter(half >= 7).mapInArrow(run, "features array<double>, label int").toPandas()
    table = table.sort_values("features", key=lambda s: s.map(tuple))
    x = np.array(table["features"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    weights, base = _logistic(x, table["label"].to_numpy(dtype=float))
    return ToxicModel(terms, stems, weights, base)


def scored(docs: DataFrame, model: ToxicModel, carry: list[str] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted (and ``row``) for every row of ``docs``; no shuffle.

    A missing text scores as an empty one; a missing id is kept; repeated rows score
    alike; no rows give none. Columns not named in ``carry`` are not read.
    """
    source = docs.select("doc_id", (remainder(FOLDS) == 1).alias("held_out"), whole_text().alias("text"),
                         *([row_of(list(carry)).alias("row")] if carry else []))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, score double, predicted int"
    names = ["doc_id", "held_out", "score", "predicted"]
    if carry:
        names.append("row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features = [shared.value.describe(t.as_py()) for t in batch.column("text")]
            score = shared.value.scores(np.array(features, dtype=float).reshape(-1, len(FEATURES)))
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(score),
                       pa.array((score >= THRESHOLD).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns + ([batch.column("row")] if carry else []), names=names)

    return source.mapInArrow(run, with_row(schema, source))
