import itertools
import random

import numpy as np
import pytest
import zlib

from probewise.llm import languages as g

SYLLABLES = {"aa": ["ka", "to", "mi", "re"], "bb": ["sch", "ung", "ein"], "cc": ["eau", "oi", "que"]}


def spoken(rng, language, n):
    return ["".join(rng.choices(SYLLABLES[language], k=rng.randint(1, 4))) for _ in range(n)]


@pytest.fixture(scope="module")
def chain():
    rng = random.Random(1)
    pieces = [(x, spoken(rng, x, rng.randint(3, 15))) for x in rng.choices(list(SYLLABLES), k=400)]
    return g.fit(pieces, ["ka", "sch", "eau"])


def scores(chain, words):
    """Emissions, one word and one run of characters at a time."""
    out = []
    for word in words:
        total = np.zeros(len(chain.languages))
        text = f"\n{word}\n"
        for size in g.GRAMS:
            for i in range(len(text) - size + 1):
                run = text[i:i + size]
                if "\n" not in run[1:-1]:
                    value = np.uint64(ord(run[0]))
                    for c in run[1:]:
                        value = (value.reshape(1) * g.w.ODD + np.uint64(ord(c)))[0]
                    total += chain.grams[int(g.w.mixed(np.array([value]) + np.uint64(size))[0] >> np.uint64(64 - chain.bits))]
        out.append(total + chain.entries[chain.looked_up(g.Features([word], chain.bits).words)[0]])
    return np.array(out)


def by_all_paths(chain, words):
    """Marginals from the weights of all sequences of languages."""
    given, kinds, out = scores(chain, words), len(chain.languages), np.zeros((len(words), len(chain.languages)))
    for path in itertools.product(range(kinds), repeat=len(words)):
        total = chain.first[path[0]] + sum(given[t, k] for t, k in enumerate(path))
        total += sum(chain.neighbours[a, b] for a, b in zip(path, path[1:]))
        for t, k in enumerate(path):
            out[t, k] += np.exp(total)
    return out / out.sum(axis=1, keepdims=True)


def test_marginals_by_all_paths(chain, monkeypatch):
    rng = random.Random(2)
    texts = [spoken(rng, "aa", 2) + ["x", "ein"], ["to"], spoken(rng, "bb", 1) + spoken(rng, "cc", 6), ["eau", "ka"] * 3]
    expected = np.concatenate([by_all_paths(chain, t) for t in texts])
    sizes = np.array([len(t) for t in texts])
    joined = [x for t in texts for x in t]
    assert np.abs(chain.marginals(joined, sizes) - expected).max() < 1e-5
    monkeypatch.setattr(g, "PIECE", 3)
    assert np.abs(chain.marginals(joined, sizes) - expected).max() < 1e-5


def test_long_texts_keep_finite_messages(chain):
    rng = random.Random(3)
    words = [x for _ in range(400) for x in spoken(rng, rng.choice(list(SYLLABLES)), 30)] + ["zzz" * 2000]
    found = chain.marginals(words, np.array([len(words)]))
    assert np.isfinite(found).all() and np.abs(found.sum(axis=1) - 1).max() < 1e-9


def test_words_of_switched_text(chain):
    rng, hits, total = random.Random(4), 0, 0
    for _ in range(40):
        truth, words = [], []
        for language in rng.sample(list(SYLLABLES), 3):
            part = spoken(rng, language, rng.randint(2, 9))
            words += part
            truth += [language] * len(part)
        label = chain.marginals(words, np.array([len(words)])).argmax(axis=1)
        hits += sum(chain.languages[k] == t for k, t in zip(label, truth))
        total += len(words)
    assert hits / total > 0.98


def test_neighbours_are_learnt(chain):
    assert (np.argmax(chain.neighbours, axis=1) == np.arange(3)).all()


def test_gradient_by_small_steps():
    rng = np.random.default_rng(5)
    chain = g.Chain(["a", "b"], 8, np.zeros(0, dtype=np.uint64))
    chain.neighbours, chain.first = rng.normal(size=(2, 2)), rng.normal(size=2)
    given, truth = rng.normal(size=(1, 4, 2)), [0, 1, 1, 0]

    def likelihood(scores, neighbours):
        def total(path):
            return (chain.first[path[0]] + sum(scores[0, t, k] for t, k in enumerate(path))
                    + sum(neighbours[a, b] for a, b in zip(path, path[1:])))
        return total(truth) - np.log(sum(np.exp(total(p)) for p in itertools.product((0, 1), repeat=4)))

    marginal, pairs = g._expected(chain, given)
    own = np.zeros((2, 2))
    for a, b in zip(truth, truth[1:]):
        own[a, b] += 1
    for i, j in itertools.product((0, 1), repeat=2):
        moved = chain.neighbours.copy()
        moved[i, j] += 1e-6
        assert abs((likelihood(given, moved) - likelihood(given, chain.neighbours)) / 1e-6 - (own - pairs)[i, j]) < 1e-4
    for t in range(4):
        moved = given.copy()
        moved[0, t, 1] += 1e-6
        assert abs((likelihood(moved, chain.neighbours) - likelihood(given, chain.neighbours)) / 1e-6 - (truth[t] - marginal[0, t, 1])) < 1e-4


def test_held_out_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = g.labelled(docs, g.fitted(docs)).collect()
    held = [r for r in rows if r.held_out and r.lang_pred != g.UNKNOWN]
    assert len(rows) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert len(held) > 250 and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_switched_documents(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(spoken(rng, x, 40)), x) for i in range(300) for x in [rng.choice(list(SYLLABLES))]]
    switched = [(1000, " ".join(spoken(rng, "aa", 30) + spoken(rng, "cc", 12)), None)]
    docs = spark.createDataFrame(rows + switched, "doc_id long, text string, lang string")
    chain = g.fitted(docs)
    got = g.labelled(docs, chain, stretches=True).filter("doc_id = 1000").first()
    assert got.lang_pred == "aa" and 0.6 < got.score < 0.8 and got.n_words == 42
    assert [(s.lang, s.start, s.words) for s in got.stretches] == [("aa", 0, 30), ("cc", 30, 12)] and got.n_switches == 1


def test_held_out_rows_do_not_matter(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(spoken(rng, x, 20)), x) for i in range(120) for x in [rng.choice(list(SYLLABLES))]]
    wrong = [(i, t, "aa" if zlib.crc32(str(i).encode()) % 3 == 1 else x) for i, t, x in rows]
    schema = "doc_id long, text string, lang string"
    one, other = (g.fitted(spark.createDataFrame(x, schema)) for x in (rows, wrong))
    assert (one.grams == other.grams).all() and (one.neighbours == other.neighbours).all()


def test_odd_rows(odd, none):
    chain = g.fitted(odd)
    rows = g.labelled(odd, chain).collect()
    assert len(rows) == odd.count()
    for r, text in ((r, t) for r in rows for t in [r.lang_pred]):
        assert (text == "und") == (r.n_words == 0)
    assert {r.lang_pred for r in rows if r.doc_id in (2, 3, 4)} == {"und"}
    assert g.labelled(none, g.fitted(none)).collect() == []
    assert {r.lang_pred for r in g.labelled(odd, g.fitted(none)).collect()} == {"und"}
