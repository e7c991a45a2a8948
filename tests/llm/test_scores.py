import itertools
import random

import numpy as np

from probewise.llm import gam, quality, toxicity
from probewise.llm.labelled import remainder


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_finds_what_edit_distance_finds():
    terms, stems = ["scum", "idiot", "worthless", "trash"], ["veq", "chll"]
    automaton, rng = toxicity.Automaton(terms, stems), random.Random(16)
    words = {"".join(w) for w in itertools.product("idot", repeat=5)}
    for term in terms * 60:
        word = list(term)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(word) + 1)
            word[at:at + rng.randint(0, 1)] = rng.choices("abtrshi", k=rng.randint(0, 1))
        words.add("".join(word))
    words |= {"veq", "vequita", "vexq", "chllane", "chl", ""}
    for word in words:
        near = [distance(word, t) for t in terms if distance(word, t) <= toxicity._accepts(t)]
        expected = 0 if any(word.startswith(s) for s in stems) else min(near, default=-1)
        assert automaton.look(word) == expected, word


def test_quoted_terms_count_apart():
    model = toxicity.ToxicModel(["idiot"], [], np.zeros(len(toxicity.FEATURES)), 0.0)
    spoken = dict(zip(toxicity.FEATURES, model.describe('he was called "an idiot" by them')))
    abuse = dict(zip(toxicity.FEATURES, model.describe("you idiott")))
    assert spoken["quoted"] > 0 and spoken["any"] == 0
    assert abuse["near"] > 0 and abuse["quoted"] == 0 and abuse["any"] == 1


def corpus(spark):
    rng = random.Random(17)
    docs, labels = [], []
    for i in range(1500):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(20, 80))]
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["dreadful", "nasties", "dreadfull"] if i % 10 else ["vexx" + rng.choice("abcde")])
        poor = i % 7 == 0
        docs.append((i, " ".join(w.upper() + "!!" for w in words) if poor else " ".join(words)))
        labels.append((i, int(not poor), int(bad)))
    return (spark.createDataFrame(docs, "doc_id long, text string"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    truth = {r.doc_id: r for r in labels.collect()}
    toxic = toxicity.scored(docs, toxicity.fitted(docs, labels)).collect()
    good = quality.scored(docs, quality.fitted(docs, labels)).collect()
    for rows, name in ((toxic, "toxic"), (good, "quality")):
        assert len(rows) == 1500
        held = [r for r in rows if r.held_out]
        assert np.mean([r.predicted == truth[r.doc_id][name] for r in held]) > 0.97


def test_labels_of_held_out_rows_are_not_read(spark):
    docs, labels = corpus(spark)
    turned = labels.withColumn("toxic", (1 - labels.toxic)).where(remainder(3) == 1).unionByName(labels.where(remainder(3) != 1))
    one, two = toxicity.fitted(docs, labels), toxicity.fitted(docs, turned)
    assert one.terms == two.terms and np.allclose(one.weights, two.weights)


def test_odd_rows_and_unfit_labels(spark, odd, none):
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1), (3, 1, 0), (3, 1, 0), (5, 7, 9)], "doc_id long, quality int, toxic int")
    for op in (toxicity, quality):
        model = op.fitted(odd, labels)
        rows = op.scored(odd, model).collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
        assert op.scored(none, op.fitted(none, labels.limit(0))).collect() == []
    carried = toxicity.scored(odd, toxicity.fitted(odd, labels), carry=odd.columns).collect()
    assert sorted(map(repr, (r.row["text"] for r in carried))) == sorted(map(repr, (r.text for r in odd.collect())))


def test_additive_model_learns_shapes_and_a_pair():
    rng = np.random.default_rng(18)
    x = rng.uniform(-1, 1, (4000, 4))
    y = ((np.abs(x[:, 0]) > 0.6) | (x[:, 1] * x[:, 2] > 0.25)).astype(float)
    model = gam.fit(x, y)
    fresh = rng.uniform(-1, 1, (2000, 4))
    truth = (np.abs(fresh[:, 0]) > 0.6) | (fresh[:, 1] * fresh[:, 2] > 0.25)
    assert np.mean((model.scores(fresh) > 0.5) == truth) > 0.9
    assert (1, 2) in model.pairs
    assert gam.fit(x[:0], y[:0]).scores(fresh).tolist() == [0.5] * 2000


def test_misspelt_words_under_a_stem_are_caught(spark):
    rng = random.Random(31)
    under = ["zorgling", "zorgtard", "zorgface", "zorgbrained", "zorgish"]
    clean = ["".join(rng.choices("abcdefghij", k=7)) for _ in range(300)]
    rows = [(" ".join(rng.choices(clean, k=30) + rng.sample(under, 2)), 1) for _ in range(200)]
    rows += [(" ".join(rng.choices(clean, k=30)), 0) for _ in range(400)]
    terms, stems = toxicity.learnt_lexicon(spark.createDataFrame(rows, "text string, label int"))
    assert any("zorg".startswith(s) or s.startswith("zorg") for s in stems)
    automaton, caught, tried = toxicity.Automaton(terms, stems), 0, 0
    for word in under:
        for i in (1, 2, 3):
            caught += automaton.look(word[:i] + "q" + word[i + 1:]) >= 0
            tried += 1
    assert caught >= 0.9 * tried
