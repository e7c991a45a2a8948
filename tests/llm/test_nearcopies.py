import random

import numpy as np
import plain
from probewise.llm import nearcopies as n
from probewise.llm.components import components


def corpus(rng, bases=25):
    words = [f"w{i}" for i in range(300)]
    texts, at = {}, 0
    for _ in range(bases):
        base = rng.choices(words, k=rng.randint(3, 200))
        for _ in range(rng.randint(1, 6)):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts[at] = " ".join(own)
            at += rng.randint(1, 3)
    return texts


def test_classes_by_brute_force(spark, monkeypatch):
    texts = corpus(random.Random(12))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    expected = plain.near_classes(texts)
    assert {r.doc_id: r.class_id for r in n.near_classes(docs).collect()} == expected
    monkeypatch.setattr(n, "BLOCK", 2)  # every bucket of three or more in parts
    assert {r.doc_id: r.class_id for r in n.near_classes(docs).collect()} == expected
    kept = {r.doc_id for r in n.one_of_each(docs).collect()}
    assert kept == set(expected.values())


def around_the_threshold(rng, families=4, members=20):
    """Variants of a text of which some align just enough with each other, some with a passage moved."""
    words = [f"w{i}" for i in range(3000)]
    texts = {}
    for _ in range(families):
        base = rng.sample(words, 120)
        for _ in range(members):
            own = list(base)
            for _ in range(rng.choice([1, 1, 2, 2, 3])):
                own[rng.randrange(len(own))] = rng.choice(words)
            if rng.random() < 0.4:
                cut = rng.randint(20, 100)
                own = own[cut:] + own[:cut]
            texts[len(texts)] = " ".join(own)
    return texts


def test_classes_of_variants_around_the_threshold(spark):
    texts = around_the_threshold(random.Random(2))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    expected = plain.near_classes(texts)
    assert {r.doc_id: r.class_id for r in n.near_classes(docs).collect()} == expected


def linked_by_brute_force(words):
    root = list(range(len(words)))
    for i in range(len(words)):
        for j in range(i):
            if root[i] != root[j] and plain.aligned_share(words[i], words[j]) >= 0.8:
                root = [root[j] if r == root[i] else r for r in root]
    return {frozenset(k for k, r in enumerate(root) if r == x) for x in root}


def test_links_connect_what_any_pair_connects():
    rng = random.Random(16)
    for round_ in range(6):
        texts = [t.split() for t in around_the_threshold(rng, 2, 14).values()]
        links = n.links_within([n.shingles(t) for t in texts])
        root = list(range(len(texts)))
        for i, j in links:
            assert plain.aligned_share(texts[i], texts[j]) >= 0.8
            root = [root[j] if r == root[i] else r for r in root]
        assert {frozenset(k for k, r in enumerate(root) if r == x) for x in root} == linked_by_brute_force(texts)
        assert len(links) < len(texts)


def test_common_counts_are_exact():
    rng = np.random.default_rng(18)
    for many in (3, 12, 40):
        kmers = [rng.integers(0, 30, rng.integers(5, 60)).astype(np.uint64) for _ in range(many)]
        marks = [n.labelled(x) for x in kmers]
        got = n.common(marks)
        for i in range(many):
            for j in range(many):
                if i != j:
                    assert got[i, j] == len(np.intersect1d(marks[i], marks[j]))
                    assert got[i, j] >= n.aligned(kmers[i], kmers[j])


def test_pivots_spare_alignments(monkeypatch):
    """Two families that share all words in another order: hardly a pair across is aligned."""
    rng = random.Random(19)
    base = [f"w{i}" for i in range(200)]
    families = [base, base[100:] + base[:100]]
    texts = []
    for family in families:
        for _ in range(30):
            own = list(family)
            own[rng.randrange(200)] = f"x{len(texts)}"
            texts.append(own)
    calls, real = [], n.similarity
    monkeypatch.setattr(n, "similarity", lambda *a: calls.append(1) or real(*a))
    assert len(n.links_within([n.shingles(t) for t in texts])) == 58 and len(calls) < 65


def test_order_matters(spark):
    rng = random.Random(13)
    words = [f"w{i}" for i in range(400)]
    swapped = words[200:] + words[:200]
    edited = words[:100] + ["new"] + words[100:]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(swapped)), (3, " ".join(edited))], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in n.near_classes(docs).collect()} == {1: 1, 2: 2, 3: 1}
    assert rng


def test_banded_share_is_exact_from_the_threshold_on():
    rng = random.Random(14)
    for _ in range(300):
        base = rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(5, 120))
        other = list(base)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(other))
            other[at:at + rng.randint(0, 2)] = rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(0, 2))
        if len(other) < 5:
            continue
        exact = plain.aligned_share(base, other)
        got = n.similarity(n.shingles(base), n.shingles(other))
        assert (got >= n.SIMILAR) == (exact >= n.SIMILAR)


def test_sketches_of_similar_texts_meet():
    rng = random.Random(15)
    met = 0
    for _ in range(100):
        base = [f"w{rng.randrange(5000)}" for _ in range(300)]
        other = list(base)
        for at in rng.sample(range(300), 5):
            other[at] = "edited"
        one, two = n.sketch(n.shingles(base)), n.sketch(n.shingles(other))
        met += bool(set(one.tolist()) & set(two.tolist()))
    assert met >= 99


def test_odd_rows(odd):
    rows = n.near_classes(odd).collect()
    assert len(rows) == odd.count()
    of = {}
    for r in rows:
        of.setdefault(r.doc_id, r.class_id)
    assert of[1] == of[9] == 1 and of[2] == of[3] == of[4] == 2 and of[5] == of[6] == 5 and of[7] == 7
    assert n.one_of_each(odd).columns == odd.columns


def test_without_rows(none):
    assert n.near_classes(none).collect() == []


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200) if i != 120] + [(500, 400)], "a long, b long")
    roots = {r.node: r.root for r in components(links).collect()}
    assert all(roots[i] == (0 if i <= 120 else 121) for i in range(201)) and roots[500] == roots[400] == 400
