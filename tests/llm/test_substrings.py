import random

import plain
from probewise.llm import substrings


def test_repeats_by_brute_force(spark):
    rng = random.Random(10)
    words = [f"w{i}" for i in range(40)]
    passages = [rng.choices(words, k=rng.randint(5, 40)) for _ in range(6)]
    texts = {}
    for d in rng.sample(range(1000), 120):
        parts = [rng.choice(passages) if rng.random() < 0.6 else rng.choices(words, k=rng.randint(1, 15)) for _ in range(rng.randint(0, 8))]
        texts[d] = rng.choice([" ", "\n", " \t "]).join(w for p in parts for w in p)
    texts[1001] = texts[1002] = texts[max(texts)]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    for window in (10, 11, 50):
        rows = {r.doc_id: tuple(r)[1:] for r in substrings.repeats_removed(docs, window).collect()}
        assert rows == plain.repeats(texts, window)


def test_many_buckets_and_rows_give_the_same(spark, monkeypatch):
    rng = random.Random(11)
    shared = rng.choices("abcdefgh", k=90)
    texts = {d: " ".join(rng.choices("abcdefgh", k=20) + shared[d % 7:] + rng.choices("abcdefgh", k=20)) for d in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    monkeypatch.setattr(substrings, "PER_BUCKET", 64)
    rows = {r.doc_id: tuple(r)[1:] for r in substrings.repeats_removed(docs).collect()}
    assert rows == plain.repeats(texts)


def test_odd_rows(odd):
    rows = substrings.repeats_removed(odd, 5).collect()
    assert len(rows) == odd.count()
    texts = {r.doc_id: r.text for r in odd.collect() if r.doc_id is not None}
    expected = plain.repeats(texts, 5)
    for r in rows:
        if r.doc_id is not None:
            assert tuple(r)[1:] == expected[r.doc_id]


def test_without_rows(none):
    assert substrings.repeats_removed(none).collect() == []
