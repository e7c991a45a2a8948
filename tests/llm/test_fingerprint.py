import hashlib
import random

from probewise.llm import fingerprint as f


def plain_result(texts):
    """{doc_id: (n_chars, edited sha, fingerprints)} of distinct ids by the definition."""
    order = sorted(texts, reverse=True)
    out = {}
    for i, d in enumerate(order):
        text, after = texts[d] or "", texts[order[(i + 1) % len(order)]] or ""
        third = len(text) // 3
        edited = text[:len(text) - third] + after[:third]
        own, changed, following = (f.fingerprint(f.codes(t)) for t in (text, edited, after))
        out[d] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), own, changed, f.likeness(own, changed), f.likeness(own, following))
    return out


def test_edited_texts_across_partitions(spark):
    rng = random.Random(6)
    texts = {3 * i: " ".join(rng.choices(["alpha", "é", "𝒳y", "gamma", "delta\n", "7"], k=rng.randint(0, 400))) for i in range(400)}
    texts[7], texts[8] = None, ""
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    for parts in (1, 4, 40):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        rows = {r.doc_id: tuple(r)[1:] for r in f.edited_fingerprints(docs).collect()}
        assert rows == plain_result(texts)
    spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_odd_rows(odd):
    rows = f.edited_fingerprints(odd).collect()
    assert len(rows) == odd.count()
    assert sorted((r.n_chars for r in rows)) == sorted(len(r.text or "") for r in odd.collect())


def test_none_and_one(spark, none):
    assert f.edited_fingerprints(none).collect() == []
    one, = f.edited_fingerprints(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).collect()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()


def test_an_edit_changes_the_signature_near_it_only():
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(900)]
    text = " ".join(words)
    moved = " ".join(words[:400] + ["inserted"] + words[400:])
    other = " ".join(rng.sample(words, 900))
    own, near, far = (f.fingerprint(f.codes(t)) for t in (text, moved, other))
    assert f.likeness(own, near) > 0.9
    assert f.likeness(own, far) < 0.5
    assert all(len(s) <= f.LONGEST for s in own.split(":")[1:2])


def test_common_subsequence_by_table():
    rng = random.Random(9)
    for _ in range(200):
        a, b = ("".join(rng.choices("abcd", k=rng.randint(0, 30))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
        assert f.common_subsequence(a, b) == row[-1]
