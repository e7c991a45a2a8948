import hashlib
import random
import zlib

import numpy as np
import plain
from probewise.llm import squares as s


def runs(words, least=6, exponent=4):
    """All runs by comparing the text with itself moved by every period."""
    found, n = {}, len(words)
    for q in range(1, n // exponent + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            low = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            if i + q - low >= max(least, exponent * q):
                found.setdefault((low, i + q), q)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def looped(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def described(doc_id, text):
    words = plain.WORD.findall(text or "")
    words = words if doc_id is None else looped(doc_id, words)
    found = runs(words)
    gone = {i for a, n, q in found for i in range(a + q, a + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None,
            sha("".join(f"{a},{n},{q}\n" for a, n, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def periodic(rng, n):
    """Words of few kinds, with stretches that repeat, some of them nested."""
    words = []
    while len(words) < n:
        base = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randint(1, 12))]
        if rng.random() < 0.3:
            base = base * rng.randint(2, 4) + [rng.randrange(3)]
        words += (base * rng.randint(1, 7))[:rng.randint(1, 80)]
    return np.array(words[:n], dtype=np.int64)


def test_runs_by_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        words = periodic(rng, rng.randint(0, 120))
        for least, exponent in ((6, 4), (2, 2), (1, 3)):
            assert [tuple(r) for r in s.runs_of([words], least, exponent)[0].tolist()] == runs(words.tolist(), least, exponent)


def test_word_by_word_is_the_same():
    rng = random.Random(2)
    for _ in range(60):
        words, at = periodic(rng, rng.randint(1, 90)), 0
        catchers = s.Catchers(2, 2)
        while at < len(words):
            size = rng.choice([1, 1, 2, 9])
            catchers.append(words[at:at + size])
            at += size
        assert [tuple(r) for r in catchers.runs().tolist()] == runs(words.tolist(), 2, 2)


def test_squares_are_known_as_soon_as_they_end():
    words = np.array([9, 1, 2, 3, 1, 2, 3, 1, 7])
    seen = []
    catchers = s.Catchers(2, 2)
    for word in words:
        catchers.append(np.array([word]))
        seen.append([tuple(r) for r in catchers.runs().tolist() if r[2] == 3])
    assert not any(seen[:6]) and (1, 6, 3) in seen[6] and (1, 7, 3) in seen[7]


def test_many_texts_at_once():
    rng = random.Random(3)
    texts = sorted((periodic(rng, rng.randint(0, 150)) for _ in range(80)), key=len, reverse=True)
    assert [[tuple(r) for r in found.tolist()] for found in s.runs_of(texts)] == [runs(t.tolist()) for t in texts]


def test_long_texts_in_appends(monkeypatch):
    monkeypatch.setattr(s, "STREAM", 64)
    rng = random.Random(4)
    words = periodic(rng, 700)
    assert [tuple(r) for r in s.runs_of([words])[0].tolist()] == runs(words.tolist())


def test_results_by_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{x}" for x in periodic(rng, rng.randint(0, 200)))) for i in range(150)]
    rows += [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 400)))) for i in range(150, 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: tuple(r) for r in s.periodic_runs(df, s.looped).collect()}
    assert got == {i: described(i, t) for i, t in rows}
    assert sum(r[1] > 0 for r in got.values()) > 100


def test_odd_rows(odd, none):
    got = s.periodic_runs(odd, s.looped).collect()
    assert len(got) == odd.count()
    expected = {(r.doc_id, r.text): described(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect() if len(r.text or "") < 10_000}
    rows = {tuple(r) for r in got}
    assert all(e in rows for e in expected.values())
    assert s.periodic_runs(none, s.looped).collect() == []


def test_one_word_many_times(spark):
    text = "junk " * 200_000
    row = s.periodic_runs(spark.createDataFrame([(None, text)], "doc_id long, text string")).first()
    assert tuple(row)[1:6] == (1, 0, 200_000, 1, 200_000_000) and row.collapsed_sha256 == sha("junk")
