import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from probewise.llm import negatives as n


def brute(rows, anchors, positives=5, kept=5):
    """Rows (id, label, vector) -> result rows, by sorting all scores in whole numbers."""
    out = set()
    whole = {i: (label, [int(np.floor(256.0 * float(x))) for x in v]) for i, label, v in rows}
    for a in (i for i in whole if i in anchors):
        label, q = whole[a]
        score = {i: sum(x * y for x, y in zip(q, v)) for i, (_, v) in whole.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if whole[i][0] == label][:positives]:
            window = [i for i in order if whole[i][0] != label and 80 * score[p] <= 100 * score[i] <= 100 * score[p]]
            out |= {(a, p, rank + 1, i, score[p], score[i]) for rank, i in enumerate(window[:kept])}
    return out


def found(df):
    return {tuple(r) for r in df.collect()}


def test_strassen_is_the_product():
    rng = np.random.default_rng(3)
    for _ in range(60):
        i, k, j = rng.integers(1, 70, 3)
        a, b = rng.integers(-300, 300, (i, k)), rng.integers(-300, 300, (k, j))
        assert (n.strassen(a, b, leaf=int(rng.integers(1, 9))) == a @ b).all()


def test_strassen_multiplies_seven_times_a_level(monkeypatch):
    calls, real = [], n.strassen

    def counted(a, b, leaf=n.LEAF):
        calls.append(min(*a.shape, b.shape[1]) <= leaf)
        return real(a, b, leaf)

    monkeypatch.setattr(n, "strassen", counted)
    counted(np.ones((32, 32), dtype=np.int64), np.ones((32, 32), dtype=np.int64), 4)
    assert sum(calls) == 7 ** 3


def test_sums_that_wrap_on_the_way_are_exact():
    a = np.array([[2 ** 61, 1], [0, 2 ** 61]], dtype=np.int64)
    b = np.array([[1, 0], [2 ** 61, 1]], dtype=np.int64)
    assert (n.strassen(a, b, leaf=1) == [[2 ** 62, 1], [0, 2 ** 61]])[:, 1].all()


def test_heaps_merge_in_any_order():
    rng = random.Random(4)
    entries = [(rng.randrange(4), rng.randrange(6), rng.randrange(30)) for _ in range(300)]
    expected = [sorted({e for e in entries if e[0] == o}, key=lambda e: (-e[1], e[2]))[:3] for o in range(4)]
    for _ in range(5):
        rng.shuffle(entries)
        parts = []
        for low in range(0, 300, 100):
            heaps = n.Heaps(4, 3)
            for part in (entries[low:low + 60], entries[low + 40:low + 100]):  # overlapping
                heaps.add(*np.array(part, dtype=np.int64).T)
            parts.append(heaps)
        merged = n.Heaps(4, 3)
        for heaps in parts:
            merged.add(*heaps.entries())
        assert [list(zip(*merged.entries()))[3 * o:3 * o + 3] for o in range(4)] == expected


def test_results_by_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(int(i), int(rng.integers(0, 3)), [float(x) for x in rng.normal(0, 0.02, 6)]) for i in rng.permutation(180)]
    rows += [(500 + i, i % 3, rows[7][2]) for i in range(30)]  # a common vector: many equal scores
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(5)
    singles = [(i, label, [np.float32(x) for x in v]) for i, label, v in rows]
    expected = brute(singles, {i for i, _, _ in rows if i % 10 == 0})
    assert len(expected) > 100
    picked = F.col("vec_id") % 10 == 0
    assert found(n.hard_negatives(df, picked)) == expected
    assert found(n.hard_negatives(df, picked, block_bytes=8 * 6 * 10)) == expected  # some blocks of anchors
    monkeypatch.setattr(n, "TILE", 7)
    assert found(n.hard_negatives(df.repartition(1), picked)) == expected


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 2, [0.9, 0.0]), (2, 2, [0.9, 0.0]), (3, 2, [0.9]),
        (4, 2, []), (5, None, [1.0, 0.0]), (6, 2, None), (7, 2, [None, 1.0]), (8, 2, [nan, 1.0]), (9, 2, [inf, 1.0]),
        (None, 2, [1.0, 0.0]), (10, 3, [-1.0, 0.0]), (None, None, None)]
    extra = [(*r, "x", 1, 2, 3, 4) for r in rows]
    df = spark.createDataFrame(extra, "vec_id long, label int, embedding array<double>, q string, rank int, anchor int, pair int, block int")
    got = found(n.hard_negatives(df, F.col("vec_id") % 10 == 0))
    assert got == {(0, 1, 1, 2, 65536, 58880), (0, 1, 2, 3, 65536, 58880)}
    assert found(n.hard_negatives(df.limit(0), F.col("vec_id") % 10 == 0)) == set()


def test_scores_that_could_overflow_are_refused(spark):
    df = spark.createDataFrame([(0, 1, [1e30])], "vec_id long, label int, embedding array<double>")
    with pytest.raises(ValueError):
        n.hard_negatives(df, F.col("vec_id") % 10 == 0)
