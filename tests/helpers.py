import numpy as np


def acts_frame(spark, x, y, domain, ids=None):
    ids = range(len(y)) if ids is None else ids
    rows = [(int(i), str(d), int(t), [float(v) for v in row]) for i, d, t, row in zip(ids, domain, y, x)]
    return spark.createDataFrame(rows, "example_id long, domain string, y int, x array<float>")


def planted(n=240, d=8, domains=("a", "b", "c"), seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32)
    y = (x[:, 0] + 0.5 * x[:, 1] + 0.3 * rng.normal(size=n) > 0).astype(int)
    return x, y, np.array([domains[i % len(domains)] for i in range(n)])


def brute_auroc(scores, y):
    pos, neg = scores[y == 1], scores[y == 0]
    if not len(pos) or not len(neg):
        return None
    return float((pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean())


def brute_metrics(scores, y, threshold):
    pred = scores >= threshold
    tp, fp = int((pred & (y == 1)).sum()), int((pred & (y == 0)).sum())
    fn = int((~pred & (y == 1)).sum())
    return {
        "accuracy": float((pred == (y == 1)).mean()),
        "precision": tp / (tp + fp) if tp + fp else 0.0,
        "recall": tp / (tp + fn) if tp + fn else 0.0,
        "f1": 2 * tp / (2 * tp + fp + fn) if 2 * tp + fp + fn else 0.0,
    }
