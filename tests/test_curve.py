import numpy as np
import pytest
from helpers import brute_auroc, brute_metrics
from pyspark.sql import functions as F

from probewise.operators import curve


def counted(spark, groups):
    rows = [(g, float(s), int(t)) for g, (scores, y) in groups.items() for s, t in zip(scores, y)]
    return curve.count_scores(spark.createDataFrame(rows, "g string, score double, y int"), ["g"])


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(3)
    out = {
        "ties": (rng.integers(-4, 5, 300) / 8.0, rng.integers(0, 2, 300)),
        "smooth": (rng.normal(size=257), rng.integers(0, 2, 257)),
        "outlier": (np.append(rng.normal(size=150) * 1e-6, [1e9, -1e9]), rng.integers(0, 2, 152)),
        "one_class": (rng.normal(size=20), np.ones(20, int)),
        "single": (np.array([0.25]), np.array([1])),
        "constant": (np.zeros(40), rng.integers(0, 2, 40)),
    }
    hot = rng.integers(0, 2, 4000)
    out["hot_value"] = (np.where(rng.random(4000) < 0.6, 0.5, rng.normal(size=4000)) + 0.01 * hot * (rng.random(4000) < 0.1), hot)
    return out


def test_auroc_matches_pair_counting(spark, groups):
    found = {r["g"]: r["auroc"] for r in curve.auroc(counted(spark, groups), ["g"], len(groups)).collect()}
    for g, (scores, y) in groups.items():
        want = brute_auroc(scores, y)
        assert (found[g] is None) == (want is None), g
        if want is not None:
            assert found[g] == pytest.approx(want, abs=1e-12), g


@pytest.mark.parametrize("name,metric", [("hamming", "accuracy"), ("hamming", "f1"), ("projected", "f1")])
def test_threshold_search_matches_brute_force(spark, groups, name, metric):
    points = curve.score_curve(counted(spark, groups), ["g"], len(groups))
    grid = curve.GRIDS[name]
    table = curve.candidate_thresholds(points, ["g"], grid)
    best = {r["g"]: r["threshold"] for r in curve.select_threshold(table, ["g"], metric).collect()}
    per_group = {r["g"]: r["c"] for r in table.groupBy("g").agg(F.count("*").alias("c")).collect()}
    for g, (scores, y) in groups.items():
        assert per_group[g] == len(grid)
        want, value = None, -np.inf
        for t in np.quantile(scores, grid):
            here = brute_metrics(scores, y, t)[metric]
            if here > value + 1e-15:
                want, value = t, here
        assert brute_metrics(scores, y, best[g])[metric] == pytest.approx(value)
        assert best[g] == pytest.approx(want, rel=1e-12, abs=1e-15)


def test_candidate_confusion_counts(spark, groups):
    points = curve.score_curve(counted(spark, groups), ["g"])
    for r in curve.candidate_thresholds(points, ["g"], curve.GRIDS["sanity"]).collect():
        scores, y = groups[r["g"]]
        assert r["tp"] == int(((scores >= r["threshold"]) & (y == 1)).sum())
        assert r["fp"] == int(((scores >= r["threshold"]) & (y == 0)).sum())


def test_sanity_threshold_prefers_the_largest(spark):
    scores, y = np.array([0.0, 0.0, 1.0, 1.0]), np.array([0, 0, 1, 1])
    points = curve.score_curve(counted(spark, {"a": (scores, y)}), ["g"])
    row = curve.sanity_threshold(curve.candidate_thresholds(points, ["g"], curve.GRIDS["sanity"]), ["g"]).first()
    assert row["f1"] == 1.0 and row["threshold"] == 1.0
    small = curve.select_threshold(curve.candidate_thresholds(points, ["g"], curve.GRIDS["sanity"]), ["g"], "f1").first()
    assert 0.0 < small["threshold"] < 1.0


def test_metrics_at_threshold(spark, groups):
    table = curve.threshold_metrics(counted(spark, groups), ["g"], F.lit(0.1), len(groups))
    for r in table.collect():
        scores, y = groups[r["g"]]
        for name, value in brute_metrics(scores, y, 0.1).items():
            assert r[name] == pytest.approx(value), (r["g"], name)
        assert r["n"] == len(y) and r["threshold"] == 0.1


def test_unknown_metric(spark, groups):
    with pytest.raises(ValueError):
        curve.select_threshold(spark.createDataFrame([("a", 0.1, 0.5)], "g string, threshold double, auroc double"), ["g"], "auroc")


def test_one_outlier_does_not_fill_a_bin(spark):
    counts = spark.range(50_000).select(
        F.lit("a").alias("domain"), (F.col("id") / 50_000).alias("score"), (F.col("id") % 2).alias("pos"), (1 - F.col("id") % 2).alias("neg"))
    outlier = spark.createDataFrame([("a", 1e12, 1, 0)], "domain string, score double, pos long, neg long")
    binned = curve._binned(counts.unionByName(outlier), ["domain"], 1)
    assert binned.groupBy("_bin").count().agg(F.max("count")).first()[0] <= 50_000 / 500
    assert binned.groupBy("_bin").agg(F.min("score").alias("lo"), F.max("score").alias("hi")).orderBy("_bin").selectExpr(
        "lo > coalesce(lag(hi) over (order by _bin), -1) as apart").filter("not apart").isEmpty()


def test_bounds_hold_and_sketches_merge(spark):
    rng = np.random.default_rng(41)
    score, y = np.round(rng.normal(size=6000), 3), rng.integers(0, 2, 6000)
    score += 0.8 * y
    rows = [(f"g{i % 2}", float(s), int(t)) for i, (s, t) in enumerate(zip(score, y))]
    rows += [("same", 1.0, i % 2) for i in range(50)] + [("one", float(i), 1) for i in range(9)] + [("g0", None, 1), ("g0", 5.0, None)]
    df = spark.createDataFrame(rows, "g string, score double, y int").repartition(6)
    exact = {r["g"]: r["auroc"] for r in curve.auroc(curve.stored_counts(df.dropna(), ["g"]), ["g"]).collect()}
    parts = df.withColumn("part", F.spark_partition_id())
    merged = curve.merged_sketches(curve.score_sketches(parts, ["g", "part"]), ["g"])
    for sketches in (None, merged):
        for r in curve.auroc_bounds(df, ["g"], sketches).collect():
            if r["g"] == "one":
                assert r["low"] is None and r["high"] is None
                continue
            assert r["low"] <= exact[r["g"]] <= r["high"]
            assert r["high"] - r["low"] < 0.01 or r["g"] == "same" and (r["low"], r["high"]) == (0.0, 1.0)
    grid = [0.1, 0.5, 0.9]
    for r in curve.approximate_quantiles(merged, ["g"], grid).filter("g like 'g%'").collect():
        own = np.array([s for g, s, _ in rows if g == r["g"] and s is not None])
        for p, q in zip(grid, r["quantiles"]):
            assert abs((own <= q).mean() - p) < 0.01
    assert curve.auroc_bounds(df.limit(0), ["g"]).collect() == []
