from dataclasses import replace

import numpy as np
import pytest
from helpers import acts_frame, brute_auroc, brute_metrics, planted
from pyspark.sql import functions as F

from probewise.config import (
    Directions, ExperimentSettings, HammingSettings, ProbeSettings, ProjectedSettings, Projection, Quantiser, Schedule)
from probewise.plans import evaluate, experiment
from probewise.sources import artifacts

SETTINGS = ExperimentSettings(
    probe=ProbeSettings(Directions(1, 2)),
    projected=ProjectedSettings(Projection(4), schedule=Schedule(3, 512)),
    hamming=HammingSettings(methods=("sign",), sign_schedule=Schedule(6, 512, 2, 6)))


@pytest.fixture(scope="module")
def data():
    return planted(240, 8)


@pytest.fixture(scope="module")
def prepared(spark, data):
    return experiment.prepare(acts_frame(spark, *data), SETTINGS)


def held_out(prepared, data, name):
    ids = sorted(r["example_id"] for r in prepared.split.filter(F.col("split") == name).collect())
    x, y, domain = data
    return x[ids].astype(float), y[ids], domain[ids]


def check_metrics(prepared, data, results, method):
    found = {(r["train_scope"], r["eval_scope"], r["split"]): r for r in results.metrics.collect()}
    scopes = prepared.trained
    assert len(found) == len(scopes) * (len(scopes) + 1)
    for scope in scopes:
        model = results.models[(method, scope)]
        for name, split in (("val", "val"), ("test", "test"), ("test", "cross_eval")):
            x, y, domain = held_out(prepared, data, name)
            for other in scopes if split == "cross_eval" else [scope]:
                if split == "cross_eval" and other == scope:
                    continue
                mine = np.ones(len(y), bool) if other == "combined" else domain == other
                scores = model.scores(x[mine])
                row = found[(scope, other, split)]
                assert row["n"] == mine.sum() and row["n_rows"] == len(model.rows)
                assert row["auroc"] == pytest.approx(brute_auroc(scores, y[mine]))
                for metric, value in brute_metrics(scores, y[mine], model.threshold).items():
                    assert row[metric] == pytest.approx(value), (scope, other, split, metric)


def test_projected_experiment(spark, data, prepared, tmp_path):
    results = experiment.run_projected(prepared, SETTINGS)
    check_metrics(prepared, data, results, "projected")
    assert ("projected", "global_all_rows") in results.models
    assert results.artifact_metrics.filter("train_scope = 'global_all_rows'").count() == 2
    row = results.metrics.filter("split = 'cross_eval'").first()
    assert row["source_split"] == "shared_test" and row["split_source"] is None
    assert row["projection_dim"] == 4 and row["projection_method"] == "row_subspace"
    matrix = evaluate.auroc_matrix(results.metrics, prepared.trained)
    assert matrix.columns == ["train_scope", "combined", "a", "b", "c"] and matrix.count() == 4
    with pytest.raises(ValueError, match="twice"):
        evaluate.auroc_matrix(results.metrics.unionByName(results.metrics), prepared.trained)
    art = experiment.projected_artifacts(prepared, results).filter("scope = 'a'").first()
    model = results.models[("projected", "a")]
    np.testing.assert_allclose(art["rows_projected_quantized"], model.encoded_rows(True))
    baked = np.array(art["euclidean_baked_rows"])
    np.testing.assert_allclose((baked ** 2).sum(axis=1), art["euclidean_constant"], atol=1e-9)
    artifacts.save_projected(prepared, results, str(tmp_path / "p"))
    saved = spark.read.parquet(str(tmp_path / "p" / "wta_model"))
    assert saved.count() == 5 and saved.filter("scope = 'a'").first()["artifact"] == "wta_a_L33_post_layer_proj4_lsq3bit_euclidean"
    assert spark.read.csv(str(tmp_path / "p" / "metrics_csv"), header=True).count() == results.metrics.count()
    ids = spark.read.parquet(str(tmp_path / "p" / "examples"))
    assert ids.filter("scope = 'combined'").count() == 240
    assert spark.read.parquet(str(tmp_path / "p" / "wta_history")).count() == 15


@pytest.mark.parametrize("weighted", [False, True])
def test_hamming_experiment(spark, data, prepared, tmp_path, weighted):
    settings = replace(SETTINGS, hamming=replace(SETTINGS.hamming, weighted=weighted))
    results = experiment.run_hamming(prepared, settings)
    check_metrics(prepared, data, results, "sign")
    row = results.metrics.filter("split = 'val'").first()
    assert row["source_split"] == "shared_val" and row["weighted_rows"] is weighted
    artifacts.save_hamming(prepared, results, str(tmp_path / "h"))
    saved = spark.read.parquet(str(tmp_path / "h" / "wta_model"))
    assert saved.count() == 4 and "hash_matrix" in saved.columns
    if not weighted:
        assert {h["epoch"] for h in results.history.collect()} == {2, 4, 6}
        assert all(set(m.alphas) == {1.0} for m in results.models.values())


def test_unweighted_early_stop_comes_after_seven_evaluations(spark, prepared):
    hamming = replace(SETTINGS.hamming, weighted=False, sign_schedule=Schedule(150, 512, 5, 6))
    history = experiment.run_hamming(prepared, replace(SETTINGS, hamming=hamming)).history
    assert [r["epoch"] for r in history.filter("scope = 'combined'").orderBy("epoch").collect()] == list(range(5, 36, 5))


def test_learned_matrix_and_learned_projection(spark, data, prepared):
    hamming = replace(SETTINGS.hamming, methods=("learned_matrix",), matrix_schedule=Schedule(2, 32, 2, 6))
    results = experiment.run_hamming(prepared, replace(SETTINGS, hamming=hamming))
    check_metrics(prepared, data, results, "learned_matrix")
    assert experiment.hamming_artifacts(prepared, results, True).first()["hash_matrix"]
    projected = replace(SETTINGS.projected, projection=Projection(4, "learned"), schedule=Schedule(2, 512))
    results = experiment.run_projected(prepared, replace(SETTINGS, projected=projected), False)
    check_metrics(prepared, data, results, "projected")
    plain = replace(SETTINGS.projected, projection=None, quantiser=Quantiser(3, on=False), schedule=Schedule(1, 512), distance="dot")
    results = experiment.run_projected(prepared, replace(SETTINGS, projected=plain), False)
    check_metrics(prepared, data, results, "projected")
    with pytest.raises(ValueError, match="row_subspace or learned"):
        bad = replace(SETTINGS.projected, projection=Projection(4, "pca"))
        experiment.run_projected(prepared, replace(SETTINGS, projected=bad))


def test_tokens_follow_the_split_of_their_example(spark, data):
    x, y, domain = data
    means = acts_frame(spark, x, y, domain)
    tokens = means.withColumn("token_position", F.explode(F.array(F.lit(0), F.lit(1))))
    settings = replace(SETTINGS, train_on="tokens")
    ready = experiment.prepare(means, settings, tokens)
    assert ready.rows.count() == 480
    assert ready.rows.join(ready.split.withColumnRenamed("split", "s"), "example_id").filter("split != s").isEmpty()
    metrics = experiment.run_hamming(ready, settings).metrics
    assert metrics.filter("split = 'test' and train_scope = 'combined'").first()["n"] == 96
    assert metrics.first()["train_on"] == "tokens"


def test_sanity_reports(spark, data, prepared):
    train = prepared.rows.filter("split = 'train'")
    report = {r["scope"]: r for r in evaluate.sanity_report(train, prepared.scopes, prepared.matrices).collect()}
    assert set(report) == {"combined", "a", "b", "c"} and report["combined"]["n"] == train.count()
    assert all(r["f1"] > 0.6 for r in report.values())
    signs = evaluate.sign_hash_report(train, prepared.scopes, prepared.matrices).collect()
    assert {r["scope"] for r in signs} == set(report)


def test_metrics_of_all_families_line_up(spark, prepared):
    a = experiment.run_hamming(prepared, replace(SETTINGS, hamming=replace(SETTINGS.hamming, weighted=False))).metrics
    b = experiment.run_projected(prepared, replace(SETTINGS, projected=replace(SETTINGS.projected, schedule=Schedule(1, 512))), False).metrics
    both = evaluate.ordered_metrics(evaluate.metrics_union(a, b))
    assert both.count() == a.count() + b.count()
    assert both.filter("method is null").count() == b.count()


def test_run_all_trains_three_families_from_one_split(spark, data):
    settings = replace(SETTINGS, projected=replace(SETTINGS.projected, schedule=Schedule(1, 512)),
                       hamming=replace(SETTINGS.hamming, sign_schedule=Schedule(2, 512, 5, 6)))
    means = acts_frame(spark, *data)
    out = experiment.run_all(means, settings)
    assert set(out) == {"projected", "hamming_weighted", "hamming_unweighted"}
    sizes = {name: r.metrics.filter("split = 'test' and train_scope = 'combined'").first()["n"] for name, r in out.items()}
    assert set(sizes.values()) == {48}


def test_conflicting_labels_fall_back_to_the_joined_split(spark, data):
    means = acts_frame(spark, *data)
    both = means.unionByName(means.filter("example_id < 5").withColumn("y", 1 - F.col("y")))
    ready = experiment.prepare(both, SETTINGS)
    assert ready.rows.groupBy("example_id").agg(F.count_distinct("split").alias("n")).filter("n > 1").isEmpty()
    assert ready.rows.count() == 245
