import json

import numpy as np
import pytest
from helpers import acts_frame, planted
from pyspark.sql import functions as F

from probewise.operators import pooling, scopes
from probewise.plans import extract
from probewise.sources import activations as stores
from probewise.sources.numpy_store import NumpyStore
from probewise.workspace import shared_folder, written


@pytest.fixture(scope="module")
def acts(spark):
    x, y, domain = planted(50, 6)
    return acts_frame(spark, x, y, domain)


def test_store_round_trip_and_gate(spark, acts, tmp_path):
    path = str(tmp_path / "store")
    calls = []

    def make():
        calls.append(1)
        return acts

    first = stores.stored_or_made(spark, path, make)
    assert first.count() == 50 and len(calls) == 1
    assert stores.stored_or_made(spark, path, make).count() == 50 and len(calls) == 1
    stores.stored_or_made(spark, path, make, force=True)
    assert len(calls) == 2
    assert stores.newest_version(spark, path)[0] == 2
    with pytest.raises(FileExistsError):
        stores.write_activations(acts, path)
    plan = first.filter("domain = 'a'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(domain" in plan


def test_a_failing_writer_leaves_the_version_before(spark, acts, tmp_path):
    path = str(tmp_path / "versions")
    stores.write_activations(acts, path)
    broken = acts.withColumn("y", F.raise_error(F.lit("the writer fails")).cast("int"))
    with pytest.raises(Exception, match="the writer fails"):
        stores.write_activations(broken, path, replace=True)
    assert stores.newest_version(spark, path)[0] == 1 and stores.read_activations(spark, path).count() == 50
    doubled = stores.read_activations(spark, path)
    stores.write_activations(doubled.unionByName(doubled), path, replace=True)  # from the store itself
    assert stores.newest_version(spark, path)[0] == 2 and stores.read_activations(spark, path).count() == 100
    plain = str(tmp_path / "plain")
    acts.write.parquet(plain)
    assert stores.read_activations(spark, plain).count() == 50 and stores.newest_version(spark, plain) is None
    with pytest.raises(FileExistsError):
        stores.write_activations(acts, plain)


def test_required_columns_and_manifest(spark, acts):
    with pytest.raises(KeyError, match="domain"):
        stores.require_columns(acts.drop("domain"))
    row = stores.manifest(acts).first()
    assert (row["n_rows"], row["min_width"], row["max_width"], row["longest_domain"]) == (50, 6, 6, 1)
    assert stores.vector_width(acts) == 6
    with pytest.raises(ValueError):
        stores.vector_width(acts.withColumn("x", F.slice("x", 1, F.least(F.col("example_id"), F.lit(2)).cast("int") + 1)))
    assert sum(r["n"] for r in stores.inspect(acts).collect()) == 50


def test_half_precision(spark, acts):
    row = acts.select("x", stores.half_precision(F.col("x")).alias("h")).first()
    np.testing.assert_array_equal(np.float16(row["x"]).astype(float), row["h"])


def test_numpy_store(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(37, 4)).astype(np.float16)
    for name, value in {"X_mean": x, "y_mean": np.arange(37) % 2, "domain_mean": np.array(["ab"[i % 2] for i in range(37)]),
                        "example_index_mean": np.arange(37) * 10, "X_token": x[:5], "y_token": np.zeros(5, int),
                        "domain_token": np.array(["a"] * 5), "example_index_token": np.arange(5), "token_position": np.arange(5)}.items():
        np.save(tmp_path / f"{name}.npy", value)
    spark.dataSource.register(NumpyStore)
    df = spark.read.format("numpy_store").option("rows_per_partition", 10).load(str(tmp_path))
    rows = df.orderBy("example_id").collect()
    assert df.rdd.getNumPartitions() == 4 and len(rows) == 37
    np.testing.assert_array_equal(np.array([r["x"] for r in rows]), x.astype(np.float32))
    assert rows[3]["example_id"] == 30 and rows[3]["domain"] == "b" and rows[3]["y"] == 1
    tokens = spark.read.format("numpy_store").option("part", "token").load(str(tmp_path))
    assert [r["token_position"] for r in tokens.orderBy("token_position").collect()] == list(range(5))
    names = ("X_mean", "y_mean", "domain_mean", "example_index_mean")
    for save in (np.savez, np.savez_compressed):
        save(tmp_path / "one.npz", **{n: np.load(tmp_path / f"{n}.npy") for n in names})
        packed = spark.read.format("numpy_store").option("rows_per_partition", 10).load(str(tmp_path / "one.npz"))
        assert packed.rdd.getNumPartitions() == 4
        assert packed.orderBy("example_id").collect() == rows
    (tmp_path / "manifest.json").write_text(json.dumps({"arrays": {"X_mean": {}, "gone": {}}}))
    with pytest.raises(Exception, match="gone.npy"):
        spark.read.format("numpy_store").load(str(tmp_path)).count()
    (tmp_path / "manifest.json").write_text(json.dumps({"arrays": {"X_mean": {}}}))
    with pytest.raises(Exception, match="lacks the arrays"):
        spark.read.format("numpy_store").load(str(tmp_path)).count()


def test_spans(spark):
    df = spark.createDataFrame([
        ("plain", [1, 2], [1, 2, 3, 4], [3, 4]), ("closed", [1, 2], [1, 2, 3, 9], [3]),
        ("fallback", [1, 2, 3, 4], [1, 2, 3, 4], [3, 4]), ("nothing", [1, 2], [1, 2], []),
        ("only_end", [1, 2], [1, 2, 9], [7]),
    ], "name string, prefix array<long>, full array<long>, own array<long>")
    span = pooling.assistant_span(F.col("prefix"), F.col("full"), F.col("own"), 9)
    got = {r["name"]: r for r in df.select("name", "full", span.alias("s")).withColumn(
        "t", pooling.span_tokens(F.col("full"), F.col("s"))).collect()}
    assert tuple(got["plain"]["s"]) == (2, 4) and got["plain"]["t"] == [3, 4]
    assert tuple(got["closed"]["s"]) == (2, 3)
    assert tuple(got["fallback"]["s"]) == (2, 4)
    assert got["nothing"]["s"] is None
    assert tuple(got["only_end"]["s"]) == (2, 3) and got["only_end"]["t"] == [9]


def test_extraction_pools_all_tokens_and_caps_the_stored_ones(spark):
    text = " ".join(f"w{i}" for i in range(70))
    examples = spark.createDataFrame(
        [(0, "a", 1, "p", text), (1, "a", 0, "p", "bad"), (2, "b", 0, "p", "empty")],
        "example_id long, domain string, label int, user_prompt string, assistant_text string")

    sizes = []

    def encoder(pairs):
        sizes.append(len(pairs))
        if any(answer == "bad" for _, answer in pairs):
            raise RuntimeError("no")
        return [np.empty((0, 3)) if answer == "empty" else
                np.arange(len(answer.split(" ")), dtype=float)[:, None] * np.ones(3) for _, answer in pairs]

    found = extract.extract(examples, encoder)
    mean = found.means.collect()
    assert [r["example_id"] for r in mean] == [0] and mean[0]["x"] == [34.5] * 3 and mean[0]["y"] == 1
    tokens = sorted(found.tokens.collect(), key=lambda r: r["token_position"])
    assert len(tokens) == 64 and tokens[-1]["token_position"] == 63 and tokens[5]["x"] == [5.0] * 3
    assert {r["example_id"]: r["error"] for r in found.errors.collect()} == {1: "RuntimeError: no", 2: "no token vectors"}
    pooled = pooling.mean_pool(spark.createDataFrame(
        [(0, [1.0, 2.0]), (0, [3.0, 4.0]), (1, [5.0, 6.0])], "example_id long, x array<double>").repartition(3))
    assert {r["example_id"]: r["x"] for r in pooled.collect()} == {0: [2.0, 3.0], 1: [5.0, 6.0]}
    with pytest.raises(ValueError, match="RuntimeError: no"):
        extract.extracted_or_fail(extract.extract(examples.filter("example_id = 1"), encoder))

    def exhausted(pairs):
        raise RuntimeError("CUDA out of memory")
    with pytest.raises(Exception, match="out of memory"):
        extract.extract(examples, exhausted)


def test_hash_encoder_equals_its_jvm_form(spark):
    df = spark.createDataFrame([("one",), ("zwei",)], "token string")
    for r in extract.hashed_tokens(df, 5).collect():
        np.testing.assert_allclose(r["x"], extract.hash_vector(r["token"], 5))


def test_label_refresh_is_all_or_nothing(spark, acts):
    current = acts.select("example_id", (1 - F.col("y")).alias("label"))
    flipped = scopes.refresh_labels(acts, current)
    assert flipped.columns == acts.columns
    assert flipped.join(acts.select("example_id", F.col("y").alias("old")), "example_id").filter("y + old != 1").isEmpty()
    same = scopes.refresh_labels(acts, current.filter("example_id > 0"))
    assert same.exceptAll(acts).isEmpty()


def test_scopes(spark, acts):
    assert scopes.in_scope(acts, "combined").count() == 50
    order = [r["domain"] for r in scopes.domain_order(acts, ("c",)).orderBy("place").collect()]
    assert order == ["c", "a", "b"]
    assert [r["domain"] for r in scopes.domain_order(acts).orderBy("place").collect()] == ["a", "b", "c"]
    with pytest.raises(ValueError, match="no token activations"):
        scopes.training_table(acts, None, "tokens")
    with pytest.raises(ValueError):
        scopes.training_table(acts, None, "words")
    assert scopes.flip_labels(acts, [], "y") is acts
    assert scopes.flip_labels(acts, ["a"], "y").schema["y"].dataType == acts.schema["y"].dataType
    coverage = scopes.class_coverage(acts.withColumn("y", F.when(F.col("domain") == "a", 1).otherwise(F.col("y"))), ["domain"])
    assert {r["domain"]: r["usable"] for r in coverage.collect()} == {"a": False, "b": True, "c": True}


def test_written_tables_live_in_the_shared_folder(spark):
    out = written(spark.range(3), "three")
    assert out.inputFiles()[0].removeprefix("file://").startswith(shared_folder(spark))
