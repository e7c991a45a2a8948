import numpy as np
import pytest
from helpers import acts_frame, planted
from pyspark.sql import functions as F

from probewise.functions import kernels, vectors
from probewise.operators import scoring
from probewise.operators.projection import orthonormal, row_span_projection


def frame(spark, x):
    return acts_frame(spark, x, np.zeros(len(x)), ["a"] * len(x))


def collected(df):
    rows = df.orderBy("example_id").collect()
    return np.array([r["score"] for r in rows]), np.array([r["winner"] for r in rows])


def test_projection_preserves_dot_products(spark):
    rng = np.random.default_rng(0)
    rows, x = rng.normal(size=(4, 16)), rng.normal(size=(7, 16))
    weight, meta = row_span_projection(rows, 8, seed=0)
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    z = frame(spark, x).select("example_id", kernels.linear_map(F.col("x"), weight).alias("z")).orderBy("example_id")
    after = np.array([r["z"] for r in z.collect()]) @ (unit @ weight.T).T
    assert meta.exact and meta.rank == 4 and meta.filled == 4 and meta.gram_error < 1e-9
    np.testing.assert_allclose(after, x @ unit.T, atol=2e-5)
    assert weight.shape == (8, 16)
    np.testing.assert_allclose(weight @ weight.T, np.eye(8), atol=1e-9)
    assert row_span_projection(rows, 8, complete=False)[0].shape == (4, 16)
    assert row_span_projection(rows, 99)[0].shape == (16, 16)
    assert not row_span_projection(rows, 2)[1].exact
    assert row_span_projection(np.vstack([rows, rows[:2] * 3]), 16)[1].rank == 4
    with pytest.raises(ValueError):
        row_span_projection(np.empty((0, 4)))


@pytest.mark.parametrize("quantize", [False, True])
def test_euclidean_equals_dot(spark, quantize):
    rng = np.random.default_rng(1)
    rows, x = rng.normal(size=(5, 12)), rng.normal(size=(9, 12))
    weight, _ = row_span_projection(rows, 8)
    model = scoring.ProjectedModel(kernels.unit_rows(rows), weight, quantize=quantize, bias=0.3)
    a = collected(scoring.projected_scores(frame(spark, x), model, "dot"))
    b = collected(scoring.projected_scores(frame(spark, x), model, "euclidean"))
    np.testing.assert_allclose(a[0], b[0], atol=1e-5)
    np.testing.assert_array_equal(a[1], b[1])
    np.testing.assert_allclose(model.scores(np.float32(x).astype(float)), a[0], atol=1e-9)
    with pytest.raises(ValueError):
        scoring.projected_scores(frame(spark, x), model, "cosine")


def test_unweighted_hamming_literals(spark):
    rows = np.array([[1, -1, 1, -1], [-1, -1, 1, 1]])
    x = np.array([[2, -3, 4, -1], [-2, -4, 2, 3]])
    model = scoring.HammingModel(rows)
    for score in (scoring.hamming_scores, scoring.hamming_scores_in_jvm):
        scores, winners = collected(score(frame(spark, x), model))
        np.testing.assert_allclose(scores, [1.0, 1.0])
        np.testing.assert_array_equal(winners, [0, 1])
    np.testing.assert_array_equal(model.alphas, np.ones(2))


def test_zero_counts_as_plus_and_ties_go_to_the_lowest_row(spark):
    model = scoring.HammingModel(np.array([[1.0, 1.0], [1.0, 1.0], [-1.0, 1.0]]))
    for score in (scoring.hamming_scores, scoring.hamming_scores_in_jvm):
        scores, winners = collected(score(frame(spark, np.array([[0.0, -0.0], [-1.0, -1.0]])), model))
        np.testing.assert_allclose(scores, [1.0, 0.0])
        np.testing.assert_array_equal(winners, [0, 2])


def test_jvm_and_arrow_forms_agree(spark):
    x, _, _ = planted(60, 6)
    bank = np.random.default_rng(2).normal(size=(4, 6))
    df = frame(spark, x)
    for a, b in [
        (scoring.cosine_scores(df, bank), scoring.cosine_scores_in_jvm(df, bank)),
        (scoring.hamming_scores(df, scoring.HammingModel(bank, np.array([1, 1.5, 0.7, 1.1]), -0.2)),
         scoring.hamming_scores_in_jvm(df, scoring.HammingModel(bank, np.array([1, 1.5, 0.7, 1.1]), -0.2))),
    ]:
        (s1, w1), (s2, w2) = collected(a), collected(b)
        np.testing.assert_allclose(s1, s2, atol=1e-12)
        np.testing.assert_array_equal(w1, w2)
    want = (kernels.unit_rows(x.astype(float)) @ kernels.unit_rows(bank).T)
    np.testing.assert_allclose(collected(scoring.cosine_scores(df, bank))[0], want.max(axis=1), atol=1e-9)


@pytest.mark.parametrize("width", [5, 64, 130, 700])
def test_packed_codes_give_the_same_scores(spark, width):
    rng = np.random.default_rng(width)
    x, bank = rng.normal(size=(40, width)), rng.normal(size=(3, width))
    model = scoring.HammingModel(bank, np.array([1.0, 1.25, 0.5]), 0.125)
    df = frame(spark, x)
    codes = df.select("example_id", kernels.sign_words(F.col("x")).alias("words"))
    (s1, w1), (s2, w2) = collected(scoring.hamming_scores(df, model)), collected(scoring.hamming_scores_packed(codes, model))
    np.testing.assert_allclose(s1, s2, atol=1e-12)
    np.testing.assert_array_equal(w1, w2)
    with pytest.raises(ValueError):
        scoring.hamming_scores_packed(codes, scoring.HammingModel(bank, matrix=np.eye(width)))


def test_matrix_hash_uses_both_sides(spark):
    rng = np.random.default_rng(5)
    x, bank, matrix = rng.normal(size=(20, 5)), rng.normal(size=(3, 5)), rng.normal(size=(5, 5))
    scores, winners = collected(scoring.hamming_scores(frame(spark, x), scoring.HammingModel(bank, matrix=matrix)))
    codes = np.where(np.float32(x) @ matrix.T >= 0, 1, -1)
    sims = codes @ np.where(bank @ matrix.T >= 0, 1, -1).T / 5
    np.testing.assert_allclose(scores, sims.max(axis=1))
    np.testing.assert_array_equal(winners, sims.argmax(axis=1))


def test_quantiser_rounds_halves_to_even_and_clips(spark):
    df = spark.createDataFrame([([0.5, 1.5, 2.5, -0.5, 99.0, -99.0],)], "z array<double>")
    got = df.select(vectors.quantize(F.col("z"), 1.0, *scoring.qrange(3)).alias("q")).first()["q"]
    assert got == [0.0, 2.0, 2.0, 0.0, 3.0, -4.0]
    np.testing.assert_array_equal(kernels.quantized_steps(np.array([0.5, 1.5, 99.0]), 1.0, -4, 3), [0, 2, 3])
    assert scoring.qrange(3, signed=False) == (0, 7)
    assert scoring.default_scale(128, 3) == pytest.approx(1 / (np.sqrt(128) * 4))
    wide = scoring.ProjectedModel(np.eye(3), bits=32)
    np.testing.assert_allclose(wide.encoded_rows(True), np.eye(3))


def test_null_space_and_normalisation(spark):
    x, _, _ = planted(30, 5)
    directions = np.random.default_rng(4).normal(size=(2, 5))
    basis = orthonormal(np.vstack([directions, directions[:1]]))
    assert basis.shape == (2, 5)
    df = frame(spark, x)
    rest = np.array([r[0] for r in df.select(kernels.null_space(F.col("x"), basis)).collect()])
    np.testing.assert_allclose(rest @ directions.T, 0.0, atol=1e-6)
    same = df.select(kernels.null_space(F.col("x"), None).alias("v")).first()["v"]
    assert len(same) == 5
    one = df.select(vectors.remove_direction(vectors.as_doubles(F.col("x")), vectors.literal_vector(basis[0])).alias("v"))
    np.testing.assert_allclose(np.array([r["v"] for r in one.collect()]) @ basis[0], 0.0, atol=1e-6)
    unit = df.select(vectors.l2_normalize(vectors.as_doubles(F.col("x"))).alias("u"))
    np.testing.assert_allclose(np.linalg.norm([r["u"] for r in unit.collect()], axis=1), 1.0, atol=1e-6)


def test_vectors_of_different_length_are_an_error(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0, 3.0])], "example_id long, x array<double>").coalesce(1)
    with pytest.raises(Exception, match="of one length"):
        scoring.cosine_scores(df, np.ones((1, 2))).collect()


def test_softplus_is_safe(spark):
    df = spark.createDataFrame([(-800.0,), (0.0,), (800.0,)], "v double")
    got = [r[0] for r in df.select(vectors.softplus(F.col("v"))).collect()]
    np.testing.assert_allclose(got, [0.0, np.log(2), 800.0])


def test_banks_in_blocks_equal_one_product(spark):
    rng = np.random.default_rng(21)
    x, bank = rng.normal(size=(70, 12)), np.repeat(rng.normal(size=(60, 12)), 2, axis=0)  # every row twice: ties
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "example_id long, x array<double>").repartition(3)
    ids = rng.permutation(120)
    table = [(int(i), v.tolist(), 1.0 + (int(i) % 3) / 8) for i, v in zip(ids, bank)]
    for weighted in (False, True):
        given = spark.createDataFrame(table, "row_id int, row array<double>, alpha double").select("row_id", "row", *(["alpha"] if weighted else []))
        for block_bytes, together in ((1 << 20, 8), (2000, 2)):
            got = {r["example_id"]: (r["score"], r["winner"]) for r in scoring.blocked_winners(
                rows, given, block_bytes=block_bytes, together=together).collect()}
            scores = scoring.sign_similarity(x, bank) * (np.array([a for _, _, a in table]) if weighted else 1.0)
            for i, own in enumerate(scores):
                assert got[i] == (own.max(), min(ids[own == own.max()]))
    none = scoring.blocked_winners(rows, given.limit(0)).first()
    assert none["score"] is None and none["winner"] is None


def test_rows_whose_code_is_in_the_bank_meet_no_block(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x, bank = rng.normal(size=(60, 70)), rng.normal(size=(40, 70))
    bank[20:30] = x[:10] * rng.uniform(0.1, 9.0, size=(10, 70))  # the codes of ten rows, one of them twice
    bank[35], x[50], bank[36] = x[3], -1e-60, 1e-60              # too small for a float, but of unlike signs
    table = [(99 - i, row.tolist()) for i, row in enumerate(bank)]
    given = spark.createDataFrame(table, "row_id int, row array<double>")
    rows = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "example_id int, x array<double>")
    got = {r["example_id"]: (r["score"], r["winner"]) for r in scoring.blocked_winners(rows, given, block_bytes=6000, together=2).collect()}
    ids = 99 - np.arange(40)
    for i, own in enumerate(scoring.sign_similarity(x, bank)):
        assert got[i] == (own.max(), min(ids[own == own.max()]))
    assert got[3] == (1.0, 64) and got[50][0] < 1.0

    def refused(*_):
        raise AssertionError("a block was scored")

    monkeypatch.setattr(scoring, "_better", refused)
    settled = scoring.blocked_winners(rows.filter("example_id < 10"), given, block_bytes=6000, together=2).collect()
    assert {r["example_id"]: r["winner"] for r in settled} == {i: got[i][1] for i in range(10)}


def test_banks_are_refused_by_size_not_by_rows(spark, monkeypatch):
    bank = spark.range(5000).select(F.col("id").cast("int").alias("row_id"), F.array(F.lit(1.0)).alias("row"))
    assert kernels.bounded_bank(bank).shape == (5000, 1)
    monkeypatch.setattr(kernels, "MAX_BANK_BYTES", 5000)
    with pytest.raises(ValueError):
        kernels.bounded_bank(bank)


def test_alarm_rate_goes_on_after_a_restart(spark, tmp_path):
    from probewise.streaming.alarm_rate import alarm_rate

    def arrives(name, rows):
        spark.createDataFrame(rows, "time timestamp, domain string, flagged int").coalesce(1).write.parquet(str(tmp_path / "in" / name))

    def run():
        stream = spark.readStream.schema("time timestamp, domain string, flagged int").parquet(str(tmp_path / "in" / "*"))
        alarm_rate(stream, "time", "10 minutes", "5 minutes").writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
            "checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start().awaitTermination()
        rows = spark.read.parquet(str(tmp_path / "out")).selectExpr("minute(window_start) AS m", "domain", "n", "n_flagged", "rate").collect()
        return sorted(tuple(r) for r in rows)

    at = [__import__("datetime").datetime(2024, 1, 1, 0, m) for m in range(60)]
    arrives("a", [(at[1], "d", 1), (at[2], "d", 0), (at[3], "e", None), (at[12], "d", 1), (None, "d", 1)])
    assert run() == []  # the first window is open until minute 15
    arrives("b", [(at[4], "d", 0), (at[17], "d", 1)])
    assert run() == [(0, "d", 3, 1, 1 / 3), (0, "e", 1, 0, 0.0)]
    arrives("c", [(at[5], "d", 1), (at[40], "e", 1)])  # the first comes too late
    assert run() == [(0, "d", 3, 1, 1 / 3), (0, "e", 1, 0, 0.0), (10, "d", 2, 2, 1.0)]
    batch = spark.read.parquet(str(tmp_path / "in" / "*"))
    assert alarm_rate(batch, "time", "10 minutes", "5 minutes").count() == 4
