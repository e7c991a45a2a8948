import numpy as np
import pytest
from helpers import acts_frame
from pyspark.sql import functions as F

from probewise.config import SplitSettings
from probewise.operators import sampling, split


def alternating(spark, n=80):
    return acts_frame(spark, np.zeros((n, 1)), [i % 2 for i in range(n)], ["ab"[i % 2] for i in range(n)])


def test_split_is_disjoint_and_complete(spark):
    acts = alternating(spark)
    table = split.shared_split(acts)
    assert split.leaked_examples(table).count() == 0
    assert split.coverage_gaps(acts, table).count() == 0
    sizes = {r["split"]: r["count"] for r in table.groupBy("split").count().collect()}
    assert sizes == {"test": 16, "val": 13, "train": 51}
    per = {(r["split"], r["domain"]): r["n"] for r in split.split_counts(acts, table).collect()}
    assert per[("test", "a")] == per[("test", "b")] == 8


def test_split_is_deterministic_and_seeded(spark):
    acts = alternating(spark)
    first = {r["example_id"]: r["split"] for r in split.shared_split(acts).collect()}
    again = {r["example_id"]: r["split"] for r in split.shared_split(acts.repartition(7)).collect()}
    other = {r["example_id"]: r["split"] for r in split.shared_split(acts, SplitSettings(seed=5)).collect()}
    assert first == again and first != other


def test_small_strata_are_split_without_strata(spark):
    acts = acts_frame(spark, np.zeros((11, 1)), [0] * 10 + [1], ["a"] * 11)
    sizes = {r["split"]: r["count"] for r in split.shared_split(acts).groupBy("split").count().collect()}
    assert sizes == {"test": 3, "val": 2, "train": 6}
    quotas = split.stratum_quotas(spark.createDataFrame([("x", 10), ("y", 1)], "stratum string, n long"), 0.2)
    assert {r["pool"] for r in quotas.collect()} == {"*"}


def test_quotas_use_the_largest_remainder(spark):
    strata = spark.createDataFrame([("a", 7), ("b", 7), ("c", 16)], "stratum string, n long")
    got = {r["stratum"]: r["quota"] for r in split.stratum_quotas(strata, 0.2).collect()}
    assert sum(got.values()) == 6 and got == {"a": 2, "b": 1, "c": 3}


def test_rule_and_join_agree_and_tokens_follow(spark):
    acts = alternating(spark, 60)
    rule = split.split_rule(split.one_row_per_example(acts).select("example_id", split.stratum_key().alias("stratum")))
    by_rule = {r["example_id"]: r["split"] for r in rule.tag(acts).collect()}
    table = split.shared_split(acts)
    assert by_rule == {r["example_id"]: r["split"] for r in table.collect()}
    tokens = acts.withColumn("token_position", F.explode(F.array(F.lit(0), F.lit(1))))
    tagged = split.tag_split(tokens, table)
    assert tagged.count() == 120
    assert tagged.groupBy("example_id").agg(F.count_distinct("split").alias("n")).filter("n > 1").isEmpty()
    assert split.rows_in_split(tokens, table, "val").count() == 2 * table.filter("split = 'val'").count()
    with pytest.raises(ValueError):
        split.rows_in_split(acts, table, "dev")


def test_repeated_ids_count_once(spark):
    acts = alternating(spark, 40)
    doubled = acts.unionByName(acts)
    assert split.shared_split(doubled).count() == 40
    assert split.one_row_per_example(doubled).filter("conflict").isEmpty()
    mixed = split.one_row_per_example(acts.unionByName(acts.withColumn("y", 1 - F.col("y"))))
    assert mixed.filter("conflict and y = 0").count() == 40


def test_no_stratum_is_sorted_whole(spark):
    """The rank look-up sorts single hash prefixes, never a whole stratum."""
    rows = spark.range(20_000).select(F.col("id").alias("example_id"), F.lit("hot").alias("stratum"))
    quotas = spark.createDataFrame([("hot", 20_000, 6_666)], "stratum string, n long, quota long")
    taken = sampling.take_per_stratum(rows, quotas, 3)
    order = rows.withColumn("h", sampling.hash_order(3)).orderBy("h", "example_id").limit(6_666)
    assert taken.count() == 6_666
    assert taken.join(order, "example_id", "left_anti").isEmpty()
    assert "Window" not in taken._jdf.queryExecution().executedPlan().toString()


def test_balanced_cap(spark):
    rows = spark.createDataFrame(
        [(i, "a" if i < 100 else "b", int(i % 10 == 0)) for i in range(130)], "example_id long, domain string, label int")
    got = {(r["domain"], r["label"]): r["count"]
           for r in sampling.balanced_cap(rows, 40, 0).groupBy("domain", "label").count().collect()}
    assert got == {("a", 0): 20, ("a", 1): 10, ("b", 0): 27, ("b", 1): 3}
    assert sampling.balanced_cap(rows, None).count() == 130
    assert sampling.balanced_cap(rows, 1).filter("domain = 'a'").count() == 2


def test_exact_per_class(spark):
    rows = spark.createDataFrame([(i, i % 2) for i in range(20)], "example_id long, label int")
    assert sampling.exact_per_class(rows, 4).count() == 8
    with pytest.raises(ValueError):
        sampling.exact_per_class(rows, 11)
