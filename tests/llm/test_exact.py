from collections import defaultdict

from pyspark.sql import functions as F

from probewise.llm import exact
from probewise.llm.shared import sieve, sifted, without

BLANKS = dict.fromkeys(map(ord, " \t\n\x0b\x0c\r"))


def test_groups_of_odd_rows(odd):
    rows = odd.collect()
    groups = defaultdict(list)
    for r in rows:
        groups[(r.text or "").translate(BLANKS)].append(r)
    out = exact.exact_groups(odd, carry=odd.columns).collect()
    assert len(out) == len(rows)
    for r in out:
        members = groups[(r.row["text"] or "").translate(BLANKS)]
        best = min(members, key=lambda m: (-len(m.text or ""), m.doc_id is None, m.doc_id or 0))
        assert (r.keep_id, r.group_size) == (best.doc_id, len(members))
    assert sum(r.kept for r in out) == len(groups)
    assert all(r.doc_id == r.keep_id for r in out if r.kept)


def test_without_rows(none):
    assert exact.exact_groups(none).collect() == []


def test_texts_that_share_length_and_prefix_differ(spark):
    docs = spark.createDataFrame([(i, "p" * 300 + str(i % 7)) for i in range(70)], "doc_id long, text string")
    out = exact.exact_groups(docs).collect()
    assert all(r.group_size == 10 and r.keep_id == r.doc_id % 7 for r in out)


def test_a_crowded_sieve_lets_all_keys_pass_and_without_is_exact(spark):
    keys = spark.range(5000).select(F.col("id").alias("k"))
    words, bits = sieve(keys, 64)
    assert sifted(spark.range(10_000), words, bits, [F.col("id")]).filter("id < 5000 and not candidate").count() == 0
    frame = spark.range(10_000).select(F.col("id").alias("k"), F.lit("x").alias("candidate_"))
    assert {r.k for r in without(frame, keys, "k").collect()} == set(range(5000, 10_000))
