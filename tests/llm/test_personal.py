import random

import pytest
import plain
from pyspark.sql import functions as F

from probewise.llm import personal


def spans_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = personal.candidates(docs).collect()
    return {r.doc_id: [(k, s.start, s.end) for k in personal.KINDS for s in r[k]] for r in rows}


def test_base_spans_match_the_plain_patterns(spark):
    rng = random.Random(3)
    pieces = ["a", "b.c", "@", ".", "..", "x_y", "%", "-", "1", "12", "255", "256", "0001", "+", " ", "(", ")", "é", "𝒳", "\n",
              "4111 1111 1111 1111", "4111-1111-1111-1111", "10.0.0.1", "1.2.3.4.5", "+1 (555) 010-9999", "me@site.example.com"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 24))) for _ in range(3000)]
    texts += [None, "", "a@b.c_d@e.f", "1" * 5000, "1 " * 5000, "a." * 3000 + "@" + "b." * 3000, "+" + "1 " * 4000, "a" * 20000,
              "+1  2  3  4  5  6  7  8  9", "+1. 2. 3. 4. 5. 6. 7. 8. 9", "call +1((2))..3--4  5((6  7  8  9)) now"]
    marks = ["+", "  ", "((", "))", "..", "--", ". ", "1", "23", "4", "x"]
    texts += ["+" + "".join(rng.choices(marks, k=rng.randint(4, 30))) for _ in range(800)]
    got = spans_of(spark, texts)
    for i, text in enumerate(texts):
        assert got[i] == plain.base_spans(text), text


def test_result_rows_and_digest(spark):
    texts = ["mail me@site.example.com or +1 555 010 9999", None, "", "host 10.0.0.1, card 4111111111111111"]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)] + [(None, texts[0], "x", 2)],
                                 "doc_id long, text string, spans string, n_email int")
    rows = personal.personal_spans(docs).collect()
    assert len(rows) == 5
    for r in rows:
        base = plain.base_spans(texts[r.doc_id or 0])
        assert r.base_sha256 == plain.sha(",".join(f"{k}:{s}:{e}" for k, s, e in base))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, *_ in base) for x in personal.KINDS]
        assert set(f"{k}:{s}:{e}" for k, s, e in base) <= set(r.spans.split(",")) | {""} or not base


def test_trees_add_look_alikes_but_not_plain_numbers(spark):
    rng = random.Random(5)

    def number(form):
        return "".join(str(rng.randint(0, 9)) if c == "9" else c for c in form)

    texts = [f"please call +{number('1 (999) 555-9999')} soon" for _ in range(500)]
    texts += [f"the order {number('99999999')} and {number('9999-99-99')} came" for _ in range(700)]
    hidden = [f"please call {number('1 (999) 555-9999')} soon" for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts + hidden)), "doc_id long, text string")
    added = {r.doc_id: r.n_added for r in personal.personal_spans(docs).collect()}
    assert sum(added[i] for i in range(1200, 1220)) >= 18
    assert sum(added[i] for i in range(500, 1200)) == 0


def test_every_proposal_counts(spark):
    """A hundred of 120,000 proposals have a sign of their own: half of them are enough for a threshold, a third of that is not."""
    rare, number = F.col("id") % 1200 == 7, personal.KINDS.index("phone")
    features = F.concat(F.array(F.lit(float(number)), F.when(rare, 9.0).otherwise(F.col("id") % 5)), F.array_repeat(F.lit(0.0), 20))
    rows = spark.range(120_000).select(F.col("id").alias("doc_id"), F.array(F.struct(
        F.lit(number).alias("kind"), F.lit(0).alias("start"), F.lit(9).alias("end"), rare.alias("hit"), features.alias("features"))).alias("loose"))
    assert number in personal.fitted(rows).thresholds


@pytest.mark.parametrize("rows", [[], [(1, None), (None, "")]])
def test_nothing_to_find(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.spans for r in personal.personal_spans(docs).collect()] == [""] * len(rows)
