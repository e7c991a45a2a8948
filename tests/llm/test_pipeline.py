import re
from collections import Counter

import plain

import corpus_pipeline
from probewise.llm import catalog

SMALL = "/root/testdata/sf0.001"


def test_each_stage_on_what_the_one_before_kept(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        given, docs = docs.collect(), spark.read.parquet(str(tmp_path / name))
        seen[name] = given, docs.collect()
        if name != "packing":
            assert docs.columns == names
            assert set(docs.collect()) <= set(given)
    given, kept = seen["exact dedup"]
    first = {}
    for r in sorted(given, key=lambda r: (-len(r.text), r.doc_id)):
        first.setdefault(re.sub("[ \t-\r]", "", r.text), r.doc_id)
    assert sorted(r.doc_id for r in kept) == sorted(first.values())
    given, kept = seen["near dedup"]
    assert {r.doc_id for r in kept} == set(plain.near_classes({r.doc_id: r.text for r in given}).values())
    given, kept = seen["source mix"]
    assert max(Counter(r.doc_id for r in kept).values()) <= 2 and len(kept) > len(given)
    given, kept = seen["packing"]
    assert Counter(r.doc_id for r in kept if r.start == 0) == Counter(r.doc_id for r in given)


def test_toxic_documents_go_and_clean_ones_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    kept = {r.doc_id for r in corpus_pipeline.toxicity_filter(spark, docs, "/root/testdata/sf0.01").collect()}
    clean = [d for d, t in labels.items() if t == 0]
    toxic = [d for d, t in labels.items() if t == 1]
    assert sum(d in kept for d in clean) >= 0.98 * len(clean)
    assert sum(d in kept for d in toxic) <= 0.35 * len(toxic)


def test_odd_rows_pass_through(spark, odd, none):
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SMALL)
            assert name == "packing" or out.columns == docs.columns
            if name != "packing":
                assert out.count() <= 2 * docs.count()


def test_queries_match_their_sql(spark):
    import duckdb
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    for name, sql in catalog.SQL.items():
        got, expected = catalog.QUERIES[name](spark, SMALL), con.sql(sql)
        names = sorted(expected.columns)
        assert sorted(got.columns) == names, name
        one, other = ([tuple(r[c] for c in names) for r in rows] for rows in
                      (got.toArrow().to_pylist(), expected.to_arrow_table().to_pylist()))
        assert sorted(one, key=repr) == sorted(other, key=repr), name
