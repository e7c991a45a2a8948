import pytest

from probewise.llm import catalog

SMALL = "/root/testdata/sf0.001"
RESULTS = {
    "op1_personal_data": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op2_anchor_substrings": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op3_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op4_quality": ["doc_id", "held_out", "score", "predicted"],
    "op5_order_minhash": ["doc_id", "class_id"],
    "op6_source_mix": ["doc_id", "size", "source_size", "target", "taken"],
    "op7_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op8_vector_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op9_piecewise_hash": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op12_dyadic_squares": ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
    "op13_language_chain": ["doc_id", "held_out", "lang_pred", "score"],
    "op10_virtual_slots": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
}


@pytest.mark.parametrize("name", RESULTS)
def test_result_columns_and_rows(spark, name):
    out = catalog.QUERIES[name](spark, SMALL)
    assert out.columns[:len(RESULTS[name])] == RESULTS[name]
    ids = {r.doc_id for r in out.select("doc_id").collect()}
    assert ids == {r.doc_id for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id").collect()}
