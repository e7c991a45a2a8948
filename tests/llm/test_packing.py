import random
from collections import defaultdict

import plain
from probewise.llm import packing


def pieces_by(rows, key):
    out = defaultdict(list)
    for r in rows:
        out[r[key]].append(r)
    return out


def check_sequences(rows, limits=packing.LIMITS):
    for pieces in pieces_by(rows, "sequence_id").values():
        pieces.sort(key=lambda r: r.offset)
        at = 0
        for r in pieces:
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= limits[0] and len(pieces) <= limits[1] and sum(r.loss_tokens for r in pieces) <= limits[2]


def test_documents_come_back_whole(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    reader = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(1)
    alphabet = ["the ", "Ünï", " 12 ", "\n\n", "  ", "don't", "<|endoftext|>", "###", "𝒳", "a"]
    texts = {i: "".join(rng.choices(alphabet, k=int(rng.paretovariate(0.5)) % 4000)) for i in range(300)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    rows = packing.packed(docs, with_ids=True).collect()
    check_sequences(rows)
    for doc_id, pieces in pieces_by(rows, "doc_id").items():
        pieces.sort(key=lambda r: r.start)
        ids = [i for r in pieces for i in r.ids]
        assert ids == reader.encode(texts[doc_id], add_special_tokens=False).ids + [0]
        assert all(plain.crc_of_ids(r.ids) == r.ids_crc32 and r.doc_tokens == len(ids) and len(r.ids) == r.length for r in pieces)
        assert [r.start for r in pieces] == [sum(p.length for p in pieces[:i]) for i in range(len(pieces))]
    filled = [sum(r.length for r in s) for s in pieces_by(rows, "sequence_id").values()]
    assert sum(n < 1024 for n in filled) <= 6


def test_limits_on_segments_and_loss_bearing_tokens(spark):
    rng = random.Random(2)
    rows = [(i, "ask " * rng.randint(0, 60), "answer " * rng.randint(0, 90)) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, prompt string, text string")
    limits = (256, 5, 100)
    out = packing.packed(docs, limits=limits, prompt="prompt").collect()
    check_sequences(out, limits)
    for doc_id, pieces in pieces_by(out, "doc_id").items():
        assert sum(r.length for r in pieces) == pieces[0].doc_tokens
        assert sum(r.loss_tokens for r in pieces) == pieces[0].doc_tokens - len(packing.encoder(None).encode(rows[doc_id][1]))


def test_odd_rows(odd):
    rows = packing.packed(odd, carry=["source"]).collect()
    check_sequences(rows)
    assert sum(r.start == 0 for r in rows) == odd.count()
    assert sum(r.length == 1 and r.doc_tokens == 1 for r in rows) == 4  # closing ids of missing and empty texts


def test_without_rows(none):
    assert packing.packed(none).collect() == []
