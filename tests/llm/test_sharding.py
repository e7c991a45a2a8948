import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from probewise.llm import sharding


def test_shards_have_near_equal_bytes_and_gapless_slots(spark):
    docs = spark.range(20_000).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("é"), (F.col("id") % 97 + F.when(F.col("id") % 1000 == 0, 3000).otherwise(0)).cast("int")).alias("text"))
    out = sharding.sharded(docs).collect()
    loads, slots = Counter(), defaultdict(list)
    for r in out:
        loads[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert sorted(loads) == list(range(16))
    assert max(loads.values()) <= 1.01 * min(loads.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_odd_rows(odd):
    out = sharding.sharded(odd, carry=["text"]).collect()
    assert len(out) == odd.count()
    for r in out:
        text = (r.row["text"] or "").encode()
        assert r["size"] == len(text) + 1 and r.text_crc32 == zlib.crc32(text)


def test_without_rows(none):
    assert sharding.sharded(none).collect() == []


def test_a_grown_map_moves_slots_only_into_the_new_shard(spark, tmp_path):
    docs = spark.range(50_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"))
    slotted = docs.select(sharding.size_of().alias("size"), sharding.virtual_slot().alias("virtual"))
    loads = sharding.slot_loads(slotted).cache()
    first = sharding.first_map(loads, 4)
    sharding.write_map(first, str(tmp_path / "map"))
    old = spark.read.parquet(str(tmp_path / "map")).filter("version = 1")
    sharding.write_map(sharding.grown_map(old, loads, 5), str(tmp_path / "map"))
    both = spark.read.parquet(str(tmp_path / "map"))
    one = {r.virtual: r.shard for r in both.filter("version = 1").collect()}
    two = {r.virtual: r.shard for r in both.filter("version = 2").collect()}
    assert one.keys() == two.keys()
    assert all(two[v] in (one[v], 4) for v in one)
    size = {r.virtual: r.bytes for r in loads.collect()}
    share = sum(size[v] for v in two if two[v] == 4) / sum(size.values())
    assert 0.18 <= share <= 0.2
    placed = sharding.sharded(docs, slot_map=both.filter("version = 2"))
    assert placed.select("shard").distinct().count() == 5


def test_both_versions_of_the_map_over_a_table(spark, odd, none):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("y"), (F.col("id") % 40).cast("int")).alias("text"))
    rows = sharding.rebalanced(docs).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in rows} == {(r.doc_id, r.shard, r.slot) for r in sharding.sharded(docs).collect()}
    assert all(r.next_shard in (r.shard, 16) and r.map_version == 1 for r in rows)
    loads = Counter()
    for r in rows:
        loads[r.next_shard] += r["size"]
    assert len(loads) == 17 and 0.04 < loads[16] / sum(loads.values()) <= 1 / 17
    assert len({r.text_group for r in rows}) == 40
    assert sharding.rebalanced(odd).count() == odd.count() and sharding.rebalanced(none).collect() == []
