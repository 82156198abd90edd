from brute import jump
from pyspark.sql import functions as F

from tidewire.llm.sharding import jump_hash, shard_documents, with_slots

KEYS = [0, 1, -1, 2**62, -(2**63), 2**63 - 1, *range(500, 800)]
SCHEMA = "doc_id long, text string, size string, shard string"


def test_jumps_equal_the_plain_walk(spark):
    keys = spark.createDataFrame([(k,) for k in KEYS], "k long")
    for shards in (1, 2, 40):
        rows = keys.select("k", jump_hash(F.col("k"), shards).alias("s")).collect()
        assert all(r["s"] == jump(r["k"], shards) for r in rows)


def test_one_more_shard_takes_rows_only_into_itself(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    rows = shard_documents(docs, 40).collect()
    moved = [r for r in rows if r["shard"] != r["grown_shard"]]
    assert 30 < len(moved) < 130 and all(r["grown_shard"] == 40 for r in moved)


def test_odd_rows_and_clashing_columns(spark):
    rows = [(None, None, "a", "b"), (5, "", None, None), (5, "é", "a", "b"), (5, "é", "a", "b"), (7, "x" * 300_000, "", "")]
    found = shard_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [r["size"] for r in found] == [16, 16, 18, 18, 300_016]
    assert found[0]["shard"] == jump(0, 40) and found[0]["text_crc32"] == 0
    assert len({r["shard"] for r in found[1:4]}) == 1


def test_slots_have_no_gap(spark):
    rows = [(i % 7, i // 3) for i in range(2000)] + [(1, None)] * 5
    for block in (50, 10_000):
        found = with_slots(spark.createDataFrame(rows, "shard int, key int"), "shard", ["key"], rows_per_block=block).collect()
        by_shard = {}
        for r in found:
            by_shard.setdefault(r["shard"], []).append(r["slot"])
        assert len(found) == len(rows) and all(sorted(s) == list(range(len(s))) for s in by_shard.values())


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert with_slots(shard_documents(empty)).count() == 0
