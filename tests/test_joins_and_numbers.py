import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewire.operators import lookup
from tidewire.operators.ordinals import with_chunks, with_row_number


@pytest.mark.parametrize("how", ["left", "inner", "left_anti", "left_semi"])
def test_salted_join_equals_the_plain_one(spark, how):
    keys = ["hot"] * 400 + [None] * 100 + [f"k{i % 37}" for i in range(300)] + ["absent"] * 20
    big = spark.createDataFrame(list(enumerate(keys)), "ord long, key string")
    table = spark.createDataFrame(
        [("hot", 1.0), ("other", 2.0)] + [(f"k{i}", float(i)) for i in range(30)],
        "key string, w double",
    )
    want = sorted(map(tuple, big.join(table, "key", how).collect()), key=str)
    got = lookup.salted_join(big, table, ["key"], how, ["ord"], hot_share=10, salts=16)
    assert sorted(map(tuple, got.collect()), key=str) == want
    counted = table.join(big.groupBy("key").agg(F.count("*").alias("n")), "key", "left").fillna(0, ["n"])
    known = lookup.salted_join(big, counted, ["key"], how, ["ord"], "n", hot_share=10, salts=16)
    kept = [c for c in big.join(table, "key", how).columns]
    assert sorted(map(tuple, known.select(*kept).collect()), key=str) == want
    by_size = lookup.lookup_join(big, table, ["key"], how, broadcast_bytes=0)
    assert sorted(map(tuple, by_size.collect()), key=str) == want


def test_small_lookup_is_broadcast(spark):
    big = spark.range(100).withColumn("key", F.col("id") % 7)
    table = spark.range(7).select(F.col("id").alias("key"), F.lit(1).alias("w"))
    plan = lookup.lookup_join(big, table, ["key"])._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan


def test_row_numbers_over_blocks(spark):
    draw = random.Random(1)
    start = dt.date(2024, 1, 1)
    rows = [
        ("A" if i % 3 else "B", i * draw.choice([1, 1000]) + i, start + dt.timedelta(draw.randrange(4)))
        for i in range(200)
    ]
    rows = list({(t, o): (t, o, d) for t, o, d in rows}.values())
    df = spark.createDataFrame(rows, "ticker string, ord long, date date").repartition(5)
    for by, order in (("date", lambda r: (r[2], r[1])), (None, lambda r: r[1])):
        got = with_row_number(df, by=by, block_bits=3).collect()
        want = {}
        for ticker in "AB":
            ranked = sorted((r for r in rows if r[0] == ticker), key=order)
            want.update({(ticker, r[1]): k for k, r in enumerate(ranked, 1)})
        assert {(r.ticker, r.ord): r.number for r in got} == want


@pytest.mark.parametrize("rows,last,short", [(701, 8, 1), (306, 4, 6), (100, 1, 100)])
def test_chunks(spark, rows, last, short):
    df = spark.range(1, rows + 1).withColumnRenamed("id", "number")
    counts = {r.chunk: r["count"] for r in with_chunks(df).groupBy("chunk").count().collect()}
    assert len(counts) == last and counts[last] == short
    assert all(n == 100 for chunk, n in counts.items() if chunk < last)


def test_rows_with_null_keys_are_numbered(spark):
    from tidewire.operators.ordinals import with_row_number

    rows = [("A", 1, None), ("A", 2, 5), ("A", 0, 5), (None, 3, 1), (None, 4, None)]
    df = spark.createDataFrame(rows, "ticker string, ord long, date int")
    got = {(r["ticker"], r["ord"]): r["number"] for r in with_row_number(df, block_bits=1).collect()}
    assert got == {("A", 1): 1, ("A", 0): 2, ("A", 2): 3, (None, 4): 1, (None, 3): 2}
    alone = with_row_number(df, by=None).collect()
    assert {(r["ticker"], r["ord"]): r["number"] for r in alone}[None, 4] == 2
