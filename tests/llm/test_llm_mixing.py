import pytest

from tidewire.llm.mixing import leaf_budgets, mix, token_count
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, epoch string, n int"


def share_out(amount, children):
    """Plain water filling: children are (weight, low, high)."""
    low, high = 0.0, 1e12
    for _ in range(200):
        mid = (low + high) / 2
        if sum(min(max(mid * w, a), b) for w, a, b in children) < amount:
            low = mid
        else:
            high = mid
    return [min(max(high * w, a), b) for w, a, b in children]


def test_budgets_equal_plain_water_filling(spark):
    leaves = [("a", "x", "1", 100), ("a", "x", "2", 1000), ("a", "y", "1", 10), ("b", "x", "1", 5000), ("b", "z", "9", 0), ("c", "x", "1", 50)]
    targets = {"domain": {"a": 5.0, "b": 1.0, "c": 0.0}, "lang": {"x": 3.0}, "source": {"2": 0.5}}
    table = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    got = {tuple(r)[:3]: r["amount"] for r in leaf_budgets(table, targets=targets, budget=1.3, least=1, most=3).collect()}
    weight = lambda level, v: targets[level].get(v, 1.0)

    def down(amount, rows, depth):
        if depth == 3:
            return {rows[0][:3]: amount}
        names = sorted({r[depth] for r in rows})
        parts = [[r for r in rows if r[depth] == n] for n in names]
        level = ("domain", "lang", "source")[depth]
        given = share_out(amount, [(weight(level, n), sum(r[3] for r in p), 3 * sum(r[3] for r in p)) for n, p in zip(names, parts, strict=True)])
        out = {}
        for g, p in zip(given, parts, strict=True):
            out |= down(g, p, depth + 1)
        return out

    want = down(1.3 * sum(r[3] for r in leaves), leaves, 0)
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-6, abs=1e-3)
    assert sum(got.values()) == pytest.approx(1.3 * 6160)


def documents(spark, n=600):
    rows = [(i, " ".join(["w"] * (1 + i % 13)), ["en", "de", None][i % 3], f"src{(i * i) % 11}" if i % 50 else None, "e", 1) for i in range(n)]
    rows += [(None, None, None, None, None, None), (7, "", "en", "odd", "e", 1), (1, "w w", "de", "src1", "e", 1), (1, "w w", "de", "src1", "e", 1)]
    rows.append((9000, "long " * 50_000, "en", "src0", "e", 1))
    return spark.createDataFrame(rows, SCHEMA)


def test_every_row_is_kept_and_parts_follow_the_budget(spark):
    docs = documents(spark)
    mixed = mix(docs, slices=16)
    assert sorted(mixed.columns) == sorted(docs.columns)
    first = mixed.filter("epoch = 0")
    assert first.count() == docs.count()
    assert mixed.filter("epoch > 1 or epoch < 0").count() == 0
    total = docs.agg(F.sum(token_count(F.col("text")))).first()[0]
    taken = mixed.agg(F.sum(token_count(F.col("text")))).first()[0]
    assert total < taken <= 1.25 * total


def test_slices_and_partitions_do_not_matter(spark):
    docs = documents(spark)
    rows = [
        sorted(map(str, mix(d, slices=s).select("doc_id", "lang", "source", "epoch").collect()))
        for d, s in ((docs, 1), (docs.repartition(7), 64), (docs.coalesce(1), 4096))
    ]
    assert rows[0] == rows[1] == rows[2]


def test_part_is_the_longest_prefix_that_fits(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 5), "en", "src1", "e", 1) for i in range(200)], SCHEMA)
    total = docs.agg(F.sum(token_count(F.col("text")))).first()[0]
    for budget in (1.0, 1.4, 1.99, 2.0):
        taken = mix(docs, budget=budget).agg(F.sum(token_count(F.col("text")))).first()[0]
        assert budget * total - 5 <= taken <= budget * total + 1e-6


def test_empty_table(spark):
    assert mix(spark.createDataFrame([], SCHEMA)).count() == 0
