import numpy as np
import pytest
from brute import components, unit

from tidewire.llm.embedding_dedup import _near, _nodes, embedding_duplicates, embedding_links, fit_centres
from tidewire.llm.common import materialize

SCHEMA = "vec_id long, embedding array<float>, n_links string"


def table(seed: int = 0):
    rng = np.random.default_rng(seed)
    rows = rng.normal(size=(300, 16)).astype(np.float32)
    rows[50:90] = rows[0] + rng.normal(scale=0.12, size=(40, 16))
    rows[90:110] = rows[1]
    rows[110:140] = rows[2] * 3 + rng.normal(scale=0.8, size=(30, 16))
    return rows.astype(np.float32)


def check(found, rows):
    near = unit(rows) @ unit(rows).T >= 0.9
    np.fill_diagonal(near, False)
    low = components(len(rows), lambda i: np.flatnonzero(near[i]))
    got = {r["vec_id"]: r for r in found}
    for i in range(len(rows)):
        assert got[i]["n_links"] == near[i].sum()
        assert got[i]["component_id"] == low[i]
        assert got[i]["kept"] == (low[i] == i)


@pytest.mark.parametrize("reach", [None, 1.5])
def test_links_equal_brute_force(spark, monkeypatch, reach):
    monkeypatch.setattr("tidewire.llm.embedding_dedup.PER_CELL", 40)
    rows = table()
    vectors = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(rows)], SCHEMA)
    check(embedding_duplicates(vectors, reach=reach).collect(), rows)


def test_a_few_strong_directions_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr("tidewire.llm.embedding_dedup.PER_CELL", 40)
    rng = np.random.default_rng(5)
    spectrum = 1 / np.arange(1, 65)
    rows = rng.normal(size=(1200, 64)) * spectrum
    rows[600:] = rows[:600] + 0.45 * rng.normal(size=(600, 64)) * spectrum
    rows = rows.astype(np.float32)
    vectors = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(rows)], SCHEMA)
    check(embedding_duplicates(vectors).collect(), rows)


def test_blocks_give_the_same_counts(spark):
    rows = table(2)
    vectors = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(rows)], SCHEMA)
    nodes = _nodes(vectors, "vec_id", "embedding")
    centres = fit_centres(rows, 3)
    sums = []
    for block in (1000, 13):
        links = materialize(embedding_links(nodes, centres, 0.9, None, block)).filter("u = v")
        sums.append(sorted(map(tuple, links.groupBy("u").sum("n").collect())))
    assert sums[0] == sums[1] and sums[0]


def test_cosines_at_the_threshold_are_told_in_double_precision():
    rng = np.random.default_rng(3)
    one = unit(rng.normal(size=(1, 64)))
    side = rng.normal(size=(400, 64))
    side = unit(side - (side @ one.T) * one)
    cosine = 0.9 + rng.uniform(-2e-8, 2e-8, size=(400, 1))
    other = unit(cosine * one + np.sqrt(1 - cosine**2) * side)
    exact = (one @ other.T >= 0.9)[0]
    assert 100 < exact.sum() < 300
    assert (_near(one, other, 0.9)[0] == exact).all()


def test_long_vectors_make_more_blocks(spark, monkeypatch):
    monkeypatch.setattr("tidewire.llm.embedding_dedup.BLOCK_BYTES", 40 * 16 * 8)
    monkeypatch.setattr("tidewire.llm.embedding_dedup.SAMPLE_BYTES", 50 * 16 * 8)
    rows = table(4)
    vectors = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(rows)], "vec_id int, embedding array<double>, cell string")
    check(embedding_duplicates(vectors).collect(), rows)


def test_odd_vectors_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]),
        (8, []), (9, [1.0, 0.0, 0.0]), (10, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (2, [2.0, 0.0]), (11, [1e-30, 0.0]),
    ]
    found = embedding_duplicates(spark.createDataFrame([(*r, None) for r in rows], SCHEMA)).collect()
    assert len(found) == len(rows)
    got = sorted(((r[0] is None, r[0] or 0), r[1], r[2], r[3]) for r in found)
    plain = [((False, k), 0, k, True) for k in (3, 4, 5, 6, 7, 8)]
    group = [((False, 1), 4, 1, True), *[((False, 2), 4, 1, False)] * 2, ((False, 11), 4, 1, False), ((True, 0), 4, 1, False)]
    lengths = [((False, 9), 1, 9, True), ((False, 10), 1, 9, False)]
    assert got == sorted(plain + group + lengths)


def test_empty_and_unusable_tables(spark):
    assert embedding_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert embedding_duplicates(spark.createDataFrame([(1, None, None)], SCHEMA)).first()["kept"]
