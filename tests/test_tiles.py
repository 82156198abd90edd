import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewire.operators import rolling, tiles
from tidewire.session import bucketed


def sparse(rng, count, words=40, length=6):
    """Unit rows (ids, ws), lower ids first; lower ids are rarer."""
    rows = []
    for _ in range(count):
        ids = np.sort(rng.choice(words, length, replace=False, p=np.arange(1, words + 1) / (words * (words + 1) / 2)))
        ws = rng.random(length) + 0.05
        rows.append((ids, ws / np.linalg.norm(ws)))
    return rows


def all_pairs(rows, threshold):
    dense = np.zeros((len(rows), 64))
    for i, (ids, ws) in enumerate(rows):
        dense[i, ids] = ws
    near = dense @ dense.T + 1e-9 >= threshold
    return {(i, j) for i, j in zip(*np.nonzero(near)) if i < j}


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.8, 0.95])
def test_index_proposes_every_pair_once(threshold):
    rows = sparse(np.random.default_rng(4), 150)
    index = tiles.SparseRows([r[0] for r in rows], [r[1] for r in rows], threshold)
    proposed = [(i, int(j)) for i in range(len(rows)) for j in index.candidates(i)]
    assert len(proposed) == len(set(proposed))
    near = {(i, j) for i, j in proposed if index.similar(i, np.array([j]))[0] + 1e-9 >= threshold}
    assert near == all_pairs(rows, threshold)
    if threshold >= 0.8:
        assert len(proposed) < len(rows) * (len(rows) - 1) / 4    # the bound of weights and rests leaves most out


@pytest.mark.parametrize(("threshold", "tile_rows"), [(0.8, 40), (0.6, 25), (0.9, 1000)])
def test_tiles_of_terms_hold_each_pair_once(spark, threshold, tile_rows):
    rows = sparse(np.random.default_rng(7), 130, length=5)
    df = spark.createDataFrame(
        [("A", i, [int(x) for x in ids], [float(w) for w in ws]) for i, (ids, ws) in enumerate(rows)],
        "ticker string, ord long, ids array<long>, ws array<double>",
    )
    tiled = tiles.assign_tiles(df, ["ticker"], threshold, tile_rows).toPandas()
    found = []
    for _, part in tiled.groupby(tiles.TILE):
        part = part.reset_index(drop=True)
        index = tiles.SparseRows(part["ids"], part["ws"], threshold)
        cross = part["low"].iloc[0] != part["high"].iloc[0]
        for i in range(len(part)):
            for j in index.candidates(i, tiles.tile_terms(part, index)):
                if cross and part["slice"][i] == part["slice"][j]:
                    continue
                if index.similar(i, np.array([j]))[0] + 1e-9 >= threshold:
                    found.append(tuple(sorted((int(part["ord"][i]), int(part["ord"][j])))))
    assert len(found) == len(set(found)) and set(found) == all_pairs(rows, threshold)
    if tile_rows < 130:
        # Vectors are shipped once a tile, and only where a partner lies within the bound of a posting.
        assert not tiled.duplicated(["ord", *tiles.TILE]).any()
        postings = sum(len(ids) for ids, _ in rows)
        assert len(tiled) < postings


def clustered(rng, count, groups=12, width=6, noise=0.05):
    centres = rng.normal(size=(groups, width))
    return centres[rng.integers(0, groups, count)] + noise * rng.normal(size=(count, width))


def test_angle_bound_loses_no_pair_and_skips_slices(spark):
    rows = clustered(np.random.default_rng(2), 400)
    df = spark.createDataFrame(
        [("A", i, [float(x) for x in v]) for i, v in enumerate(rows)] + [("A", 1000, [0.0] * 6), ("B", 1, [1.0] * 6)],
        "ticker string, ord long, embedding array<double>",
    )
    tiled = tiles.assign_tiles(df, ["ticker"], 0.95, 25).toPandas()
    met = set()
    for _, part in tiled.groupby(["ticker", *tiles.TILE]):
        if part["ticker"].iloc[0] == "A":
            low, high = (set(part.loc[part["slice"] == part[side], "ord"]) for side in ("low", "high"))
            met |= {(min(a, b), max(a, b)) for a in low for b in high if a != b}
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    near = {(i, j) for i, j in zip(*np.nonzero(unit @ unit.T >= 0.95)) if i < j}
    assert near <= met
    slices = tiled.loc[tiled["ticker"] == "A", "slice"].nunique()
    pairs = len(tiled.loc[tiled["ticker"] == "A"].drop_duplicates(tiles.TILE))
    assert pairs < 0.6 * slices * (slices + 1) / 2


def test_slice_partners():
    pivots = np.array([[1.0, 0.0], [0.0, 1.0], [-1.0, 0.0]])
    met = tiles.slice_partners(pivots, np.array([0.1, 0.1, 3.2]), 0.9)
    assert met.tolist() == [[True, False, True], [False, True, True], [True, True, True]]


def test_later_rounds_shuffle_no_vector(spark):
    rng = np.random.default_rng(3)
    items = spark.createDataFrame(
        [("A", i, int(i % 7), 10, [float(x) for x in v]) for i, v in enumerate(clustered(rng, 60))],
        "ticker string, ord long, day int, size int, embedding array<double>",
    )
    stored = bucketed(rolling._tiled(items, ["embedding"], 0.9, 3, 16), [*rolling.SPAN, *tiles.TILE])
    run = rolling.compare_tile(0.9, 3, ["embedding"])
    states = items.select("ticker", "ord", F.lit(0).alias("status"))
    later = rolling.next_round(stored, states, run)
    plan = later._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert not moved or all("embedding" not in line for line in moved)
    assert "hashpartitioning" not in plan.split("FlatMapCoGroupsInPandas")[1].split("FileScan parquet")[0].split("Exchange")[0]
    first = rolling.first_round(stored, run)
    assert "Exchange" not in first._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, later.collect()))


def test_bucketed_table_outlives_its_name(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 7)
    stored = bucketed(df, ["k"])
    assert stored.groupBy("k").count().count() == 7 and stored.count() == 100
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("tidewire_")]


def test_prefixes_of_an_empty_batch():
    run = tiles.posting_batches(0.7, ["ticker"])
    assert list(run(iter([pd.DataFrame(columns=["ticker", "ord", "ids", "ws"])]))) == []
