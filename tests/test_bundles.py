import tracemalloc

import numpy as np
import pandas as pd
import pytest

from tidewire.operators import rolling, tiles

from test_tiles import all_pairs, sparse


@pytest.mark.parametrize(("threshold", "at_once"), [(0.3, 1024), (0.7, 16), (0.95, 1024)])
def test_sketches_lose_no_pair(threshold, at_once):
    rows = sparse(np.random.default_rng(5), 3 * tiles.FEW_ROWS)
    index = tiles.SparseRows([r[0] for r in rows], [r[1] for r in rows], threshold)
    want = all_pairs(rows, threshold)

    def met(first, cross):
        proposed = [(i, int(j)) for i, others in index.near(first, cross, at_once) for j in others]
        assert len(proposed) == len(set(proposed))
        return {(i, j) for i, j in proposed if index.similar(i, np.array([j]))[0] + 1e-9 >= threshold}

    assert met(len(rows), False) == want
    assert met(100, False) == {(i, j) for i, j in want if i < 100}
    assert met(100, True) == {(i, j) for i, j in want if i < 100 <= j}


def test_small_tiles_ship_a_row_once_a_bundle(spark):
    """Before, a row was shipped once for each of its terms that it shared, or for each slice it met."""
    rng = np.random.default_rng(6)
    items = [("A", i, i % 4, 10, [int(x) for x in ids], [float(w) for w in ws]) for i, (ids, ws) in enumerate(sparse(rng, 200))]
    df = spark.createDataFrame(items, "ticker string, ord long, day int, size int, ids array<long>, ws array<double>")
    assert rolling._tiled(df, ["ids", "ws"], 0.5, 3, 16).count() == 2 * len(items)

    items = [("A", i, i % 4, 10, [float(x) for x in rng.normal(size=16)]) for i in range(200)]
    df = spark.createDataFrame(items, "ticker string, ord long, day int, size int, embedding array<double>")
    assert rolling._tiled(df, ["embedding"], 0.2, 3, 16).count() == 2 * len(items)


def test_bundles_of_slices_lose_no_pair(spark):
    rng = np.random.default_rng(8)
    rows = rng.normal(size=(300, 8))
    df = spark.createDataFrame([("A", i, [float(x) for x in v]) for i, v in enumerate(rows)], "ticker string, ord long, embedding array<double>")
    tiled = tiles.assign_tiles(df, ["ticker"], 0.6, 10, 60).toPandas()
    assert not tiled.duplicated(["ord", *tiles.TILE]).any() and tiled["slice"].nunique() > 3
    met = set()
    for (_, low, high), part in tiled.groupby(tiles.TILE):
        one, two = (part.loc[part["slice"] == side, "ord"] for side in (low, high))
        met |= {(min(a, b), max(a, b)) for a in one for b in two if a != b}
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    assert {(i, j) for i, j in zip(*np.nonzero(unit @ unit.T >= 0.6)) if i < j} <= met


def test_similarities_held_at_once_are_bounded():
    assert tiles.rows_at_once(16, 100) == 16
    for others in (1, 8192, 16384, 10**6):
        assert tiles.rows_at_once(10**6, others) * others <= max(tiles.CELLS, tiles.DENSE_ROWS, others)
    one = tiles.DenseRows(np.ones((1000, 2)))
    two = tiles.DenseRows(np.ones((16384, 2)))
    assert max(block.size for _, block in one.row_blocks(two)) <= tiles.CELLS


def test_a_dense_tile_takes_little_more_than_its_vectors():
    """Before, similarities and the conditions made of them took 37 MB a tile of 8,000 rows."""
    rng = np.random.default_rng(3)

    def taken(count):
        frame = pd.DataFrame({"ticker": "A", "ord": np.arange(count), "day": np.sort(rng.integers(0, 8, count)).astype(np.int32)})
        frame["size"], frame["status"], frame["span"] = rng.integers(1, 50, count).astype(np.int32), 0, 0
        for c in ("slice", "low", "high"):
            frame[c] = 0
        frame["embedding"] = list(rng.normal(size=(count, 8)).astype(np.float32))
        tracemalloc.start()
        try:
            rolling.compare_tile(0.7, 3, ["embedding"])(frame)
            return tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    assert taken(8000) - taken(2000) < 3 << 20 and taken(8000) < 12 << 20


def test_parts_of_dense_rows_and_odd_vectors():
    rows = tiles.DenseRows(pd.Series([[3.0, 4.0], [0.0, 0.0], [np.nan, 1.0], [0.0, 2.0]] * 600))
    assert rows.matrix[:4].tolist() == [[0.6, 0.8], [0.0, 0.0], [0.0, 0.0], [0.0, 1.0]] and (rows.matrix[2396:] == rows.matrix[:4]).all()
    part = rows.part(1, 4)
    assert len(part) == 3 and part.matrix.base is not None and part.similar(2, np.array([2, 0])).tolist() == [1.0, 0.0]
    with pytest.raises(ValueError):
        tiles.DenseRows([[1.0, 2.0]] * tiles.DENSE_ROWS + [[1.0]])
