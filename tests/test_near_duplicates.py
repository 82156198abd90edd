import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tidewire.operators import rolling, vectors, weekly
from tidewire.operators.components import connected_components

START = dt.date(2024, 1, 1)


def cosine(a, b):
    na, nb = math.sqrt(sum(x * x for x in a)), math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b)) / (na * nb) if na and nb else 0.0


def one_by_one(rows, threshold, lookback):
    """The rule as stated, article by article: rows of (ticker, ord, day, size, vector)."""
    survivors = {}
    for ticker, order, day, size, vector in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        earlier = survivors.setdefault(ticker, [])
        if not any(
            day - d <= lookback and size <= s and cosine(vector, v) + 1e-9 >= threshold
            for _, d, s, v in earlier
        ):
            earlier.append((order, day, size, vector))
    return sorted((t, o) for t, kept in survivors.items() for o, *_ in kept)


def tables(spark, rows):
    news = spark.createDataFrame(
        [(t, o, START + dt.timedelta(days=d), "h", "s", "x" * n) for t, o, d, n, _ in rows],
        "ticker string, ord long, date date, headline string, source string, summary string",
    )
    embedded = spark.createDataFrame(
        [(t, o, [float(x) for x in v]) for t, o, _, _, v in rows if v is not None],
        "ticker string, ord long, embedding array<float>",
    )
    return news, embedded


def kept(df):
    return sorted((r.ticker, r.ord) for r in df.select("ticker", "ord").collect())


@pytest.mark.parametrize(
    "tile_rows,local_rows,threshold", [(8192, 4096, 0.7), (8192, 0, 0.95), (20, 0, 0.7)]
)
def test_rolling_equals_the_sequential_rule(spark, tile_rows, local_rows, threshold):
    draw = random.Random(7)
    rows = []
    for i in range(120):
        ticker = "HOT" if i % 3 else f"T{i % 5}"
        base = draw.choice([(1, 0, 0), (0, 1, 0), (1, 1, 0), (0, 0, 1)])
        shift = [0, 0, 0] if draw.random() < 0.4 else [draw.uniform(-0.6, 0.6) for _ in base]
        vector = [0, 0, 0] if i % 29 == 0 else [b + s for b, s in zip(base, shift)]
        rows.append((ticker, i, draw.randrange(9), draw.choice([5, 5, 8, 13]), vector))
    news, embedded = tables(spark, rows)
    rows32 = {(r.ticker, r.ord): r.embedding for r in embedded.collect()}
    exact = [(t, o, d, n, rows32[t, o]) for t, o, d, n, _ in rows]
    result = rolling.rolling_dedup(news, embedded, threshold, 3, tile_rows, local_rows)
    assert kept(result) == one_by_one(exact, threshold, 3)


def test_rolling_borders(spark):
    a = [1.0, 0.0]
    rows = [
        ("A", 0, 0, 10, a), ("A", 1, 3, 10, a),      # N days later: dropped
        ("B", 0, 0, 10, a), ("B", 1, 4, 10, a),      # N+1 days later: kept
        ("C", 0, 0, 10, a), ("C", 1, 1, 11, a),      # longer copy: kept, earlier one stays
        ("D", 0, 0, 10, a), ("D", 1, 0, 10, [0.75, 0.6614378]),
        ("E", 0, 0, 10, a), ("E", 1, 1, 10, None),   # no vector: kept
        ("F", 0, 0, 10, [0.0, 0.0]), ("F", 1, 0, 10, [0.0, 0.0]),
    ]
    news, embedded = tables(spark, rows)
    got = kept(rolling.rolling_dedup(news, embedded, 0.75, 3))
    assert ("A", 1) not in got and ("D", 1) not in got
    assert len(got) == 10


def test_long_chain_and_crowd_of_copies(spark):
    # A drifting chain (each near the one before only) and a third of all rows in equal copies.
    rows = [
        ("A", i, i, 10, [math.cos(i * 0.5), math.sin(i * 0.5)]) for i in range(14)
    ] + [("A", 100 + i, 50, 10 + i % 3, [1.0, 1.0]) for i in range(20)]
    news, embedded = tables(spark, rows)
    exact = {(r.ticker, r.ord): r.embedding for r in embedded.collect()}
    want = one_by_one([(t, o, d, n, exact[t, o]) for t, o, d, n, _ in rows], 0.8, 3)
    items = rolling.comparable_articles(news, embedded)
    assert rolling.settle_copies(items, ["embedding"]).count() == 14 + 3
    for local_rows in (0, 4096):
        assert kept(rolling.rolling_dedup(news, embedded, 0.8, 3, 16, local_rows)) == want


def words(draw, size):
    return " ".join(draw.choice("abcdefghijklmnopqrstuvwxyz") * 3 for _ in range(size))


@pytest.fixture(scope="module")
def texts(spark):
    draw = random.Random(3)
    pool = [words(draw, 30) for _ in range(12)]
    rows = []
    for i in range(120):
        base = draw.choice(pool).split()
        for _ in range(draw.choice([0, 0, 2, 6, 12])):
            base[draw.randrange(len(base))] = draw.choice("abcdefghijklmnop") * 4
        text = " ".join(base) if i % 31 else "- !"
        rows.append(("AB"[i % 3 == 0], i, START + dt.timedelta(days=i % 20), text[:20], "s", text[20:]))
    return rows, spark.createDataFrame(
        rows, "ticker string, ord long, date date, headline string, source string, summary string"
    )


def tfidf(rows):
    """Unit TF-IDF vectors from first principles: {(ticker, ord): {word: weight}}."""
    import re
    from collections import Counter

    counts = {
        (t, o): Counter(re.findall(r"\w{2,}", f"{h} {s}".lower())) for t, o, _, h, _, s in rows
    }
    out = {}
    for (ticker, order), terms in counts.items():
        group = [c for (t, _), c in counts.items() if t == ticker]
        weights = {
            w: n * (math.log((1 + len(group)) / (1 + sum(w in g for g in group))) + 1)
            for w, n in terms.items()
        }
        norm = math.sqrt(sum(x * x for x in weights.values())) or 1.0
        out[ticker, order] = {w: x / norm for w, x in weights.items()}
    return out


def dot(a, b):
    return sum(x * b[w] for w, x in a.items() if w in b)


@pytest.mark.parametrize("tile_rows,threshold", [(1024, 0.7), (16, 0.7), (16, 0.5)])
def test_weekly_equals_all_pairs(texts, tile_rows, threshold):
    rows, df = texts
    unit = tfidf(rows)
    parent = {(t, o): (t, o) for t, o, *_ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    week = {(t, o): d.isocalendar()[:2] for t, o, d, *_ in rows}
    size = {(t, o): len(h) + len(s) for t, o, _, h, _, s in rows}
    keys = sorted(parent)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            if a[0] == b[0] and week[a] == week[b] and dot(unit[a], unit[b]) > threshold + 1e-9:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    best = {}
    for key in keys:
        best[root(key)] = min(best.get(root(key), (0, None)), (-size[key], key[1]))
    want = sorted((r[0], o, r[1]) for r, (_, o) in best.items())
    got = weekly.weekly_keys(df, threshold, tile_rows).collect()
    assert sorted((r.ticker, r.ord, r.component) for r in got) == want
    assert weekly.weekly_dedup(df, threshold, tile_rows).count() == len(want)


def test_rolling_on_text_vectors(texts):
    rows, df = texts
    unit = tfidf(rows)
    survivors = {}
    for t, o, d, _, _, s in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        earlier = survivors.setdefault(t, [])
        if not any(
            (d - day).days <= 3 and len(s) <= size and dot(unit[t, o], unit[t, k]) + 1e-9 >= 0.7
            for k, day, size in earlier
        ):
            earlier.append((o, d, len(s)))
    want = sorted((t, k) for t, rows_ in survivors.items() for k, *_ in rows_)
    sparse = vectors.tfidf_vectors(df)
    assert kept(rolling.rolling_dedup(df, sparse, 0.7)) == want
    assert kept(rolling.rolling_dedup(df, sparse, 0.7, tile_rows=20, local_rows=0)) == want


def test_counts(spark):
    news, embedded = tables(spark, [("A", i, 0, 5, [1.0, 0.0]) for i in range(4)])
    row = rolling.dedup_counts(news, rolling.rolling_dedup(news, embedded)).first()
    assert (row.input_rows, row.output_rows, row.removed_rows) == (4, 1, 3)


def test_model_hook(articles):
    import numpy as np

    df = articles([("A", i, "2024-01-01", "h" * i, "s", "b") for i in range(1, 5)])
    found = vectors.embed_with_model(df, lambda: lambda t: np.array([[len(x), 1.0] for x in t]))
    got = {r.ord: r.embedding[0] for r in found.collect()}
    assert got == {i: float(i + 2) for i in range(1, 5)}


def test_components(spark):
    draw = random.Random(5)
    path = [(i, i + 1) for i in range(0, 60)]
    star = [(100, 100 + i) for i in range(1, 60)]
    loose = [(draw.randrange(200, 260), draw.randrange(200, 260)) for _ in range(40)]
    edges = [("A", u, v) for u, v in path + star + loose] + [("B", 5, 3)]
    draw.shuffle(edges)
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for t, u, v in edges:
        a, b = root((t, u)), root((t, v))
        parent[max(a, b)] = min(a, b)
    want = sorted((t, n, root((t, n))[1]) for t, n in list(parent) if root((t, n)) != (t, n))
    df = spark.createDataFrame(edges, "ticker string, u long, v long")
    got = connected_components(df).collect()
    assert sorted((r.ticker, r.node, r.component) for r in got) == want
