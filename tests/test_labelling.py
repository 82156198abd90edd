import datetime as dt
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewire.functions import numbers as N
from tidewire.operators import directional, sampling

# Stored label counts per ticker for -1, 0, 1.
STORED_LABELS = {"ABT": (71, 291, 339), "BEP": (14, 125, 167), "FSLR": (126, 205, 224)}


def news(spark, rows):
    return spark.createDataFrame(
        rows, "ticker string, ord long, date date, headline string, source string, summary string"
    )


@pytest.fixture(scope="module")
def months(spark):
    """A: 20, 3, 40 and 10 rows in four months, the first to appear being March; B: 5 rows."""
    rows, order = [], 0
    for month, count in ((3, 20), (1, 3), (2, 40), (4, 10)):
        for i in range(count):
            rows.append(("A", order, dt.date(2024, month, 1 + i % 28), f"h{order}", "s", "b"))
            order += 1
    rows += [("B", i, dt.date(2024, 5, 1), f"h{i}", "s", "b") for i in range(5)]
    return news(spark, rows)


def test_quota_and_gap(months):
    quota = {(r.ticker, r.month.month): r for r in sampling.sample_quota(months, 30).collect()}
    march, january, february, april = (quota["A", m] for m in (3, 1, 2, 4))
    assert [q.month_rank for q in (march, january, february, april)] == [1, 2, 3, 4]
    assert [q.quota for q in (march, january, february, april)] == [8, 8, 7, 7]
    assert [q.first_take for q in (march, january, february, april)] == [8, 3, 7, 7]
    assert march.gap == 5 and quota["B", 5].whole


@pytest.mark.parametrize("n", [1, 3, 30, 72])
def test_sample_has_the_exact_size(months, n):
    keys = sampling.sample_keys(months, n).collect()
    assert Counter(r.ticker for r in keys) == {"A": n, "B": min(n, 5)}
    assert len({(r.ticker, r.ord) for r in keys}) == len(keys)
    again = sampling.sample_keys(months.repartition(9), n).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, keys))
    other = sampling.sample_keys(months, n, seed=43).collect()
    assert n in (72,) or sorted(map(tuple, other)) != sorted(map(tuple, keys))


def test_sample_of_everything_and_per_ticker_sizes(months):
    assert sampling.stratified_sample(months, 1000).count() == months.count()
    counts = sampling.stratified_sample(months, {"A": 12}, default=2).groupBy("ticker").count()
    assert {r.ticker: r["count"] for r in counts.collect()} == {"A": 12, "B": 2}
    strata = sampling.stratified_sample(months, {"A": 12}, default=0)
    taken = Counter(r.date.month for r in strata.collect())
    assert taken == {3: 3, 1: 3, 2: 3, 4: 3}


def test_numbered_chunks(spark):
    rows = [("A", i, dt.date(2024, 1, 1 + (i * 7) % 5), f"h{i}", "s", None) for i in range(7)]
    out = directional.numbered_chunks(news(spark, rows), 3).orderBy("number").collect()
    assert [r.number for r in out] == list(range(1, 8))
    assert [r.chunk for r in out] == [1, 1, 1, 2, 2, 2, 3]
    order = sorted(range(7), key=lambda i: ((i * 7) % 5, i))
    assert [r.text for r in out] == [f"h{i} nan" for i in order]


def test_combine_by_position(spark):
    start = dt.date(2024, 1, 1)
    rows, labels = [], []
    for ticker, stored in STORED_LABELS.items():
        values = [v for v, n in zip((-1, 0, 1), stored) for _ in range(n)]
        for k, value in enumerate(values):
            rows.append((ticker, 5000 - k, start + dt.timedelta(k // 3), f"h{k}", "s", "b"))
            labels.append((ticker, k, 999, value))     # the index is not used
    sample = news(spark, rows).repartition(6)
    given = spark.createDataFrame(labels, "ticker string, ord long, idx int, label int")
    out = directional.positional_combine(sample, given)
    result = directional.label_passthrough(out)
    counts = Counter((r.ticker, r.directional_sentiment) for r in result.collect())
    for ticker, stored in STORED_LABELS.items():
        assert tuple(counts[ticker, v] for v in (-1, 0, 1)) == stored
    first = out.filter("ticker = 'ABT'").orderBy("date", "ord").limit(72).collect()
    assert [r.directional_sentiment for r in first] == [-1] * 71 + [0]


def test_combine_checks_counts(spark):
    rows = [(t, i, dt.date(2024, 1, 1), "h", "s", "b") for t in "AB" for i in range(3)]
    labels = [("A", i, i, 1) for i in range(3)] + [("B", i, i, 1) for i in range(2)]
    sample = news(spark, rows)
    given = spark.createDataFrame(labels, "ticker string, ord long, idx int, label int")
    with pytest.raises(ValueError, match="B: 3 vs 2"):
        directional.positional_combine(sample, given)
    kept = directional.positional_combine(sample, given, "skip")
    assert {r.ticker for r in kept.collect()} == {"A"} and kept.count() == 3
    wrong = directional.count_mismatches(sample, given.filter("ticker = 'A'")).collect()
    assert [(r.ticker, r.left_rows, r.right_rows) for r in wrong] == [("B", 3, 0)]


def test_override(spark):
    day = dt.date(2024, 1, 1)
    base = news(spark, [
        ("A", 0, day, "h", "s", "b"), ("A", 1, day, "h", "s", "b"), ("A", 2, day, "hb", "s", ""),
        ("A", 3, day, None, "s", "x"), ("B", 0, day, "h", "s", "b"),
    ])
    predicted = base.withColumn("directional_sentiment_pred", F.lit(0))
    train = spark.createDataFrame(
        [
            ("A", 7, day, "h", "z", "b", 1), ("A", 9, day, "h", "z", "b", -1),
            ("A", 8, day, "", "z", "x", -1), ("B", 1, day, "h", "z", "b", None),
        ],
        "ticker string, ord long, date date, headline string, source string, summary string, "
        "directional_sentiment int",
    )
    with pytest.raises(ValueError, match="twice"):
        directional.label_override(predicted, train)
    out = directional.label_override(predicted, train, "first").orderBy("ticker", "ord")
    assert [r.directional_sentiment for r in out.collect()] == [1, 1, 0, -1, 0]


def test_label_codes(spark):
    df = spark.createDataFrame([(-1,), (0,), (1,), (None,)], "l int")
    code = N.encode_label(F.col("l"))
    rows = df.select(code.alias("c"), N.decode_label(code).alias("d"), "l").collect()
    assert [r.c for r in rows] == [0, 1, 2, None] and all(r.d == r.l for r in rows)
    with pytest.raises(Exception, match="invalid sentiment label 2"):
        spark.createDataFrame([(2,)], "l int").select(N.encode_label(F.col("l"))).collect()
