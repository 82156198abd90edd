import datetime as dt
import hashlib
import random
import re

import numpy as np
import pytest

from tidewire.functions.word_trees import factored
from tidewire.operators import sampling
from tidewire.operators.loadings import factor_loadings

START = dt.date(2024, 1, 1)


def test_loadings_equal_least_squares(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 3)) * [1.0, 30.0, 0.01]
    factors = [(START + dt.timedelta(days=i), *map(float, v)) for i, v in enumerate(x)]
    daily, want = [], {}
    for ticker, coefficients in (("A", [0.5, 2.0, -0.1, 7.0]), ("B", [0.0, 0.0, 1.0, 3.0])):
        y = coefficients[0] + x @ coefficients[1:] + rng.normal(scale=0.3, size=40)
        daily += [(ticker, START + dt.timedelta(days=i), float(v)) for i, v in enumerate(y)]
        design = np.c_[np.ones(40), x]
        fit, *_ = np.linalg.lstsq(design, y, rcond=None)
        want[ticker] = [*fit, 1 - ((y - design @ fit) ** 2).sum() / ((y - y.mean()) ** 2).sum()]
    daily += [("few", START + dt.timedelta(days=i), 1.0) for i in range(4)]
    daily += [("flat", START + dt.timedelta(days=i), 2.0) for i in range(9)] + [("A", START + dt.timedelta(days=400), 9.0), ("A", START, None)]
    found = {r["ticker"]: r for r in factor_loadings(
        spark.createDataFrame(daily, "ticker string, date date, Final_Sentiment double"),
        spark.createDataFrame(factors, "date date, mkt_rf double, smb double, hml double"),
    ).collect()}
    for ticker, numbers in want.items():
        got = [found[ticker][c] for c in ("alpha", "beta_mkt_rf", "beta_smb", "beta_hml", "r_squared")]
        assert np.allclose(got, numbers, rtol=1e-6) and found[ticker]["num_days"] == 40
    assert found["few"]["alpha"] is None and found["flat"]["r_squared"] is None
    assert abs(found["flat"]["alpha"] - 2.0) < 1e-9


def test_dependent_factors_have_no_solution(spark):
    days = [(START + dt.timedelta(days=i), float(i), 2.0 * i, float(i * i)) for i in range(20)]
    daily = spark.createDataFrame([("A", d, a + 1) for d, a, _, _ in days], "ticker string, date date, s double")
    found = factor_loadings(daily, spark.createDataFrame(days, "date date, mkt_rf double, smb double, hml double"), "s").first()
    assert found["num_days"] == 20 and found["alpha"] is None and found["r_squared"] is None


def plain_sample(rows, n):
    """{(ticker, ord): taken_by} by sorting, as the contract states it."""
    out = {}
    for ticker in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == ticker]
        key = {r[1]: (hashlib.md5(f"42|{ticker}|{r[1]}".encode()).hexdigest(), r[1]) for r in own}
        months = {}
        for _, o, d in sorted(own, key=lambda r: r[1]):
            months.setdefault(d.replace(day=1), []).append(o)
        rest = []
        for k, members in enumerate(months.values()):
            quota = n // len(months) + (k < n % len(months))
            ranked = sorted(members, key=key.get)
            take = len(ranked) if n >= len(own) else quota
            out |= {(ticker, o): "quota" for o in ranked[:take]}
            rest += ranked[take:]
        gap = n - sum(min(len(m), n // len(months) + (k < n % len(months))) for k, m in enumerate(months.values()))
        out |= {(ticker, o): "gap" for o in sorted(rest, key=key.get)[:max(0, gap)]}
    return out


@pytest.mark.parametrize("digits", [1, 2, 4])
@pytest.mark.parametrize("n", [0, 1, 7, 60, 150, 10_000])
def test_picks_equal_a_sort_by_hash(spark, monkeypatch, digits, n):
    monkeypatch.setattr(sampling, "BIN_DIGITS", digits)
    draw = random.Random(1)
    rows = [("HOT" if i % 3 else f"T{i % 4}", i, START + dt.timedelta(days=int(draw.random() ** 3 * 200))) for i in range(300)]
    df = spark.createDataFrame(rows, "ticker string, ord long, date date")
    got = {(r["ticker"], r["ord"]): r["taken_by"] for r in sampling.sample_keys(df, n).collect()}
    assert got == plain_sample(rows, n)


def test_factored_patterns_find_the_same():
    draw = random.Random(2)
    for _ in range(300):
        words = ["".join(draw.choice("abAB.") for _ in range(draw.randrange(1, 5))) for _ in range(draw.randrange(1, 9))]
        text = "".join(draw.choice("abABc.") for _ in range(40))
        plain = re.compile("|".join(map(re.escape, words)), re.I)
        tree = re.compile(factored(words).replace("\\x{2e}", "\\."), re.I)
        assert [m.span() for m in plain.finditer(text)] == [m.span() for m in tree.finditer(text)]
        whole, tree = (re.compile(rf"\b(?:{p})\b", re.I) for p in (
            "|".join(map(re.escape, words)), factored(words, first_wins=False).replace("\\x{2e}", "\\.")))
        assert bool(whole.search(text)) == bool(tree.search(text))


def test_factored_shapes():
    assert factored(["car", "cart", "care"]) == "car" and factored(["cart", "car"]) == "car(?:t)?"
    assert factored(["cart", "car"], first_wins=False) == "car(?:t)?" and factored([]) == ""
    assert factored(["x", "", "y"]) == "(?:x)?" and factored(["a.b", "a+b"]) == "a(?:\\x{2e}b|\\x{2b}b)"
    deep = "z" * 20_000
    assert factored([deep]) == deep


def test_long_lists_in_spark(spark):
    from pyspark.sql import functions as F
    from tidewire.functions.word_trees import word_tree
    from tidewire.operators import relevance

    words = [f"word{i:04d}" for i in range(5_000)] + ["É+1", "straße", None]
    rules = spark.createDataFrame([("A", ["abb"], [], words, ["zz"], ["none"])], "ticker string, aliases array<string>, "
                                  "products array<string>, direct_keywords array<string>, indirect_keywords array<string>, "
                                  "low_signal_phrases array<string>")
    texts = ["the ABB WORD4999 x", "the abb word5000", "Abb é+1!", "abb STRASSE", "abb Straße", "abbey word0001"]
    articles = spark.createDataFrame([("A", i, START, t, "s", "m") for i, t in enumerate(texts)],
                                     "ticker string, ord long, date date, headline string, source string, summary string")
    found = {r["ord"]: r["relevance_score"] for r in relevance.relevance_scores(articles, rules, evidence=False).collect()}
    assert found == {0: 0.75, 1: 0.48, 2: 0.75, 3: 0.48, 4: 0.75, 5: 0.12}
    one = rules.select(F.length(word_tree(F.col("direct_keywords"))).alias("n")).first()["n"]
    assert one < 40_000


def test_a_source_listed_twice(spark):
    from tidewire.operators.trust import with_trust

    df = spark.createDataFrame([("A", 1, "x"), ("A", 2, "y"), ("A", 3, None)], "ticker string, ord long, source string")
    listed = [("x", 0.25), ("x", 0.25), (None, 0.9)]
    same = with_trust(df, spark.createDataFrame(listed, "source string, weight double"))
    assert {r["ord"]: r["x3_factor"] for r in same.collect()} == {1: 0.25, 2: 0.5, 3: 0.5}
    with pytest.raises(ValueError, match="more than one weight"):
        with_trust(df, spark.createDataFrame([("x", 0.25), ("x", 0.5)], "source string, weight double"))
