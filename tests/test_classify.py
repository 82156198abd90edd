import datetime as dt

import numpy as np
import pytest

from tidewire.operators import classify

WORDS = {-1: "loss fall weak", 0: "meeting plain note", 1: "gain rise strong"}


@pytest.fixture(scope="module")
def train(spark):
    rows = [
        ("A", i, dt.date(2024, 1, 1), f"{WORDS[i % 3 - 1]} w{i}", "s", None, i % 3 - 1)
        for i in range(90)
    ] + [("A", 200, dt.date(2024, 1, 1), "unlabelled", "s", "b", None)]
    return spark.createDataFrame(
        rows, "ticker string, ord long, date date, headline string, source string, "
        "summary string, directional_sentiment int",
    )


def test_learns_and_lets_truth_win(spark, train):
    news = train.drop("directional_sentiment").unionByName(
        spark.createDataFrame(
            [("B", 0, dt.date(2024, 2, 1), "strong gain", "s", "rise")],
            train.drop("directional_sentiment").schema,
        )
    )
    final, metrics = classify.classify_direction(news, train, features=1 << 10)
    rows = {(r.ticker, r.ord): r.directional_sentiment for r in final.collect()}
    assert len(rows) == 92 and rows["B", 0] == 1
    assert all(rows["A", i] == i % 3 - 1 for i in range(90))
    assert metrics["accuracy"] > 0.9 and set(metrics) == {"accuracy", "f1"}


def test_split_is_stable_and_about_a_tenth(spark):
    df = spark.range(5000).selectExpr("'A' as ticker", "id as ord")
    fit, test = classify.split_rows(df)
    assert fit.count() + test.count() == 5000 and 400 < test.count() < 600
    again = classify.split_rows(df.repartition(11))[1]
    assert again.exceptAll(test).count() == 0


def test_bad_or_no_labels(spark, train):
    with pytest.raises(ValueError, match="no label"):
        classify.labelled_texts(train.filter("directional_sentiment is null"))
    bad = train.selectExpr("* except (directional_sentiment)", "2 as directional_sentiment")
    with pytest.raises(Exception, match="invalid sentiment label 2"):
        classify.train_classifier(bad)
    with pytest.raises(ValueError, match="no columns"):
        classify.labelled_texts(train.drop("summary"))


def test_user_model(train):
    seen = []

    def make():
        def scorer(texts):
            assert len(texts) <= 16
            return np.array([[("loss" in t), 0.5, ("gain" in t)] for t in texts], dtype=float)
        return scorer

    out = classify.predict_with_model(train.drop("directional_sentiment"), make).collect()
    seen = {r.ord: r.directional_sentiment_pred for r in out}
    assert all(seen[i] == i % 3 - 1 for i in range(90)) and seen[200] == 0
