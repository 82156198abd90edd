"""One three-class text classifier of direction for all tickers; ``bayes`` has one per ticker.

The built-in model is TF-IDF features and multinomial logistic regression over all tickers at
once. A user's own model can be applied in its place with ``predict_with_model``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, SQLTransformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions.numbers import decode_label, encode_label
from tidewire.functions.text import joined_text, text_or_empty
from tidewire.operators.directional import count_mismatches, label_override
from tidewire.schemas import NEWS, TRAIN, require_columns
from tidewire.session import materialize

TEST_SHARE = 0.1
BATCH_ROWS = 16
FEATURES = 1 << 16


def with_text(df: DataFrame) -> DataFrame:
    """Null texts become empty, and headline and summary one text."""
    clean = df.withColumns({c: text_or_empty(F.col(c)) for c in ("headline", "summary")})
    return clean.withColumn("text", joined_text(F.col("headline"), F.col("summary")))


def labelled_texts(train: DataFrame) -> DataFrame:
    """(ticker, ord, text, label 0..2) of the labelled rows; raises when there are none."""
    require_columns(train, [f.name for f in TRAIN.fields], "train")
    rows = with_text(train.filter(F.col("directional_sentiment").isNotNull()))
    label = encode_label(F.col("directional_sentiment")).cast("double")
    rows = rows.select("ticker", "ord", "text", label.alias("label"))
    if rows.isEmpty():
        raise ValueError("the training table has no label")
    return rows


def split_rows(df: DataFrame, test_share: float = TEST_SHARE, seed: int = 42):
    """(train, test) by a seeded hash of (ticker, ord): the same split at any partitioning."""
    draw = F.pmod(F.xxhash64(F.lit(seed), "ticker", "ord"), F.lit(1_000_000)) / 1_000_000
    is_test = draw < test_share
    return df.filter(~is_test), df.filter(is_test)


def build_pipeline(max_tokens: int | None = None, features: int = FEATURES, **regression) -> Pipeline:
    tokens = RegexTokenizer(
        inputCol="text", outputCol="all_tokens", pattern="[\\p{L}\\p{N}_]+", gaps=False
    )
    kept = f"slice(all_tokens, 1, {max_tokens})" if max_tokens else "all_tokens"
    cut = SQLTransformer(statement=f"SELECT *, {kept} AS tokens FROM __THIS__")
    counts = HashingTF(inputCol="tokens", outputCol="counts", numFeatures=features)
    idf = IDF(inputCol="counts", outputCol="features")
    settings = {"maxIter": 20, "regParam": 0.01, **regression}
    model = LogisticRegression(family="multinomial", **settings)
    return Pipeline(stages=[tokens, cut, counts, idf, model])


def train_classifier(
    train: DataFrame, test_share: float = TEST_SHARE, seed: int = 42, **settings
) -> tuple[PipelineModel, dict[str, float]]:
    """The fitted model and its accuracy and F1 on the held-out share."""
    rows = materialize(labelled_texts(train))
    fit_rows, test_rows = split_rows(rows, test_share, seed)
    model = build_pipeline(**settings).fit(fit_rows)
    metrics: dict[str, float] = {}
    if not test_rows.isEmpty():
        scored = materialize(model.transform(test_rows).select("label", "prediction"))
        for name in ("accuracy", "f1"):
            metrics[name] = MulticlassClassificationEvaluator(metricName=name).evaluate(scored)
    return model, metrics


def predict(model: PipelineModel, news: DataFrame) -> DataFrame:
    """News columns plus ``directional_sentiment_pred`` in -1, 0, 1."""
    require_columns(news, [f.name for f in NEWS.fields], "news")
    scored = model.transform(with_text(news))
    label = decode_label(F.col("prediction")).alias("directional_sentiment_pred")
    return scored.select(*[f.name for f in NEWS.fields], label)


def predict_with_model(
    news: DataFrame,
    make_scorer: Callable[[], Callable[[list[str]], np.ndarray]],
    batch_rows: int = BATCH_ROWS,
) -> DataFrame:
    """As ``predict``, with a user's model: ``make_scorer`` runs once per task and returns a
    function from a batch of texts to an array of three class scores per text."""
    columns = [f.name for f in NEWS.fields]
    rows = with_text(news).select(*columns, "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for batch in batches:
            texts = batch["text"].tolist()
            best = [
                np.asarray(scorer(texts[i:i + batch_rows])).argmax(axis=1) - 1
                for i in range(0, len(texts), batch_rows)
            ]
            found = np.concatenate(best) if best else np.array([], dtype=int)
            yield batch[columns].assign(directional_sentiment_pred=found.astype("int32"))

    schema = "ticker string, ord long, date date, headline string, source string, " \
        "summary string, directional_sentiment_pred int"
    return rows.mapInPandas(run, schema)


def classify_direction(
    news: DataFrame, train: DataFrame, on_repeat: str = "error", check: bool = True, **settings
) -> tuple[DataFrame, dict[str, float]]:
    """One label per article, truth over prediction, and the held-out metrics."""
    model, metrics = train_classifier(train, **settings)
    final = label_override(predict(model, news), train, on_repeat)
    if check and not count_mismatches(final, news).isEmpty():
        raise ValueError("some tickers have another number of labels than articles")
    return final, metrics
