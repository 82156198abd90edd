"""From per-article scores to weighted daily sentiment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.numbers import (
    ALPHA, BETA, article_score, half_even, magnitude, relevance_power, trust_power,
)

DAY = ["ticker", "date"]


def _rename(directional: DataFrame, relevance: DataFrame, trust: DataFrame, keys: list[str]):
    label = "directional_sentiment"
    if label not in directional.columns:
        label = "directional_score"
    return (
        directional.select(*keys, F.col(label).cast("double").alias("x1")),
        relevance.select(*keys, F.col("relevance_score").cast("double").alias("x2")),
        trust.select(*keys, F.col("x3_factor").cast("double").alias("x3")),
    )


def _daily(mean: Column, count: Column, x2: Column, x3: Column, x1: Column, digits: int):
    return [
        F.col("ticker"),
        F.col("date"),
        half_even(mean, digits).alias("Final_Sentiment"),
        count.cast("long").alias("Num_News"),
        half_even(x2, digits).alias("Avg_Relevance"),
        half_even(x3, digits).alias("Avg_Trustfulness"),
        half_even(x1, digits).alias("Avg_Directional"),
    ]


def daily_sentiment_by_date(
    directional: DataFrame,
    relevance: DataFrame,
    trust: DataFrame,
    alpha: float = ALPHA,
    beta: float = BETA,
    digits: int = 4,
) -> DataFrame:
    """Every score of a day meets every other score of that day (inner join on the date).

    Row score times weight is a product of one factor per side, so sums over the joined rows are
    products of sums per side. Each side is reduced to one row per (ticker, date) before the join,
    and the n1*n2*n3 joined rows are counted without being made.
    """
    d1, d2, d3 = _rename(directional, relevance, trust, DAY)
    x1, x2, x3 = F.col("x1"), F.col("x2"), F.col("x3")
    s1 = d1.groupBy(*DAY).agg(
        F.count("*").alias("n1"), F.sum(x1).alias("sum1"), F.avg(x1).alias("avg1")
    )
    s2 = d2.groupBy(*DAY).agg(
        F.count("*").alias("n2"),
        F.sum(F.abs(x2)).alias("w2"),
        F.sum(relevance_power(x2, alpha) * F.abs(x2)).alias("sw2"),
        F.avg(x2).alias("avg2"),
    )
    s3 = d3.groupBy(*DAY).agg(
        F.count("*").alias("n3"),
        F.sum(F.abs(x3)).alias("w3"),
        F.sum(trust_power(x3, beta) * F.abs(x3)).alias("sw3"),
        F.avg(x3).alias("avg3"),
    )
    joined = s1.join(s2, DAY).join(s3, DAY)
    weight = F.col("w2") * F.col("w3")
    mean = F.when(
        weight > 0,
        F.coalesce(F.col("sum1"), F.lit(0.0)) / F.col("n1") * F.col("sw2") * F.col("sw3") / weight,
    ).otherwise(F.lit(0.0))
    count = F.col("n1") * F.col("n2") * F.col("n3")
    return joined.select(
        *_daily(mean, count, F.col("avg2"), F.col("avg3"), F.col("avg1"), digits)
    )


def combine_articles(directional: DataFrame, relevance: DataFrame, trust: DataFrame) -> DataFrame:
    """x1, x2, x3 of the same article side by side, joined on the unique (ticker, ord)."""
    key = ["ticker", "ord"]
    d1, d2, d3 = _rename(directional, relevance, trust, [*key, "date"])
    return d1.join(d2.drop("date"), key).join(d3.drop("date"), key)


def daily_from_articles(
    scored: DataFrame, alpha: float = ALPHA, beta: float = BETA, digits: int = 4
) -> DataFrame:
    """Weighted daily mean of a table with ticker, date, x1, x2, x3."""
    x1, x2, x3 = F.col("x1"), F.col("x2"), F.col("x3")
    weight = magnitude(x2, x3)
    sums = scored.groupBy(*DAY).agg(
        F.sum(article_score(x1, x2, x3, alpha, beta) * weight).alias("num"),
        F.sum(weight).alias("den"),
        F.count("*").alias("n"),
        F.avg(x1).alias("avg1"),
        F.avg(x2).alias("avg2"),
        F.avg(x3).alias("avg3"),
    )
    mean = F.when(
        F.col("den") > 0, F.coalesce(F.col("num"), F.lit(0.0)) / F.col("den")
    ).otherwise(F.lit(0.0))
    return sums.select(
        *_daily(mean, F.col("n"), F.col("avg2"), F.col("avg3"), F.col("avg1"), digits)
    )


def daily_sentiment_by_article(
    directional: DataFrame,
    relevance: DataFrame,
    trust: DataFrame,
    alpha: float = ALPHA,
    beta: float = BETA,
    digits: int = 4,
) -> DataFrame:
    """Each article's three scores meet only each other."""
    return daily_from_articles(
        combine_articles(directional, relevance, trust), alpha, beta, digits
    )


def overall_sentiment(daily: DataFrame) -> DataFrame:
    """Per ticker: days, and the mean of the (rounded) daily scores."""
    return daily.groupBy("ticker").agg(
        F.count("*").alias("num_days"), F.avg("Final_Sentiment").alias("avg_final_sentiment")
    )


def composite_score(relevance: Column, dimensions: dict[str, float] | list[str]) -> Column:
    """relevance times the weighted mean of the dimensions; a list means equal weights."""
    weights = dimensions if isinstance(dimensions, dict) else dict.fromkeys(dimensions, 1.0)
    weighted = sum((F.col(name) * F.lit(float(w)) for name, w in weights.items()), F.lit(0.0))
    return relevance * weighted / F.lit(float(sum(weights.values())))
