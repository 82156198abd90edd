"""Source trust weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.operators.lookup import lookup_join
from tidewire.session import materialize

# Editorial trust per source.
SOURCE_WEIGHTS = {
    "DowJones": 0.90,
    "MarketWatch": 0.90,
    "Yahoo": 0.80,
    "Finnhub": 0.40,
    "SeekingAlpha": 0.30,
}
DEFAULT_WEIGHT = 0.50
LITERAL_WEIGHTS = 200    # larger tables are joined, not written into the expression


def weight_expression(weights: dict[str, float], default: float = DEFAULT_WEIGHT) -> Column:
    """Exact, case-sensitive weight of ``source`` as a map literal: no join at all."""
    if not weights:
        return F.lit(default)
    pairs = [F.lit(part) for item in weights.items() for part in (item[0], float(item[1]))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("source")), F.lit(default))


def with_trust(
    df: DataFrame,
    weights: dict[str, float] | DataFrame | None = None,
    default: float = DEFAULT_WEIGHT,
) -> DataFrame:
    """Add ``x3_factor``; ``weights`` may be a table (source, weight) of any size.

    A source that is listed twice with different weights raises; equal rows count once.
    """
    weights = SOURCE_WEIGHTS if weights is None else weights
    if isinstance(weights, dict):
        if len(weights) <= LITERAL_WEIGHTS:
            return df.withColumn("x3_factor", weight_expression(weights, default))
        weights = df.sparkSession.createDataFrame(
            list(weights.items()), "source string, weight double"
        )
    single = weights.groupBy("source").agg(F.min("weight").alias("weight"), F.max("weight").alias("_most"))
    single = materialize(single)
    unclear = single.filter("weight <> _most").orderBy("source").limit(5).collect()
    if unclear:
        raise ValueError(f"more than one weight for {[r['source'] for r in unclear]}")
    joined = lookup_join(df, single.drop("_most"), ["source"])
    return joined.withColumn("x3_factor", F.coalesce("weight", F.lit(default))).drop("weight")


def trust_scores(
    df: DataFrame,
    weights: dict[str, float] | DataFrame | None = None,
    default: float = DEFAULT_WEIGHT,
) -> DataFrame:
    """``x3_factor`` per row and its mean over the row's ticker."""
    scored = with_trust(df, weights, default)
    means = scored.groupBy("ticker").agg(F.avg("x3_factor").alias("x3_factor_avg"))
    return lookup_join(scored, materialize(means), ["ticker"], salt_by=["ticker", "ord"])


def overall_trust(scored: DataFrame) -> DataFrame:
    """One row: the mean weight over everything."""
    return scored.agg(F.avg("x3_factor").alias("avg_x3_factor"))


def preview(scored: DataFrame, rows: int = 5) -> DataFrame:
    """First rows in (ticker, date, ord) order."""
    shown = scored.select("ticker", "date", "ord", "source", "x3_factor", "x3_factor_avg")
    return shown.orderBy("ticker", "date", "ord").limit(rows)
