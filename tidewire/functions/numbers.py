"""Score arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHA = 2.0  # exponent of relevance
BETA = 1.5   # exponent of trust


def half_even(c: Column, digits: int) -> Column:
    return F.bround(c, digits)


def relevance_power(x2: Column, alpha: float = ALPHA) -> Column:
    return F.pow(x2, F.lit(alpha))


def trust_power(x3: Column, beta: float = BETA) -> Column:
    return F.pow(x3, F.lit(beta))


def article_score(x1: Column, x2: Column, x3: Column, alpha: float, beta: float) -> Column:
    return x1 * relevance_power(x2, alpha) * trust_power(x3, beta)


def magnitude(x2: Column, x3: Column) -> Column:
    return F.abs(x2) * F.abs(x3)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def direction_band(c: Column) -> Column:
    """Bullish from 0.60 up, bearish from -0.60 down, neutral between."""
    return F.when(c >= 0.60, "Bullish").when(c <= -0.60, "Bearish").when(c.isNotNull(), "Neutral")


def relevance_band(c: Column) -> Column:
    """Direct from 0.70, indirect from 0.30, neutral below."""
    return (
        F.when(c >= 0.70, "Directly related")
        .when(c >= 0.30, "Indirectly related")
        .when(c.isNotNull(), "Neutral")
    )


def encode_label(label: Column) -> Column:
    """-1, 0, 1 -> 0, 1, 2; any other value fails the job."""
    bad = F.raise_error(F.concat(F.lit("invalid sentiment label "), label.cast("string")))
    return F.when(label.isin(-1, 0, 1), (label + 1).cast("int")).when(
        label.isNotNull(), bad.cast("int")
    )


def decode_label(label: Column) -> Column:
    return (label - 1).cast("int")
