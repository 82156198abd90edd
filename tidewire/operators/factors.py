"""Market factor proxies from a long price table.

There is one row per trading day, a few thousand per century, so the windows over the day series
are small however large the rest of the data is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.numbers import half_even

# The five symbols by role.
SYMBOLS = {"market": "SPY", "small": "IWM", "value": "IWD", "growth": "IWF", "bill": "IRX"}
FACTORS = ["mkt_rf", "smb", "hml", "rf"]
DAYS_IN_YEAR = 365


def wide_prices(
    prices: DataFrame,
    symbols: dict[str, str] | None = None,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """One row per date with a column per role; ``start`` inclusive, ``end`` exclusive."""
    symbols = symbols or SYMBOLS
    rows = prices.filter(F.col("symbol").isin(list(symbols.values())))
    if start:
        rows = rows.filter(F.col("date") >= F.lit(start).cast("date"))
    if end:
        rows = rows.filter(F.col("date") < F.lit(end).cast("date"))
    price = {
        role: F.max(F.when(F.col("symbol") == name, F.col("adj_close"))).alias(role)
        for role, name in symbols.items()
    }
    return rows.groupBy("date").agg(*price.values())


def factor_proxies(
    prices: DataFrame,
    symbols: dict[str, str] | None = None,
    start: str | None = None,
    end: str | None = None,
    mode: str = "price_diff",
) -> DataFrame:
    """mkt_rf, smb, hml, rf per day; days with a missing factor are dropped.

    ``mode='price_diff'`` takes the change of a price difference for smb and hml;
    ``'return_diff'`` takes the difference of the two returns.
    """
    wide = wide_prices(prices, symbols, start, end).withColumn("_series", F.lit(1))
    days = Window.partitionBy("_series").orderBy("date")
    so_far = days.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    series = {
        "_market": F.col("market"),
        "_small": F.col("small"),
        "_value": F.col("value"),
        "_growth": F.col("growth"),
        "_size_gap": F.col("small") - F.col("market"),
        "_style_gap": F.col("value") - F.col("growth"),
    }
    for name, value in series.items():
        wide = wide.withColumn(name, F.last(value, ignorenulls=True).over(so_far))

    def change(name: str) -> Column:
        filled = F.col(name)
        return (F.try_divide(filled, F.lag(filled).over(days)) - 1) * 100

    if mode == "price_diff":
        smb, hml = change("_size_gap"), change("_style_gap")
    elif mode == "return_diff":
        smb = change("_small") - change("_market")
        hml = change("_value") - change("_growth")
    else:
        raise ValueError(f"unknown mode {mode}")
    bill = F.col("bill") / DAYS_IN_YEAR
    return wide.select(
        "date",
        (change("_market") - bill).alias("mkt_rf"),
        smb.alias("smb"),
        hml.alias("hml"),
        bill.alias("rf"),
    ).dropna("any", subset=FACTORS)


def last_days(factors: DataFrame, days: int = 15, digits: int = 4) -> DataFrame:
    """The latest trading days, rounded."""
    latest = factors.orderBy(F.desc("date")).limit(days)
    return latest.select("date", *[half_even(F.col(c), digits).alias(c) for c in FACTORS])


def factor_summary(factors: DataFrame) -> DataFrame:
    """First day, last day and number of days."""
    return factors.agg(
        F.min("date").alias("first_day"),
        F.max("date").alias("last_day"),
        F.count("*").alias("num_days"),
    )
