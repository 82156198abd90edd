"""Exact-size sampling, stratified by month, reproducible at any partitioning.

Rows are ordered by a seeded hash of (ticker, ord), so the picks do not depend on how the data is
laid out and a lost executor recomputes the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.text import month_of
from tidewire.operators.lookup import lookup_join
from tidewire.session import materialize

STRATUM = ["ticker", "month"]
BIN_DIGITS = 4    # leading hex digits of a hash that make its bin


def _target(n_total: int | dict[str, int], default: int | None) -> Column:
    """Sample size per ticker as a column."""
    if isinstance(n_total, int):
        return F.lit(n_total)
    pairs = [F.lit(part) for item in n_total.items() for part in item]
    sized = F.try_element_at(F.create_map(*pairs), F.col("ticker"))
    return F.coalesce(sized, F.lit(default or 0))


def sample_quota(
    df: DataFrame,
    n_total: int | dict[str, int],
    default: int | None = None,
    appearance: str = "ord",
) -> DataFrame:
    """Per (ticker, month): rows, quota, first-pass take, and the ticker's remaining gap.

    Months are ranked in order of first appearance, and the first ``n % months`` get one extra.
    ``whole`` marks tickers small enough to be passed through as they are.
    """
    target = _target(n_total, default)
    months = (
        df.select("ticker", month_of(F.col("date")).alias("month"), F.col(appearance).alias("_at"))
        .groupBy(*STRATUM)
        .agg(F.count("*").alias("num_rows"), F.min("_at").alias("_first"))
    )
    per_ticker = Window.partitionBy("ticker")    # one row per month from here on
    ranked = (
        months.withColumn("month_rank", F.row_number().over(per_ticker.orderBy("_first", "month")))
        .withColumn("num_months", F.count("*").over(per_ticker))
        .withColumn("ticker_rows", F.sum("num_rows").over(per_ticker))
        .withColumn("n_total", target)
    )
    extra = (F.col("month_rank") <= F.col("n_total") % F.col("num_months")).cast("int")
    quota = F.floor(F.col("n_total") / F.col("num_months")) + extra
    return (
        ranked.withColumn("whole", F.col("n_total") >= F.col("ticker_rows"))
        .withColumn("quota", quota.cast("long"))
        .withColumn("first_take", F.least("quota", "num_rows"))
        .withColumn("gap", F.col("n_total") - F.sum("first_take").over(per_ticker))
        .drop("_first")
    )


def sample_keys(
    df: DataFrame,
    n_total: int | dict[str, int],
    seed: int = 42,
    default: int | None = None,
    appearance: str = "ord",
) -> DataFrame:
    """(ticker, ord) of the sampled rows, and whether quota or gap filling took them.

    Rows are counted by the leading digits of their hashes, and running sums over these bins say which are
    taken whole, which in part, and which not at all; only rows of bins that give some go on, and only within
    a bin are rows ranked. So the work doesn't depend on the size of the sample, and no task sees more
    of a month or ticker than a bin.
    """
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), "ticker", F.col("ord").cast("string")))
    keyed = df.select("ticker", "ord", month_of(F.col("date")).alias("month"), order.alias("_hash"))
    keyed = keyed.withColumn("_bin", F.substring("_hash", 1, BIN_DIGITS))
    plan = _bin_plan(keyed, sample_quota(df, n_total, default, appearance))
    joined = lookup_join(keyed, plan, [*STRATUM, "_bin"], "inner", salt_by=["ord"])

    def rank(*partition: str) -> Column:
        return F.row_number().over(Window.partitionBy(*partition).orderBy("_hash", "ord"))

    marked = joined.withColumn("_in_quota", rank(*STRATUM, "_bin") <= F.col("_take"))
    rest = rank("ticker", "_bin", "_in_quota")
    return marked.withColumn("_rest_rank", rest).filter(
        F.col("_in_quota") | (F.col("_rest_rank") <= F.col("_fill"))
    ).select("ticker", "ord", F.when(F.col("_in_quota"), "quota").otherwise("gap").alias("taken_by"))


def _bin_plan(keyed: DataFrame, quota: DataFrame) -> DataFrame:
    """(ticker, month, _bin, _take, _fill) of the bins that give rows: ``_take`` of the month's quota, and
    ``_fill`` of the ticker's gap from what all its months leave over in the bin."""

    def before(value: Column, partition: list[str]) -> Column:
        window = Window.partitionBy(*partition).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(value).over(window), F.lit(0))

    def some_of(rows: Column, wanted: Column) -> Column:
        return F.greatest(F.lit(0).cast("long"), F.least(rows, wanted))

    n = F.col("_n")
    bins = keyed.groupBy(*STRATUM, "_bin").agg(F.count("*").alias("_n"))
    bins = bins.join(quota.select(*STRATUM, "whole", "quota", "gap"), STRATUM)
    wanted = F.col("quota") - before(n, STRATUM)
    bins = materialize(
        bins.withColumn("_take", F.when(F.col("whole"), n).otherwise(some_of(n, wanted))).withColumn("_left", n - F.col("_take"))
    )
    over = bins.groupBy("ticker", "_bin").agg(F.sum("_left").alias("_rest"), F.max("gap").alias("gap"))
    fill = some_of(F.col("_rest"), F.col("gap") - before(F.col("_rest"), ["ticker"]))
    over = over.select("ticker", "_bin", fill.alias("_fill"))
    gives = (F.col("_take") > 0) | ((F.col("_fill") > 0) & (F.col("_left") > 0))
    return materialize(bins.join(over, ["ticker", "_bin"]).filter(gives).select(*STRATUM, "_bin", "_take", "_fill"))


def stratified_sample(
    df: DataFrame,
    n_total: int | dict[str, int],
    seed: int = 42,
    default: int | None = None,
    appearance: str = "ord",
) -> DataFrame:
    """The sampled rows themselves. Order by (ticker, date, ord) where they are written."""
    keys = sample_keys(df, n_total, seed, default, appearance).select("ticker", "ord")
    return df.join(keys, ["ticker", "ord"], "left_semi")
