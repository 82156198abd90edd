"""The labelling loop: numbered chunks out, labels back in, truth over prediction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions.text import joined_text, text_or_empty
from tidewire.operators.lookup import lookup_join
from tidewire.operators.ordinals import with_chunks, with_row_number
from tidewire.schemas import NEWS, require_columns
from tidewire.session import materialize

NEWS_COLUMNS = [f.name for f in NEWS.fields]


def numbered_chunks(sample: DataFrame, size: int = 100, null_text: str = "nan") -> DataFrame:
    """Running number per ticker, its chunk, and headline and summary as one text."""
    text = joined_text(F.col("headline"), F.col("summary"), null_text=null_text)
    numbered = with_chunks(with_row_number(sample), size)
    return numbered.select("ticker", "chunk", "number", text.alias("text"))


def count_mismatches(left: DataFrame, right: DataFrame) -> DataFrame:
    """Tickers whose row counts differ, with both counts (0 when a side has none)."""
    counts = left.groupBy("ticker").agg(F.count("*").alias("left_rows")).join(
        right.groupBy("ticker").agg(F.count("*").alias("right_rows")), "ticker", "full"
    )
    return counts.fillna(0, ["left_rows", "right_rows"]).filter("left_rows <> right_rows")


def require_same_counts(left: DataFrame, right: DataFrame) -> None:
    """Raise on the first few tickers whose row counts differ."""
    wrong = count_mismatches(left, right).orderBy("ticker").limit(5).collect()
    if wrong:
        shown = ", ".join(f"{r['ticker']}: {r['left_rows']} vs {r['right_rows']}" for r in wrong)
        raise ValueError(f"tickers with unequal numbers of rows: {shown}")


def positional_combine(
    sample: DataFrame, labels: DataFrame, on_mismatch: str = "error"
) -> DataFrame:
    """Give the k-th sample row (by date, ord) the k-th label of its ticker (by ord).

    The label's own index is not used. Tickers whose counts differ raise with
    ``on_mismatch='error'`` and are left out with ``'skip'``.
    """
    require_columns(sample, NEWS_COLUMNS, "sample")
    require_columns(labels, ["ticker", "ord", "label"], "labels")
    left = with_row_number(sample.select(*NEWS_COLUMNS), "_place")
    right = with_row_number(labels.select("ticker", "ord", "label"), "_place", by=None)
    right = right.select("ticker", "_place", F.col("label").alias("directional_sentiment"))
    if on_mismatch == "error":
        require_same_counts(sample, labels)
    else:
        wrong = materialize(count_mismatches(sample, labels).select("ticker"))
        left = lookup_join(left, wrong, ["ticker"], "left_anti", salt_by=["ticker", "ord"])
    return left.join(right, ["ticker", "_place"]).drop("_place")


def label_passthrough(train: DataFrame) -> DataFrame:
    """The labels of a fully labelled table, as the directional table."""
    require_columns(train, ["date", "directional_sentiment"], "train")
    return train.select("ticker", "ord", "date", "directional_sentiment")


def _text_key():
    """Digest of the two texts; the length keeps the border between them."""
    headline, summary = text_or_empty(F.col("headline")), text_or_empty(F.col("summary"))
    joined = F.concat(F.length(headline).cast("string"), F.lit(":"), headline, summary)
    return F.unhex(F.sha2(joined, 256))


def label_override(
    predicted: DataFrame, train: DataFrame, on_repeat: str = "error"
) -> DataFrame:
    """One row per predicted article: the true label where (ticker, date, texts) has one.

    A key that is labelled twice would multiply rows. ``on_repeat='error'`` raises then;
    ``'first'`` takes the label with the lowest ``ord``.
    """
    truth = train.filter(F.col("directional_sentiment").isNotNull()).select(
        "ticker", "date", _text_key().alias("_key"), "ord", "directional_sentiment"
    )
    keys = ["ticker", "date", "_key"]
    truth = truth.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.min_by("directional_sentiment", "ord").alias("_true")
    )
    truth = materialize(truth)
    if on_repeat == "error" and not truth.filter("_n > 1").isEmpty():
        raise ValueError("the training table labels a (ticker, date, headline, summary) twice")
    rows = predicted.select(
        "ticker", "ord", "date", _text_key().alias("_key"), "directional_sentiment_pred"
    )
    joined = lookup_join(rows, truth.drop("_n"), keys, salt_by=["ticker", "ord"])
    final = F.coalesce("_true", "directional_sentiment_pred").cast("int")
    return joined.select("ticker", "ord", "date", final.alias("directional_sentiment"))
