"""The four flows from raw articles to daily sentiment, each over all tickers at once."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidewire.operators.clean import ObservedIntegrity, clean_news
from tidewire.operators.directional import positional_combine
from tidewire.operators.relevance import relevance_scores
from tidewire.operators.rolling import LOOKBACK_DAYS, THRESHOLD, rolling_dedup
from tidewire.operators.sampling import stratified_sample
from tidewire.operators.score import daily_sentiment_by_article, daily_sentiment_by_date
from tidewire.operators.trust import with_trust
from tidewire.operators.vectors import tfidf_vectors
from tidewire.session import stored


def processed_news(
    raw: DataFrame,
    vectors: DataFrame | None = None,
    threshold: float = THRESHOLD,
    lookback: int = LOOKBACK_DAYS,
    folder: str | None = None,
) -> DataFrame:
    """Clean, check, then drop rolling near-duplicates; TF-IDF vectors unless others are given.

    Both stages are read several times by what follows, so each is stored once, as Parquet by
    ticker: in ``folder`` (as ``cleaned`` and ``processed``, which must be new), or beside the checkpoints.
    """
    places = [f"{folder.rstrip('/')}/{name}" if folder else None for name in ("cleaned", "processed")]
    integrity = ObservedIntegrity()
    cleaned = stored(clean_news(raw, integrity=integrity), places[0], ["ticker"])
    integrity.check()    # counted while the table was written
    if vectors is None:
        vectors = tfidf_vectors(cleaned)
    return stored(rolling_dedup(cleaned, vectors, threshold, lookback), places[1], ["ticker"])


def labelling_sample(processed: DataFrame, n_total: int | dict[str, int] = 1000, seed: int = 42):
    """The month-stratified sample that goes out for labelling. A processed table is in date
    order, so months appear in calendar order."""
    return stratified_sample(processed, n_total, seed, appearance="date")


def training_table(sample: DataFrame, labels: DataFrame, on_mismatch: str = "error") -> DataFrame:
    """The sample with its returned labels; a ticker with the wrong number of labels raises.

    ``on_mismatch='skip'`` leaves such tickers out; ``count_mismatches`` lists them.
    """
    return positional_combine(sample, labels, on_mismatch)


def daily_signal(
    processed: DataFrame,
    directional: DataFrame,
    rules: DataFrame,
    weights: dict[str, float] | DataFrame | None = None,
    join: str = "date",
    digits: int = 4,
) -> DataFrame:
    """Relevance, trust and direction combined into one row per (ticker, date)."""
    combine = {"date": daily_sentiment_by_date, "article": daily_sentiment_by_article}[join]
    relevance = relevance_scores(processed, rules, evidence=False)
    return combine(directional, relevance, with_trust(processed, weights), digits=digits)
