"""Named queries over the driver's tables, one per operator group.

``documents`` plays the articles (language as ticker, doc_id as ord), ``labels`` the known
directions, ``embeddings`` the vectors and ``events`` the prices.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import numbers as N
from tidewire.functions import text as X
from tidewire.operators import (
    bayes, clean, directional, factors, loadings, relevance, rolling, sampling, score, trust, vectors,
    weekly,
)
from tidewire.plans import flows
from tidewire.schemas import RULES
from tidewire.session import spread

SAMPLE_ROWS = 120
ROLLING_COSINE = 0.20
DIGITS = 9
SMALL_TILE = 16    # rows; groups of the smallest tables are larger

# Word lists and weights for the invented prose and sources of the driver's tables.
WORD_LISTS = {
    "en": {
        "aliases": ["thst", "anin", "oned"],
        "products": ["ationthe", "onbleing"],
        "direct_keywords": ["nterthe", "ouinor", "whheth"],
        "indirect_keywords": ["retition", "shrewh"],
        "low_signal_phrases": ["the the", "edha"],
    },
    "fr": {
        "aliases": ["queque", "letre"],
        "products": ["euxtion"],
        "direct_keywords": ["auxch", "mentan"],
        "indirect_keywords": ["eaument", "oution"],
        "low_signal_phrases": ["de la"],
    },
    "de": {
        "aliases": ["enlich", "erung"],
        "products": [],
        "direct_keywords": ["keitkeit", "teber"],
        "indirect_keywords": ["schte", "unglich"],
        "low_signal_phrases": [],
    },
    "es": {
        "aliases": [],
        "products": ["raar"],
        "direct_keywords": ["mimi"],
        "indirect_keywords": ["asbo", "llll"],
        "low_signal_phrases": ["de no"],
    },
}
# (modulus, remainder, text before, text after): what is put into rows by their ``ord``.
NEWS_EDITS = {
    "headline": [(11, 4, "Breaking:  ", ""), (23, 7, "LIVE: ", "")],
    "summary": [
        (13, 4, "", ' the thst nterthe FDA "a passage that is quoted" end'),
        (17, 6, "", " Oned ouinor, EPS guidance; enlich keitkeit queque auxch raar mimi"),
        (19, 8, "", " queque mentan merger erung teber SPIN-OFF"),
    ],
}
RAW_EDITS = {
    "headline": [(89, 3, "", " #name?"), (67, 9, '"', "'")],
    "summary": [(83, 7, "", " with Proven  Results today"), (79, 11, "see ZACKS.com ", "")],
}
DATE_SPELLINGS = [
    "dd/MM/yyyy", "d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "dd/MM/yy", "yyyy-MM-dd", "yyyyMMdd", "d MMM yyyy", "d MMMM yyyy",
    "MMM d, yyyy", "MMMM d, yyyy", "d/M/yyyy 9:07", "yyyy-MM-dd 10:11:12", "yyyy-MM-dd 10:11:12.5",
    "yyyy-MM-dd 10:11:12+00:00", "yyyy-MM-dd'T'10:11:12'Z'",
]
SOURCE_WEIGHTS = {"src0": 0.9, "src1": 0.9, "src2": 0.8, "src3": 0.4, "src4": 0.3}
ROLES = {"view": "SPY", "signup": "IWM", "click": "IWD", "purchase": "IWF", "error": "IRX"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _put(column: str, edits: list[tuple[int, int, str, str]]) -> Column:
    """Texts put before or after a column in the rows whose ``ord`` has a remainder."""
    value = F.col(column)
    for modulus, rest, before, after in edits:
        edited = F.concat(F.lit(before), value, F.lit(after))
        value = F.when(F.col("ord") % modulus == rest, edited).otherwise(value)
    return value


def news(spark: SparkSession, sf: str) -> DataFrame:
    """The documents as articles, some with what the rules of relevance and comparison look for."""
    headline = F.substring_index("text", "\n", 1)
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 90).cast("int"))
    # a table of one row group is one task; its texts are dealt to all cores
    plain = spread(table(spark, sf, "documents"), "doc_id").select(
        F.col("lang").alias("ticker"),
        F.col("doc_id").alias("ord"),
        day.alias("date"),
        headline.alias("headline"),
        "source",
        F.trim(F.substr("text", F.length(headline) + 2)).alias("summary"),
    )
    return plain.withColumns({c: _put(c, edits) for c, edits in NEWS_EDITS.items()})


def raw_news(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that break each rule of cleaning, and dates as text: day-first and ISO forms."""
    written = (
        F.when(F.col("ord") % 97 == 5, "not a date")
        .when(F.col("ord") % 2 == 0, F.date_format("date", "dd/MM/yyyy"))
        .otherwise(F.date_format("date", "yyyy-MM-dd"))
    )
    broken = {c: _put(c, edits) for c, edits in RAW_EDITS.items()}
    token = F.when(F.col("ord") % 73 == 13, "NA").otherwise(broken["headline"])
    return news(spark, sf).withColumns({**broken, "headline": token, "date": written})


def rules(spark: SparkSession) -> DataFrame:
    rows = [(ticker, *[lists[f.name] for f in RULES.fields[1:]]) for ticker, lists in WORD_LISTS.items()]
    return spark.createDataFrame(rows, RULES)


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Articles with a known direction."""
    known = F.when(F.col("toxic") == 1, -1).when(F.col("quality") == 1, 1).otherwise(0)
    labels = table(spark, sf, "labels").select(
        F.col("doc_id").alias("ord"), known.cast("int").alias("directional_sentiment")
    )
    return news(spark, sf).join(labels, "ord")


def article_vectors(spark: SparkSession, sf: str) -> DataFrame:
    vectors_ = table(spark, sf, "embeddings").select(F.col("vec_id").alias("ord"), "embedding")
    return vectors_.join(news(spark, sf).select("ticker", "ord"), "ord")


def prices(spark: SparkSession, sf: str) -> DataFrame:
    role = F.create_map(*[F.lit(part) for item in ROLES.items() for part in item])
    return (
        table(spark, sf, "events")
        .groupBy(F.col("ts").cast("date").alias("date"), "event_type")
        .agg(F.avg("value").alias("adj_close"))
        .select("date", F.try_element_at(role, F.col("event_type")).alias("symbol"), "adj_close")
    )


def _rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    doubles = [name for name, kind in df.dtypes if kind == "double"]
    return df.withColumns({c: N.half_even(F.col(c), digits) for c in doubles})


def clean_news_query(spark, sf):
    return clean.clean_news(raw_news(spark, sf))


def clean_news_titles(spark, sf):
    """The same from a table with the other header names, in another order and case."""
    raw = raw_news(spark, sf)
    renamed = raw.select(
        F.col("summary").alias(" Summary"), F.col("headline").alias("TITLE"), F.col("date").alias("DateTime"),
        F.col("source").alias("source "), "ord", "ticker",
    )
    return clean.clean_news(renamed)


def clean_rejects(spark, sf):
    rejected = clean.rejected_news(raw_news(spark, sf))
    return rejected.select("ticker", "ord", "raw_date", "source", "reject_reason")


def clean_counts(spark, sf):
    return clean.stage_counts(clean.verdicts(raw_news(spark, sf)))


def integrity_report(spark, sf):
    return clean.integrity_report(news(spark, sf))


def comparison_text(spark, sf):
    text = X.comparison_text(F.col("headline"), F.col("summary"))
    return news(spark, sf).select("ticker", "ord", text.alias("text"))


def trust_scores(spark, sf):
    scored = trust.trust_scores(news(spark, sf), SOURCE_WEIGHTS)
    return _rounded(scored.select("ticker", "ord", "source", "x3_factor", "x3_factor_avg"))


def trust_preview(spark, sf):
    return _rounded(trust.preview(trust.trust_scores(news(spark, sf), SOURCE_WEIGHTS)))


def trust_overall(spark, sf):
    return _rounded(trust.overall_trust(trust.with_trust(news(spark, sf), SOURCE_WEIGHTS)))


def relevance_scores(spark, sf):
    return relevance.relevance_scores(news(spark, sf), rules(spark), evidence=False)


def relevance_evidence(spark, sf):
    scored = relevance.relevance_scores(news(spark, sf), rules(spark))
    return relevance.relevance_text(scored)


def date_spellings(spark, sf):
    """Each article's date in one of many spellings, day first, and read back."""
    spelled = [F.date_format("date", f) for f in DATE_SPELLINGS]
    spelled.append(F.lit("31/31/2024"))
    text = F.element_at(F.array(*spelled), (F.col("ord") % len(spelled) + 1).cast("int"))
    return news(spark, sf).select("ticker", "ord", X.parse_date(text).alias("date"))


def rules_missing(spark, sf):
    return relevance.rules_missing(news(spark, sf), rules(spark).filter("ticker <> 'es'"))


def relevance_skipped(spark, sf):
    """With rules for one language only, and the others left out on request."""
    some = rules(spark).filter("ticker = 'de'")
    return relevance.relevance_scores(news(spark, sf), some, evidence=False, on_missing="skip")


def sample_quota(spark, sf):
    return sampling.sample_quota(news(spark, sf), SAMPLE_ROWS)


def stratified_sample(spark, sf):
    return sampling.sample_keys(news(spark, sf), SAMPLE_ROWS)


def chunk_numbers(spark, sf):
    return directional.numbered_chunks(news(spark, sf))


def positional_combine(spark, sf):
    rows = labelled(spark, sf)
    labels = rows.select("ticker", "ord", F.col("directional_sentiment").alias("label"))
    combined = directional.positional_combine(rows, labels)
    return combined.select("ticker", "ord", "date", "directional_sentiment")


def count_mismatches(spark, sf):
    return directional.count_mismatches(news(spark, sf), labelled(spark, sf))


def positional_skip(spark, sf):
    """Labels lack the last row of one ticker, which is left out; the others get theirs."""
    rows = labelled(spark, sf)
    labels = rows.select("ticker", "ord", F.col("directional_sentiment").alias("label"))
    last = labels.filter("ticker = 'fr'").agg(F.max("ord").alias("last"))
    labels = labels.join(F.broadcast(last), (F.col("ticker") == "fr") & (F.col("ord") == F.col("last")), "left_anti")
    combined = flows.training_table(rows, labels, "skip")
    return combined.select("ticker", "ord", "date", "directional_sentiment")


def _predicted(spark, sf):
    guess = (F.length("headline") % 3 - 1).cast("int")
    return news(spark, sf).withColumn("directional_sentiment_pred", guess)


def label_override(spark, sf):
    return directional.label_override(_predicted(spark, sf), labelled(spark, sf), "first")


def label_passthrough(spark, sf):
    return directional.label_passthrough(labelled(spark, sf))


def label_codes(spark, sf):
    code = N.encode_label(F.col("directional_sentiment"))
    rows = labelled(spark, sf).select("ticker", "ord", "directional_sentiment", code.alias("code"))
    return rows.withColumn("decoded", N.decode_label(F.col("code")))


def rolling_dedup(spark, sf):
    kept = rolling.rolling_dedup(news(spark, sf), article_vectors(spark, sf), ROLLING_COSINE)
    return kept.select("ticker", "ord", "date")


def rolling_dedup_text(spark, sf):
    articles = news(spark, sf)
    kept = rolling.rolling_dedup(articles, vectors.tfidf_vectors(articles))
    return kept.select("ticker", "ord", "date")


def rolling_dedup_tiled(spark, sf):
    """The same with tiles so small that groups are cut, and every round in tiles."""
    kept = rolling.rolling_dedup(
        news(spark, sf), article_vectors(spark, sf), ROLLING_COSINE, tile_rows=SMALL_TILE, local_rows=0
    )
    return kept.select("ticker", "ord", "date")


def rolling_text_tiled(spark, sf):
    articles = news(spark, sf)
    kept = rolling.rolling_dedup(articles, vectors.tfidf_vectors(articles), tile_rows=SMALL_TILE, local_rows=0)
    return kept.select("ticker", "ord", "date")


def weekly_tiled(spark, sf):
    return weekly.weekly_keys(news(spark, sf), tile_rows=SMALL_TILE)


def rolling_counts(spark, sf):
    articles = news(spark, sf)
    kept = rolling.rolling_dedup(articles, article_vectors(spark, sf), ROLLING_COSINE)
    return rolling.dedup_counts(articles, kept)


def weekly_tfidf_dedup(spark, sf):
    return weekly.weekly_keys(news(spark, sf))


def _daily_inputs(spark, sf):
    articles = news(spark, sf)
    return (
        labelled(spark, sf),
        relevance.relevance_scores(articles, rules(spark), evidence=False),
        trust.with_trust(articles, SOURCE_WEIGHTS),
    )


def daily_sentiment_date(spark, sf):
    return score.daily_sentiment_by_date(*_daily_inputs(spark, sf), digits=DIGITS)


def daily_sentiment_article(spark, sf):
    return score.daily_sentiment_by_article(*_daily_inputs(spark, sf), digits=DIGITS)


def daily_overall(spark, sf):
    daily = score.daily_sentiment_by_article(*_daily_inputs(spark, sf), digits=DIGITS)
    return _rounded(score.overall_sentiment(daily))


def daily_signal(spark, sf):
    """The whole way from raw articles: clean, drop near copies, score, aggregate by day."""
    processed = flows.processed_news(
        raw_news(spark, sf), article_vectors(spark, sf), ROLLING_COSINE
    )
    return flows.daily_signal(
        processed, labelled(spark, sf), rules(spark), SOURCE_WEIGHTS, "article", DIGITS
    )


def composite_score(spark, sf):
    scored = score.combine_articles(*_daily_inputs(spark, sf))
    equal = score.composite_score(F.col("x2"), ["x1", "x3"])
    weighed = score.composite_score(F.col("x2"), {"x1": 3.0, "x3": 1.0})
    return _rounded(
        scored.select("ticker", "ord", equal.alias("equal_score"), weighed.alias("weighted_score"))
    )


def direction_bands(spark, sf):
    scored = score.combine_articles(*_daily_inputs(spark, sf))
    direction = N.direction_band(F.col("x1") * F.col("x3"))
    return scored.select(
        "ticker", "ord", direction.alias("direction"),
        N.relevance_band(F.col("x2")).alias("relevance"),
    )


def factor_proxies(spark, sf):
    return _rounded(factors.factor_proxies(prices(spark, sf)))


def factor_return_diff(spark, sf):
    return _rounded(factors.factor_proxies(prices(spark, sf), mode="return_diff"))


def factor_last_days(spark, sf):
    return factors.last_days(factors.factor_proxies(prices(spark, sf)))


def factor_loadings(spark, sf):
    daily = score.daily_sentiment_by_article(*_daily_inputs(spark, sf), digits=DIGITS)
    return _rounded(loadings.factor_loadings(daily, factors.factor_proxies(prices(spark, sf))), 6)


def factor_summary(spark, sf):
    return factors.factor_summary(factors.factor_proxies(prices(spark, sf)))


def classifier_scores(spark, sf):
    return bayes.classify_by_ticker(news(spark, sf), labelled(spark, sf), "first")


def classifier_split(spark, sf):
    return bayes.labelled_rows(labelled(spark, sf)).select("ticker", "ord", "label", "held_out")


def classifier_words(spark, sf):
    return bayes.word_counts(bayes.labelled_rows(labelled(spark, sf)).filter("not held_out"))


def classifier_guesses(spark, sf):
    rows = bayes.labelled_rows(labelled(spark, sf)).filter("not held_out")
    return bayes.predict(news(spark, sf), rows)


def classifier_metrics(spark, sf):
    return _rounded(bayes.held_out_metrics(labelled(spark, sf)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "clean_news": clean_news_query,
    "clean_rejects": clean_rejects,
    "clean_counts": clean_counts,
    "integrity_report": integrity_report,
    "comparison_text": comparison_text,
    "trust_scores": trust_scores,
    "trust_preview": trust_preview,
    "trust_overall": trust_overall,
    "relevance_scores": relevance_scores,
    "relevance_evidence": relevance_evidence,
    "sample_quota": sample_quota,
    "stratified_sample": stratified_sample,
    "chunk_numbers": chunk_numbers,
    "positional_combine": positional_combine,
    "label_override": label_override,
    "label_passthrough": label_passthrough,
    "label_codes": label_codes,
    "rolling_dedup": rolling_dedup,
    "rolling_dedup_text": rolling_dedup_text,
    "rolling_dedup_tiled": rolling_dedup_tiled,
    "rolling_text_tiled": rolling_text_tiled,
    "rolling_counts": rolling_counts,
    "weekly_tfidf_dedup": weekly_tfidf_dedup,
    "weekly_tiled": weekly_tiled,
    "daily_sentiment_date": daily_sentiment_date,
    "daily_sentiment_article": daily_sentiment_article,
    "daily_overall": daily_overall,
    "daily_signal": daily_signal,
    "composite_score": composite_score,
    "direction_bands": direction_bands,
    "factor_proxies": factor_proxies,
    "factor_return_diff": factor_return_diff,
    "factor_last_days": factor_last_days,
    "factor_summary": factor_summary,
    "factor_loadings": factor_loadings,
    "classifier_scores": classifier_scores,
    "classifier_split": classifier_split,
    "classifier_words": classifier_words,
    "classifier_guesses": classifier_guesses,
    "classifier_metrics": classifier_metrics,
    "clean_news_titles": clean_news_titles,
    "rules_missing": rules_missing,
    "date_spellings": date_spellings,
    "relevance_skipped": relevance_skipped,
    "count_mismatches": count_mismatches,
    "positional_skip": positional_skip,
}
