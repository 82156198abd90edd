"""A multinomial naive Bayes classifier of direction for every ticker, all in one job.

Word counts are exact. A word that a ticker's labelled texts lack says nothing and is left out.
Words and articles meet in a join by (ticker, word); the word "the" of one ticker may be in every
article, so that side is broadcast while small and salted beyond. The words of an article are counted where it
lies, so beyond the broadcast each distinct word of an article is shuffled twice: to its counts, and back as numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.numbers import decode_label, encode_label
from tidewire.functions.text import joined_text, text_or_empty
from tidewire.operators.directional import label_override, require_same_counts
from tidewire.operators.lookup import BROADCAST_BYTES, lookup_join, measured_bytes
from tidewire.operators.vectors import term_counts
from tidewire.schemas import NEWS, TRAIN, require_columns
from tidewire.session import materialize

LABELS = (0, 1, 2)
HELD_OUT = "1a"         # a tenth: 26 of the 256 first bytes of a digest
WORD = r"[\p{L}\p{N}_]+"
DIGITS = 6              # scores that agree to so many digits are a tie; the lowest label has it


def is_held_out() -> Column:
    """By a digest of (ticker, ord), so the split is the same at any partitioning."""
    digest = F.md5(F.concat_ws(":", "ticker", F.col("ord").cast("string")))
    return F.left(digest, F.lit(2)) < HELD_OUT


def words(max_tokens: int | None = None) -> Column:
    """Lower-case words of headline and summary; all of them unless a number is given."""
    text = joined_text(text_or_empty(F.col("headline")), text_or_empty(F.col("summary")))
    found = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    return F.slice(found, 1, max_tokens) if max_tokens else found


def labelled_rows(train: DataFrame) -> DataFrame:
    """Labelled rows with ``label`` 0, 1 or 2 and ``held_out``; raises when there are none."""
    require_columns(train, [f.name for f in TRAIN.fields], "train")
    rows = train.filter(F.col("directional_sentiment").isNotNull())
    rows = rows.withColumns({"label": encode_label(F.col("directional_sentiment")), "held_out": is_held_out()})
    if rows.isEmpty():
        raise ValueError("the training table has no label")
    return rows


def word_counts(rows: DataFrame, max_tokens: int | None = None) -> DataFrame:
    """(ticker, word, n0, n1, n2): how often each label's texts have the word."""
    counts = [F.count_if(F.col("label") == k).alias(f"n{k}") for k in LABELS]
    exploded = rows.select("ticker", "label", F.explode(words(max_tokens)).alias("word"))
    return exploded.groupBy("ticker", "word").agg(*counts)


def _priors(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Per ticker: rows (r0, r1, r2) and words (t0, t1, t2) of each label, and the vocabulary."""
    of_rows = rows.groupBy("ticker").agg(*[F.count_if(F.col("label") == k).alias(f"r{k}") for k in LABELS])
    totals = [F.sum(f"n{k}").alias(f"t{k}") for k in LABELS]
    return of_rows.join(counts.groupBy("ticker").agg(*totals, F.count("*").alias("vocabulary")), "ticker", "left")


def predict(
    news: DataFrame, rows: DataFrame, max_tokens: int | None = None, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """(ticker, ord, label) for every article of a ticker with rows to learn from.

    The score of a label is the logarithm of its share of the rows, plus that of (n + 1) / (t +
    vocabulary) for each word. A label that no row of the ticker has is never given.
    """
    counts = materialize(word_counts(rows, max_tokens))
    priors = materialize(_priors(rows, counts))
    key = ["ticker", "ord"]
    # stored, as the optimizer would else copy the search for words into each filter above it
    counted = materialize(term_counts(news, found=words(max_tokens))).select(*key, F.explode("terms").alias("t"))
    texts = counted.select(*key, F.col("t.term").alias("word"), F.col("t.tf").alias("times"))
    on, uses = ["ticker", "word"], None
    if measured_bytes(counts) > broadcast_bytes:    # the join has to know the words that are in many articles
        uses = "uses"
        counts = materialize(counts.join(texts.groupBy(*on).agg(F.count("*").alias(uses)), on))
    met = lookup_join(texts, counts, on, "inner", broadcast_bytes, key, uses)
    if uses:    # whole numbers go back to the articles, which are shorter than sums of logarithms
        met = met.select(*key, "times", *[f"n{k}" for k in LABELS]).repartition(*key)
    sums = [F.sum(F.col("times") * F.ln(F.col(f"n{k}") + 1)).alias(f"s{k}") for k in LABELS]
    found = met.groupBy(*key).agg(F.sum("times").alias("length"), *sums)
    scored = lookup_join(news.select(*key), priors, ["ticker"], "inner", salt_by=["ord"])
    scored = scored.join(found, key, "left").fillna(0, ["length", *[f"s{k}" for k in LABELS]])
    total = F.col("r0") + F.col("r1") + F.col("r2")
    choices = []
    for k in LABELS:
        words_of = F.when(F.col("length") > 0, F.col("length") * F.ln(F.col(f"t{k}") + F.col("vocabulary")))
        score = F.ln(F.col(f"r{k}") / total) + F.col(f"s{k}") - F.coalesce(words_of, F.lit(0.0))
        choice = F.struct(F.round(score, DIGITS).alias("score"), F.lit(-k).alias("order"))
        choices.append(F.when(F.col(f"r{k}") > 0, choice))
    return scored.select(*key, (-F.array_max(F.array(*choices))["order"]).alias("label"))


def evaluate(predicted: DataFrame, rows: DataFrame) -> DataFrame:
    """Per ticker over rows with a true label: rows, accuracy, and F1 averaged over its labels.

    Labels that neither truth nor prediction has are left out of the average.
    """
    pairs = rows.select("ticker", "ord", F.col("label").alias("truth")).join(predicted, ["ticker", "ord"])
    cells = pairs.groupBy("ticker", "truth", "label").agg(F.count("*").alias("n"))
    sides = cells.select(
        "ticker", "n", F.explode(F.array(*[F.lit(k) for k in LABELS])).alias("k"), "truth", "label"
    ).groupBy("ticker", "k").agg(
        F.sum(F.when((F.col("truth") == F.col("k")) & (F.col("label") == F.col("k")), F.col("n")).otherwise(0)).alias("hits"),
        F.sum(F.when(F.col("truth") == F.col("k"), F.col("n")).otherwise(0)).alias("true"),
        F.sum(F.when(F.col("label") == F.col("k"), F.col("n")).otherwise(0)).alias("given"),
    )
    f1 = F.when(F.col("true") + F.col("given") > 0, 2 * F.col("hits") / (F.col("true") + F.col("given")))
    return sides.groupBy("ticker").agg(
        F.sum("true").alias("num_rows"), (F.sum("hits") / F.sum("true")).alias("accuracy"), F.avg(f1).alias("f1")
    )


def held_out_metrics(train: DataFrame, max_tokens: int | None = None) -> DataFrame:
    """``evaluate`` over the held-out tenth, by models of the other rows."""
    rows = materialize(labelled_rows(train))
    test = rows.filter("held_out")
    return evaluate(predict(test, rows.filter("not held_out"), max_tokens), test)


def classify_by_ticker(
    news: DataFrame, train: DataFrame, on_repeat: str = "error", check: bool = True, max_tokens: int | None = None
) -> DataFrame:
    """One label per article: the true one where there is one, else that of its ticker's model.

    Models learn from the rows that are not held out. ``check`` raises where a ticker ends with
    another number of rows than it has articles, as one without labelled rows does.
    """
    rows = materialize(labelled_rows(train))
    guesses = predict(news, rows.filter("not held_out"), max_tokens)
    guessed = news.select(*[f.name for f in NEWS.fields]).join(
        guesses.select("ticker", "ord", decode_label(F.col("label")).alias("directional_sentiment_pred")), ["ticker", "ord"]
    )
    final = label_override(guessed, train, on_repeat)
    if check:
        final = materialize(final)
        require_same_counts(final, news)
    return final
