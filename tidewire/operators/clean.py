"""Cleaning: one pass of row rules, then keep-first by headline and by summary.

Nothing is dropped silently. Every row gets a ``reject_reason`` (null when kept), in the order
the rules apply: bad_date, missing, placeholder, promotion, duplicate_headline,
duplicate_summary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidewire.functions import text as X
from tidewire.functions.columns import computed_once
from tidewire.operators.lookup import lookup_join
from tidewire.schemas import ARTICLE_COLUMNS, require_columns
from tidewire.session import materialize

NEWS_COLUMNS = ["ticker", "ord", *ARTICLE_COLUMNS]


def normalize_columns(df: DataFrame) -> DataFrame:
    """Trimmed lower-case names; ``title`` is a headline, ``datetime`` a date if there is none."""
    df = df.toDF(*[c.strip().lower() for c in df.columns])
    if "title" in df.columns and "headline" not in df.columns:
        df = df.withColumnRenamed("title", "headline")
    if "datetime" in df.columns and "date" not in df.columns:
        df = df.withColumnRenamed("datetime", "date")
    return df


def _typed(raw: DataFrame, date_formats: list[str] | None = None) -> DataFrame:
    """Rows without quotes and null tokens; ``raw_date`` keeps the text a date was read from."""
    raw = require_columns(normalize_columns(raw), NEWS_COLUMNS, "raw news")
    bare = computed_once(
        raw, ["ticker", "ord"], {c: X.strip_quotes(F.col(c)) for c in ARTICLE_COLUMNS}
    )
    date = X.null_tokens(F.col("date"))
    return computed_once(
        bare,
        ["ticker", "ord"],
        {
            "raw_date": date,
            "date": X.parse_date(date, date_formats),
            "headline": X.blank_to_null(X.null_tokens(F.col("headline"))),
            "source": X.null_tokens(F.col("source")),
            "summary": X.blank_to_null(X.null_tokens(F.col("summary"))),
        },
    )


def apply_row_rules(raw: DataFrame, date_formats: list[str] | None = None) -> DataFrame:
    """Typed rows with the reason of the first row rule they break."""
    typed = _typed(raw, date_formats)
    headline, summary = F.col("headline"), F.col("summary")
    reason = (
        F.when(F.col("date").isNull(), "bad_date")
        .when(headline.isNull() | summary.isNull(), "missing")
        .when(X.has_placeholder(headline) | X.has_placeholder(summary), "placeholder")
        .when(X.is_promotion(summary), "promotion")
    )
    return computed_once(typed, typed.columns, {"reject_reason": reason})


def _digest(name: str) -> Column:
    return F.unhex(F.sha2(name, 256)).alias(f"_{name}")


def verdicts(
    raw: DataFrame, date_formats: list[str] | None = None, integrity: ObservedIntegrity | None = None
) -> DataFrame:
    """(ticker, ord, reject_reason) of every row, stored; the reason is null for kept rows.

    The row rules look at the texts once, and what is stored of them is digests. First rows are a
    ``min`` that hash-aggregates and combines on the map side, so a text that fills a third of the
    table shuffles as a few rows.
    """
    ruled = apply_row_rules(raw, date_formats)
    marks = materialize(ruled.select("ticker", "ord", "reject_reason", _digest("headline"), _digest("summary")))
    key = ["ticker", "ord"]
    sound = marks.filter(F.col("reject_reason").isNull())
    by_headline = sound.groupBy("ticker", "_headline").agg(F.min("ord").alias("ord"))
    firsts = sound.join(by_headline, [*key, "_headline"], "left_semi")
    by_summary = firsts.groupBy("ticker", "_summary").agg(F.min("ord").alias("ord"))
    passed = (
        by_headline.select(*key, F.lit(1).alias("_pass"))
        .unionByName(by_summary.select(*key, F.lit(2).alias("_pass")))
        .groupBy(*key)
        .agg(F.max("_pass").alias("_pass"))
    )
    reason = (
        F.when(F.col("reject_reason").isNotNull(), F.col("reject_reason"))
        .when(F.col("_pass").isNull(), "duplicate_headline")
        .when(F.col("_pass") == 1, "duplicate_summary")
    )
    judged = marks.select(*key, "reject_reason").join(passed, key, "left")
    judged = judged.select(*key, reason.alias("reject_reason"))
    return materialize(integrity.expect(judged) if integrity else judged)


def clean_news(
    raw: DataFrame, date_formats: list[str] | None = None, integrity: ObservedIntegrity | None = None
) -> DataFrame:
    """The kept rows. Only the keys of dropped rows meet the texts again, and no rule is asked twice.

    ``integrity`` watches the rows and is to be checked once they have been written.
    """
    dropped = verdicts(raw, date_formats, integrity).filter(F.col("reject_reason").isNotNull()).select("ticker", "ord")
    fields = _typed(raw, date_formats).select(*NEWS_COLUMNS)
    kept = lookup_join(fields, dropped, ["ticker", "ord"], "left_anti")
    return integrity.watch(kept) if integrity else kept


def mark_rejects(raw: DataFrame, date_formats: list[str] | None = None) -> DataFrame:
    """Every input row with its ``reject_reason``. The joins are on (ticker, ord), which is unique."""
    return _typed(raw, date_formats).join(verdicts(raw, date_formats), ["ticker", "ord"], "left")


def rejected_news(raw: DataFrame, date_formats: list[str] | None = None) -> DataFrame:
    """The removed rows with their reason."""
    return mark_rejects(raw, date_formats).filter(F.col("reject_reason").isNotNull())


def stage_counts(marked: DataFrame) -> DataFrame:
    """Rows per ticker and outcome; kept rows count as ``kept``."""
    outcome = F.coalesce("reject_reason", F.lit("kept")).alias("outcome")
    return marked.groupBy("ticker", outcome).agg(F.count("*").alias("num_rows"))


def integrity_report(df: DataFrame) -> DataFrame:
    """Violations per ticker of the rules a cleaned table must satisfy.

    Repeats are counted over (ticker, field, digest) with map-side combining, so neither a hot
    ticker nor a hot text ends up in one task.
    """
    require_columns(df, NEWS_COLUMNS, "clean news")

    def bad(condition):
        return F.count_if(F.coalesce(condition, F.lit(False)))

    headline, summary = F.col("headline"), F.col("summary")
    simple = df.groupBy("ticker").agg(
        F.count("*").alias("num_rows"),
        bad(F.col("date").isNull()).alias("null_date"),
        bad(headline.isNull()).alias("null_headline"),
        bad(summary.isNull()).alias("null_summary"),
        bad(X.has_placeholder(headline) | X.has_placeholder(summary)).alias("placeholder"),
    )
    fields = F.array(
        *[
            F.struct(F.lit(name).alias("field"), F.unhex(F.sha2(name, 256)).alias("digest"))
            for name in ("headline", "summary")
        ]
    )
    groups = (
        df.select("ticker", F.explode(fields).alias("f"))
        .groupBy("ticker", "f.field", "f.digest")
        .agg((F.count("*") - 1).alias("extra"))
    )
    repeats = groups.groupBy("ticker").agg(
        F.sum(F.when(F.col("field") == "headline", F.col("extra")).otherwise(0)).alias(
            "duplicate_headline"
        ),
        F.sum(F.when(F.col("field") == "summary", F.col("extra")).otherwise(0)).alias(
            "duplicate_summary"
        ),
    )
    return simple.join(repeats, "ticker")


class ObservedIntegrity:
    """The integrity rules as metrics of a job that runs anyway, such as the write of the cleaned table.

    ``watch`` is put around the rows that are written and ``expect`` around the verdicts they come from. Each text
    passes the verdicts once, so there are repeats exactly if more rows come out than verdicts let pass, which
    takes a (ticker, ord) that isn't unique.
    """

    def __init__(self) -> None:
        self.written, self.passed = Observation(), Observation()

    def expect(self, judged: DataFrame) -> DataFrame:
        return judged.observe(self.passed, F.count_if(F.col("reject_reason").isNull()).alias("rows"))

    def watch(self, df: DataFrame) -> DataFrame:
        headline, summary = F.col("headline"), F.col("summary")

        def bad(condition: Column) -> Column:
            return F.count_if(F.coalesce(condition, F.lit(False)))

        return require_columns(df, NEWS_COLUMNS, "clean news").observe(
            self.written,
            F.count(F.lit(1)).alias("rows"),
            bad(F.col("date").isNull()).alias("null_date"),
            bad(headline.isNull()).alias("null_headline"),
            bad(summary.isNull()).alias("null_summary"),
            bad(X.has_placeholder(headline) | X.has_placeholder(summary)).alias("placeholder"),
        )

    def check(self) -> dict[str, int]:
        """The metrics once the jobs are done; raises if a rule is broken."""
        metrics = {k: v or 0 for k, v in self.written.get.items()}
        broken = {k: v for k, v in metrics.items() if v and k != "rows"}
        extra = metrics["rows"] - (self.passed.get["rows"] or 0)
        if extra:
            broken["repeated_rows"] = extra
        if broken:
            raise ValueError(f"Integrity violations: {broken}")
        return metrics


def assert_integrity(df: DataFrame) -> DataFrame:
    """Raise if any ticker breaks a rule; otherwise hand the table on."""
    report = integrity_report(df)
    checks = [c for c in report.columns if c not in ("ticker", "num_rows")]
    totals = report.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in checks]).first()
    broken = {c: totals[c] for c in checks if totals[c]}
    if broken:
        raise ValueError(f"Integrity violations: {broken}")
    return df
