"""Rule-based relevance of an article to the ticker it is filed under.

Each ticker has one row of word lists. The lists are turned into patterns once per ticker, the
patterns are joined to the articles, and category, score, rationale and evidence are plain
column expressions. Keep article files partitioned by ticker: the compiled pattern is then
reused from row to row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import text as X
from tidewire.functions.columns import computed_once
from tidewire.functions.numbers import clamp, half_even
from tidewire.functions.word_trees import word_tree
from tidewire.operators.lookup import lookup_join
from tidewire.schemas import RULES, require_columns

# The two catalyst tiers, whole words, any case.
HIGH_TIER = "(?iuU)\\b(FDA|approval|recall|verdict|acquisition|merger|spin[- ]?off|CEO|CFO)\\b"
MID_TIER = "(?iuU)\\b(earnings|EPS|guidance|price target|upgrade|downgrade)\\b"
# Quoted text of 10 to 180 characters, quotes included.
QUOTED = "[\"'][^\"']{10,180}[\"']"
MAX_SPANS = 3
CONTEXT = 40
MAX_SPAN = 160

DIRECT, INDIRECT, UNRELATED = "Directly Related", "Indirectly Related", "Unrelated"
# Score band of each category.
BANDS = {DIRECT: (0.70, 1.00), INDIRECT: (0.30, 0.69), UNRELATED: (0.00, 0.29)}

# Score of each case; a pair holds (plain, with a low-signal phrase).
SCORE_HIGH_TIER, SCORE_MID_TIER, SCORE_DIRECT = 0.92, 0.86, 0.75
SCORE_TARGET, SCORE_SECTOR, SCORE_NONE = (0.48, 0.34), (0.44, 0.36), (0.12, 0.06)
# Rationale texts; %s stands for the target.
RATIONALE = {
    DIRECT: "Article contains company-specific, near-term catalyst "
            "(earnings/regulatory/transaction) likely to move %s next week.",
    INDIRECT: "Mentions %s or sector/peer factors with plausible but weaker near-term impact on "
              "%s.",
    UNRELATED: "General market or unrelated content with no expected near-term effect on %s.",
}

NO_LIST = "."        # pattern of an empty list: any character of a line
NEVER = "(?!)"
QUICK_WORDS = 24     # lists up to here are searched plainly before their pattern is tried


def rule_patterns(rules: DataFrame) -> DataFrame:
    """One row of regular expressions per ticker."""
    require_columns(rules, [f.name for f in RULES.fields], "ticker rules")
    words = {
        f.name: F.coalesce(F.col(f.name), F.array().cast("array<string>")) for f in RULES.fields[1:]
    }
    direct = F.concat(words["direct_keywords"], words["products"])

    def listed(array: Column) -> Column:
        found = F.concat(F.lit("(?iu)"), word_tree(array))
        return F.when(F.size(array) > 0, found).otherwise(F.lit(NO_LIST))

    def quick(array: Column) -> Column:
        """Words for a plain search beforehand, which pays for short lists only."""
        short = (F.size(array) > 0) & (F.size(array) <= QUICK_WORDS)
        return F.when(short, F.array_distinct(F.transform(array, X.folded)))

    aliases = words["aliases"]
    whole_word = F.concat(F.lit("(?iuU)\\b(?:"), word_tree(aliases, first_wins=False), F.lit(")\\b"))
    return rules.select(
        "ticker",
        F.coalesce(F.try_element_at(aliases, F.lit(1)), F.lit("the target stock")).alias("target"),
        F.when(F.size(aliases) > 0, whole_word).otherwise(F.lit(NEVER)).alias("target_re"),
        listed(aliases).alias("alias_re"),
        listed(direct).alias("direct_re"),
        listed(words["indirect_keywords"]).alias("indirect_re"),
        listed(words["low_signal_phrases"]).alias("low_re"),
        quick(aliases).alias("target_words"),
        quick(direct).alias("direct_words"),
        quick(words["indirect_keywords"]).alias("indirect_words"),
        quick(words["low_signal_phrases"]).alias("low_words"),
    )


def rules_missing(articles: DataFrame, rules: DataFrame) -> DataFrame:
    """(ticker, num_rows) of the articles whose ticker has no rules."""
    counts = articles.groupBy("ticker").agg(F.count("*").alias("num_rows"))
    return counts.join(rules.select("ticker").distinct(), "ticker", "left_anti")


def require_rules(articles: DataFrame, rules: DataFrame, on_missing: str) -> None:
    """Raise for a ticker with two rows of rules, and with ``'error'`` for one without any."""
    repeated = rules.groupBy("ticker").count().filter("count > 1").orderBy("ticker").limit(5).collect()
    if repeated:
        raise ValueError(f"more than one row of rules for {[r['ticker'] for r in repeated]}")
    if on_missing == "error":
        absent = rules_missing(articles, rules).orderBy("ticker").limit(5).collect()
        if absent:
            raise ValueError(f"no rules for {[r['ticker'] for r in absent]}")


def _with_branch(articles: DataFrame, rules: DataFrame) -> DataFrame:
    """Articles of tickers that have rules, with their patterns and decision inputs."""
    patterned = lookup_join(
        articles, rule_patterns(rules), ["ticker"], "inner", salt_by=["ticker", "ord"]
    )
    text = X.joined_text(F.col("headline"), F.col("source"), F.col("summary"))
    either = {
        kind: F.when(F.col("_target"), F.col(f"direct_{kind}")).otherwise(F.col(f"indirect_{kind}"))
        for kind in ("re", "words")
    }
    return (
        patterned.withColumn("_text", text)
        .withColumn("_folded", X.folded(F.col("_text")))
        .withColumn("_target", _found(F.col("target_re"), F.col("target_words")))
        .withColumn("_hit", _found(either["re"], either["words"]))
    )


def _found(pattern: Column, words: Column) -> Column:
    return X.may_contain(F.col("_folded"), words) & X.matches(F.col("_text"), pattern)


def _score() -> Column:
    text = F.col("_text")
    low = _found(F.col("low_re"), F.col("low_words"))
    catalyst = (
        F.when(text.rlike(HIGH_TIER), SCORE_HIGH_TIER)
        .when(text.rlike(MID_TIER), SCORE_MID_TIER)
        .otherwise(SCORE_DIRECT)
    )

    def by_signal(scores: tuple[float, float]) -> Column:
        plain, weak = scores
        return F.when(low, weak).otherwise(plain)

    return (
        F.when(F.col("_target") & F.col("_hit"), catalyst)
        .when(F.col("_target"), by_signal(SCORE_TARGET))
        .when(F.col("_hit"), by_signal(SCORE_SECTOR))
        .otherwise(by_signal(SCORE_NONE))
    )


def _category() -> Column:
    return (
        F.when(F.col("_target") & F.col("_hit"), DIRECT)
        .when(F.col("_target") | F.col("_hit"), INDIRECT)
        .otherwise(UNRELATED)
    )


def _in_band(category: Column, score: Column) -> Column:
    banded = F.lit(None).cast("double")
    for name, (low, high) in BANDS.items():
        banded = F.when(category == name, clamp(score, low, high)).otherwise(banded)
    return half_even(banded, 2)


def _rationale(category: Column) -> Column:
    texts = F.lit(None).cast("string")
    for name, text in RATIONALE.items():
        filled = F.replace(F.lit(text), F.lit("%s"), F.col("target"))
        texts = F.when(category == name, filled).otherwise(texts)
    return texts


def _shortened(span: Column) -> Column:
    """At most 160 characters, an ellipsis when cut, inner double quotes doubled."""
    cut = F.concat(X.rstrip(F.substring(span, 1, MAX_SPAN)), F.lit("…"))
    fitted = F.when(F.length(span) > MAX_SPAN, cut).otherwise(span)
    return F.replace(fitted, F.lit('"'), F.lit('""'))


def _context(field: Column, pattern: Column, match: Column) -> Column:
    """The first match with 40 characters around it; null when there is none.

    ``match`` is the matched text. It cannot occur before the first match, since the pattern would
    have matched there, so a plain search finds its place, counted in characters.
    """
    start = F.instr(field, match) - 1
    left = F.greatest(start - CONTEXT, F.lit(0))
    window = F.substring(field, left + 1, start + F.length(match) + CONTEXT - left)
    found = (field != "") & ((match != "") | X.matches(field, pattern))
    return F.when(found, _shortened(X.strip(window)))


def _fallback(field: Column) -> Column:
    stripped = X.strip(field)
    return F.when(stripped != "", _shortened(stripped))


def _with_evidence(branched: DataFrame) -> DataFrame:
    """Add ``evidence``: quoted passages, then the surroundings of a match, else the text itself."""
    pattern = (
        F.when(F.col("_target") & F.col("_hit"), F.col("direct_re"))
        .when(F.col("_target"), F.col("alias_re"))
        .when(F.col("_hit"), F.col("indirect_re"))
        .otherwise(F.lit(".+"))
    )
    fields = {f"_{c}": X.text_or_empty(F.col(c)) for c in ("headline", "summary")}
    located = computed_once(branched, branched.columns, {**fields, "_re": pattern})
    first = {
        f"{name}_match": F.call_function("regexp_extract", F.col(name), F.col("_re"), F.lit(0))
        for name in fields
    }
    located = computed_once(located, located.columns, first)

    headline, summary, found = F.col("_headline"), F.col("_summary"), F.col("_re")
    quoted = F.concat(
        F.regexp_extract_all(headline, F.lit(QUOTED), F.lit(0)),
        F.regexp_extract_all(summary, F.lit(QUOTED), F.lit(0)),
    )
    unwrapped = F.transform(
        quoted,
        lambda s: F.when(
            s.startswith('"') & s.endswith('"'), F.substring(s, F.lit(2), F.length(s) - 2)
        ).otherwise(s),
    )
    related = F.col("_target") | F.col("_hit")
    around = F.array(
        _context(headline, found, F.col("_headline_match")),
        F.when(related, _context(summary, found, F.col("_summary_match"))),
    )
    spans = F.slice(F.concat(unwrapped, F.array_compact(around)), 1, MAX_SPANS)
    listed = computed_once(located, located.columns, {"_spans": spans})
    fallback = F.array_compact(F.array(F.coalesce(_fallback(headline), _fallback(summary))))
    evidence = F.when(F.size("_spans") > 0, F.col("_spans")).otherwise(fallback)
    return listed.withColumn("evidence", evidence)


def relevance_scores(
    articles: DataFrame, rules: DataFrame, evidence: bool = True, on_missing: str = "error"
) -> DataFrame:
    """date, score, category, rationale and (optionally) evidence spans per article.

    A ticker without rules raises; ``on_missing='skip'`` leaves its articles out, and
    ``rules_missing`` lists what was left out.
    """
    require_rules(articles, rules, on_missing)
    scored = _with_branch(articles, rules).withColumn("category", _category())
    columns = [
        F.col("ticker"),
        F.col("ord"),
        F.col("date"),
        _in_band(F.col("category"), _score()).alias("relevance_score"),
        F.col("category"),
        _rationale(F.col("category")).alias("rationale"),
    ]
    if evidence:
        return _with_evidence(scored).select(*columns, "evidence")
    return scored.select(*columns)


def evidence_text(evidence: Column) -> Column:
    """The spans as a JSON array with a space after each comma."""
    item = F.transform(evidence, lambda s: F.to_json(F.array(s)))
    bare = F.transform(item, lambda s: F.substring(s, F.lit(2), F.length(s) - 2))
    return F.concat(F.lit("["), F.array_join(bare, ", "), F.lit("]"))


def relevance_text(scored: DataFrame) -> DataFrame:
    """The text form written to files: two decimals and JSON evidence."""
    return scored.select(
        "ticker",
        "ord",
        X.iso_text(F.col("date")).alias("date"),
        F.format_string("%.2f", F.col("relevance_score")).alias("relevance_score"),
        "category",
        "rationale",
        evidence_text(F.col("evidence")).alias("evidence_spans"),
    )
