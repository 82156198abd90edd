import json

import pytest
from pyspark.sql import functions as F

from tidewire.operators import relevance
from tidewire.schemas import RULES


@pytest.fixture(scope="module")
def rules(spark):
    return spark.createDataFrame(
        [
            ("T", ["acme corp", "acm.un"], ["widget+"], ["m&a", "Dividend"], ["rates", "ai"], ["top picks"]),
            ("E", [], [], [], [], []),
            ("N", ["straße"], None, ["umsatz"], ["öl"], ["x\\Ey"]),
        ],
        RULES,
    )


def scored(articles, rules, rows):
    df = articles([(t, i, "2024-01-01", h, s, b) for i, (t, h, s, b) in enumerate(rows)])
    out = relevance.relevance_text(relevance.relevance_scores(df, rules))
    return [r.asDict() for r in out.orderBy("ticker", "ord").collect()]


@pytest.mark.parametrize(
    "headline,summary,category,score",
    [
        ("Acme Corp dividend up", "FDA approval", "Directly Related", "0.92"),
        ("Acme Corp dividend up", "spin off", "Directly Related", "0.92"),
        ("ACM.UN WIDGET+", "Price Target raised", "Directly Related", "0.86"),
        ("acme corp m&a", "nothing else", "Directly Related", "0.75"),
        ("acme corp m&a", "ceos meet", "Directly Related", "0.75"),
        ("acme corp", "plain", "Indirectly Related", "0.48"),
        ("acme corp", "one of our top picks", "Indirectly Related", "0.34"),
        ("acme corporation", "he said so", "Indirectly Related", "0.44"),
        ("higher rates", "Top Picks", "Indirectly Related", "0.36"),
        ("sunny", "day", "Unrelated", "0.12"),
        ("sunny", "top picks", "Unrelated", "0.06"),
        ("acmXun m&a", "dividend", "Unrelated", "0.12"),
    ],
)
def test_decision_table(articles, rules, headline, summary, category, score):
    row = scored(articles, rules, [("T", headline, "src", summary)])[0]
    assert (row["category"], row["relevance_score"]) == (category, score)
    assert "acme corp" in row["rationale"]


def test_empty_lists_match_any_text(articles, rules):
    row = scored(articles, rules, [("E", "something", "s", "b")])[0]
    assert (row["category"], row["relevance_score"]) == ("Indirectly Related", "0.36")
    assert "the target stock" in row["rationale"]


def test_non_ascii_and_quoting(articles, rules):
    rows = scored(
        articles, rules,
        [("N", "STRAßE umsatz", "s", "b"), ("N", "Straßen", "s", "ÖL"), ("N", "n", "s", "x\\ey")],
    )
    assert [r["relevance_score"] for r in rows] == ["0.75", "0.44", "0.06"]


def test_evidence(articles, rules):
    long = "z" * 100 + " acme corp dividend " + "y" * 100
    emoji = "😀" * 50 + " m&a acme corp " + "😀" * 50
    rows = scored(
        articles, rules,
        [
            ("T", "acme corp \"a quoted passage\" dividend", "s", "say 'another passage' m&a"),
            ("T", long, "s", "no match"),
            ("T", emoji, "s", ""),
            ("T", "   ", "s", "  fallback text "),
            ("T", "line one\nline two", "s", "x" * 300),
            ("T", "acme corp", "s", "tail acme corp"),
        ],
    )
    spans = [json.loads(r["evidence_spans"]) for r in rows]
    # Only a span in double quotes at both ends is unwrapped; contexts double inner quotes.
    assert spans[0][0] == "a quoted passage" and spans[0][1] == "'another passage'"
    assert spans[0][2].startswith('acme corp ""a quoted passage"" dividend')
    at = long.index("dividend")
    assert spans[1] == [long[at - 40:at + len("dividend") + 40].strip()]
    at = emoji.index("m&a")
    assert spans[2] == [emoji[at - 40:at + 3 + 40].strip()]
    assert spans[3] == [""]          # the blank line matches, and is empty once trimmed
    assert spans[4] == ["line one\nline two"[:8 + 40]]
    assert spans[5] == ["acme corp", "tail acme corp"]
    assert rows[5]["evidence_spans"] == '["acme corp", "tail acme corp"]'


def test_long_span_is_cut(articles, spark):
    word = "k" * 150
    rules = spark.createDataFrame([("T", ["acme"], [], [word], ["i"], ["l"])], RULES)
    text = "acme " + "a" * 60 + " " + word + " " + "b" * 60
    span = json.loads(scored(articles, rules, [("T", text, "s", "q")])[0]["evidence_spans"])[0]
    assert len(span) == 161 and span.endswith("…")


def test_articles_without_rules(articles, rules):
    with pytest.raises(ValueError, match="no rules for .*Q"):
        scored(articles, rules, [("Q", "h", "s", "b")])
    df = articles([("Q", 0, "2024-01-01", "h", "s", "b"), ("E", 0, "2024-01-01", "h", "s", "b")])
    assert [tuple(r) for r in relevance.rules_missing(df, rules).collect()] == [("Q", 1)]
    assert relevance.relevance_scores(df, rules, on_missing="skip").count() == 1


def test_two_rows_of_rules_raise(articles, rules):
    df = articles([("E", 0, "2024-01-01", "h", "s", "b")])
    with pytest.raises(ValueError, match="more than one row of rules"):
        relevance.relevance_scores(df, rules.unionByName(rules))


def test_patterns_are_one_row_per_ticker(rules):
    row = relevance.rule_patterns(rules).filter(F.col("ticker") == "E").first()
    assert (row.target_re, row.direct_re, row.direct_words) == ("(?!)", ".", None)
