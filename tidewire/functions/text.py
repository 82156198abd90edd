"""String and date expressions, all built-in and so evaluated inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Field texts that a CSV reader takes for a missing value.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Day-first forms come before the ISO ones; an ISO date is never read day-first.
DATE_FORMATS = [
    "d/M/yyyy", "d/M/yyyy H:m", "d/M/yyyy H:m:s", "d-M-yyyy", "d-M-yyyy H:m", "d.M.yyyy",
    "yyyy-MM-dd", "yyyy-MM-dd H:m", "yyyy-MM-dd H:m:s", "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ssXXX",
    "d/M/yy", "d-M-yy", "d.M.yy", "yyyyMMdd", "yyyy/M/d",
    "d MMM yyyy", "d MMMM yyyy", "d-MMM-yyyy", "MMM d, yyyy", "MMMM d, yyyy", "MMM d yyyy", "MMMM d yyyy",
]
# ISO with a fraction of a second, an offset, or both, as a cast reads it: the day is that of the session's zone.
ISO_TIME = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}:\d{2})?$"

# White space as str.strip and re's \s see it: Unicode spaces and the four separators.
SPACE = "[\\s\\x1c-\\x1f]"


def null_tokens(c: Column) -> Column:
    return F.when(~c.isin(NA_TOKENS), c)


def strip_quotes(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit('"'), F.lit("")), F.lit("'"), F.lit(""))


def blank_to_null(c: Column) -> Column:
    return F.when(~c.rlike(f"(?U)^{SPACE}*$"), c)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"(?U)^{SPACE}+|{SPACE}+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, f"(?U){SPACE}+$", "")


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _shape(date_format: str) -> str:
    """Regular expression of the texts a date format can read, such as d/M/yyyy."""
    def piece(match: re.Match) -> str:
        token = match.group()
        if token[0] == "'":
            return re.escape(token[1:-1])
        if token[0] == "X":
            return "(Z|[+-]\\d{2}:\\d{2})"
        if token[0] == "M" and len(token) > 2:
            return "\\p{L}+"
        if token[0].isalpha():
            return "\\d{1,2}" if len(token) == 1 else f"\\d{{{len(token)}}}"
        return re.escape(token)

    return "^" + re.sub(r"'[^']*'|([a-zA-Z])\1*|.", piece, date_format) + "$"


def parse_date(c: Column, formats: list[str] | None = None) -> Column:
    """First format that fits, as a DATE; null when none does.

    A format is only tried on text of its shape, since a failed parse is slow.
    """
    tries = [
        F.when(c.rlike(_shape(f)), F.try_to_timestamp(c, F.lit(f))) for f in formats or DATE_FORMATS
    ]
    if formats is None:
        tries.append(F.when(c.rlike(ISO_TIME), c.try_cast("timestamp")))
    return F.coalesce(*tries).cast("date")


def iso_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def month_of(c: Column) -> Column:
    return F.trunc(c, "MM")


def week_of(c: Column) -> Column:
    """Monday of the week."""
    return F.date_trunc("week", c).cast("date")


def has_placeholder(c: Column) -> Column:
    return c.contains("#") & F.upper(c).contains("#NAME?")


def folded(c: Column) -> Column:
    """Text under which any two spellings that differ in case only are equal."""
    return F.upper(F.lower(F.replace(c, F.lit("İ"), F.lit("I"))))


def is_promotion(summary: Column) -> Column:
    """The promotion sentence names its site, so the two short patterns cover it. Word borders
    are slow to search for; a plain search decides whether to look."""
    text = folded(summary)
    likely = text.contains("ZACKS.COM") | text.contains("PROVEN")
    return likely & summary.rlike("(?iuU)\\bZacks\\.com\\b|\\bproven\\s+results\\b")


def comparison_text(headline: Column, summary: Column) -> Column:
    """Lower-cased text without one leading news tag, white space collapsed."""
    text = F.lower(F.concat(text_or_empty(headline), F.lit(" "), text_or_empty(summary)))
    text = F.regexp_replace(text, f"(?U)^(breaking|update|live|market alert):{SPACE}*", "")
    return strip(F.regexp_replace(text, f"(?U){SPACE}+", " "))


def joined_text(*parts: Column, null_text: str = "") -> Column:
    """Parts with one space between them; a missing part becomes ``null_text``."""
    filled = [F.coalesce(p.cast("string"), F.lit(null_text)) for p in parts]
    return F.concat_ws(" ", *filled)


def matches(text: Column, pattern: Column) -> Column:
    """Search with a pattern column. ``regexp_instr`` keeps the compiled pattern while it
    stays the same from row to row, which ``rlike`` does not."""
    return F.regexp_instr(text, pattern) > 0


def may_contain(folded_text: Column, folded_words: Column) -> Column:
    """Whether any word occurs, case aside; a quick test before a pattern search. Null words
    stand for a pattern that is not made of words."""
    found = F.exists(folded_words, lambda word: folded_text.contains(word))
    return folded_words.isNull() | found


def ticker_from_path(path: Column) -> Column:
    """``.../ABT_cleaned.csv`` -> ``ABT``."""
    return F.upper(F.regexp_extract(path, "([^/_]+)_[^/]*$", 1))
