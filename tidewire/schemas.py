"""Explicit schemas of what is read. ``ord`` is the row's place within its ticker's input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


_S, _I, _L, _D, _DATE = (
    T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.DateType(),
)
_WORDS = T.ArrayType(_S)

RAW_NEWS = _table(ticker=_S, ord=_L, date=_S, headline=_S, source=_S, summary=_S)
NEWS = _table(ticker=_S, ord=_L, date=_DATE, headline=_S, source=_S, summary=_S)
RULES = _table(
    ticker=_S, aliases=_WORDS, products=_WORDS, direct_keywords=_WORDS,
    indirect_keywords=_WORDS, low_signal_phrases=_WORDS,
)
RULE_FILE = T.StructType(RULES.fields[1:])
LABEL_FILE = _table(idx=_I, label=_I)
TRAIN = T.StructType(NEWS.fields + [T.StructField("directional_sentiment", _I, True)])
PRICES = _table(date=_DATE, symbol=_S, adj_close=_D)

ARTICLE_COLUMNS = ["date", "headline", "source", "summary"]


def require_columns(df: DataFrame, columns: list[str], where: str = "input") -> DataFrame:
    """Raise if a needed column is absent. Looks at the schema only; no job runs."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{where} has no columns {missing}")
    return df
