"""Joining a large table with one that has a single row per key.

The key of the large table may be badly skewed (one ticker or one source may hold a third of
all rows), so the lookup side is broadcast when it is measured to be small, and otherwise the
hot keys are spread over many salts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 << 20
HOT_SHARE = 1000     # a key with more than 1/HOT_SHARE of all rows is hot: fewer than 1000 exist
HOT_SALTS = 1024


def measured_bytes(df: DataFrame) -> int:
    """Size of the rows as text plus a row overhead: one pass over a narrow result."""
    width = F.octet_length(F.to_json(F.struct(*[F.col(c) for c in df.columns])))
    return df.agg(F.coalesce(F.sum(width + 64), F.lit(0)).alias("n")).first()["n"]


def lookup_join(
    big: DataFrame,
    table: DataFrame,
    on: list[str],
    how: str = "left",
    broadcast_bytes: int = BROADCAST_BYTES,
    salt_by: list[str] | None = None,
    rows_per_key: str | None = None,
) -> DataFrame:
    """Join ``big`` with ``table``, whose rows are unique in ``on``.

    ``table`` should be cheap to read twice (a stored or materialized table). ``salt_by`` names the
    columns that tell the rows of a key apart, ``rows_per_key`` a column of ``table`` that says how
    many rows of ``big`` a key has, where that is known.
    """
    if measured_bytes(table) <= broadcast_bytes:
        return big.join(F.broadcast(table), on, how)
    return salted_join(big, table, on, how, salt_by, rows_per_key)


def salted_join(
    big: DataFrame,
    table: DataFrame,
    on: list[str],
    how: str = "left",
    salt_by: list[str] | None = None,
    rows_per_key: str | None = None,
    hot_share: int = HOT_SHARE,
    salts: int = HOT_SALTS,
) -> DataFrame:
    """Shuffle join in which the hot keys of ``big`` are spread over ``salts`` sub-keys.

    The hot keys are found by a map-side combined count, or read from ``rows_per_key``. At most ``hot_share`` keys can each hold
    more than 1/``hot_share`` of the rows, so the hot list has a proven bound; it is the only
    thing broadcast, and only its rows of ``table`` are repeated.
    """
    if rows_per_key:
        counts = table.select(*on, F.col(rows_per_key).alias("_n"))
        total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).first()["n"]
    else:
        counts = big.groupBy(*on).agg(F.count("*").alias("_n"))
        total = big.count()
    hot_rows = counts.filter(F.col("_n") > total / hot_share).select(*on).limit(hot_share).collect()
    if not hot_rows:
        return big.join(table, on, how)
    schema = counts.select(*on).schema
    hot = F.broadcast(
        big.sparkSession.createDataFrame(hot_rows, schema).withColumn("_hot", F.lit(True))
    )
    spread = F.pmod(F.xxhash64(*(salt_by or big.columns)), F.lit(salts)).cast("int")
    no_key = F.lit(False)
    for key in on:
        no_key = no_key | F.col(key).isNull()    # these rows match nothing; keep them apart too
    tagged = (
        big.join(hot, on, "left")
        .withColumn("_salt", F.when(F.col("_hot") | no_key, spread).otherwise(F.lit(0)))
        .drop("_hot")
    )
    all_salts = F.sequence(F.lit(0), F.lit(salts - 1))
    repeated = (
        table.join(hot, on, "left")
        .withColumn("_salt", F.explode(F.when(F.col("_hot"), all_salts).otherwise(F.array(F.lit(0)))))
        .drop("_hot")
    )
    return tagged.join(repeated, [*on, "_salt"], how).drop("_salt")
