"""Exact row numbers within a ticker without putting a ticker into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_BITS = 16


def with_row_number(
    df: DataFrame,
    out: str = "number",
    group: str = "ticker",
    by: str | None = "date",
    ord_col: str = "ord",
    block_bits: int = BLOCK_BITS,
) -> DataFrame:
    """Number the rows of each ``group`` 1..N in order of (``by``, ``ord_col``).

    ``ord_col`` is unique within a group, so a block of 2**``block_bits`` consecutive values holds
    at most that many rows, whatever the skew. Rows are numbered within (group, by, block); the
    block's offset comes from the block counts, which are tiny and combined map-side. A null group is a group of its
    own, and null values of ``by`` come first.
    """
    keys = [group] + ([by] if by else [])
    cell = [*keys, "_block"]
    blocked = df.withColumn("_block", F.shiftright(F.col(ord_col).cast("long"), block_bits))
    counts = blocked.groupBy(*cell).agg(F.count("*").alias("_n"))

    def before(partition: list[str], order: str):
        window = Window.partitionBy(*partition).orderBy(order)
        window = window.rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("_n").over(window), F.lit(0))

    offsets = counts.withColumn("_offset", before(keys, "_block"))
    # Structs of keys are joined, in which nulls are equal.
    if by:
        starts = counts.groupBy(*keys).agg(F.sum("_n").alias("_n"))
        starts = starts.select(F.struct(*keys).alias("_keys"), before([group], by).alias("_start"))
        offsets = offsets.withColumn("_keys", F.struct(*keys)).join(starts, "_keys")
    else:
        offsets = offsets.withColumn("_start", F.lit(0))
    offsets = offsets.select(F.struct(*cell).alias("_cell"), (F.col("_offset") + F.col("_start")).alias("_offset"))

    local = F.row_number().over(Window.partitionBy(*cell).orderBy(ord_col))
    return (
        blocked.withColumn("_cell", F.struct(*cell)).join(offsets, "_cell")
        .withColumn(out, (local + F.col("_offset")).cast("long"))
        .drop("_block", "_offset", "_cell")
    )


def with_chunks(df: DataFrame, size: int = 100, number: str = "number") -> DataFrame:
    """Chunk number of an already numbered table; the last chunk may be short."""
    return df.withColumn("chunk", (F.floor((F.col(number) - 1) / size) + 1).cast("int"))
