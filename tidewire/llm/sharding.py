"""Shards by jump consistent hashing: no ring table, and a new shard only takes rows.

Each key walks a seeded sequence of jumps over ever larger shard numbers and stops before it
passes the last one. Adding shard ``n`` changes the walk only of keys whose next jump lands on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.common import read, unique_name

# Fixed values of the published generator: a 64-bit linear congruential step, of which the
# high 31 bits are used.
MULTIPLIER = 2862933555777941757
HIGH = 33
ROWS_PER_BLOCK = 50_000     # rows that are numbered together
OVERHEAD = 16               # bytes that a row counts besides its text


def _step(hi: Column, lo: Column) -> tuple[Column, Column]:
    """The generator's next state, in two halves of 32 bits so that no product overflows."""
    m_hi, m_lo = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF
    mask = F.lit(0xFFFFFFFF)

    def times(x: Column, m: int) -> Column:
        """x * m modulo 2**32."""
        upper = (x * F.lit(m >> 16)).bitwiseAND(0xFFFF)
        return (F.shiftleft(upper, 16) + x * F.lit(m & 0xFFFF)).bitwiseAND(mask)

    low_part = lo * F.lit(m_lo & 0xFFFF) + 1
    high_part = lo * F.lit(m_lo >> 16)
    low = low_part + F.shiftleft(high_part.bitwiseAND(0xFFFF), 16)
    carry = F.shiftrightunsigned(low, 32) + F.shiftrightunsigned(high_part, 16)
    return (carry + times(lo, m_hi) + times(hi, m_lo)).bitwiseAND(mask), low.bitwiseAND(mask)


def jump_hash(key: Column, shards: int) -> Column:
    """Shard 0 to ``shards`` - 1 of a 64-bit key. A null key counts as 0."""
    if shards < 1:
        raise ValueError("a table has at least one shard")
    key = F.coalesce(key.cast("long"), F.lit(0))
    start = F.struct(
        F.lit(0).cast("long").alias("at"),
        F.lit(0).cast("long").alias("next"),
        F.shiftrightunsigned(key, 32).alias("hi"),
        key.bitwiseAND(0xFFFFFFFF).alias("lo"),
    )

    def jump(state: Column, _: Column) -> Column:
        hi, lo = _step(state["hi"], state["lo"])
        draw = F.shiftrightunsigned(hi, HIGH - 32) + 1
        target = F.floor((state["next"] + 1) * (F.lit(float(1 << 31)) / draw)).cast("long")
        moved = F.struct(
            state["next"].alias("at"), target.alias("next"), hi.alias("hi"), lo.alias("lo")
        )
        return F.when(state["next"] < shards, moved).otherwise(state)

    # every jump goes up by one at least, so ``shards`` jumps are enough
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, jump)
    return walk["at"].cast("int")


def text_size(text: str = "text") -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD


def with_slots(
    df: DataFrame,
    shard: str = "shard",
    order: list[str] | None = None,
    out: str = "slot",
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Number the rows of each shard 0, 1, 2, ... without putting a shard into one task.

    Rows fall into blocks by the hash of ``order``; a block is numbered on its own and starts where
    the blocks before it end. ``order`` defaults to all columns. Equal rows are numbered in any
    order. An empty table stays empty.
    """
    order = order or df.columns
    block, count, base = (unique_name(df, n) for n in ("_block", "_count", "_base"))
    shards = df.agg(F.count("*").alias("n"), F.approx_count_distinct(shard).alias("s")).first()
    blocks = max(1, -(-shards["n"] // (rows_per_block * max(1, shards["s"]))))
    dealt = df.withColumn(block, F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int"))
    counts = dealt.groupBy(shard, block).agg(F.count("*").alias(count))
    before = Window.partitionBy(shard).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(shard, block, F.coalesce(F.sum(count).over(before), F.lit(0)).alias(base))
    number = F.row_number().over(Window.partitionBy(shard, block).orderBy(*order))
    return (
        dealt.withColumn(out, number.cast("long") - 1)
        .join(offsets, [shard, block])
        .withColumn(out, F.col(out) + F.col(base))
        .drop(block, base)
    )


def shard_documents(
    docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``docs`` with size, text_crc32, law, shard and grown_shard added; a row-local decision.

    ``key`` and ``shards`` alone decide (law ``key``). With one more shard a row keeps its shard or
    moves to the new one, ``grown_shard``. Sizes are UTF-8 bytes plus 16; a null text has no bytes
    and the checksum of the empty text; a null key counts as 0. Equal keys share a shard. Input
    columns of these names are replaced.
    """
    clean = docs.drop("size", "text_crc32", "law", "shard", "grown_shard")
    return clean.withColumns(
        {
            "size": text_size(text),
            "text_crc32": F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")),
            "law": F.lit("key"),
            "shard": jump_hash(F.col(key), shards),
            "grown_shard": jump_hash(F.col(key), shards + 1),
        }
    )


def shard_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage of the pipeline: every document with its shard."""
    return shard_documents(docs, 40)


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    placed = shard_documents(docs).drop("text")
    names = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    return with_slots(placed, "shard", ["doc_id", "text_crc32", "size"]).select(*names)
