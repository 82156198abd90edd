"""Small helpers that the training-data operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.session import checkpoint_dir, materialize

__all__ = ["bucket_of", "is_train", "materialize", "read", "spans_text", "stored", "unique_name"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stored(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back.

    Smaller than a checkpoint for texts, and it cuts the lineage in the same way.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unique_name(df: DataFrame, name: str) -> str:
    """``name``, or ``name`` with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def bucket_of(key: str | Column, n: int) -> Column:
    """crc32 of the key written as text, modulo ``n``: the folds of the held-out rows."""
    return F.pmod(F.crc32(F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(""))), F.lit(n))


def is_train(key: str, n: int, held_out: int) -> Column:
    return bucket_of(key, n) != held_out


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined, in the order given."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
