"""Sinks into plain folders. A failed write leaves the old table as it was.

Tables with a ticker column are partitioned by it, and dynamic partition overwrite replaces the
tickers present in the data once the job has succeeded. Any other table is written into a new
folder beside the old one, which takes its place by two renames; a driver that dies between them leaves the
old table under its hidden name. ``versions.write_versioned`` replaces whole tables without such a moment.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, DataFrameWriter
from pyspark.sql import functions as F

from tidewire.operators.relevance import relevance_text

CSV_OPTIONS = {
    "header": True, "quote": '"', "escape": '"', "emptyValue": "", "encoding": "UTF-8",
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}


def _save(df: DataFrame, path: str, parts: list[str], fmt: str, **options) -> None:
    writer: DataFrameWriter = df.write.format(fmt).options(**options)
    if parts:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).save(path)
        return
    context = df.sparkSession.sparkContext
    hadoop_path = context._jvm.org.apache.hadoop.fs.Path
    target = hadoop_path(path.rstrip("/"))
    files = target.getFileSystem(context._jsc.hadoopConfiguration())
    mark = uuid.uuid4().hex
    fresh, old = (hadoop_path(target.getParent(), f".{target.getName()}-{kind}-{mark}") for kind in ("new", "old"))
    writer.save(fresh.toString())
    replaced = files.exists(target) and files.rename(target, old)
    if not files.rename(fresh, target):
        if replaced:
            files.rename(old, target)
        raise OSError(f"could not put the new table at {path}")
    if replaced:
        files.delete(old, True)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Between stages: columnar, partitioned by ticker when there is one."""
    parts = partition_by if partition_by is not None else [c for c in ["ticker"] if c in df.columns]
    _save(df, path, parts, "parquet")


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Header, minimal quoting, fixed column order, a folder per ticker when there is one."""
    if columns:
        parts = [c for c in ["ticker"] if c in df.columns and c not in columns]
        df = df.select(*parts, *columns)
    _save(df, path, ["ticker"] if "ticker" in df.columns else [], "csv", **CSV_OPTIONS)


def write_sorted_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """As ``write_csv``, rows in (ticker, date, ord) order across the files of a ticker.

    A range partitioning on the full order splits a large ticker over many files.
    """
    ordered = df.repartitionByRange("ticker", "date", "ord").sortWithinPartitions(
        "ticker", "date", "ord"
    )
    write_csv(ordered, path, columns)


def write_relevance(scored: DataFrame, path: str) -> None:
    """The text table: date, two-decimal score, category, rationale, JSON evidence."""
    columns = ["date", "relevance_score", "category", "rationale", "evidence_spans"]
    write_csv(relevance_text(scored), path, columns)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Headerless ``number,text`` files in a folder per ticker and chunk; a chunk is one file."""
    rows = chunks.select("ticker", "chunk", "number", "text")
    rows = rows.repartition("ticker", "chunk").sortWithinPartitions("ticker", "chunk", "number")
    _save(rows, path, ["ticker", "chunk"], "csv", **{**CSV_OPTIONS, "header": False})


def write_dated_csv(df: DataFrame, path: str) -> None:
    """A date-indexed table: the date is the first column."""
    rest = [c for c in df.columns if c != "date"]
    write_csv(df.select(F.col("date"), *rest), path)
