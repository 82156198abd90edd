"""Readers with explicit schemas. One scan covers all tickers.

Files come either in a folder per ticker (``ticker=ABT/``) or with the ticker as the first part of
the file name (``ABT_raw_dataset.csv``). ``ord`` counts the rows of a ticker from 0, by file path and
place in the file. A quoted field may hold line breaks, so a file is never split.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire import schemas as S
from tidewire.functions.text import ticker_from_path
from tidewire.operators.clean import normalize_columns
from tidewire.sources.versions import current_folder

CSV_OPTIONS = {
    "header": True, "multiLine": True, "quote": '"', "escape": '"', "encoding": "UTF-8",
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}


PATH_MISSING = "PATH_NOT_FOUND"
HEADER_BLOCK = 4096     # bytes of a file read at once to find its first line
HEADER_THREADS = 16


def _with_ticker(df: DataFrame) -> DataFrame:
    """The file's path, and the ticker from its name when the layout has no such column."""
    df = df.withColumn("_file", F.col("_metadata.file_path"))
    if "ticker" not in df.columns:
        df = df.withColumn("ticker", ticker_from_path(F.col("_metadata.file_path")))
    return df


def with_position(df: DataFrame) -> DataFrame:
    """Add ``ord``: the row's place within its ticker, by file path and place in the file.

    ``df`` is a scan with ``ticker`` and ``_file``. How Spark packs files into tasks does not show:
    the running id only counts within a file, and a table of one row per file says where each file
    starts. That table is joined, so the articles themselves are not shuffled for it.
    """
    placed = df.withColumn("_id", F.monotonically_increasing_id())
    files = placed.groupBy("ticker", "_file").agg(
        F.min("_id").alias("_first"), F.count("*").alias("_rows")
    )
    before = Window.partitionBy("ticker").orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select(
        "_file", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start")
    )
    ord_ = F.col("_id") - F.col("_first") + F.col("_start")
    return placed.join(starts, "_file").withColumn("ord", ord_).drop("_id", "_first", "_start", "_file")


def only_tickers(df: DataFrame, tickers: list[str] | None) -> DataFrame:
    """Restrict to some tickers (any case). Applied to a scan, this prunes folders or files."""
    if tickers is None:
        return df
    return df.filter(F.col("ticker").isin([t.upper() for t in tickers]))


def require_tickers(df: DataFrame, tickers: list[str], on_missing: str = "skip") -> DataFrame:
    """``on_missing='error'`` raises when a wanted ticker has no rows; ``'skip'`` goes on."""
    wanted = only_tickers(df, tickers)
    if on_missing == "error":
        found = {r["ticker"] for r in wanted.select("ticker").distinct().collect()}
        absent = sorted({t.upper() for t in tickers} - found)
        if absent:
            raise FileNotFoundError(f"No rows for tickers {absent}")
    return wanted


def _scan(load: Callable[[], DataFrame], empty: DataFrame, on_missing: str) -> DataFrame:
    """``load()``, or ``empty`` for a path that is not there and may be skipped."""
    try:
        return load()
    except AnalysisException as error:
        if on_missing == "skip" and error.getCondition() == PATH_MISSING:
            return empty
        raise


def _ticker_of(file: str) -> str:
    """The ticker of a path, as ``_with_ticker`` finds it: a folder's, else the first part of the file's name."""
    folder = re.search(r"/ticker=([^/]+)/", file)
    name = re.search(r"([^/_]+)_[^/]*$", file)
    return (unquote(folder[1]) if folder else name[1] if name else "").upper()


def first_lines(spark: SparkSession, path: str, tickers: list[str] | None = None) -> list[tuple[str, str]]:
    """(file, first line) of each file that isn't empty, in order; other tickers' files aren't opened.

    The driver, which lists the files for any scan, opens each and reads a block or, for a longer line, some; so
    what is read doesn't grow with the files. (Python tasks take in their whole partition, even if they
    end early, and a limit over all files is no limit in each.)
    """
    context = spark.sparkContext
    jvm, conf = context._jvm, context._jsc.hadoopConfiguration()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
    wanted = None if tickers is None else {t.upper() for t in tickers}
    files = sorted(f for f in spark.read.text(path).inputFiles() if wanted is None or _ticker_of(f) in wanted)

    def first(file: str) -> tuple[str, str] | None:
        place = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
        stream, codec = place.getFileSystem(conf).open(place), codecs.getCodec(place)
        stream = codec.createInputStream(stream) if codec else stream
        read = b""
        try:
            while b"\n" not in read and b"\r" not in read and (more := bytes(stream.readNBytes(HEADER_BLOCK))):
                read += more
        finally:
            stream.close()
        return (place.toString(), re.split(rb"\r\n|\n|\r", read)[0].decode("utf-8", "replace")) if read else None

    with ThreadPoolExecutor(HEADER_THREADS) as pool:
        return [found for found in pool.map(first, files) if found]


def header_names(line: str) -> tuple[str, ...] | None:
    """Normalized column names of a header line, made different; None if a quoted name goes on after the line."""
    if line.count('"') % 2:
        return None
    names: list[str] = []
    for k, cell in enumerate(next(csv.reader([line.lstrip("\ufeff")]), [])):
        name = cell.strip().lower() or f"_c{k}"
        names.append(name if name not in names else f"{name}_{k}")
    return tuple(names)


def _files_by_header(
    spark: SparkSession, path: str, columns: list[str], tickers: list[str] | None
) -> dict[tuple[str, ...] | None, list[str]]:
    """Paths of the files, those with the same column names together; raises where names are missing."""
    grouped: dict[tuple[str, ...] | None, list[str]] = {}
    for file, line in first_lines(spark, path, tickers):
        grouped.setdefault(header_names(line), []).append(file)
    for names, files in grouped.items():
        if names is not None:
            known = spark.createDataFrame([], ", ".join(f"`{n.replace('`', '``')}` string" for n in names) or "_none string")
            S.require_columns(normalize_columns(known), columns, ", ".join(files[:5]))
    return grouped


def read_text_csv(
    spark: SparkSession,
    path: str,
    columns: list[str],
    tickers: list[str] | None = None,
    on_missing: str = "error",
    own_headers: bool = True,
) -> DataFrame:
    """All-string CSV scan with normalized names; raises when a column is missing.

    Each file is read by its own header: files with the same names, letter case and spaces aside, make one scan,
    and the scans are joined by name. ``own_headers=False`` saves the look at first lines where all files are
    known to have one layout; a file that differs then raises. Columns that some files lack are null there.
    ``on_missing='skip'`` takes a path without files as an empty table. The path of a versioned table is read at
    its newest version.
    """
    path = current_folder(spark, path)
    empty = spark.createDataFrame([], ", ".join(f"{c} string" for c in ["_file", "ticker", *columns]))
    options = {**CSV_OPTIONS, "inferSchema": False, "enforceSchema": False}
    base = path.rstrip("/")

    def scan(paths: str | list[str], names: tuple[str, ...] | None = None) -> DataFrame:
        reader = spark.read.options(**options)
        if isinstance(paths, list) and all(f"{base}/" in file for file in paths):
            reader = reader.option("basePath", base)    # so that folder names still give columns
        if names:
            reader = reader.option("enforceSchema", True).schema(
                T.StructType([T.StructField(n, T.StringType()) for n in names])
            )
        df = _with_ticker(reader.csv(paths))
        df = S.require_columns(normalize_columns(df), columns, path)
        return only_tickers(df, tickers)

    def load() -> DataFrame:
        if not own_headers:
            return scan(path)
        grouped = _files_by_header(spark, path, columns, tickers)
        scans = [scan(files, names) for names, files in grouped.items()]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scans) if scans else empty

    df = with_position(_scan(load, empty, on_missing))
    return df.select("ticker", "ord", *[c for c in df.columns if c not in ("ticker", "ord")])


def read_raw_news(
    spark: SparkSession, path: str, tickers: list[str] | None = None, on_missing: str = "error"
) -> DataFrame:
    """Raw articles: ``title`` and ``datetime`` headers are understood, other columns dropped."""
    df = read_text_csv(spark, path, S.ARTICLE_COLUMNS, tickers, on_missing)
    return df.select("ticker", "ord", *S.ARTICLE_COLUMNS)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, header: bool = True) -> DataFrame:
    """Typed CSV scan; columns absent from the file come out null only if the schema adds them."""
    options = {**CSV_OPTIONS, "header": header, "enforceSchema": not header}
    return spark.read.options(**options).schema(schema).csv(current_folder(spark, path))


def read_news(
    spark: SparkSession,
    path: str,
    tickers: list[str] | None = None,
    fmt: str = "csv",
    on_missing: str = "error",
) -> DataFrame:
    """A cleaned or processed table, as CSV or Parquet."""
    if fmt == "csv":
        df = read_text_csv(spark, path, S.ARTICLE_COLUMNS, tickers, on_missing)
        df = df.withColumn("date", F.col("date").try_cast("date"))
    else:
        empty = spark.createDataFrame([], S.NEWS)
        place = current_folder(spark, path)
        df = only_tickers(_scan(lambda: spark.read.format(fmt).load(place), empty, on_missing), tickers)
    return df.select("ticker", "ord", *S.ARTICLE_COLUMNS)


def read_labels(
    spark: SparkSession, path: str, tickers: list[str] | None = None, on_missing: str = "error"
) -> DataFrame:
    """Headerless ``idx,label`` files, with or without a space after the comma."""
    reader = spark.read.schema(S.LABEL_FILE).options(
        header=False, ignoreLeadingWhiteSpace=True, multiLine=True
    )
    empty = spark.createDataFrame([], "_file string, ticker string, idx int, label int")
    df = _scan(lambda: _with_ticker(reader.csv(path)), empty, on_missing)
    return with_position(only_tickers(df, tickers)).select("ticker", "ord", "idx", "label")


def read_headed_by_position(
    spark: SparkSession, path: str, schema: T.StructType, tickers: list[str] | None = None
) -> DataFrame:
    """Skip the header line and take the columns by position."""
    df = spark.read.options(**{**CSV_OPTIONS, "enforceSchema": True}).schema(schema).csv(path)
    columns = [f.name for f in schema.fields]
    return with_position(only_tickers(_with_ticker(df), tickers)).select("ticker", "ord", *columns)


def read_rules(
    spark: SparkSession, path: str, tickers: list[str] | None = None, on_missing: str = "error"
) -> DataFrame:
    """One JSON object of word lists per ticker; keys that are not used are dropped."""
    reader = spark.read.option("multiLine", True).schema(S.RULE_FILE)
    df = _scan(lambda: _with_ticker(reader.json(path)), spark.createDataFrame([], S.RULES), on_missing)
    return only_tickers(df.select(*[f.name for f in S.RULES.fields]), tickers)


def read_prices(
    spark: SparkSession, path: str, start: str | None = None, end: str | None = None,
    fmt: str = "parquet",
) -> DataFrame:
    """Landed long price table; the date range reaches the scan."""
    df = spark.read.schema(S.PRICES).format(fmt).option("header", True).load(current_folder(spark, path))
    if start:
        df = df.filter(F.col("date") >= F.lit(start).cast("date"))
    if end:
        df = df.filter(F.col("date") < F.lit(end).cast("date"))
    return df
