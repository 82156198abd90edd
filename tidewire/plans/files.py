"""Queries that write the driver's tables through each sink and read them back, and their SQL.

Files go into a new folder beside the checkpoints, which all executors see. Tickers are upper-case there, as a
reader takes them from folders and file names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire import schemas as S
from tidewire.operators import directional, factors, relevance, sampling
from tidewire.operators.clean import ObservedIntegrity, clean_news
from tidewire.operators.ordinals import with_row_number
from tidewire.plans import catalog, oracle
from tidewire.plans.catalog import DIGITS, SAMPLE_ROWS
from tidewire.session import checkpoint_dir
from tidewire.sources import readers, versions, writers


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _news(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.news(spark, sf).withColumn("ticker", F.upper("ticker"))


def csv_round_trip(spark, sf):
    """Quoted fields with commas, quotes and line breaks; ``ord`` counts anew in the order of the files."""
    path = _folder(spark, "csv")
    writers.write_sorted_csv(_news(spark, sf), path, S.ARTICLE_COLUMNS)
    return readers.read_news(spark, path)


def csv_two_headers(spark, sf):
    """Half of the rows under one header and half under another, in one folder."""
    path = _folder(spark, "headers")
    articles = _news(spark, sf).withColumn("url", F.lit("u"))
    writers.write_csv(articles.filter("ord % 2 = 0").select("ticker", *S.ARTICLE_COLUMNS, "url"), path)
    other = articles.filter("ord % 2 = 1").select(
        "ticker", F.col("source").alias(" SOURCE"), F.col("date").alias("Datetime "), F.col("summary").alias("Summary"),
        F.col("headline").alias("Title"),
    )
    other.write.mode("append").partitionBy("ticker").options(**writers.CSV_OPTIONS).csv(path)
    return readers.read_raw_news(spark, path).drop("ord")


def csv_some_tickers(spark, sf):
    """Two tickers of a folder, given in lower case, and a path that isn't there and is skipped."""
    path = _folder(spark, "some")
    writers.write_csv(_news(spark, sf).select("ticker", *S.ARTICLE_COLUMNS), path)
    some = readers.read_news(spark, path, ["en", "Fr"])
    none = readers.read_news(spark, f"{path}-none", on_missing="skip")
    return some.unionByName(none).groupBy("ticker").agg(F.count("*").alias("num_rows"), F.max("ord").alias("last_ord"))


def sample_file(spark, sf):
    """The sample as it lies in its files: rows of a ticker in order of date, numbered from 0 when read."""
    path = _folder(spark, "sample")
    sampled = sampling.stratified_sample(catalog.news(spark, sf), SAMPLE_ROWS)
    writers.write_sorted_csv(sampled.withColumn("ticker", F.upper("ticker")), path, S.ARTICLE_COLUMNS)
    return readers.read_news(spark, path).select("ticker", "ord", "date")


def chunk_files(spark, sf):
    path = _folder(spark, "chunks")
    writers.write_chunks(directional.numbered_chunks(_news(spark, sf)), path)
    schema = spark.createDataFrame([], "number long, text string").schema
    return readers.read_csv(spark, path, schema, header=False).select("ticker", "chunk", "number", "text")


def label_files(spark, sf):
    """``idx,label`` files without header, some with a space after the comma, given back to their sample."""
    path = _folder(spark, "labels")
    sample = catalog.labelled(spark, sf).withColumn("ticker", F.upper("ticker"))
    numbered = with_row_number(sample, "idx")
    space = F.when(F.col("idx") % 3 == 0, " ").otherwise("")
    line = F.concat(F.col("idx").cast("string"), F.lit(","), space, F.col("directional_sentiment").cast("string"))
    lines = numbered.select("ticker", "idx", line.alias("line")).repartitionByRange("ticker", "idx").sortWithinPartitions("ticker", "idx")
    lines.drop("idx").write.partitionBy("ticker").text(path)
    combined = directional.positional_combine(sample, readers.read_labels(spark, path))
    return combined.select("ticker", "ord", "date", "directional_sentiment")


def headed_by_position(spark, sf):
    """Files whose header names are not looked at."""
    path = _folder(spark, "position")
    foreign = _news(spark, sf).select("ticker", *[F.col(c).alias(f"c{k}") for k, c in enumerate(S.ARTICLE_COLUMNS)])
    writers.write_csv(foreign, path)
    schema = spark.createDataFrame([], "date date, headline string, source string, summary string").schema
    return readers.read_headed_by_position(spark, path, schema).drop("ord")


def rules_from_files(spark, sf):
    """Relevance with rules read from JSON files, one object of word lists a ticker, with a key that is not used."""
    path = _folder(spark, "rules")
    catalog.rules(spark).withColumns({"ticker": F.upper("ticker"), "unused": F.array(F.lit("x"))}).write.partitionBy("ticker").json(path)
    scored = relevance.relevance_scores(_news(spark, sf), readers.read_rules(spark, path), evidence=False)
    return scored.withColumn("ticker", F.lower("ticker"))


def relevance_file(spark, sf):
    """The relevance table as text, all columns read as they are written."""
    path = _folder(spark, "relevance")
    scored = relevance.relevance_scores(catalog.news(spark, sf), catalog.rules(spark))
    writers.write_relevance(scored.withColumn("ticker", F.upper("ticker")), path)
    columns = ["date", "relevance_score", "category", "rationale", "evidence_spans"]
    return readers.read_text_csv(spark, path, columns).select(F.lower("ticker").alias("ticker"), *columns)


def dated_file(spark, sf):
    """Factors with the date as first column, and a price range read back from a stored table."""
    path = _folder(spark, "factors")
    found = catalog._rounded(factors.factor_proxies(catalog.prices(spark, sf)))
    writers.write_dated_csv(found, path)
    return readers.read_csv(spark, path, found.schema)


def price_range(spark, sf):
    path = _folder(spark, "prices")
    writers.write_parquet(catalog.prices(spark, sf), path)
    return catalog._rounded(readers.read_prices(spark, path, "2024-01-05", "2024-01-12"))


def replaced_table(spark, sf):
    """A table that is replaced by a change of itself, read at its newest version."""
    path = _folder(spark, "versions")
    versions.write_versioned(_news(spark, sf).filter("ord % 3 = 0"), path, partition_by=["ticker"])
    versions.write_versioned(_news(spark, sf), path, partition_by=["ticker"])
    newer = readers.read_news(spark, path, fmt="parquet").withColumn("source", F.concat("source", F.lit("'")))
    versions.write_versioned(newer, path, partition_by=["ticker"])
    return readers.read_news(spark, path, fmt="parquet")


def observed_counts(spark, sf):
    """The metrics that come with the write of the cleaned table."""
    integrity = ObservedIntegrity()
    writers.write_parquet(clean_news(catalog.raw_news(spark, sf), integrity=integrity), _folder(spark, "cleaned"))
    return spark.createDataFrame([tuple(integrity.check().values())], "num_rows long, null_date long, null_headline long, "
                                 "null_summary long, placeholder long")


FILE_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        csv_round_trip, csv_two_headers, csv_some_tickers, sample_file, chunk_files, label_files, headed_by_position,
        rules_from_files, relevance_file, dated_file, price_range, replaced_table, observed_counts,
    )
}

_UPPER = f"with {oracle.NEWS}, upper_news as (select * replace (upper(ticker) as ticker) from news)"
# An empty field is a missing one once it has been in a file, and so are the texts that stand for one.
_BACK = "date, nullif(headline, '') as headline, nullif(source, '') as source, nullif(summary, '') as summary"
_ROLES = ", ".join(f"'{k}': '{v}'" for k, v in catalog.ROLES.items())

FILE_SQL: dict[str, str] = {
    "csv_round_trip": f"""{_UPPER}
select ticker, row_number() over (partition by ticker order by date, ord) - 1 as ord, {_BACK} from upper_news""",
    "csv_two_headers": f"""{_UPPER}
select ticker, date::varchar as date, nullif(headline, '') as headline, nullif(source, '') as source,
       nullif(summary, '') as summary from upper_news""",
    "csv_some_tickers": f"""{_UPPER}
select ticker, count(*) as num_rows, count(*) - 1 as last_ord from upper_news where ticker in ('EN', 'FR') group by ticker""",
    "sample_file": f"""with sampled as ({oracle.ORACLE["stratified_sample"]}),
dated as (select ticker, ord, date '2024-01-01' + cast(ord % 90 as int) as date from sampled)
select upper(ticker) as ticker, row_number() over (partition by ticker order by date, ord) - 1 as ord, date from dated""",
    "chunk_files": f"select upper(ticker) as ticker, chunk, number, text from ({oracle.ORACLE['chunk_numbers']})",
    "label_files": f"""with {oracle.NEWS}, {oracle.LABELLED}
select upper(ticker) as ticker, ord, date, directional_sentiment from labelled""",
    "headed_by_position": f"{_UPPER} select ticker, {_BACK} from upper_news",
    "rules_from_files": oracle.ORACLE["relevance_scores"],
    "relevance_file": f"""select ticker, date, relevance_score, category, rationale, evidence_spans
from ({oracle.ORACLE["relevance_evidence"]})""",
    "dated_file": oracle.ORACLE["factor_proxies"],
    "price_range": f"""
select ts::date as date, (map {{{_ROLES}}})[event_type] as symbol, round_even(avg(value), {DIGITS}) as adj_close
from events where ts::date >= date '2024-01-05' and ts::date < date '2024-01-12' group by all""",
    "replaced_table": f"""{_UPPER}
select ticker, ord, date, headline, source || '''' as source, summary from upper_news""",
    "observed_counts": f"""select count(*) as num_rows, 0::bigint as null_date, 0::bigint as null_headline, 0::bigint as null_summary,
       0::bigint as placeholder from ({oracle.ORACLE["clean_news"]})""",
}
