import datetime as dt
import glob
import json

import pytest
from pyspark.sql import functions as F

from tidewire import schemas as S
from tidewire.operators import clean, directional, relevance
from tidewire.sources import readers, writers


@pytest.fixture
def raw_folder(tmp_path):
    (tmp_path / "ABT_raw_dataset.csv").write_text(
        'datetime,title,source,summary,url\n'
        '3/2/2024,"One, with comma",Yahoo,"line one\nline ""two""",u\n'
        '4/2/2024,NA,Yahoo,b,u\n'
        "5/2/2024,It's three,DowJones,c,u\n",
        encoding="utf-8",
    )
    (tmp_path / "tsla_raw_dataset.csv").write_text(
        " Date ,Headline,Source,Summary\n2024-02-03,Vier ö,s,d\n", encoding="utf-8"
    )
    return tmp_path


def test_raw_files(spark, raw_folder):
    abt = readers.read_raw_news(spark, f"{raw_folder}/ABT_raw_dataset.csv")
    rows = abt.orderBy("ord").collect()
    assert [r.ticker for r in rows] == ["ABT"] * 3
    assert rows[0].summary == 'line one\nline "two"' and rows[0].headline == "One, with comma"
    kept = clean.clean_news(abt).orderBy("ord").collect()
    assert [(r.headline, r.date) for r in kept] == [
        ("One, with comma", dt.date(2024, 2, 3)), ("Its three", dt.date(2024, 2, 5))
    ]
    assert kept[0].summary == "line one\nline two"
    tsla = readers.read_raw_news(spark, f"{raw_folder}/tsla_raw_dataset.csv").first()
    assert (tsla.ticker, tsla.headline) == ("TSLA", "Vier ö")
    with pytest.raises(ValueError, match="no columns"):
        readers.read_text_csv(spark, f"{raw_folder}/ABT_raw_dataset.csv", ["body"]).count()


def test_ticker_choice(spark, articles):
    df = articles([(t, 0, "2024-01-01", "h", "s", "b") for t in ("ABT", "AMZN")])
    assert readers.only_tickers(df, ["abt"]).count() == 1
    assert readers.require_tickers(df, ["abt", "NEE"]).count() == 1
    with pytest.raises(FileNotFoundError, match="NEE"):
        readers.require_tickers(df, ["abt", "NEE"], "error")


def test_labels_and_rules(spark, tmp_path):
    (tmp_path / "AMZN_output.csv").write_text("1, 1\n2,-1\n3, 0\n")
    labels = readers.read_labels(spark, str(tmp_path / "*_output.csv")).orderBy("ord").collect()
    assert [(r.ticker, r.idx, r.label) for r in labels] == [
        ("AMZN", 1, 1), ("AMZN", 2, -1), ("AMZN", 3, 0)
    ]
    (tmp_path / "BEP_config.json").write_text(
        json.dumps({"aliases": ["bep"], "products": [], "direct_keywords": ["é"], "unused": ["x"]})
    )
    rule = readers.read_rules(spark, str(tmp_path / "*_config.json")).first()
    assert (rule.ticker, rule.aliases, rule.direct_keywords) == ("BEP", ["bep"], ["é"])
    assert rule.low_signal_phrases is None
    assert relevance.rule_patterns(readers.read_rules(spark, str(tmp_path / "*.json"))).count() == 1


def test_positional_header(spark, tmp_path):
    (tmp_path / "ABT_sample_full.csv").write_text("a,b,c,d\n2024-01-01,h,s,m\n")
    schema = "date date, headline string, source string, summary string"
    struct = spark.createDataFrame([], schema).schema
    row = readers.read_headed_by_position(spark, str(tmp_path / "ABT_sample_full.csv"), struct).first()
    assert (row.ticker, row.date, row.summary) == ("ABT", dt.date(2024, 1, 1), "m")


def test_news_round_trip(spark, articles, tmp_path):
    df = articles(
        [
            ("A", 0, "2024-01-02", 'say "x", y', "s", "line\nbreak"),
            ("A", 1, "2024-01-01", "é", None, "b"),
            ("B", 0, "2024-01-01", "h", "s", "b"),
        ]
    )
    writers.write_sorted_csv(df, f"{tmp_path}/csv", S.ARTICLE_COLUMNS)
    back = readers.read_news(spark, f"{tmp_path}/csv")
    assert sorted((r.ticker, r.date, r.headline, r.summary) for r in back.collect()) == sorted(
        (r.ticker, r.date, r.headline, r.summary) for r in df.collect()
    )
    writers.write_parquet(df, f"{tmp_path}/pq")
    writers.write_parquet(df.filter("ticker = 'B'").withColumn("source", F.lit("new")), f"{tmp_path}/pq")
    stored = readers.read_news(spark, f"{tmp_path}/pq", ["a", "b"], "parquet")
    assert {(r.ticker, r.source) for r in stored.collect()} == {("A", "s"), ("A", None), ("B", "new")}
    pruned = readers.read_news(spark, f"{tmp_path}/pq", ["a"], "parquet")
    plan = pruned._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(ticker" in plan


def test_chunk_files(spark, articles, tmp_path):
    df = articles([("A", i, "2024-01-01", f"h{i}", "s", "b, c") for i in range(5)])
    writers.write_chunks(directional.numbered_chunks(df, 2), f"{tmp_path}/chunks")
    files = sorted(glob.glob(f"{tmp_path}/chunks/ticker=A/chunk=*/*.csv"))
    assert len(files) == 3
    assert open(files[0]).read() == '1,"h0 b, c"\n2,"h1 b, c"\n'
    assert open(files[2]).read() == '5,"h4 b, c"\n'


def test_relevance_and_dated_files(spark, articles, tmp_path):
    rules = spark.createDataFrame([("A", ["h"], ["x"], ["b"], ["i"], ["l"])], S.RULES)
    df = articles([("A", 0, "2024-01-01", "h", "s", "b")])
    writers.write_relevance(relevance.relevance_scores(df, rules), f"{tmp_path}/rel")
    text = open(glob.glob(f"{tmp_path}/rel/ticker=A/*.csv")[0]).read().splitlines()
    assert text[0] == "date,relevance_score,category,rationale,evidence_spans"
    assert text[1].startswith("2024-01-01,0.75,Directly Related,") and text[1].endswith('"[""b""]"')
    factors = spark.createDataFrame([(1.5, dt.date(2024, 1, 1))], "mkt_rf double, date date")
    writers.write_dated_csv(factors, f"{tmp_path}/f")
    written = {open(f).read() for f in glob.glob(f"{tmp_path}/f/*.csv")}
    assert written - {"date,mkt_rf\n"} == {"date,mkt_rf\n2024-01-01,1.5\n"}


def test_prices(spark, tmp_path):
    rows = [(dt.date(2024, 1, d), "SPY", float(d)) for d in range(1, 6)]
    spark.createDataFrame(rows, S.PRICES).write.parquet(f"{tmp_path}/p")
    df = readers.read_prices(spark, f"{tmp_path}/p", "2024-01-02", "2024-01-04")
    assert sorted(r.date.day for r in df.collect()) == [2, 3]
    assert "PushedFilters: [IsNotNull(date)" in df._jdf.queryExecution().toString()
    spark.createDataFrame(rows, S.PRICES).write.option("header", True).csv(f"{tmp_path}/c")
    assert readers.read_csv(spark, f"{tmp_path}/c", S.PRICES).count() == 5


def test_checkpoint_dir_follows_the_session(spark):
    from tidewire.session import checkpoint_dir, materialize

    assert checkpoint_dir(spark) == spark.sparkContext.getCheckpointDir()
    assert materialize(spark.range(3)).count() == 3


def two_tickers(folder):
    (folder / "ABT_a.csv").write_text("date,headline,source,summary\n2024-01-01,h1,S1,b1\n2024-01-02,h2,S2,b2\n")
    (folder / "ABT_b.csv").write_text(
        "source,datetime,summary,title\n" + "".join(f"T{i},2024-02-0{i},c{i},t{i}\n" for i in range(1, 6))
    )
    (folder / "TSLA_a.csv").write_text(" Title ,Date,source,summary,url\nx,2024-03-01,U1,y,z\n")
    return f"{folder}/*.csv"


def test_each_file_is_read_by_its_own_header(spark, tmp_path):
    rows = readers.read_raw_news(spark, two_tickers(tmp_path)).orderBy("ticker", "ord").collect()
    assert [(r.ticker, r.ord, r.date, r.headline, r.source, r.summary) for r in rows[1:4]] == [
        ("ABT", 1, "2024-01-02", "h2", "S2", "b2"), ("ABT", 2, "2024-02-01", "t1", "T1", "c1"),
        ("ABT", 3, "2024-02-02", "t2", "T2", "c2"),
    ]
    assert (rows[-1].ticker, rows[-1].ord, rows[-1].headline, rows[-1].summary) == ("TSLA", 0, "x", "y")


def test_ord_does_not_depend_on_packing(spark, tmp_path):
    path = two_tickers(tmp_path)
    found = []
    for size in ("64", "1g"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        found.append(sorted(map(tuple, readers.read_raw_news(spark, path).collect())))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found[0] == found[1] and [r[1] for r in found[0]] == [*range(7), 0]


def test_wanted_tickers_prune_the_scan(spark, tmp_path):
    news = readers.read_raw_news(spark, two_tickers(tmp_path), ["tsla"])
    assert news.count() == 1
    plan = news._jdf.queryExecution().toString()
    assert "DataFilters: [(upper(regexp_extract(file_path" in plan
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "A_output.csv").write_text("1,1\n")
    labels = readers.read_labels(spark, f"{tmp_path}/l/*.csv", ["A"])
    assert "DataFilters: [(upper(regexp_extract(file_path" in labels._jdf.queryExecution().toString()


def test_missing_paths(spark, tmp_path):
    for read in (readers.read_raw_news, readers.read_news, readers.read_labels, readers.read_rules):
        with pytest.raises(Exception, match="PATH_NOT_FOUND"):
            read(spark, f"{tmp_path}/none").count()
        assert read(spark, f"{tmp_path}/none", on_missing="skip").count() == 0


def test_failed_write_leaves_the_old_table(spark, tmp_path):
    for path, write, name in (("a", writers.write_dated_csv, "x"), ("b", writers.write_parquet, "ticker")):
        old = spark.createDataFrame([("2024-01-01", "1")], f"date string, {name} string")
        write(old, f"{tmp_path}/{path}")
        before = sorted(glob.glob(f"{tmp_path}/{path}/**", recursive=True))
        broken = old.withColumn("date", F.raise_error(F.lit("stop")).cast("string"))
        with pytest.raises(Exception, match="stop"):
            write(broken, f"{tmp_path}/{path}")
        assert sorted(glob.glob(f"{tmp_path}/{path}/**", recursive=True)) == before
        write(old.withColumn("date", F.lit("2024-01-02")), f"{tmp_path}/{path}")
        reader = spark.read.option("header", True).format("csv" if path == "a" else "parquet")
        assert [str(r["date"]) for r in reader.load(f"{tmp_path}/{path}").collect()] == ["2024-01-02"]
