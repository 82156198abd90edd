"""Sinks and sources together: queries against their SQL, versions, first lines."""

import gzip
import os

import pytest
from test_catalog import SF, rows, sql  # noqa: F401
from pyspark.sql import functions as F

from tidewire.plans.files import FILE_QUERIES, FILE_SQL
from tidewire.sources import readers, versions

needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")


@needs_tables
@pytest.mark.parametrize("name", sorted(FILE_QUERIES))
def test_query_equals_sql(spark, sql, name):  # noqa: F811
    df, result = FILE_QUERIES[name](spark, SF), sql.execute(FILE_SQL[name])
    names = [c[0] for c in result.description]
    assert rows(df.columns, df.collect()) == rows(names, result.fetchall())


def ids(spark, path):
    return sorted(r["id"] for r in spark.read.parquet(versions.current_folder(spark, path)).collect())


def test_a_write_that_stops_anywhere_leaves_a_whole_table(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    versions.write_versioned(spark.range(3), path)
    assert ids(spark, path) == [0, 1, 2]
    with pytest.raises(Exception, match="stop"):    # in the data
        versions.write_versioned(spark.range(5).withColumn("id", F.raise_error(F.lit("stop")).cast("long")), path)
    assert ids(spark, path) == [0, 1, 2]
    create, old = versions._Folder.create, versions._remove_old

    def torn(self, name, text):    # within the pointer
        create(self, name, text[:9])
        raise OSError("stop")

    for stopped in (torn, lambda self, name, text: (_ for _ in ()).throw(OSError("stop"))):    # and before it
        monkeypatch.setattr(versions._Folder, "create", stopped)
        with pytest.raises(OSError, match="stop"):
            versions.write_versioned(spark.range(4), path)
        assert ids(spark, path) == [0, 1, 2]
    monkeypatch.setattr(versions._Folder, "create", create)
    monkeypatch.setattr(versions, "_remove_old", lambda *a: (_ for _ in ()).throw(OSError("stop")))
    with pytest.raises(OSError, match="stop"):    # after it
        versions.write_versioned(spark.range(2), path)
    assert ids(spark, path) == [0, 1]
    monkeypatch.setattr(versions, "_remove_old", old)
    for n in (6, 7, 8):
        versions.write_versioned(spark.read.parquet(versions.current_folder(spark, path)).limit(0).union(spark.range(n)), path)
        assert ids(spark, path) == list(range(n))
    assert len(versions._Folder(spark, path).pointers()) == versions.KEPT


def test_two_writes_at_once(spark, tmp_path):
    path = f"{tmp_path}/t"
    versions.write_versioned(spark.range(1), path)
    (tmp_path / "t" / "_pointer.2").write_text("")    # taken by a write that died
    versions.write_versioned(spark.range(2), path)
    assert ids(spark, path) == [0, 1]
    with pytest.raises(Exception, match="exist"):
        versions._Folder(spark, path).create("_pointer.3", "v-x\n")
    assert versions.current_folder(spark, f"{tmp_path}/none") == f"{tmp_path}/none"


def test_first_lines(spark, tmp_path):
    (tmp_path / "A_x.csv").write_text("﻿Date,Title\r\n1,2\r\n")
    (tmp_path / "B_x y.csv").write_text("n" * 10_000 + "\nrest\n")
    (tmp_path / "C_x.csv").write_text("")
    (tmp_path / "D_x.csv.gz").write_bytes(gzip.compress(b"zipped,name\n1,2\n"))
    found = {os.path.basename(f): line for f, line in readers.first_lines(spark, f"{tmp_path}/*")}
    assert found == {"A_x.csv": "﻿Date,Title", "B_x y.csv": "n" * 10_000, "D_x.csv.gz": "zipped,name"}
    assert [os.path.basename(f) for f, _ in readers.first_lines(spark, f"{tmp_path}/*", ["a"])] == ["A_x.csv"]
    assert readers._ticker_of("x/ticker=ab%20c/part-0.csv") == "AB C" and readers._ticker_of("x/nope.csv") == ""


def test_header_names():
    assert readers.header_names('﻿ Date ,"a, b",DATE,,x') == ("date", "a, b", "date_2", "_c3", "x")
    assert readers.header_names('date,"broken') is None and readers.header_names("") == ()


def test_missing_names_are_reported_before_any_scan(spark, tmp_path):
    (tmp_path / "A_x.csv").write_text("date,headline,source,summary\n2024-01-01,h,s,b\n")
    (tmp_path / "B_x.csv").write_text("date,nothing\n1,2\n")
    with pytest.raises(ValueError, match="B_x.csv has no columns"):
        readers.read_raw_news(spark, f"{tmp_path}/*.csv")
    assert readers.read_raw_news(spark, f"{tmp_path}/*.csv", ["A"]).count() == 1
