"""The queries on the smallest tables: against their SQL, or against plain versions."""

import os
import re

import numpy as np
import pytest
from brute import components, digest, fingerprint, personal_data, secrets, unit
from pyspark.sql import functions as F

from tidewire.llm.queries import ORACLE, QUERIES

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")


def comparable(value):
    return repr(round(value, 6) + 0.0) if isinstance(value, float) else str(value)


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(comparable(r[i]) for i in order) for r in records)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        connection.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    df, result = QUERIES[name](spark, SF), connection.execute(ORACLE[name])
    names = [c[0] for c in result.description]
    assert rows(df.columns, df.collect()) == rows(names, result.fetchall())


@pytest.mark.parametrize(("name", "plain"), [("op1_personal_data", personal_data), ("op5_random_secrets", secrets)])
def test_base_spans(spark, name, plain):
    want = {r["doc_id"]: plain(r["text"] or "") for r in documents(spark)}
    for r in QUERIES[name](spark, SF).collect():
        assert r["base_sha256"] == digest(want[r["doc_id"]])
        counts = {k: sum(s[0] == k for s in want[r["doc_id"]]) for k in (c[2:] for c in r.asDict() if c.startswith("n_"))}
        assert counts == {k: r[f"n_{k}"] for k in counts}


def test_fingerprints(spark):
    docs = documents(spark)
    found = {r["doc_id"]: r for r in QUERIES["op8_simhash_anchors"](spark, SF).collect()}
    prints = np.array([fingerprint(d["text"]) for d in docs], np.uint64)
    low = components(len(docs), lambda i: np.flatnonzero(np.bitwise_count(prints[i] ^ prints) <= 2))
    for i, d in enumerate(docs):
        assert found[d["doc_id"]]["fingerprint"] == format(int(prints[i]), "016x")
        assert found[d["doc_id"]]["component_id"] == docs[low[i]]["doc_id"]


def test_vectors(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    near = unit([v["embedding"] for v in vectors]) @ unit([v["embedding"] for v in vectors]).T >= 0.9
    np.fill_diagonal(near, False)
    low = components(len(vectors), lambda i: np.flatnonzero(near[i]))
    found = {r["vec_id"]: r for r in QUERIES["op9_spherical_cells"](spark, SF).collect()}
    for i, v in enumerate(vectors):
        assert tuple(found[v["vec_id"]])[1:3] == (near[i].sum(), vectors[low[i]]["vec_id"])


def test_pages_give_their_articles(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    found = {r["page_id"]: r for r in QUERIES["op4_style_tree"](spark, SF).collect()}
    for p in pages:
        article = re.search(r"<article>(.*?)</article>", p["html"], re.S)[1]
        pieces = [re.sub(r"<[^>]*>", " ", x) for x in re.split(r"</?(?:p|h1)>", article)]
        from html import unescape
        want = "\n".join(t for t in (" ".join(unescape(x).split()) for x in pieces) if t)
        assert found[p["page_id"]]["text"] == want and found[p["page_id"]]["n_chars"] == len(want)


@pytest.mark.parametrize(("name", "n", "out"), [("op3_string_kernel", 3, 1), ("op10_toxicity_trees", 4, 2)])
def test_held_out_rows_are_marked(spark, name, n, out):
    import zlib
    for r in QUERIES[name](spark, SF).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % n == out) and 0 <= r["score"] <= 1


def test_pipeline_stages_and_run(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {tuple(r) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        rows_ = out.select(*docs.columns).collect()
        assert {tuple(r) for r in rows_} <= kept, name
        if name != "sharding":
            assert out.columns == docs.columns
        docs = spark.createDataFrame(rows_, docs.schema)
        kept = {tuple(r) for r in rows_}
    final = corpus_pipeline.run(spark, SF)
    assert final.count() == len(rows_) and final.agg(F.max("shard")).first()[0] < 40
