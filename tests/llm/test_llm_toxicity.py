import random

from tidewire.llm.toxicity import _Reader, toxicity_stage, with_toxicity

DOCS, LABELS = "doc_id long, text string, _score int, features string, score string", "doc_id long, quality int, toxic int"
BAD = ["zargh", "blunkish", "blunker", "mopfel"]


def tables(spark, n=1200, seed=3):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [f"w{rng.randint(0, 500)}x".translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(rng.randint(5, 80))]
        toxic = i % 5 == 0
        for _ in range(rng.randint(2, 5) if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(BAD)
        docs.append((i, " ".join(words), 1, "f", "s"))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_held_out_labels(spark):
    docs, labels = tables(spark)
    odd = [(5000, None, 1, "f", "s"), (5001, "", 1, "f", "s"), (5002, "you zargh you " * 20_000, 1, "f", "s"), (None, "z4rgh", 1, "f", "s"), (0, docs[0][1], 1, "f", "s")]
    d = spark.createDataFrame(docs + odd, DOCS)
    l = spark.createDataFrame(labels[:800] + [(3, 1, 0), (None, 1, 1), (9, 1, None)], LABELS)
    scored = with_toxicity(d.drop("score"), l).collect()
    assert len(scored) == len(docs) + len(odd) and all(0 <= r["score"] <= 1 for r in scored)
    by = {r["doc_id"]: r["score"] for r in scored}
    wrong = [i for i, _, t in labels[800:] if (by[i] >= 0.3) != (t == 1)]
    assert len(wrong) <= 4
    assert by[5000] == by[5001] < 0.3 <= by[5002]


def test_labels_of_one_kind_or_none(spark):
    docs, labels = tables(spark, 40)
    d = spark.createDataFrame(docs, DOCS).drop("score")
    zero = spark.createDataFrame([(i, 1, 0) for i, _, _ in labels], LABELS)
    assert {r["score"] for r in with_toxicity(d, zero).collect()} == {0.0}
    assert {r["score"] for r in with_toxicity(d, zero.limit(0)).collect()} == {0.0}
    assert with_toxicity(d.limit(0), zero).count() == 0


def test_spelled_with_signs():
    reader = _Reader({"zargh": 3.0, "blun*": 2.0})
    plain, signs = reader.features("you zargh now"), reader.features("you z4r.gh now")
    assert plain[:2] == signs[:2] and plain[12] == 0 < signs[12] and plain[7] > 0
    assert reader.features("blunkers")[3] == 2.0 and reader.features(None)[0] == 0.0


def test_stage_keeps_columns(spark, monkeypatch):
    docs, labels = tables(spark)
    d = spark.createDataFrame(docs, DOCS)
    monkeypatch.setattr("tidewire.llm.toxicity.read", lambda *_: spark.createDataFrame(labels, LABELS))
    left = toxicity_stage(spark, d, "unused")
    assert left.columns == d.columns
    kept = {r["doc_id"] for r in left.collect()}
    assert len(kept - {i for i in range(0, 1200, 5)}) >= 955 and len(kept & set(range(0, 1200, 5))) <= 5
