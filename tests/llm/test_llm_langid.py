import random

import numpy as np

from tidewire.llm.langid import RIDGE, _fit_rows, _landmarks, fit, presence, with_language

SCHEMA = "doc_id long, text string, lang string, language int, score string"
PARTS = {"aa": ["tion", "ing", "the", "er"], "bb": ["ció", "que", "ado", "ñas"], "cc": ["ung", "ßen", "äch", "die"], "el": ["και", "του", "ναι", "από"]}


def documents(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = list(PARTS)[i % 4]
        text = " ".join("".join(rng.choices(PARTS[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(1, 60)))
        rows.append((i, text, lang if i % 17 else None, 1, "x"))
    return spark.createDataFrame(rows, SCHEMA)


def predictions(docs, model):
    return {r["doc_id"]: tuple(r["language"]) for r in with_language(docs.select("doc_id", "text"), model).collect()}


def test_held_out_accuracy(spark):
    model = fit(documents(spark), bound=200)
    rows = documents(spark, 200, seed=2)
    found = predictions(rows, model)
    right = sum(found[r["doc_id"]][0] == list(PARTS)[r["doc_id"] % 4] for r in rows.collect())
    assert right >= 194
    assert all(0 <= s <= 1 for _, s in found.values())


def test_kernel_is_that_of_shared_ngrams(spark):
    texts = ["The thing, the thing!", "a THE of", "ing ing"]

    def plain(text):
        bare = "".join(c if c.isalpha() else " " for c in text.lower())
        bare = f" {' '.join(bare.split())} "
        return {bare[i : i + n] for n in (1, 2, 3) for i in range(len(bare) - n + 1)}

    rows = presence(texts)
    sets = [plain(t) for t in texts]
    assert [[int(x) for x in r] for r in rows @ rows.T] == [[len(a & b) for b in sets] for a in sets]
    assert np.all(rows.sum(axis=1) == [len(s) for s in sets])


def test_odd_texts_and_tables(spark):
    model = fit(documents(spark))
    rows = [(1, None), (2, ""), (3, "12 34 !!"), (4, "tion the"), (4, "tion the"), (None, "що це"), (5, "que " * 60_000), (6, "\U0001f600")]
    found = with_language(spark.createDataFrame([(*r, None, 1, "x") for r in rows], SCHEMA).select("doc_id", "text"), model).collect()
    got = [r["language"]["lang_pred"] for r in found]
    assert got[:3] == ["und"] * 3 and got[3] == got[4] == "aa" and got[6] == "bb" and got[7] == "und" and got[5] in PARTS
    nothing = fit(documents(spark).limit(0))
    assert predictions(documents(spark, 4), nothing)[0] == ("und", 0.0)
    assert with_language(documents(spark).limit(0).select("doc_id", "text"), model).count() == 0


def test_learning_uses_no_null_language(spark):
    docs = spark.createDataFrame([(1, "tion", None, 1, "x"), (2, None, "aa", 1, "x"), (3, "!!", "bb", 1, "x")], SCHEMA)
    assert fit(docs).languages == []


def test_regression_equals_the_dense_one(spark):
    docs = documents(spark, 120).filter("lang is not null")
    model = fit(docs, bound=10_000, landmarks=16)
    texts, names = zip(*[(r["text"], r["lang"]) for r in docs.collect()], strict=True)
    rows = presence(list(texts)).astype(float)
    own = model.landmarks.astype(float)
    kernel = rows @ own / np.sqrt(rows.sum(axis=1, keepdims=True))
    values, vectors = np.linalg.eigh(own.T @ own)
    features = kernel @ vectors / np.sqrt(np.maximum(values, 1e-6 * values.max()))
    weight = np.array([1 / names.count(n) for n in names])
    for number, lang in enumerate(model.languages):
        wanted = np.array([1.0 if n == lang else -1.0 for n in names])
        left = np.vstack([features * np.sqrt(weight)[:, None], np.sqrt(RIDGE) * np.eye(features.shape[1])])
        right = np.concatenate([wanted * np.sqrt(weight), np.zeros(features.shape[1])])
        best = np.linalg.lstsq(left, right, rcond=None)[0]
        assert np.allclose(features @ best, kernel @ model.solution[:, number].astype(float), atol=1e-3)


def test_scripts_with_many_letters(spark):
    rng = random.Random(4)
    signs = {"el": "αβγδεζηθικλμνξοπρστυφχψω", "ru": "абвгдежзиклмнопрстуфхцчшыэюя", "zh": "".join(map(chr, range(0x4E00, 0x5200))), "ko": "".join(map(chr, range(0xAC00, 0xB400))), "hi": "कखगघचछजझटठडढतथदधनपफबभमयरलवािीुू"}
    rows = []
    for i in range(500):
        lang = list(signs)[i % 5] if i % 25 else "hi"    # scripts with few rows count as much
        rows.append((i, " ".join("".join(rng.choices(signs[lang], k=rng.randint(2, 7))) for _ in range(30)), lang, 1, "x"))
    docs = spark.createDataFrame(rows, SCHEMA)
    found = predictions(docs, fit(docs.filter("doc_id % 2 = 0")))
    assert all(found[i][0] == lang for i, _, lang, _, _ in rows if i % 2)


def test_copies_keep_the_bound_and_are_one_landmark(spark):
    rows = [(i, "the tion ing" if i % 3 else "er the " + "".join(chr(97 + i // 26**k % 26) for k in range(3)), "aa", 1, "x") for i in range(3000)]
    rows += [(None, "que ñas", "bb", 1, "x")] * 50
    docs = spark.createDataFrame(rows, SCHEMA)
    assert 200 < _fit_rows(docs, 600, "doc_id").filter("lang = 'aa'").count() < 400
    marks = _landmarks(docs.select("text", "lang"), 20)
    assert marks.shape[1] == 21 and len({tuple(np.flatnonzero(c)) for c in marks.T}) == 21
    found = with_language(docs.select("doc_id", "text"), fit(docs)).select("text", "language").distinct().collect()
    assert len(found) == docs.select("text").distinct().count()
    assert {r["language"]["lang_pred"] for r in found if r["text"] == "que ñas"} == {"bb"}
