"""Language of a text by a string kernel, Nyström landmarks and kernel ridge regression.

The kernel of two texts counts the n-grams of one to three letters that both have, over the root of
the product of how many each has. N-grams of any script are hashed into a fixed number of columns,
so no letter is left out and the width doesn't grow. The kernel is taken against a fixed set of landmark texts only; these
columns of the kernel matrix stand for the whole of it (Nyström), and one ridge regression per
language, this one against the rest, is solved over them. Scoring a batch of texts is one product
of their presence matrix with the landmarks' and one with the solution. For the fit, tasks sum the products of
their rows, and the driver gets matrices of the size of the landmarks only.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.common import bucket_of, is_train, read, stored

FOLDS, HELD_OUT = 3, 1
FIT_ROWS = 8_000         # labelled rows that the regression is solved over, shared by the languages
LANDMARKS = 128
COLUMN_BITS = 15         # n-grams are hashed into 2 ** 15 columns
FIT_TASKS = 8            # each gives the driver one sum of products
SLICE = 1 << 20          # letters of a text that are hashed at a time
RIDGE = 1e-3
BATCH = 128
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter or a mark on one."""
    return np.array([unicodedata.category(chr(i))[0] in "LM" for i in range(0x110000)])


def _columns(grams: np.ndarray) -> np.ndarray:
    mixed = (grams ^ (grams >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return mixed >> np.uint64(64 - COLUMN_BITS)


def presence(texts: list[str]) -> np.ndarray:
    """Which columns hold n-grams of one to three of each whole text.

    Runs of other signs are one separator, and so are both ends.
    """
    out = np.zeros((len(texts), 1 << COLUMN_BITS), np.float32)
    one, two = np.uint64(21), np.uint64(42)
    for row, text in zip(out, texts, strict=True):
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        signs = np.concatenate(([0], np.where(_letters()[points], points, 0), [0])).astype(np.uint32)
        signs = signs[np.concatenate(([True], (signs[1:] != 0) | (signs[:-1] != 0)))]
        for at in range(0, len(signs), SLICE):
            codes = signs[at : at + SLICE + 2].astype(np.uint64) + np.uint64(1)
            row[_columns(codes)] = 1
            row[_columns(codes[:-1] << one | codes[1:])] = 1
            row[_columns(codes[:-2] << two | codes[1:-1] << one | codes[2:])] = 1
    return out


@dataclass
class Classifier:
    landmarks: np.ndarray       # columns x landmarks, each over the root of its size
    solution: np.ndarray        # landmarks x languages
    languages: list[str]

    def kernel(self, texts: list[str]) -> np.ndarray:
        rows = presence(texts)
        sizes = np.maximum(rows.sum(axis=1, keepdims=True), 1)
        return (rows @ self.landmarks) / np.sqrt(sizes)

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        """One row per text: the language with the highest score, and that score within 0 to 1."""
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        usable = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        for at in range(0, len(usable) if self.languages else 0, BATCH):
            part = usable[at : at + BATCH]
            values = self.kernel([texts[i] for i in part]) @ self.solution
            best = values.argmax(axis=1)
            for i, b, v in zip(part, best, values.max(axis=1), strict=True):
                names[i], scores[i] = self.languages[b], min(1.0, max(0.0, (float(v) + 1) / 2))
        return pd.DataFrame({"lang_pred": names, "score": scores})


def _fit_rows(docs: DataFrame, bound: int, key: str) -> DataFrame:
    """(text, lang) of at most about ``bound`` usable rows, the same number of each language.

    Rows are chosen by key and text, so that the copies of one text aren't all in or all out.
    """
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not counts:
        return usable.select("text", "lang").limit(0)
    each = max(1, bound // len(counts))
    parts = [x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1_000_000, each * 1_000_000 // n)))]
    share = F.element_at(F.create_map(*parts), F.col("lang"))
    place = F.pmod(F.xxhash64(F.col(key).cast("string"), "text"), F.lit(1_000_000))
    return usable.filter(place < share).select("text", "lang")


def _landmarks(rows: DataFrame, each: int) -> np.ndarray:
    """Columns x landmarks: ``each`` different texts of every language, in the order of their hashes."""
    marked = rows.withColumn("mark", F.xxhash64("text", F.lit(1)))
    order = Window.partitionBy("lang").orderBy("mark")
    ranked = marked.select("lang", "mark").distinct().withColumn("rank", F.row_number().over(order))
    chosen = marked.join(F.broadcast(ranked.filter(F.col("rank") <= each)), ["lang", "mark"]).dropDuplicates(["lang", "rank"])

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), BATCH):
                part = batch.iloc[at : at + BATCH]
                held = [np.flatnonzero(row) for row in presence(part["text"].tolist())]
                yield pd.DataFrame({"lang": part["lang"].tolist(), "rank": part["rank"].tolist(), "held": held})

    found = chosen.select("lang", "rank", "text").mapInPandas(places, "lang string, rank int, held array<int>")
    held = [r["held"] for r in sorted(found.collect(), key=lambda r: (r["lang"], r["rank"]))]
    own = np.zeros((1 << COLUMN_BITS, len(held)), np.float32)
    for number, columns in enumerate(held):
        own[columns, number] = 1 / np.sqrt(max(1, len(columns)))
    return own


def fit(docs: DataFrame, bound: int = FIT_ROWS, landmarks: int = LANDMARKS, key: str = "doc_id") -> Classifier:
    """Learn from (key, text, lang) rows. The rows used, the landmarks and the kernel columns are bounded.

    A language counts the same however many of its rows are used; repeated rows are used as often as
    they are there. Rows without a language or a letter are left out.
    """
    rows = stored(_fit_rows(docs, bound, key), "langid")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(counts)
    if not languages:
        return Classifier(np.zeros((1 << COLUMN_BITS, 0), np.float32), np.zeros((0, 0)), [])
    own = _landmarks(rows, max(1, landmarks // len(languages)))
    model = Classifier(own, np.zeros((0, 0)), languages)
    shared = rows.sparkSession.sparkContext.broadcast(model)
    width = own.shape[1]

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram, cross = np.zeros((width, width)), np.zeros((width, len(languages)))
        for batch in batches:
            names, texts = batch["lang"].to_numpy(), batch["text"].tolist()
            for at in range(0, len(texts), BATCH):
                part = names[at : at + BATCH]
                values = shared.value.kernel(texts[at : at + BATCH]).astype(np.float64)
                weighted = values / np.array([counts[n] for n in part])[:, None]
                gram += weighted.T @ values
                cross += weighted.T @ np.where(part[:, None] == np.array(languages, dtype=object)[None, :], 1.0, -1.0)
        yield pd.DataFrame({"gram": [gram.ravel()], "cross": [cross.ravel()]})

    parts = rows.repartition(FIT_TASKS).mapInPandas(sums, "gram array<double>, cross array<double>").collect()
    gram = np.sum([np.array(r["gram"]) for r in parts], axis=0).reshape(width, width)
    cross = np.sum([np.array(r["cross"]) for r in parts], axis=0).reshape(width, len(languages))
    # K = C W^-1 C' : features C W^-1/2, then ridge regression on +1 / -1 for each language
    inner, vectors = np.linalg.eigh((own.T @ own).astype(np.float64))
    root = vectors / np.sqrt(np.maximum(inner, 1e-6 * inner.max())) @ vectors.T
    solution = root @ np.linalg.solve(root @ gram @ root + RIDGE * np.eye(width), root @ cross)
    return Classifier(own, solution.astype(np.float32), languages)


def with_language(docs: DataFrame, model: Classifier, text: str = "text") -> DataFrame:
    """``docs`` with a column ``language`` (lang_pred, score) from the text alone.

    A null text, or one without a letter, is "und" with score 0, and so is every text where
    nothing was learned. Ties go to the language first by name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield shared.value.predict(texts.tolist())

    return docs.withColumn("language", predict(F.col(text)))


def op3_language(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.filter(is_train("doc_id", FOLDS, HELD_OUT)))
    found = with_language(docs.select("doc_id", "text"), model)
    held_out = (bucket_of("doc_id", FOLDS) == HELD_OUT).alias("held_out")
    return found.select("doc_id", held_out, "language.lang_pred", "language.score")
