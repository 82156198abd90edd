"""Toxicity by boosted trees over dense features of the whole text, with isotonic calibration.

Features are densities of a lexicon, how near its words stand to the second person, capitals,
punctuation and obfuscated spellings. The lexicon is learned from labelled rows: words, and
beginnings of words, that are far more frequent in toxic texts than in others.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log, log1p

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.boosting import fit_calibrated
from tidewire.llm.common import bucket_of, is_train, materialize, read, unique_name

FOLDS, HELD_OUT = 4, 2
FIT_ROWS = 24_000        # labelled rows that the lexicon, the trees and the curve are fitted on
LEXICON = 4_000          # terms kept
PREFIXES = (4, 5, 6)
TEXTS_AT_ONCE = 64       # texts whose terms are counted together before they leave a task
NEAR = 3                 # words on either side that count as near the second person
THRESHOLD = 0.3

# Second person forms in the languages of the corpus, and letters that signs stand for.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deiner ihr euch euer eure "
    "tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros".split()
)
STANDS_FOR = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})

_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_BROKEN = re.compile(r"[^\W\d_][\d@$!*._|-]+[^\W\d_]")
_LETTERS = re.compile(r"[^\W\d_]+")
_RUN = re.compile(r"([^\W\d_])\1\1")


def _word(chunk: str) -> tuple[str, bool]:
    """The bare lower-case word in a run of non-blanks, and whether it was spelled with signs."""
    core = _EDGES.sub("", chunk).lower()
    if core.isalpha():
        return core, False
    if _BROKEN.search(core):
        return "".join(_LETTERS.findall(core.translate(STANDS_FOR))), True
    return "".join(_LETTERS.findall(core)), False


def _terms(word: str) -> list[str]:
    return [word] + [word[:n] + "*" for n in PREFIXES if len(word) > n]


class _Reader:
    """Features of texts under a lexicon; remembers the words it has met, up to a bound."""

    REMEMBER = 100_000

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.known = lexicon, {}

    def look_up(self, chunk: str) -> tuple[float, bool, bool]:
        word, broken = _word(chunk)
        weight = max((self.lexicon.get(t, 0.0) for t in _terms(word)), default=0.0) if word else 0.0
        if len(self.known) >= self.REMEMBER:
            self.known.clear()
        self.known[chunk] = found = (weight, broken, word in SECOND_PERSON)
        return found

    def features(self, text: str | None) -> list[float]:
        text = text or ""
        chunks = text.split()
        known, look_up = self.known, self.look_up
        seen = [known.get(c) or look_up(c) for c in chunks]
        n = max(1, len(chunks))
        hits = [i for i, s in enumerate(seen) if s[0]]
        persons = [i for i, s in enumerate(seen) if s[2]]
        close = set()
        for i in persons:
            close.update(range(i - NEAR, i + NEAR + 1))
        weights = sorted((seen[i][0] for i in hits), reverse=True)
        broken = sum(1 for s in seen if s[1])
        size = max(1, len(text))
        upper = sum(1 for c in text if c.isupper()) / size
        marks = text.count("!") + text.count("?")
        signs = sum(text.count(c) for c in "#$%&*@^~|")
        return [
            len(hits) / n,
            log1p(len(hits)),
            sum(weights) / n,
            weights[0] if weights else 0.0,
            sum(weights[:5]),
            log1p(len({chunks[i].lower() for i in hits})),
            len(persons) / n,
            log1p(sum(1 for i in hits if i in close)),
            upper,
            sum(1 for c in chunks if len(c) > 2 and c.isupper()) / n,
            marks / size,
            signs / size,
            broken / n,
            log1p(sum(1 for i in hits if seen[i][1])),
            1.0 if _RUN.search(text) else 0.0,
            log1p(len(chunks)),
        ]


def learn_lexicon(rows: DataFrame, size: int = LEXICON) -> dict[str, float]:
    """Log-odds of at most ``size`` terms of (text, label) rows that mark label 1.

    Terms are counted in every row, once a row; what comes to the driver is bounded by ``size``.
    """
    totals = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("ones")).first()
    ones, zeros = totals["ones"], totals["n"] - totals["ones"]
    if not ones:
        return {}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), TEXTS_AT_ONCE):    # bounds the words in memory
                toxic, clean = Counter(), Counter()
                part = batch.iloc[at : at + TEXTS_AT_ONCE]
                for text, label in zip(part["text"], part["label"], strict=True):
                    words = {_word(c)[0] for c in set((text or "").split())}
                    (toxic if label else clean).update({t for w in words if len(w) > 2 for t in _terms(w)})
                yield pd.DataFrame(
                    [(t, toxic[t], clean[t]) for t in toxic.keys() | clean.keys()], columns=["term", "ones", "zeros"]
                )

    counted = rows.select("text", "label").mapInPandas(count, "term string, ones long, zeros long")
    counted = counted.groupBy("term").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
    odds = F.log((F.col("ones") + 0.5) / (ones + 1)) - F.log((F.col("zeros") + 0.5) / (zeros + 1))
    least = max(2, ones // 400)
    best = (
        counted.filter(F.col("ones") >= least)
        .withColumn("odds", odds)
        .filter(F.col("odds") > log(8))
        .orderBy(F.desc(F.col("odds") * F.sqrt("ones")), "term")
        .limit(size)
        .collect()
    )
    return {r["term"]: r["odds"] for r in best}


def labelled_sample(docs: DataFrame, labels: DataFrame, bound: int) -> DataFrame:
    """(text, label, part) of about ``bound`` labelled rows outside the held-out fold, all if fewer.

    The labels are thinned before the join, so the side that is broadcast is bounded. Repeated
    labels of a document count as toxic if one is.
    """
    usable = labels.select("doc_id", F.col("toxic").alias("label")).dropna()
    usable = usable.filter(is_train("doc_id", FOLDS, HELD_OUT)).groupBy("doc_id").agg(F.max("label").alias("label"))
    share = min(1.0, bound / max(1, usable.count()))
    mixed = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000))
    thinned = usable.filter(mixed < int(share * 1_000_000))
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(10)).cast("int")
    return docs.select("doc_id", "text").join(F.broadcast(thinned), "doc_id").select(
        "text", F.col("label").cast("int").alias("label"), part.alias("part")
    )


def with_toxicity(
    docs: DataFrame, labels: DataFrame, out: str = "score", fit_rows: int = FIT_ROWS
) -> DataFrame:
    """``docs`` with a calibrated score from 0 to 1 for every row; nothing else changes.

    The model is fitted on at most about ``fit_rows`` labelled rows: half for the lexicon, three
    tenths for the trees, a fifth for the curve. A null text counts as empty and is scored like any
    other. Without labels every score is 0; with labels of one kind it is their mean.
    """
    rows = materialize(labelled_sample(docs, labels, fit_rows))
    lexicon = learn_lexicon(rows.filter("part < 5"))

    @F.pandas_udf("array<double>")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = _Reader(lexicon)
        for texts in batches:
            yield pd.Series([reader.features(t) for t in texts])

    fitted = materialize(
        rows.filter("part >= 5").select("label", "part", features("text").alias("features")).coalesce(4)
    )
    model = fit_calibrated(fitted, F.col("part") >= 8)
    own = unique_name(docs, "_features")
    return model.score(docs.withColumn(own, features("text")), own, out).drop(own)


def toxicity_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """First stage of the pipeline: documents scored under the threshold stay."""
    score = unique_name(docs, "_score")
    scored = with_toxicity(docs, read(spark, sf_dir, "labels"), score)
    return scored.filter(F.col(score) < THRESHOLD).select(*docs.columns)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_toxicity(docs, read(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id",
        (bucket_of("doc_id", FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
