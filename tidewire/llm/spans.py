"""Where a pattern matches in a text, and trees over features of matches, with DataFrame functions.

Positions are code points. A text is split by the pattern and matched by it; running sums of the
lengths of both give the positions. The sums are taken by doubling, so a text with k matches costs
k log k steps. What stands around a match is taken from the pieces between matches.
"""

from __future__ import annotations

from collections.abc import Callable
from math import inf

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import materialize, spans_text

DOUBLINGS = 30            # as many as a text with 2 ** 31 matches needs
BEFORE, AFTER = 24, 12    # code points kept around a match
MATCH = "array<struct<start:int,end:int,text:string,before:string,after:string>>"
SPAN = "array<struct<kind:string,start:int,end:int>>"
TREES, DEPTH, SEED = 15, 3, 5


def _running_sums(lengths: Column) -> Column:
    shifts = F.transform(F.sequence(F.lit(0), F.lit(DOUBLINGS)), lambda i: F.pow(F.lit(2), i).cast("int"))

    def doubled(sums: Column, shift: Column) -> Column:
        added = F.transform(
            sums, lambda x, i: x + F.when(i >= shift, F.get(sums, i - shift)).otherwise(F.lit(0))
        )
        return F.when(F.size(sums) > shift, added).otherwise(sums)

    return F.aggregate(shifts, lengths, doubled)


def with_matches(df: DataFrame, text: str, pattern: str, guard: Column, out: str) -> DataFrame:
    """``df`` with all leftmost non-overlapping matches of ``pattern`` where ``guard`` is true.

    ``out`` is an array of (start, end, text, before, after); it is empty for a null text.
    """
    found, pieces, ends = f"{out}_found", f"{out}_pieces", f"{out}_ends"
    some = F.size(found) > 0
    matches = F.when(guard, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))
    df = df.withColumn(found, F.coalesce(matches, F.array().cast("array<string>")))
    df = df.withColumn(pieces, F.when(some, F.split(text, pattern, -1)))
    lengths = F.zip_with(
        F.slice(pieces, F.lit(1), F.size(found)), found, lambda a, b: F.length(a) + F.length(b)
    )
    df = df.withColumn(ends, F.when(some, _running_sums(lengths)))
    placed = F.transform(
        found,
        lambda x, i: F.struct(
            (F.get(ends, i) - F.length(x)).alias("start"),
            F.get(ends, i).alias("end"),
            x.alias("text"),
            F.right(F.get(pieces, i), F.lit(BEFORE)).alias("before"),
            F.left(F.get(pieces, i + 1), F.lit(AFTER)).alias("after"),
        ),
    )
    placed = F.when(some, placed).otherwise(F.array().cast(MATCH))
    return df.withColumn(out, placed).drop(found, pieces, ends)


def as_spans(kind: str, matches: Column) -> Column:
    return F.transform(
        matches, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"))
    )


def digest(spans: Column) -> Column:
    """Lower-case SHA-256 of the spans as text."""
    return F.sha2(spans_text(spans), 256)


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _trees(dump: str) -> list[tuple[float, list[str]]]:
    trees: list[tuple[float, list[str]]] = []
    for line in dump.splitlines()[1:]:
        bare = line.strip()
        if bare.startswith("Tree"):
            trees.append((float(bare.split("weight ")[1].rstrip("):")), []))
        elif bare:
            trees[-1][1].append(bare)
    return trees


def _branch(lines: list[str], features: Column) -> Column:
    """The tree at the front of ``lines``, in the order in which Spark prints it."""
    line = lines.pop(0)
    if line.startswith("Predict:"):
        return F.lit(float(line.split(":")[1]))
    _, feature, _, bound = line[line.index("(") + 1 : line.rindex(")")].split()
    low = _branch(lines, features)
    lines.pop(0)    # the matching Else
    high = _branch(lines, features)
    return F.when(F.get(features, F.lit(int(feature))) <= float(bound), low).otherwise(high)


def fit_selector(rows: DataFrame, certainty: float) -> Callable[[Column], Column]:
    """A test of feature arrays: is the calibrated chance of label 1 at least ``certainty``?

    ``rows`` has (label int, features, part 0 to 9) and is bounded. Trees are boosted on parts 0 to
    6; an isotonic curve over their sum on the other parts gives the lowest sum that is certain
    enough. The trees come back as plain expressions, so selecting runs inside the row. With labels
    of one kind, or no calibration rows, nothing is selected.
    """
    table = materialize(rows.dropna().withColumn("label", F.col("label").cast("double")))
    seen = table.groupBy(F.col("part") < 7).agg(F.min("label"), F.max("label")).collect()
    if len(seen) < 2 or any(r[1] == r[2] for r in seen if r[0]):
        return lambda _: F.lit(False)
    model = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=SEED).fit(
        table.filter("part < 7").select(array_to_vector("features").alias("vector"), "label")
    )

    def total(array: Column) -> Column:
        parts = [_branch(list(lines), array) * weight for weight, lines in _trees(model.toDebugString)]
        return sum(parts[1:], parts[0])

    held = table.filter("part >= 7").select(total(F.col("features")).alias("sum"), "label")
    curve = IsotonicRegression(featuresCol="sum", labelCol="label").fit(held)
    sure = [b for b, p in zip(curve.boundaries, curve.predictions, strict=True) if p >= certainty]
    cut = min(sure, default=inf)
    return lambda array: F.lit(False) if cut == inf else total(array) >= cut
