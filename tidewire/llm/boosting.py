"""Boosted trees with isotonic calibration, fitted on a bounded table of (key, label, features)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import unique_name

TREES, DEPTH, SEED = 20, 3, 11


@dataclass
class CalibratedTrees:
    """A score from 0 to 1 for an array of features; a constant where there was one class only."""

    trees: GBTClassificationModel | None
    curve: IsotonicRegressionModel | None
    constant: float

    def score(self, df: DataFrame, features: str, out: str) -> DataFrame:
        """``df`` with ``out`` added; its other columns keep their names and values."""
        if self.trees is None:
            return df.withColumn(out, F.lit(self.constant))
        vector, raw, odds, label, chance = (
            unique_name(df, n) for n in ("_vector", "_raw", "_odds", "_label", "_chance")
        )
        trees = self.trees.copy().setFeaturesCol(vector).setRawPredictionCol(raw)
        trees = trees.setProbabilityCol(odds).setPredictionCol(label)
        scored = trees.transform(df.withColumn(vector, array_to_vector(F.col(features))))
        scored = scored.withColumn(chance, vector_to_array(F.col(odds))[1]).drop(vector, raw, odds, label)
        if self.curve is None:
            return scored.withColumnRenamed(chance, out)
        curve = self.curve.copy().setFeaturesCol(chance).setPredictionCol(out)
        value = F.least(F.greatest(F.col(out), F.lit(0.0)), F.lit(1.0))
        return curve.transform(scored).withColumn(out, value).drop(chance)


def fit_calibrated(rows: DataFrame, calibrate: Column, trees: int = TREES, depth: int = DEPTH) -> CalibratedTrees:
    """Fit on (label, features): trees where ``calibrate`` is false, the curve where it is true.

    ``rows`` is a bounded, stored table. One class alone, or no rows, gives a constant score; a
    calibration part with one class alone leaves the trees' own probability.
    """
    marked = rows.withColumn("_own", calibrate)
    found = marked.groupBy("_own").agg(F.count("*").alias("n"), F.sum("label").alias("ones")).collect()
    part = {r["_own"]: (r["n"], r["ones"] or 0) for r in found}
    n, ones = part.get(False, (0, 0))
    total, positive = n + part.get(True, (0, 0))[0], ones + part.get(True, (0, 0))[1]
    if not 0 < ones < n:
        return CalibratedTrees(None, None, float(positive) / total if total else 0.0)
    table = marked.withColumn("vector", array_to_vector("features")).withColumn("label", F.col("label").cast("double"))
    model = GBTClassifier(
        featuresCol="vector", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.2,
        minInstancesPerNode=max(1, min(10, n // 100)), seed=SEED, cacheNodeIds=False,
    ).fit(table.filter(~F.col("_own")).select("vector", "label"))
    fitted = CalibratedTrees(model, None, 0.0)
    held, held_ones = part.get(True, (0, 0))
    if 0 < held_ones < held:
        held_rows = fitted.score(table.filter("_own").select("features", "label"), "features", "chance")
        fitted.curve = IsotonicRegression(featuresCol="chance", labelCol="label").fit(held_rows)
    return fitted
