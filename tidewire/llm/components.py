"""Connected components over (u, v) edges of 64-bit ids, by alternating star steps.

Every step hangs neighbours on the lowest id seen, keeps the components as they are, and is stored
before the next, so a lost executor costs one round. Rounds grow with the logarithm of the size of
the largest component. A node with very many neighbours is split by the adaptive skew join, and
minima are combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import materialize


def _hang(edges: DataFrame, large: bool) -> DataFrame:
    if large:
        seen = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        seen = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lowest = seen.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low"))
    hung = seen.join(lowest, "u")
    if large:
        out = hung.filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        others = hung.filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        out = others.unionByName(lowest.select("u", F.col("low").alias("v")))
    return out.filter("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    mix = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.bit_xor(mix), F.sum(F.shiftright(mix, 24))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the lowest id of the component, for every node but that one.

    ``edges`` has columns u and v. Loops and repeated edges are allowed; no edges give no rows.
    """
    current = materialize(edges.select("u", "v").filter("u <> v").distinct())
    before = _state(current)
    while before[0]:
        current = materialize(_hang(_hang(current, large=True), large=False))
        after = _state(current)
        if after == before:
            break
        before = after
    return current.select(F.col("u").alias("node"), F.col("v").alias("component"))
