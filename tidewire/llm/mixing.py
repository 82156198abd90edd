"""Mixing sources to target weights by budgets that go down a tree.

The leaves of the tree are the sources of a language of a domain. A node's weight is its share among
its siblings. The budget of tokens goes from the root down: each node gives its children amounts in
proportion to their weights, but none less than ``least`` passes over its texts nor more than
``most``. What a child can't take goes to its siblings, by their weights; only where a whole family
is full does its parent's own family get the rest, because the limits of a node are the sums of
those below it. A leaf then takes whole passes over its texts (epochs) and a part of one more: the
texts in front in a seeded order of that epoch, up to its tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.common import materialize, read, unique_name

SEED = 17
BUDGET = 1.25          # tokens wanted, as a multiple of the tokens there are
LEAST, MOST = 1, 2     # passes over the texts of a leaf
ORDER_BITS = 60
SLICES = 4_096         # parts of a leaf's seeded order that are summed before rows are looked at
BROADCAST_LEAVES = 100_000

# Target shares of the default tree: what isn't listed counts as OTHER. Siblings are normalised.
OTHER = 1.0
TARGETS = {
    "domain": {"d0": 4.0, "d1": 3.0, "d2": 2.0, "d3": 2.0},
    "lang": {"en": 6.0, "de": 2.0, "fr": 2.0, "es": 2.0},
    "source": {},
}
LEVELS = ("domain", "lang", "source")


def domain_of(source: Column) -> Column:
    """Five numbered sources make a domain; sources without a number are the domain "other"."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), r"([0-9]{1,9})$", 1)
    return F.when(number == "", "other").otherwise(
        F.concat(F.lit("d"), F.floor(number.try_cast("int") / 5).cast("string"))
    )


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def _weight(level: str, targets: dict[str, dict[str, float]]) -> Column:
    weight = F.lit(OTHER)
    for value, share in targets.get(level, {}).items():
        weight = F.when(F.col(level) == value, float(share)).otherwise(weight)
    return weight


def _share_out(children: DataFrame, family: list[str]) -> DataFrame:
    """``children`` with ``amount``: the family's ``give``, by weight ``w`` within ``lo`` and ``hi``.

    The sum of clamp(x * w, lo, hi) over a family grows in straight pieces with x; it bends where a
    child leaves its lower limit and where it meets its upper one. Running sums over these places
    give the piece in which the sum is ``give``, and with it x.
    """
    base = Window.partitionBy(*family)
    children = children.withColumn("base", F.sum("lo").over(base))
    places = F.array(
        F.struct((F.col("lo") / F.col("w")).alias("x"), F.col("w").alias("turn")),
        F.struct((F.col("hi") / F.col("w")).alias("x"), (-F.col("w")).alias("turn")),
    )
    bends = children.filter("w > 0 and hi > lo").select(*family, "give", "base", F.explode(places).alias("b"))
    bends = bends.groupBy(*family, "give", "base", F.col("b.x").alias("x")).agg(F.sum("b.turn").alias("turn"))
    order = Window.partitionBy(*family).orderBy("x")
    sofar = order.rowsBetween(Window.unboundedPreceding, 0)
    bends = bends.withColumn("slope", F.sum("turn").over(sofar))
    rise = F.lag("slope").over(order) * (F.col("x") - F.lag("x").over(order))
    bends = bends.withColumn("rise", F.coalesce(rise, F.lit(0.0)))
    bends = bends.withColumn("level", F.col("base") + F.sum("rise").over(sofar))
    last = bends.filter(F.col("level") <= F.col("give")).groupBy(*family, "give").agg(
        F.max_by(F.struct("x", "level", "slope"), "x").alias("at")
    )
    more = F.when(F.col("at.slope") > 1e-9, (F.col("give") - F.col("at.level")) / F.col("at.slope"))
    found = last.select(*family, (F.col("at.x") + F.coalesce(more, F.lit(0.0))).alias("x"))
    clamped = F.least(F.greatest(F.col("x") * F.col("w"), F.col("lo")), F.col("hi"))
    return children.join(found, family, "left").withColumn("amount", F.coalesce(clamped, F.col("lo"))).drop("x", "base")


def leaf_budgets(
    leaves: DataFrame,
    levels: tuple[str, ...] = LEVELS,
    targets: dict[str, dict[str, float]] = TARGETS,
    budget: float = BUDGET,
    least: float = LEAST,
    most: float = MOST,
) -> DataFrame:
    """(levels, tokens, amount) for each leaf; ``leaves`` has the levels (no nulls) and ``tokens``.

    The amounts sum to ``budget`` times all tokens, within ``least`` and ``most`` times all.
    A weight of 0 leaves a node at its lower limit. A leaf table is one row per source: it is small
    beside the documents.
    """
    limits = leaves.withColumns(
        {"lo": F.col("tokens") * float(least), "hi": F.col("tokens") * float(most), "_root": F.lit(0)}
    )
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first()["n"]
    parents = leaves.sparkSession.createDataFrame([(0, total * min(max(budget, least), most))], "_root int, give double")
    family = ["_root"]
    for depth, level in enumerate(levels):
        nodes = limits.groupBy("_root", *levels[: depth + 1]).agg(F.sum("lo").alias("lo"), F.sum("hi").alias("hi"))
        nodes = nodes.withColumn("w", _weight(level, targets)).join(parents, family)
        family = ["_root", *levels[: depth + 1]]
        shared = materialize(_share_out(nodes, family[:-1]))
        parents = shared.select(*family, F.col("amount").alias("give"))
    return leaves.join(parents.drop("_root"), list(levels)).withColumnRenamed("give", "amount")


def _order(epoch: Column, row: Column, seed: int) -> Column:
    """The place of a row in the order of an epoch: a number of ``ORDER_BITS`` bits."""
    digest = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), epoch.cast("string"), row))
    return F.conv(F.left(digest, F.lit(ORDER_BITS // 4)), 16, 10).cast("long")


def _plan(rows: DataFrame, budgets: DataFrame, levels: list[str], seed: int, slices: int) -> DataFrame:
    """(levels, full, cut): whole passes, and the last place of the order that the next one takes."""
    bits = slices.bit_length() - 1
    some = F.col("tokens") > 0
    passes_ = F.floor(F.col("amount") / F.col("tokens") + 1e-9)
    plan = budgets.withColumn("full", F.when(some, passes_).otherwise(F.lit(LEAST)).cast("int"))
    plan = plan.withColumn("rest", F.when(some, F.col("amount") - F.col("full") * F.col("tokens")).otherwise(F.lit(0.0)))
    plan = materialize(plan.select(*levels, "full", "rest"))
    placed = join_leaves(rows, plan, levels)
    placed = placed.withColumn("h", _order(F.col("full"), F.col("row"), seed))
    placed = placed.withColumn("slice", F.shiftright("h", ORDER_BITS - bits).cast("int"))
    sums = placed.groupBy(*levels, "slice", "rest").agg(F.sum("n").alias("n"))
    before = Window.partitionBy(*levels).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    edge = sums.filter((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("n") > F.col("rest")))
    edge = edge.select(*levels, "slice", (F.col("rest") - F.col("before")).alias("left"))
    at_edge = join_leaves(placed, materialize(edge), [*levels, "slice"])
    upto = Window.partitionBy(*levels).orderBy("h").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    taken = at_edge.withColumn("sum", F.sum("n").over(upto)).groupBy(*levels, "slice").agg(
        F.max(F.when(F.col("sum") <= F.col("left"), F.col("h"))).alias("cut")
    )
    start = F.shiftleft(F.col("slice").cast("long"), ORDER_BITS - bits) - 1
    cuts = taken.select(*levels, F.coalesce("cut", start).alias("cut"))
    return plan.drop("rest").join(cuts, levels, "left").withColumn("cut", F.coalesce("cut", F.lit(-1)))


def join_leaves(rows: DataFrame, leaves: DataFrame, on: list[str]) -> DataFrame:
    """Leaves are broadcast while they are few; beyond that large leaves are split by the skew join."""
    few = leaves.count() <= BROADCAST_LEAVES
    return rows.join(F.broadcast(leaves) if few else leaves, on)


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    targets: dict[str, dict[str, float]] = TARGETS,
    budget: float = BUDGET,
    seed: int = SEED,
    slices: int = SLICES,
    epoch: str = "epoch",
) -> DataFrame:
    """``docs`` with a column ``epoch``: each row once for every pass that takes it.

    With the defaults each row is in epoch 0, and some in epoch 1. Null sources and languages are
    leaves of their own. Empty texts have no tokens; they are in all whole passes, and in a part by
    their place. Rows that are equal in key and text have one place, so a part takes all or none of
    them; a part ends before the first text that doesn't fit.
    """
    names = [unique_name(docs, f"_{level}") for level in LEVELS]
    row, cut, full = (unique_name(docs, n) for n in ("_row", "_cut", "_full"))
    filled = {names[0]: domain_of(F.col("source"))}
    filled |= {n: F.coalesce(F.col(c).cast("string"), F.lit("(none)")) for n, c in zip(names[1:], LEVELS[1:], strict=True)}
    own = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text), F.lit(""))))
    rows = docs.withColumns(filled).select(
        *[F.col(n).alias(level) for n, level in zip(names, LEVELS, strict=True)],
        token_count(F.col(text)).alias("n"), own.alias("row"),
    )
    rows = materialize(rows)
    leaves = materialize(rows.groupBy(*LEVELS).agg(F.sum("n").alias("tokens")))
    budgets = leaf_budgets(leaves, LEVELS, targets, budget)
    plan = materialize(_plan(rows, budgets, list(LEVELS), seed, slices))
    plan = plan.select(
        *[F.col(level).alias(n) for n, level in zip(names, LEVELS, strict=True)],
        F.col("full").alias(full), F.col("cut").alias(cut),
    )
    planned = join_leaves(docs.withColumns(filled | {row: own}), plan, names)
    more = (_order(F.col(full), F.col(row), seed) <= F.col(cut)).cast("int")
    passes_ = F.sequence(F.lit(0), F.col(full) + more - 1)
    rest = [c for c in docs.columns if c != epoch]
    chosen = F.when(F.col(full) + more > 0, passes_).otherwise(F.array().cast("array<int>"))
    return planned.select(*rest, F.explode(chosen).alias(epoch))


def mixing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fourth stage of the pipeline: documents as often as their source's budget takes them."""
    epoch = unique_name(docs, "_epoch")
    return mix(docs, epoch=epoch).select(*docs.columns)


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    mixed = mix(docs)
    return mixed.select("doc_id", domain_of(F.col("source")).alias("domain"), "lang", "source", token_count(F.col("text")).alias("tokens"), "epoch")
