"""Near-duplicate vectors: spherical k-means cells, and blocked cosine products.

A vector lives in the cell of its nearest centre and visits every other cell whose boundary it is
close to: a pair with cosine c lies 2 - 2c apart (squared), so no boundary between the two is further
from either than the root of that. A pair of two cells therefore meets where the visitors of one cell
to the other meet the visitors of the other, once. This full distance is searched, and no pair can be
missed. A number for ``reach`` searches only so many times the root of (2 - 2c) / d, by which the two
differ in a direction if they differ equally in all d; vectors with a few strong directions lose links by it.

Equal vectors are one node with a weight. The nodes of a cell are packed into blocks of bounded rows and
bytes, one row each, and what moves is a block or its visitors to one cell, never a row per vector. A
task compares two blocks, so no task holds a whole cell: products in single precision, and in double
precision whatever lies within their rounding of the threshold. It reports link counts and the edges of
a spanning forest, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from tidewire.llm.common import materialize, read
from tidewire.llm.components import connected_components

SAMPLE = 20_000          # vectors the centres are fitted on
SAMPLE_BYTES = 64 << 20  # and their size at most, as doubles
PER_CELL = 4_096         # vectors a cell should hold, while there are under MAX_CELLS
MAX_CELLS = 2_048
ROUNDS = 8
BLOCK_ROWS, BLOCK_BYTES = 4_096, 8 << 20    # a block has about so many vectors, and bytes of them as doubles
PRODUCTS = 1 << 22       # cosines computed at a time
OUT_BYTES = 32 << 20     # vectors handed over to Spark at a time
ODD_CELLS = 64           # cells of the vectors that are of another length than most


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1. Scaling by the largest component first keeps the squares in range."""
    rows = np.asarray(rows, dtype=np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def fit_centres(sample: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Spherical k-means: the mean direction of each cell, again and again."""
    rows = _unit(np.asarray(sample, dtype=np.float64))
    rng = np.random.default_rng(seed)
    centres = rows[rng.choice(len(rows), size=min(cells, len(rows)), replace=False)]
    for _ in range(rounds):
        home = np.argmax(rows @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, rows)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.maximum(norms, 1e-300), centres)
    return centres


def _nodes(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """One row per distinct vector that can link: node, size, v (doubles), low (smallest key), n."""
    usable = vectors.select(F.col(key).alias("key"), F.col(vector).alias("v"))
    usable = usable.filter(_can_link("v"))
    grouped = usable.groupBy("v").agg(F.min("key").alias("low"), F.count("*").alias("n"))
    return materialize(
        grouped.select(F.monotonically_increasing_id().alias("node"), F.size("v").alias("size"), "v", "low", "n")
    )


def _can_link(v: str):
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.col(v).isNotNull() & ~odd & F.exists(v, lambda x: x != 0)


def _at_home(nodes: DataFrame, centres: np.ndarray) -> DataFrame:
    """``nodes`` with ``home``, the cell of the nearest centre. Other lengths have cells of their own."""
    length = centres.shape[1]

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            homes = -1 - batch["size"].to_numpy(np.int64) % ODD_CELLS
            fits = np.flatnonzero(batch["size"].to_numpy() == length)
            if len(fits):
                homes[fits] = np.argmax(_unit(np.stack(batch["v"].to_numpy()[fits])) @ centres.T, axis=1)
            yield batch.assign(home=homes)

    return nodes.drop("low").mapInPandas(assign, nodes.drop("low").withColumn("home", F.lit(0).cast("long")).schema)


def _unpacked(vectors: bytes, size: int, kind: str) -> np.ndarray:
    return _unit(np.frombuffer(vectors, kind).reshape(-1, size))


def _blocks(placed: DataFrame, counts: DataFrame, kind: str) -> DataFrame:
    """The nodes of each cell, hashed into its parts, and each part of one length packed into one row."""

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        packed = (np.stack(rows["v"].to_numpy()).astype(kind), rows["node"].to_numpy("<i8"), rows["n"].to_numpy("<i8"))
        return pd.DataFrame([(*key, *(p.tobytes() for p in packed))])

    dealt = placed.join(F.broadcast(counts), placed["home"] == counts["cell"])
    part = F.pmod(F.xxhash64("node"), F.col("parts").cast("long")).cast("int")
    return dealt.groupBy("cell", "parts", "size", part.alias("part")).applyInPandas(
        pack, "cell long, parts int, size int, part int, vectors binary, nodes binary, weights binary"
    )


def _visitors(blocks: DataFrame, centres: np.ndarray, slack: float, kind: str) -> DataFrame:
    """What of each block visits each other cell: (lo, hi, side, other, size, part, vectors, nodes, weights).

    ``lo`` and ``hi`` are the two cells; side 0 is at home in ``lo``. A cell is visited by those for which
    its centre is no further behind their own than ``slack`` lets a neighbour be.
    """
    gaps = np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T)) * slack + 1e-9
    names = ["lo", "hi", "side", "other", "size", "part", "vectors", "nodes", "weights"]

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, held = [], 0
        for batch in batches:
            for cell, size, part, vectors, nodes, weights in zip(
                *(batch[c] for c in ("cell", "size", "part", "vectors", "nodes", "weights")), strict=True
            ):
                near = _unpacked(vectors, size, kind) @ centres.T
                visits = near[:, [cell]] - near <= gaps[cell]
                visits[:, cell] = False
                raw, ids, ns = np.frombuffer(vectors, kind).reshape(-1, size), *(np.frombuffer(x, "<i8") for x in (nodes, weights))
                for other in np.flatnonzero(visits.any(axis=0)):
                    own = visits[:, other]
                    packed = raw[own].tobytes()
                    out.append((
                        min(cell, other), max(cell, other), int(cell > other), other, size, part,
                        packed, ids[own].tobytes(), ns[own].tobytes(),
                    ))
                    held += len(packed)
                    if held > OUT_BYTES:
                        yield pd.DataFrame(out, columns=names)
                        out, held = [], 0
        if out:
            yield pd.DataFrame(out, columns=names)

    fitting = blocks.filter((F.col("cell") >= 0) & (F.col("size") == centres.shape[1]))
    return fitting.mapInPandas(
        visit,
        "lo long, hi long, side int, other long, size int, part int, vectors binary, nodes binary, weights binary",
    )


def _forest(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> pd.DataFrame:
    """Edges that connect the ids that ``near`` (left x right) connects."""
    open_, edges = near.any(axis=1), []
    while open_.any():
        front = np.zeros(len(left), bool)
        front[np.argmax(open_)] = True
        rows, columns = front, np.zeros(len(right), bool)
        while front.any():
            columns = columns | near[front].any(axis=0)
            front = near[:, columns].any(axis=1) & ~rows
            rows = rows | front
        open_ &= ~rows
        own = np.unique(np.concatenate((left[rows], right[columns])))
        edges += [(x, own[0]) for x in own[1:]]
    return pd.DataFrame(edges, columns=["u", "v"], dtype="int64")


def _near(left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which unit rows have a cosine of ``threshold`` or more, as products in double precision say."""
    near = left.astype(np.float32) @ right.astype(np.float32).T
    rounding = (left.shape[1] + 8) * 2.0**-23
    linked = near >= threshold
    unsure, others = np.nonzero(np.abs(near - np.float32(threshold)) <= rounding)
    step = max(1, PRODUCTS // left.shape[1])
    for at in range(0, len(unsure), step):
        i, j = unsure[at : at + step], others[at : at + step]
        linked[i, j] = np.einsum("ij,ij->i", left[i], right[j]) >= threshold
    return linked


def _tile(rows: pd.DataFrame, threshold: float, kind: str) -> pd.DataFrame:
    """Link counts and forest edges between the two blocks of a tile, or inside its only one."""
    rows = rows.sort_values("side")
    size = int(rows["size"].iloc[0])
    units = [_unpacked(v, size, kind) for v in rows["vectors"]]
    nodes, weights = ([np.frombuffer(x, "<i8") for x in rows[c]] for c in ("nodes", "weights"))
    alone = bool(rows["alone"].iloc[0])
    if not alone and len(units) < 2:
        return pd.DataFrame({"u": [], "v": [], "n": []}, dtype="int64")
    left, right = units[0], units[-1]
    near = np.empty((len(left), len(right)), bool)
    to_left, to_right = np.zeros(len(left)), np.zeros(len(right))
    step = max(1, PRODUCTS // len(right))
    for at in range(0, len(left), step):
        part = slice(at, min(len(left), at + step))
        near[part] = _near(left[part], right, threshold)
        if alone:
            near[np.arange(part.start, part.stop), np.arange(part.start, part.stop)] = False
        if near[part].any():
            linked = near[part].astype(np.float64)
            to_left[part] = linked @ weights[-1]
            if not alone:
                to_right += weights[0][part] @ linked
    counts = pd.DataFrame({"u": np.concatenate((nodes[0], nodes[-1])), "n": np.concatenate((to_left, to_right))})
    counts = counts[counts["n"] > 0].assign(v=lambda d: d["u"])
    own, other = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    edges = _forest(near[np.ix_(own, other)], nodes[0][own], nodes[-1][other]).assign(n=0)
    return pd.concat([counts, edges], ignore_index=True)[["u", "v", "n"]].astype("int64")


def embedding_links(
    nodes: DataFrame, centres: np.ndarray, threshold: float, reach: float | None, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(u, v, n): for u = v a weight that node u links with, else an edge with n = 0."""
    apart = np.sqrt(max(0.0, 2 - 2 * threshold))
    slack = apart if reach is None else min(apart, reach * apart / np.sqrt(centres.shape[1]))
    kind = "<f4" if isinstance(nodes.schema["v"].dataType.elementType, FloatType) else "<f8"
    placed = materialize(_at_home(nodes, centres))
    # at most MAX_CELLS + ODD_CELLS rows
    parts = F.greatest(F.count("*") / block_rows, F.sum(F.col("size").cast("long")) * 8 / BLOCK_BYTES)
    counts = materialize(placed.groupBy(F.col("home").alias("cell")).agg(F.ceil(parts).cast("int").alias("parts")))
    blocks = materialize(_blocks(placed, counts, kind))
    data = ["size", "vectors", "nodes", "weights"]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    inside = blocks.withColumn("r", every("parts")).select(
        F.col("cell").alias("lo"), F.col("cell").alias("hi"), F.least("part", "r").alias("one"),
        F.greatest("part", "r").alias("two"), (F.col("part") > F.col("r")).cast("int").alias("side"),
        (F.col("part") == F.col("r")).alias("alone"), *data,
    )
    visits = _visitors(blocks, centres, slack, kind)
    between = visits.join(F.broadcast(counts), visits["other"] == counts["cell"]).withColumn("r", every("parts")).select(
        "lo", "hi", F.when(F.col("side") == 0, F.col("part")).otherwise(F.col("r")).alias("one"),
        F.when(F.col("side") == 0, F.col("r")).otherwise(F.col("part")).alias("two"), "side",
        F.lit(False).alias("alone"), *data,
    )
    compare = lambda rows: _tile(rows, threshold, kind)
    tiles = inside.unionByName(between).groupBy("lo", "hi", "size", "one", "two")
    return tiles.applyInPandas(compare, "u long, v long, n long")


def embedding_duplicates(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    threshold: float = 0.9,
    reach: float | None = None,
    sample: int = SAMPLE,
) -> DataFrame:
    """(key, n_links, component_id, kept) for every row of ``vectors``.

    Null or zero vectors, and those with a null, NaN or infinite component, link with nothing.
    Vectors of different lengths never link. Repeated rows link with each other. A null key is
    never the smallest of a component unless it is alone; an empty table gives no rows. The centres
    are fitted on at most ``sample`` vectors in hash order (fewer if they are so long that these would pass
    SAMPLE_BYTES); every vector is assigned and compared.
    """
    nodes = _nodes(vectors, key, vector)
    total = nodes.count()
    if total:
        length = nodes.groupBy("size").count().orderBy(F.desc("count"), "size").first()["size"]
        sample = max(1, min(sample, SAMPLE_BYTES // (8 * length)))
        fitted = nodes.filter(F.col("size") == length).orderBy(F.xxhash64("v"), "node").limit(sample)
        rows = np.array([r["v"] for r in fitted.select("v").collect()], dtype=np.float64)
        cells = min(MAX_CELLS, max(1, -(-total // PER_CELL)))
        found = materialize(embedding_links(nodes, fit_centres(rows, cells), threshold, reach))
        links = found.filter("u = v").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("links"))
        components = connected_components(found.filter("u <> v").select("u", "v"))
        rooted = nodes.join(components, "node", "left").join(links, "node", "left")
        rooted = rooted.withColumn("component", F.coalesce("component", "node"))
        lowest = rooted.groupBy("component").agg(F.min("low").alias("component_id"))
        answer = rooted.join(lowest, "component").select(
            "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"
        )
    else:
        answer = nodes.select("v", F.lit(0).cast("long").alias("n_links"), F.col("low").alias("component_id"))
    own = vectors.select(F.col(key).alias("key"), F.col(vector).alias("v"))
    own = own.withColumn("v", F.when(_can_link("v"), F.col("v")))
    return own.join(answer, "v", "left").select(
        F.col("key").alias(key),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("component_id", "key").alias("component_id"),
        F.col("key").eqNullSafe(F.coalesce("component_id", "key")).alias("kept"),
    )


def op9_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return embedding_duplicates(read(spark, sf_dir, "embeddings"))
