"""Whitening of embeddings on their leading principal axes, found by a block Jacobi-Davidson method.

Entries become whole numbers, so sums and deviations are exact. The covariance is never formed: a
product with it is one Spark job that centres each vector, multiplies, and adds up matrices of
width x block, whatever the number of rows. The driver holds the search space alone (width x a few
blocks). Each round takes the Ritz pairs of the space, locks the leading ones whose residual has come down
to double precision, and widens the space by the corrections of the others: solutions of the
equation projected onto what is orthogonal to all Ritz vectors, by a few MINRES steps that share
their products.

Rows whose vector is null or holds a null, NaN or infinite entry are left out. Shorter vectors count as if
filled up with zeros. Repeated and null keys stay as they are. Entries beyond 2**62 after scaling count as
2**62; a deviation that doesn't fit a long is null. Directions without variance are no components, so one
vector, or equal ones, have none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import read, stored, unique_name

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
LARGEST = float(1 << 62)
INNER_STEPS = 6      # MINRES steps of a correction
SPACE_BLOCKS = 4     # blocks the search space may hold before it is cut back
ROUNDS = 200
NO_VARIANCE = 1e-11  # of the largest eigenvalue; below it a direction has none
EPS = float(np.finfo(np.float64).eps)

Product = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Centre:
    """Number of rows, and the mean as whole part plus remainder: x - mean loses no digits."""

    n: int
    whole: np.ndarray
    rest: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n x - S) squared, in whole numbers."""
        if not x.size:
            return [0] * len(x)
        gap = x - self.whole
        reach = self.n * (int(np.abs(gap).max()) + 1)
        if reach * reach * x.shape[1] < 1 << 62:
            return ((self.n * gap - self.rest) ** 2).sum(axis=1).tolist()
        exact = ((self.n * gap.astype(object) - self.rest.astype(object)) ** 2).sum(axis=1)
        return [int(v) if v < 1 << 63 else None for v in exact]


@dataclass(frozen=True)
class Axes:
    centre: Centre
    values: np.ndarray     # eigenvalues, falling
    vectors: np.ndarray    # width x components
    trace: float
    residual: float        # the largest norm of V u - e u, over the largest eigenvalue


def whole_numbers(vectors: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """(key, x) with x the scaled entries as bytes of longs, stored; and their common width."""
    odd = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    plain = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    usable = plain.filter(F.col("v").isNotNull() & ~odd)
    width = usable.agg(F.max(F.size("v"))).first()[0] or 0

    def pack(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            packed = []
            for v in batch:
                x = np.full(width, SHIFT, np.int64)
                scaled = np.floor(SCALE * np.asarray(v, np.float64))
                x[: len(scaled)] += np.clip(scaled, -LARGEST, LARGEST).astype(np.int64)
                packed.append(x.tobytes())
            yield pd.Series(packed, dtype=object)

    return stored(usable.select("key", F.pandas_udf(pack, "binary")("v").alias("x")), "whitening"), width


def _matrix(cells: pd.Series, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(cells), np.int64).reshape(len(cells), width)


def centre_of(rows: DataFrame, width: int) -> Centre:
    """Exact sums of every dimension: longs are added within a batch, decimals beyond."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = [0] * width, 0
        for batch in batches:
            x = _matrix(batch["x"], width)
            safe = int(np.abs(x).max(initial=0)) * max(len(x), 1) < 1 << 62
            part = (x if safe else x.astype(object)).sum(axis=0)
            total, n = [a + int(b) for a, b in zip(total, part)], n + len(x)
        at = list(range(-1, width))
        yield pd.DataFrame({"at": at, "total": [Decimal(v) for v in (n, *total)]})

    found = rows.select("x").mapInPandas(sums, "at int, total decimal(38,0)").groupBy("at").agg(F.sum("total").alias("s"))
    by_place = {r["at"]: int(r["s"]) for r in found.collect()}    # one row a dimension
    n = by_place.pop(-1, 0)
    parts = [divmod(by_place[i], n) for i in range(width)] if n else []
    whole, rest = ([p[i] for p in parts] for i in (0, 1))
    return Centre(n, np.array(whole, np.int64), np.array(rest, np.int64))


def _added(rows: DataFrame, shape: tuple[int, int], part: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """The sum over all batches of ``part``, a matrix of ``shape``; a task sends one such matrix."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(shape)
        for batch in batches:
            total += part(_matrix(batch["x"], width))
        yield pd.DataFrame({"at": np.arange(total.size), "value": total.ravel()})

    found = rows.select("x").mapInPandas(sums, "at long, value double").groupBy("at").agg(F.sum("value").alias("value"))
    entries = found.toPandas()
    out = np.zeros(shape[0] * shape[1])
    out[entries["at"].to_numpy()] = entries["value"].to_numpy()
    return out.reshape(shape)


def covariance_product(rows: DataFrame, centre: Centre, width: int) -> Product:
    """q -> V q as one job."""

    def product(q: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            z = centre.centred(x)
            return z.T @ (z @ q)

        return _added(rows, q.shape, part, width) / centre.n

    return product


def _orthonormal(new: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the columns add to the bases; columns that add nothing go."""
    new = new / np.maximum(np.linalg.norm(new, axis=0), np.finfo(float).tiny)
    for _ in range(2):
        for base in bases:
            new = new - base @ (base.T @ new)
    if not new.size:
        return new
    left, sizes, _ = np.linalg.svd(new, full_matrices=False)
    new = left[:, sizes > 1e-10]
    for base in bases:
        new = new - base @ (base.T @ new)
    return np.linalg.qr(new)[0]


def corrections(product: Product, basis: np.ndarray, shifts: np.ndarray, right: np.ndarray, steps: int) -> np.ndarray:
    """Approximate solutions of P (V - shift) P t = right, a column each, by ``steps`` of MINRES.

    P projects out ``basis``, an orthonormal matrix. All columns share a product a step; a column
    whose Krylov space is exhausted stays as it is.
    """

    def projected(t: np.ndarray) -> np.ndarray:
        return t - basis @ (basis.T @ t)

    right = projected(projected(right))
    beta = np.linalg.norm(right, axis=0)
    start, live = beta.copy(), beta > 0
    v, before = right / np.where(live, beta, 1), np.zeros_like(right)
    solution, d_old, d_older = (np.zeros_like(right) for _ in range(3))
    rest, beta = beta, np.zeros_like(beta)
    c_old, c, s_old, s = (np.full_like(beta, x) for x in (1.0, 1.0, 0.0, 0.0))
    for _ in range(steps):
        if not live.any():
            break
        image = projected(product(v) - v * shifts)
        alpha = (v * image).sum(axis=0)
        image = image - alpha * v - beta * before
        following = np.linalg.norm(image, axis=0)
        first, second, third = c * alpha - c_old * s * beta, s * alpha + c_old * c * beta, s_old * beta
        length = np.hypot(first, following)
        live = live & (length > 0)
        safe = np.where(length > 0, length, 1)
        c_old, c, s_old, s = c, first / safe, s, following / safe
        d = (v - third * d_older - second * d_old) / safe
        solution = solution + np.where(live, c * rest, 0) * d
        rest = -s * rest
        live = live & (np.abs(rest) > 1e-3 * start) & (following > 1e-14 * np.abs(shifts))
        before, v = v, np.where(live, image / np.where(following > 0, following, 1), 0)
        beta, d_older, d_old = following, d_old, d
    return solution


def leading_pairs(product: Product, width: int, wanted: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, float]:
    """The ``wanted`` largest eigenvalues of a symmetric positive operator, falling, with unit vectors.

    Also the largest residual norm over the largest eigenvalue. It is brought down to width times the
    machine's precision, or, where rounding in the products keeps it above, as far as it falls.
    """
    wanted = min(wanted, width)
    limit = max(width, 16) * EPS
    start = np.random.default_rng(seed).normal(size=(width, wanted))
    best = np.inf
    for _ in range(3):    # what was locked is proven by fresh products, and refined if need be
        values, vectors = _search(product, _orthonormal(start), wanted, limit)
        image = product(vectors)
        ritz, turn = np.linalg.eigh((vectors.T @ image + image.T @ vectors) / 2)
        values, vectors, image = ritz[::-1], vectors @ turn[:, ::-1], image @ turn[:, ::-1]
        residual = float(np.linalg.norm(image - vectors * values, axis=0).max() / max(values[0], np.finfo(float).tiny))
        if residual <= limit or residual > best / 2:
            break
        best, start = residual, vectors
    return values, vectors, residual


def _search(product: Product, space: np.ndarray, wanted: int, limit: float) -> tuple[np.ndarray, np.ndarray]:
    width, image = len(space), product(space)
    locked, values = np.zeros((width, 0)), []
    largest, last, stalls = 0.0, np.inf, 0
    for _ in range(ROUNDS):
        # Rayleigh-Ritz
        ritz, turn = np.linalg.eigh((space.T @ image + image.T @ space) / 2)
        ritz, turn = ritz[::-1], turn[:, ::-1]
        space, image = space @ turn, image @ turn
        largest = max(largest, float(ritz[0]))
        open_ = wanted - locked.shape[1]
        gaps = image[:, :open_] - space[:, :open_] * ritz[:open_]
        norms = np.linalg.norm(gaps, axis=0)
        # locking, from the largest on; a complete space, or rounding alone, can't be bettered
        whole = locked.shape[1] + space.shape[1] == width
        stalls = stalls + 1 if norms.max(initial=0) > last / 2 else 0
        last = min(last, norms.max(initial=0))
        near = norms <= (limit if stalls < 4 else 1e4 * limit) * largest
        done = open_ if whole else int(np.argmin(near)) if not near.all() else len(near)
        locked, values = np.hstack([locked, space[:, :done]]), [*values, *ritz[:done]]
        if locked.shape[1] == wanted:
            return np.array(values), locked
        space, image, ritz, gaps = space[:, done:], image[:, done:], ritz[done:], gaps[:, done:]
        if done:
            last, stalls = np.inf, 0
        open_ = wanted - locked.shape[1]
        if space.shape[1] + open_ > SPACE_BLOCKS * wanted:
            space, image = space[:, : 2 * wanted], image[:, : 2 * wanted]
        targets = gaps.shape[1]
        found = corrections(product, np.hstack([locked, space[:, :open_]]), ritz[:targets], -gaps, INNER_STEPS)
        new = _orthonormal(np.hstack([found, gaps]) if stalls else found, locked, space)[:, : max(1, open_)]
        if not new.shape[1]:
            draw = np.random.default_rng(locked.shape[1] + space.shape[1]).normal(size=(width, 1))
            new = _orthonormal(draw, locked, space)
        space, image = np.hstack([space, new]), np.hstack([image, product(new)])
    raise RuntimeError(f"{wanted} eigenpairs not found in {ROUNDS} rounds")


def principal_axes(rows: DataFrame, width: int, components: int = COMPONENTS) -> Axes | None:
    """The leading axes of stored ``rows`` (key, x), or None if there is no variance."""
    centre = centre_of(rows, width)
    if not centre.n or not width:
        return None
    trace = float(_added(rows, (1, 1), lambda x: np.array([[(centre.centred(x) ** 2).sum()]]), width)[0, 0]) / centre.n
    if trace == 0:
        return None
    values, vectors, residual = leading_pairs(covariance_product(rows, centre, width), width, components)
    there = values > NO_VARIANCE * values[0]
    return Axes(centre, values[there], vectors[:, there], trace, residual)


def whitened_covariance(rows: DataFrame, axes: Axes) -> np.ndarray:
    """The covariance of the whitened coordinates, from the coordinates themselves."""
    width, k = axes.vectors.shape
    to_white = axes.vectors / np.sqrt(axes.values)

    def part(x: np.ndarray) -> np.ndarray:
        w = axes.centre.centred(x) @ to_white
        return np.vstack([w.T @ w, w.sum(axis=0)])

    total = _added(rows, (k + 1, k), part, width) / axes.centre.n
    return total[:k] - np.outer(total[k], total[k])


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component; see the module's text for odd vectors.

    (key, component, n, deviation, whitened, explained, identity_error)
    """
    kind = vectors.schema[key].dataType.simpleString()
    rows, width = whole_numbers(vectors, key, vector)
    axes = principal_axes(rows, width, components)
    names = [f"`{key}` {kind}", "component int", "n long", "deviation long", "whitened double", "explained double", "identity_error double"]
    if axes is None:
        return vectors.sparkSession.createDataFrame([], ", ".join(names))
    k = len(axes.values)
    to_white, share = axes.vectors / np.sqrt(axes.values), axes.values / axes.trace
    error = float(np.abs(whitened_covariance(rows, axes) - np.eye(k)).max())
    centre = axes.centre

    def project(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = _matrix(batch, width)
            white = centre.centred(x) @ to_white
            yield pd.DataFrame({"deviation": pd.Series(centre.deviations(x), dtype="Int64"), "white": list(white)})

    projected = F.pandas_udf(project, "deviation long, white array<double>")("x")
    own = unique_name(vectors.select(key), "_p")
    exploded = rows.select(F.col("key").alias(key), projected.alias(own)).select(
        key, F.col(f"{own}.deviation").alias("deviation"), F.posexplode(f"{own}.white").alias("component", "whitened")
    )
    parts = F.array(*[F.lit(float(v)) for v in share])
    return exploded.select(
        key, (F.col("component") + 1).cast("int").alias("component"), F.lit(centre.n).cast("long").alias("n"), "deviation",
        "whitened", F.element_at(parts, F.col("component") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings"))
