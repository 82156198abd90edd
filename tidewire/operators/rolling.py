"""Rolling near-duplicate removal.

Articles of a ticker are taken in order of (date, ord). One is dropped when an article that was
*kept* before it, at most N days earlier, has a cosine of at least T to it and a summary at least
as long. A longer late copy is kept and does not evict the earlier one.

The sequential rule is a fixpoint: an article is kept once everything that could drop it has been
dropped, and dropped once something that could drop it is kept. Each round decides both at once
for all tickers. It compares articles of neighbouring day buckets in bounded tiles and passes on
only a few flags per article, never the pairs, so a crowd of near copies costs no more output than
its own size. Only articles with an open pair take part in the next round.

Tiles of dense vectors are written once, bucketed by tile. Rounds read them where they lie and
bring keys and states to them; no vector is shuffled or stored again. Sparse vectors travel packed, in waves of tiles
whose files go before the next wave; a round ships only articles that still have an open pair.

Same-day copies with the same vector are settled first, without comparing them: only one that is
longer than all the earlier ones can survive.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.operators.lookup import BROADCAST_BYTES, measured_bytes
from tidewire.operators.tiles import (
    BUNDLE_ROWS, DENSE_ROWS, TILE, TOLERANCE, DenseRows, SparseRows, assign_tiles, over_waves,
)
from tidewire.operators.vectors import vector_columns
from tidewire.session import bucketed, materialize, release

KEY = ["ticker", "ord"]
THRESHOLD = 0.70
LOOKBACK_DAYS = 3
TILE_ROWS = 8192
LOCAL_ROWS = 4096      # a ticker with at most this many open articles is finished in one task
SPAN = ["ticker", "span"]
OPEN, KEPT = 0, 1


def comparable_articles(news: DataFrame, vectors: DataFrame) -> DataFrame:
    """Articles that have a vector, reduced to what the comparison needs."""
    day = F.datediff(F.col("date"), F.lit("1970-01-01").cast("date"))
    narrow = news.select(
        *KEY, day.alias("day"), F.length(F.coalesce("summary", F.lit(""))).alias("size")
    )
    return narrow.join(vectors.select(*KEY, *vector_columns(vectors)), KEY)


def settle_copies(items: DataFrame, columns: list[str]) -> DataFrame:
    """Drop same-day articles whose vector equals that of an earlier one at least as long.

    Such an article is always dropped: whatever keeps or drops the earlier copy covers it too.
    Copies are combined map-side into one row per length, and the running minimum sees at most one
    row per distinct length.
    """
    digest = F.unhex(F.sha2(F.to_json(F.struct(*columns)), 256)).alias("_digest")
    firsts = (
        items.select("ticker", "day", digest, "size", "ord")
        .groupBy("ticker", "day", "_digest", "size")
        .agg(F.min("ord").alias("ord"))
    )
    longer = Window.partitionBy("ticker", "day", "_digest").orderBy(F.desc("size"))
    longer = longer.rowsBetween(Window.unboundedPreceding, -1)
    records = firsts.withColumn("_earlier", F.min("ord").over(longer)).filter(
        F.col("_earlier").isNull() | (F.col("ord") < F.col("_earlier"))
    )
    return items.join(records.select(*KEY), KEY, "left_semi")


class _Flags:
    """What a tile learnt about its rows."""

    def __init__(self, frame: pd.DataFrame) -> None:
        self.frame = frame
        self.day, self.ord, self.size, self.status = (frame[c].to_numpy() for c in ("day", "ord", "size", "status"))
        self.waits, self.dropped, self.drops = (np.zeros(len(frame), dtype=bool) for _ in range(3))

    def covers(self, early, late, lookback: int) -> np.ndarray:
        """early x late: may the early article drop the late one, similarity aside?"""
        day_e, ord_e, size_e = (c[early, None] for c in (self.day, self.ord, self.size))
        day_l, ord_l, size_l, status_l = (c[None, late] for c in (self.day, self.ord, self.size, self.status))
        before = (day_e < day_l) | ((day_e == day_l) & (ord_e < ord_l))
        return before & (day_l <= day_e + lookback) & (size_l <= size_e) & (status_l == OPEN)

    def mark(self, early, late, may: np.ndarray) -> None:
        """``may``: early x late rows of which the early one may drop the late one."""
        if may.any():
            kept = (self.status[early] == KEPT)[:, None]
            self.dropped[late] |= (may & kept).any(axis=0)
            self.waits[late] |= (may & ~kept).any(axis=0)
            self.drops[early] |= may.any(axis=1)

    def found(self) -> pd.DataFrame:
        out = self.frame[KEY].assign(waits=self.waits, dropped=self.dropped, drops=self.drops)
        return out[self.waits | self.dropped | self.drops]


def _dense_pairs(
    flags: _Flags, first_rows: int, cross: bool, threshold: float, lookback: int, at_once: int
) -> None:
    """Compare the ``first_rows`` of a tile with all rows, or with ``cross`` with those after the first ones, in blocks."""
    count, since = len(flags.frame), first_rows if cross else 0
    if not first_rows or since == count:
        return
    rows = DenseRows(flags.frame["embedding"])
    two = slice(since, count)
    for start, similar in rows.part(0, first_rows).row_blocks(rows.part(since, count), at_once):
        block = slice(start, start + len(similar))
        similar += TOLERANCE
        near = similar >= threshold
        flags.mark(block, two, near & flags.covers(block, two, lookback))
        flags.mark(two, block, near.T & flags.covers(two, block, lookback))


def _sparse_pairs(flags: _Flags, first_rows: int, cross: bool, threshold: float, lookback: int, at_once: int) -> None:
    """Compare the ``first_rows`` of a tile with all later rows, or with ``cross`` with those after the first ones."""
    frame = flags.frame
    rows = SparseRows.of(frame, threshold)
    day, ord_, size, status = (frame[c].to_numpy() for c in ("day", "ord", "size", "status"))
    for i, others in rows.near(first_rows, cross, at_once):
        if not len(others):
            continue
        first = (day[others] < day[i]) | ((day[others] == day[i]) & (ord_[others] < ord_[i]))
        late_size, early_size = np.where(first, size[i], size[others]), np.where(first, size[others], size[i])
        late_open = np.where(first, status[i], status[others]) == OPEN
        may = late_open & (late_size <= early_size) & (np.abs(day[others] - day[i]) <= lookback)
        others, first = others[may], first[may]
        if not len(others):
            continue
        near = rows.similar(i, others) + TOLERANCE >= threshold
        others, first = others[near], first[near]
        earlier, later = others[first], others[~first]
        kept = status[earlier] == KEPT
        flags.dropped[i] |= kept.any()
        flags.waits[i] |= (~kept).any()
        flags.drops[i] |= len(later) > 0
        flags.drops[earlier] = True
        (flags.dropped if status[i] == KEPT else flags.waits)[later] = True


def compare_tile(threshold: float, lookback: int, columns: list[str], at_once: int = DENSE_ROWS):
    """Function of one tile with its states: flags of the rows that have a pair in it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cross = bool(pdf["low"].iloc[0] != pdf["high"].iloc[0])
        # Pairs within the later bucket belong to the next span, pairs within a bundle to its own tile.
        if cross:
            later = (pdf["slice"] == pdf["high"]).to_numpy()
        else:
            later = (pdf["day"] // (lookback + 1) != pdf["span"]).to_numpy()
        pdf = pdf.iloc[np.argsort(later, kind="stable")].reset_index(drop=True)
        flags, first_rows = _Flags(pdf), int((~later).sum())
        if columns != ["embedding"]:
            _sparse_pairs(flags, first_rows, cross, threshold, lookback, at_once)
        else:
            _dense_pairs(flags, first_rows, cross, threshold, lookback, at_once)
        return flags.found()

    return run


def _by_span(items: DataFrame, columns: list[str], lookback: int) -> DataFrame:
    """Each row in both of its spans.

    Buckets are N+1 days wide, so a pair lies in one bucket or in two neighbouring ones. A span
    holds a bucket and the next one; each row belongs to two spans.
    """
    bucket = F.floor(F.col("day") / (lookback + 1))
    spans = F.explode(F.array(bucket, bucket - 1)).alias("span")
    return items.select(*KEY, "day", "size", *columns, spans)


def _tiled(
    items: DataFrame, columns: list[str], threshold: float, lookback: int, tile_rows: int
) -> DataFrame:
    """Copies of the rows for each tile they take part in."""
    return assign_tiles(_by_span(items, columns, lookback), SPAN, threshold, tile_rows, max(tile_rows, BUNDLE_ROWS))


FLAGS = "ticker string, ord long, waits boolean, dropped boolean, drops boolean"


def first_round(tiles: DataFrame, run) -> DataFrame:
    """Flags while every article is open: the stored tiles are grouped as they lie."""

    def start(pdf: pd.DataFrame) -> pd.DataFrame:
        return run(pdf.assign(status=OPEN))

    return tiles.groupBy(*SPAN, *TILE).applyInPandas(start, FLAGS)


def next_round(tiles: DataFrame, states: DataFrame, run) -> DataFrame:
    """Flags among the articles of ``states`` (ticker, ord, status).

    States are sent to the tiles of their articles; of the tiles only those that get some are read on.
    """
    on = [*SPAN, *TILE]
    placed = materialize(tiles.select(*on, "ord").join(states, KEY))
    busy = placed.select(*on).distinct()
    if measured_bytes(busy) <= BROADCAST_BYTES:
        tiles = tiles.join(F.broadcast(busy), on, "left_semi")

    def go_on(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        active = rows.merge(own[["ord", "status"]], on="ord")
        return run(active) if len(active) else pd.DataFrame(columns=[c.split()[0] for c in FLAGS.split(", ")])

    return tiles.groupBy(*on).cogroup(placed.groupBy(*on)).applyInPandas(go_on, FLAGS)


def finish_ticker(threshold: float, lookback: int, columns: list[str]):
    """Function of one ticker with few open articles: the sequential rule itself."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["day", "ord"], ignore_index=True)
        rows = DenseRows(pdf["embedding"]) if columns == ["embedding"] else SparseRows.of(pdf, threshold)
        kept = pdf["status"].to_numpy() == KEPT
        day, size, dropped = pdf["day"].to_numpy(), pdf["size"].to_numpy(), np.zeros(len(pdf), dtype=bool)
        for i in range(len(pdf)):
            if kept[i]:
                continue
            since = np.searchsorted(day, day[i] - lookback)
            by = since + np.flatnonzero(kept[since:i] & (size[since:i] >= size[i]))
            near = len(by) > 0 and (rows.similar(i, by) + TOLERANCE >= threshold).any()
            dropped[i], kept[i] = near, not near
        return pdf.loc[dropped, KEY]

    return run


def dropped_keys(
    items: DataFrame,
    threshold: float = THRESHOLD,
    lookback: int = LOOKBACK_DAYS,
    tile_rows: int = TILE_ROWS,
    local_rows: int = LOCAL_ROWS,
) -> tuple[DataFrame, int]:
    """(ticker, ord) of the dropped articles among ``items``, and the rounds it took.

    Sparse rows are sent to tiles anew in each round, but only those that still have an open pair.
    """
    columns = vector_columns(items)
    dense = columns == ["embedding"]
    tiles = bucketed(_tiled(items, columns, threshold, lookback, tile_rows), [*SPAN, *TILE]) if dense else None
    active = items.withColumn("status", F.lit(OPEN))
    run = compare_tile(threshold, lookback, columns, min(tile_rows, DENSE_ROWS))
    states = items.select(*KEY, F.lit(OPEN).alias("status"))
    parts, rounds = [], 0
    while True:
        rounds += 1
        if dense:
            found = next_round(tiles, states, run) if rounds > 1 else first_round(tiles, run)
        else:
            if rounds > 1:
                active = materialize(active.drop("status").join(states, KEY))
            found = over_waves(_by_span(active, [*columns, "status"], lookback), SPAN, tile_rows, run, FLAGS)
        flags = found.groupBy(*KEY).agg(*[F.bool_or(c).alias(c) for c in ("waits", "dropped", "drops")])
        # Rows without a flag have no open pair left: they are kept and need no further look.
        is_open = F.col("status") == OPEN
        state = (
            F.when(is_open & F.col("dropped"), "dropped")
            .when(is_open & F.col("waits"), "open")
            .when(is_open & F.col("drops"), "kept")
        )
        decided = materialize(states.join(flags, KEY).withColumn("state", state))
        parts.append(decided.filter("state = 'dropped'").select(*KEY))
        states = decided.filter("state in ('open', 'kept')").select(
            *KEY, F.when(F.col("state") == "open", OPEN).otherwise(KEPT).alias("status")
        )
        load = states.groupBy("ticker").agg(
            F.count("*").alias("n"), F.count_if(F.col("status") == OPEN).alias("open")
        )
        size = load.agg(F.max("n").alias("n"), F.sum("open").alias("open")).first()
        if not size["open"]:
            break
        if size["n"] <= local_rows:    # a bounded rest, however long its chains are
            parts.append(
                items.join(states, KEY).groupBy("ticker").applyInPandas(
                    finish_ticker(threshold, lookback, columns), "ticker string, ord long"
                )
            )
            break
    dropped = parts[0]
    for part in parts[1:]:
        dropped = dropped.unionByName(part)
    return dropped, rounds


def rolling_dedup(
    news: DataFrame,
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    lookback: int = LOOKBACK_DAYS,
    tile_rows: int = TILE_ROWS,
    local_rows: int = LOCAL_ROWS,
) -> DataFrame:
    """The kept articles. ``vectors`` has (ticker, ord) and either ``embedding``, ``packed`` (see ``packing``) or the sparse
    ``ids``/``ws`` (unit vectors, terms in one order for all articles of a ticker, rarest first);
    articles without a vector are kept."""
    columns = vector_columns(vectors)
    compared = comparable_articles(news, vectors)
    if threshold > 0 and columns != ["packed"]:
        compared = compared.filter(F.exists(columns[-1], lambda x: x != 0))   # others: cosine 0
    compared = items = materialize(compared)
    if threshold <= 1 - 1e-6:
        items = materialize(settle_copies(compared, columns))
        if columns != ["embedding"]:    # what is compared from here on are the items; of the others only keys are needed
            compared = materialize(compared.select(*KEY))
            release(news.sparkSession)
    dropped, _ = dropped_keys(items, threshold, lookback, tile_rows, local_rows)
    kept = items.select(*KEY).join(dropped, KEY, "left_anti")
    gone = compared.select(*KEY).join(kept, KEY, "left_anti")
    return news.join(gone, KEY, "left_anti")


def dedup_counts(news: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows in, out and removed per ticker."""
    before = news.groupBy("ticker").agg(F.count("*").alias("input_rows"))
    after = kept.groupBy("ticker").agg(F.count("*").alias("output_rows"))
    out = F.coalesce("output_rows", F.lit(0))
    return before.join(after, "ticker", "left").select(
        "ticker", "input_rows", out.alias("output_rows"),
        (F.col("input_rows") - out).alias("removed_rows"),
    )
