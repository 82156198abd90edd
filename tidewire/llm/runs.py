"""Periodic runs of words: stretches with a period that no neighbouring word extends.

For each period q the words at q, 2 q, 3 q, .. are compared with those q before: every run of that
period has such a pair of equal words in it. How far both sides of a pair go on being equal, forwards and
backwards, gives the run. These lengths come from a difference cover: for any two places some
distance below the cover's modulus leads both to sampled places, so a few words are compared at most, and the
rest is a range minimum over the sorted suffixes of the sampled places alone.

Texts are taken a batch at a time: their words are put behind one another, with an own sign after each text, and
compared by numpy all at once. Suffixes are sorted only for texts in which some comparison gets as far as
sampled places.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import read

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LEAST = 12            # words of the shortest run
# A perfect difference set, each difference modulo 31 occurs once.
COVER, MODULUS = (0, 1, 3, 8, 12, 18), 31
BATCH_WORDS = 1 << 18
GRID_WORDS = 1 << 13  # texts up to here share one stored grid
GRID_PAIRS = 1 << 20  # pairs of a longer text that are compared at once

SCHEMA = (
    "n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string"
)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def repeated_words(words: list[str], h: int) -> list[str]:
    """The words from a place on turned into copies of a short stretch, as the number ``h`` says."""
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    stretch = words[a : a + p]
    return words[:a] + (stretch * ((n - a) // p + 1))[: n - a]


def _grid(low: int, high: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) for the multiples below n of each period in low..high-1."""
    periods = np.arange(low, high)
    counts = (n - 1) // periods
    period = np.repeat(periods, counts)
    first = np.cumsum(counts) - counts
    return (np.arange(len(period)) - np.repeat(first, counts) + 1) * period, period


@lru_cache(1)
def _small_grid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The grid of all periods by place, and how many pairs lie below each place: a prefix serves any n."""
    place, period = _grid(1, GRID_WORDS, GRID_WORDS)
    order = np.argsort(place, kind="stable")
    upto = np.searchsorted(place[order], np.arange(GRID_WORDS + 1))
    return place[order].astype(np.int32), period[order].astype(np.int32), upto


def equal_pairs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of the grid where the word equals that one period before; a run has two periods at least."""
    n = len(ids)
    if n <= GRID_WORDS:
        place, period, upto = _small_grid()
        place, period = place[: upto[n]], period[: upto[n]]
        same = ids[place] == ids[place - period]
        place, period = place[same], period[same]
        short = 2 * period <= n
        return place[short], period[short]
    found, low = [], 1
    while low <= n // 2:
        high = min(n // 2 + 1, low + max(1, GRID_PAIRS * low // n))
        place, period = _grid(low, high, n)
        same = ids[place] == ids[place - period]
        found.append((place[same], period[same]))
        low = high
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


class Suffixes:
    """The sorted suffixes at the cover's places of one or more texts, for common prefixes of two of them.

    ``ids`` holds the texts one after the other, ``starts`` where each begins, and its end. Words are positive.
    """

    def __init__(self, ids: np.ndarray, starts: np.ndarray) -> None:
        sizes = np.diff(starts)
        text = np.repeat(np.arange(len(sizes)), sizes)
        local = np.arange(len(ids)) - starts[text]
        sampled = np.isin(local % MODULUS, COVER)
        places = np.flatnonzero(sampled)
        self.number = np.cumsum(sampled) - 1    # of a sampled place
        ends = starts[text[places] + 1]
        blocks = np.zeros((len(places), MODULUS), np.int64)
        for k in range(MODULUS):
            there = places + k < ends
            blocks[there, k] = ids[places[there] + k]
        following = np.where(places + MODULUS < ends, self.number[np.minimum(places + MODULUS, len(ids) - 1)], -1)
        order = np.lexsort([*blocks.T[::-1], text[places]])
        levels, hops = [self._ranks(order, blocks, text[places])], [following]
        # Ranks by 1, 2, 4, .. blocks: the next block of a sampled place is sampled too.
        while levels[-1].max(initial=0) + 1 < len(places) and (hops[-1] >= 0).any():
            rank, hop = levels[-1], hops[-1]
            key = rank * (len(places) + 1) + np.where(hop >= 0, rank[hop] + 1, 0)
            order = np.argsort(key, kind="stable")
            levels.append(self._ranks(order, key))
            hops.append(np.where(hop >= 0, hop[hop], -1))
        self.rank = np.empty(len(places), np.int64)
        self.rank[order] = np.arange(len(places))
        self.table = [self._neighbours(order, levels, hops, blocks)]
        for k in range(max(0, len(places).bit_length() - 1)):
            below = self.table[-1]
            if len(below) <= 1 << k:
                break
            self.table.append(np.minimum(below[: -(1 << k)], below[1 << k :]))

    @staticmethod
    def _ranks(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
        rank, new = np.zeros(len(order), np.int64), np.zeros(max(0, len(order) - 1), bool)
        for key in keys:
            own = key[order].reshape(len(order), -1)
            new |= (own[1:] != own[:-1]).any(axis=1)
        rank[order[1:]] = np.cumsum(new)
        return rank

    @staticmethod
    def _neighbours(order: np.ndarray, levels, hops, blocks: np.ndarray) -> np.ndarray:
        """Common prefixes, in words, of suffixes that are neighbours in the order."""
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(len(a), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            going = (a >= 0) & (b >= 0)
            same = going & (levels[k][a] == levels[k][b])
            common[same] += MODULUS << k
            a[same], b[same] = hops[k][a[same]], hops[k][b[same]]
        there = (a >= 0) & (b >= 0)
        differ = blocks[a[there]] != blocks[b[there]]
        common[there] += np.where(differ.any(axis=1), differ.argmax(axis=1), MODULUS)
        return common

    def common(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Words in common from sampled places ``one`` and ``two`` (other places) of one text."""
        a, b = self.rank[self.number[one]], self.rank[self.number[two]]
        low, high = np.minimum(a, b), np.maximum(a, b)
        out = np.empty(len(low), np.int64)
        level = np.frexp((high - low).astype(float))[1] - 1
        for k in np.unique(level):
            at = level == k
            row = self.table[k]
            out[at] = np.minimum(row[low[at]], row[high[at] - (1 << int(k))])
        return out


def _to_samples() -> np.ndarray:
    """steps[i, d]: how far a place i and one d further on (modulo the modulus) go to sampled places."""
    steps = np.full((MODULUS, MODULUS), MODULUS)
    for i in range(MODULUS):
        for d in range(MODULUS):
            steps[i, d] = min((c - i) % MODULUS for c in COVER if (c + d) % MODULUS in COVER)
    return steps


TO_SAMPLES = _to_samples()


def common_forward(ids: np.ndarray, starts: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """How many words are equal from places ``one`` and ``two`` (later, of the same text) on.

    ``ids`` has a sign of its own after each text, which ends every comparison; ``starts`` are the begins of
    the texts, and the length of ``ids``.
    """
    out = np.zeros(len(one), np.int64)
    text = np.searchsorted(starts, one, side="right") - 1
    steps = TO_SAMPLES[(one - starts[text]) % MODULUS, (two - one) % MODULUS]
    going, at_samples = np.arange(len(one)), []
    for k in range(MODULUS):
        arrived = steps[going] == k
        at_samples.append(going[arrived])
        going = going[~arrived]
        same = ids[one[going] + k] == ids[two[going] + k]
        out[going[same]] += 1
        going = going[same]
        if not len(going):
            break
    reached = np.concatenate(at_samples)
    if not len(reached):
        return out
    # Only texts with such a pair have their suffixes sorted; a second place may be the sign after the text.
    wanted, own = np.unique(text[reached], return_inverse=True)
    sizes = starts[wanted + 1] - starts[wanted]
    local = np.concatenate([[0], np.cumsum(sizes)])
    parts = np.concatenate([ids[starts[t] : starts[t + 1]] for t in wanted])
    suffixes = Suffixes(parts + (1 - min(0, parts.min())), local)
    moved = local[own] - starts[text[reached]] + steps[reached]
    out[reached] += suffixes.common(one[reached] + moved, two[reached] + moved)
    return out


def runs_of(texts: list[np.ndarray]) -> list[np.ndarray]:
    """(start, length, period) rows of each text's runs, by start and period; texts are arrays of word numbers."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    pairs = [equal_pairs(t) for t in texts]
    text = np.repeat(np.arange(len(texts)), [len(p[0]) for p in pairs])
    if not len(text):
        return [np.zeros((0, 3), np.int64) for _ in texts]
    ids = np.concatenate([x for i, t in enumerate(texts) for x in (t, [-1 - i])]).astype(np.int64)
    place = np.concatenate([p[0] for p in pairs]).astype(np.int64)
    period = np.concatenate([p[1] for p in pairs]).astype(np.int64)
    two = starts[text] + place
    one = two - period
    # Backwards is forwards in the reversed words: each text with its sign, last text first.
    turned = np.concatenate([ids[-2::-1], ids[-1:]])
    turned_starts = np.concatenate([[0], np.cumsum(sizes[::-1] + 1)])
    mirror = starts[text] + sizes[text] - 1
    turned_start = turned_starts[len(texts) - 1 - text]
    forward = common_forward(ids, starts, one, two)
    back = np.zeros(len(one), np.int64)
    # of a pair's two places the later one comes first when reversed, and the word before it is the next one
    back_one, back_two = (turned_start + mirror - p + 1 for p in (two, one))
    inside = place > period
    back[inside] = common_forward(turned, turned_starts, back_one[inside], back_two[inside])
    start, length = place - period - back, period + forward + back
    long_enough = length >= np.maximum(LEAST, 2 * period)
    found = np.stack([text, start, length, period], axis=1)[long_enough]
    found = found[np.lexsort(found.T[[3, 2, 1, 0]])]
    if len(found):    # the same stretch at a multiple of its smallest period
        found = found[np.concatenate([[True], (found[1:, :3] != found[:-1, :3]).any(axis=1)])]
    found = found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]
    cuts = np.searchsorted(found[:, 0], np.arange(1, len(texts)))
    return [part[:, 1:] for part in np.split(found, cuts)]


def _numbered(words: list[str]) -> np.ndarray:
    numbers: dict[str, int] = {}
    return np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def summary(words: list[str], runs: np.ndarray) -> tuple:
    """The digest columns of one text: see ``SCHEMA``."""
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs.tolist())
    dropped = np.zeros(len(words) + 1, np.int64)
    np.add.at(dropped, runs[:, 0] + runs[:, 2], 1)
    np.add.at(dropped, runs[:, 0] + runs[:, 1], -1)
    kept = words if not len(runs) else [w for w, d in zip(words, np.cumsum(dropped).tolist()) if not d]
    best = (None,) * 4
    if len(runs):
        s, n, q = min(runs.tolist(), key=lambda r: (-r[1], r[0], r[2]))
        best = (s, n, q, 1000 * n // q)
    return (len(runs), *best, _sha256(listed), _sha256(" ".join(kept)))


def _together(batch: list[list[str]]) -> Iterator[list[list[str]]]:
    """Neighbouring texts of about ``BATCH_WORDS`` words in all; a longer text is alone."""
    part, total = [], 0
    for words in batch:
        if part and total + len(words) > BATCH_WORDS:
            yield part
            part, total = [], 0
        part.append(words)
        total += len(words)
    if part:
        yield part


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", repeat: bool = False) -> DataFrame:
    """One row per input row: key, and the runs of its whole text (``SCHEMA``).

    ``repeat`` first turns a part of every tenth text into copies of a stretch, by the checksum of its key.
    Null and empty texts have no words; a null key's checksum is that of an empty text. Repeated
    keys stay, other columns are left out. A text of n words takes memory in proportion to n, and time to n log n.
    """

    def find(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hashes, texts in batches:
            rows = []
            lists = (
                repeated_words(words_of(t), int(h)) if repeat else words_of(t) for h, t in zip(hashes, texts)
            )
            for part in _together(lists):
                found = runs_of([_numbered(words) for words in part])
                rows += [summary(words, runs) for words, runs in zip(part, found)]
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({c: "Int64" for c in names[:5]})

    own = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")))
    found = docs.select(F.col(key).alias("key"), F.pandas_udf(find, SCHEMA)(own, F.col(text)).alias("found"))
    return found.select(F.col("key").alias(key), "found.*")


def op12_runs(spark, sf_dir: str) -> DataFrame:
    return periodic_runs(read(spark, sf_dir, "documents"), repeat=True)
