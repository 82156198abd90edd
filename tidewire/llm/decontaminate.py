"""Benchmark passages in training documents, by spaced seeds.

A mask of ones and gaps is laid on every run of words; the words under its ones give one hash, so
words under its gaps may differ. Documents and benchmark items meet where a hash of the same mask is
equal. Each meeting gives a diagonal (place in the document minus place in the item). Along it, the
item is compared word by word: every stretch of at least 80 % equal words is an overlap if it is long
enough by itself, or if its sum, one for each equal word and minus four for each other, is not that of
chance. Overlaps of an item, on one diagonal or several (words put in or left out), are united. All
of it runs in DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import materialize, read, unique_name

# Masks with five ones, so a seed is five words; the gaps are the positions ignored.
MASKS = ("11111", "1101011", "11001101")
SIMILARITY = 0.8
LEAST_WORDS = 20          # an overlap of so many words counts, however long the item
LEAST_SUM = 6             # of a stretch that counts though it isn't enough by itself
BROADCAST_SEEDS = 2_000_000   # seeds that are broadcast (under 64 MB); more are joined by shuffle
BROADCAST_PLACES = 200_000    # likewise for the places to compare


def word_hashes(text: Column) -> Column:
    """A hash of each word: runs of letters and digits, lower-cased."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def with_seeds(df: DataFrame, words: str, place: str = "place", seed: str = "seed") -> DataFrame:
    """``df`` without ``words``, one row for each mask and place: ``place`` in the text and ``seed``."""

    def hash_at(number: int, mask: str):
        ones = [i for i, c in enumerate(mask) if c == "1"]
        return lambda i: F.xxhash64(F.lit(number), *[F.get(F.col(words), i + k) for k in ones])

    arrays, sizes = [], []
    for number, mask in enumerate(MASKS):
        count = F.greatest(F.size(words) - (len(mask) - 1), F.lit(0))
        hashes = F.transform(F.sequence(F.lit(0), count - 1), hash_at(number, mask))
        arrays.append(F.when(count > 0, hashes).otherwise(F.array().cast("array<bigint>")))
        sizes.append(count)
    rest = [c for c in df.columns if c != words]
    laid = df.select(*rest, *[s.alias(f"_n{i}") for i, s in enumerate(sizes[:-1])], F.posexplode(F.concat(*arrays)).alias("_at", seed))
    ends, start = F.lit(0), F.lit(0)
    for i in range(len(MASKS) - 1):
        ends = ends + F.col(f"_n{i}")
        start = F.when(F.col("_at") >= ends, ends).otherwise(start)
    return laid.select(*rest, (F.col("_at") - start).alias(place), seed)


def _runs(flags: Column) -> Column:
    """(first, last, upto) of each run of true flags; ``upto`` counts the true ones to its end."""
    at = lambda i: F.coalesce(F.get(flags, i), F.lit(False))
    places = F.filter(F.transform(flags, lambda f, i: F.when(f, i)), lambda i: i.isNotNull())
    firsts, lasts = F.filter(places, lambda i: ~at(i - 1)), F.filter(places, lambda i: ~at(i + 1))
    ends = lambda one, two: F.struct(
        one.alias("first"), two.alias("last"), F.array_position(places, two).cast("int").alias("upto")
    )
    return F.zip_with(firsts, lasts, ends)


def _stretches(runs: Column, enough: Column) -> Column:
    """(first, last) of the longest stretch from each run on: at least 80 % of its words are equal.

    It has ``enough`` words, or a sum of LEAST_SUM (one for each equal word and minus four for each
    other). Any other stretch lies in one of these.
    """

    def counts(one: Column, two: Column) -> Column:
        equal = two["upto"] - one["upto"] + one["last"] - one["first"] + 1
        length = two["last"] - one["first"] + 1
        total = 5 * equal - 4 * length
        return (length > 0) & ((total >= LEAST_SUM) | ((total >= 0) & (length >= enough)))

    def longest(one: Column) -> Column:
        ends = F.transform(F.filter(runs, lambda two: counts(one, two)), lambda two: two["last"])
        return F.struct(one["first"].alias("first"), F.array_max(ends).alias("last"))

    return F.filter(F.transform(runs, longest), lambda s: s["last"].isNotNull())


def _text_key(text: Column) -> list[Column]:
    filled = F.coalesce(text, F.lit(""))
    return [F.xxhash64(filled).alias("_k1"), F.xxhash64(F.lit("second"), filled).alias("_k2")]


def benchmark_overlaps(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(_k1, _k2, item, overlap, words): what each distinct text shares with each item it shares much with.

    ``overlap`` counts words of the item, ``words`` is its length. Copies of a text are compared once.
    """
    bench = items.select(F.col(item).alias("item"), word_hashes(F.col(item_text)).alias("item_words"))
    bench = materialize(bench.filter(F.size("item_words") >= len(MASKS[0])))
    seeds = materialize(with_seeds(bench, "item_words", "item_place"))
    if seeds.count() <= BROADCAST_SEEDS:
        seeds, bench = F.broadcast(seeds), F.broadcast(bench)

    keyed = docs.select(*_text_key(F.col(text)), F.col(text).alias("_text"))
    laid = with_seeds(keyed.select("_k1", "_k2", word_hashes(F.col("_text")).alias("_words")), "_words")
    met = laid.join(seeds, "seed").select(
        "_k1", "_k2", "item", (F.col("place") - F.col("item_place")).alias("diagonal")
    )
    places = materialize(met.distinct())
    wanted = places.groupBy("_k1", "_k2").agg(F.collect_set(F.struct("item", "diagonal")).alias("places"))
    if places.count() <= BROADCAST_PLACES:
        wanted = F.broadcast(wanted)
    again = keyed.join(wanted, ["_k1", "_k2"]).dropDuplicates(["_k1", "_k2"])
    again = again.select("_k1", "_k2", word_hashes(F.col("_text")).alias("_words"), "places")
    aligned = again.select("_k1", "_k2", "_words", F.explode("places").alias("p")).select(
        "_k1", "_k2", "_words", "p.item", "p.diagonal"
    ).join(bench, "item")
    flags = F.transform(
        "item_words",
        lambda w, i: F.coalesce(F.get(F.col("_words"), i + F.col("diagonal")) == w, F.lit(False)),
    )
    enough = F.least(F.ceil(F.col("words") * SIMILARITY), F.lit(LEAST_WORDS))
    compared = aligned.select("_k1", "_k2", "item", F.size("item_words").alias("words"), flags.alias("flags"))
    runs = compared.select("_k1", "_k2", "item", "words", _runs(F.col("flags")).alias("runs"))
    stretch = runs.select("_k1", "_k2", "item", "words", F.explode(_stretches(F.col("runs"), enough)).alias("s"))
    covered = stretch.groupBy("_k1", "_k2", "item", "words").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set(F.sequence("s.first", "s.last"))))).alias("overlap")
    )
    short = F.col("words") * SIMILARITY <= F.col("overlap")
    return covered.filter((F.col("overlap") >= enough) | short)


def _broadcast_few(found: DataFrame) -> DataFrame:
    """Stored; broadcast while few, so that a text with very many copies is not sent to one task."""
    found = materialize(found)
    return F.broadcast(found) if found.count() <= BROADCAST_PLACES else found


def find_contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, item_id, overlap, words) for each row and item that share a passage.

    That is at least 80 % of an item's words, or 20 of them, in stretches with at least 80 % equal
    words each. Case and punctuation don't count. Null and empty texts share nothing, nor do items
    under five words. Repeated documents and items give repeated rows.
    """
    found = _broadcast_few(benchmark_overlaps(docs, items, text))
    keyed = docs.select(F.col(key).alias("_key"), *_text_key(F.col(text)))
    return keyed.join(found, ["_k1", "_k2"]).select(
        F.col("_key").alias(key), F.col("item").alias("item_id"), "overlap", "words"
    )


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that share no passage with any item."""
    k1, k2 = unique_name(docs, "_c1"), unique_name(docs, "_c2")
    bad = benchmark_overlaps(docs, items, text).select(F.col("_k1").alias(k1), F.col("_k2").alias(k2)).distinct()
    bad = _broadcast_few(bad)
    one, two = _text_key(F.col(text))
    return docs.withColumns({k1: one, k2: two}).join(bad, [k1, k2], "left_anti").select(*docs.columns)


def decontamination_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    return find_contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
