"""Near-duplicates by SimHash fingerprints, found over the anchors of a covering code.

A Hamming code of length 63 has covering radius 1: every string of 63 bits lies within one bit of
exactly one code word. With the last bit free, its words are the anchors. Two fingerprints that
differ in ``t`` bits have a middle point at most ceil(t / 2) bits from both, and some anchor within
1 of that. So each fingerprint is copied to all anchors within ``1 + ceil(t / 2)`` bits (within the
covering radius plus the threshold; the nearer half of it is enough), and both meet at one of them.
Only fingerprints that share an anchor are compared. The fingerprints of one anchor lie within
that radius of it, so for ``t`` = 2 there are at most 2,081 of them, whatever the skew.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.common import materialize, read, stored, unique_name
from tidewire.llm.components import connected_components
from tidewire.operators.lookup import lookup_join

BITS = 64
CHUNK = 1 << 16      # hashes that are unpacked together
WORDS = 5            # 64-bit words of the long fingerprint
SHARE = 0.8          # of their shingles that near copies have in common
BLOCK = 1 << 16      # nodes of an anchor that are compared with as many others in one task
GOLAY, GOLAY_BITS = 0b101011100011, 23    # generator of the perfect Golay code, and its length
PAIRS = 1 << 21      # pairs whose bits are counted at once
_masks = None
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_shingle_hashes(df: DataFrame, text: str, width: int, out: str) -> DataFrame:
    """XXH64 (seed 42) of each run of ``width`` words, A-Z lower-cased; repeats stay.

    Fewer words give one hash of all of them; none give an empty array, as does a null text.
    """
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    words = F.filter(F.split(lower, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    split = df.withColumn(out, words)    # on its own, so that it is evaluated once a row
    last = F.greatest(F.size(out) - width, F.lit(0))
    hashes = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.xxhash64(F.array_join(F.slice(F.col(out), i + 1, F.lit(width)), " ")),
    )
    return split.withColumn(out, F.when(F.size(out) > 0, hashes).otherwise(F.array().cast("array<bigint>")))


def _majority(hashes: np.ndarray) -> int:
    """The bits that are set in more than half of the hashes, as a signed 64-bit number."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = np.ascontiguousarray(hashes[at : at + CHUNK], dtype="<i8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def with_fingerprint(
    df: DataFrame, text: str = "text", width: int = 3, out: str = "fingerprint"
) -> DataFrame:
    """``df`` with the 64-bit SimHash of the whole text. No words, or null: 0."""

    @F.pandas_udf("bigint")
    def fingerprint(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for hashes in batches:
            yield pd.Series([_majority(np.asarray(h)) for h in hashes], dtype="int64")

    shingled = with_shingle_hashes(df, text, width, out)
    return shingled.withColumn(out, fingerprint(F.col(out)))


def _flips(syndrome: int, bits: int, reach: int) -> list[int]:
    """The masks of at most ``reach`` bits that turn a word of this syndrome into a code word.

    Bit i (from 0) has the number i + 1, but the last bit is free. The syndrome of a word is the xor
    of the numbers of its set bits, and 0 exactly for code words; so the numbers turned xor to it.
    """
    found = []
    for free in (0, 1):
        for weight in range(reach - free + 1):
            for picks in combinations(range(1, bits), weight):
                value = 0
                for number in picks:
                    value ^= number
                if value == syndrome:
                    found.append(sum(1 << (number - 1) for number in picks) | free << (bits - 1))
    return found


def _anchors(words: np.ndarray, bits: int, reach: int) -> np.ndarray:
    """(len(words), k) anchors within ``reach`` bits of each word; unused places repeat the first."""
    low = words.view(np.uint8).reshape(-1, 8)
    signs = np.unpackbits(low, axis=1, bitorder="little")[:, : bits - 1]
    syndrome = np.bitwise_xor.reduce(np.where(signs, np.arange(1, bits), 0), axis=1)
    table = [_flips(value, bits, reach) for value in range(bits)]
    width = max(map(len, table))
    masks = np.array([t + [t[0]] * (width - len(t)) for t in table], dtype=np.uint64)
    return words.view(np.uint64)[:, None] ^ masks[syndrome]


def _copies(words: np.ndarray, bits: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, place of the word) of every copy."""
    anchors = _anchors(np.ascontiguousarray(words), bits, reach)
    first = np.ones(anchors.shape, bool)
    first[:, 1:] = anchors[:, 1:] != anchors[:, :1]
    return anchors[first].view(np.int64), np.repeat(np.arange(len(words)), first.sum(axis=1))


def _forest(members: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Edges that connect what ``threshold`` links, one less than the size of each component."""
    near = np.bitwise_count(members[:, None] ^ members[None, :]) <= threshold
    open_, edges = np.ones(len(members), bool), []
    while open_.any():
        root = int(np.argmax(open_))
        reached = front = np.zeros(len(members), bool)
        reached[root] = True
        front = reached.copy()
        while front.any():
            new = near[front].any(axis=0) & ~reached
            reached |= new
            front = new
        open_ &= ~reached
        signed = members[reached].view(np.int64)
        edges += [(int(x), int(signed.min())) for x in signed if x != signed.min()]
    return edges


def fingerprint_links(fingerprints: DataFrame, threshold: int = 2) -> DataFrame:
    """(u, v) edges over distinct fingerprints whose components are those of all links.

    ``fingerprints`` has one column, ``fingerprint``, without repeats.
    """
    reach = 1 + -(-threshold // 2)

    def copies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = batch["fingerprint"].to_numpy(np.int64)
            for at in range(0, len(own), CHUNK >> 4):
                part = own[at : at + (CHUNK >> 4)]
                anchors, places = _copies(part, BITS, reach)
                yield pd.DataFrame({"anchor": anchors, "fingerprint": part[places]})

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [
                e for m in batch["members"] for e in _forest(np.asarray(m, np.int64).view(np.uint64), threshold)
            ]
            yield pd.DataFrame(found, columns=["u", "v"]).astype("int64").drop_duplicates()

    spread = fingerprints.mapInPandas(copies, "anchor bigint, fingerprint bigint")
    shared = (
        spread.groupBy("anchor")
        .agg(F.collect_list("fingerprint").alias("members"))
        .filter(F.size("members") > 1)
    )
    return shared.select("members").mapInPandas(compare, "u bigint, v bigint").distinct()


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    width: int = 3,
    threshold: int = 2,
) -> DataFrame:
    """(key, fingerprint bigint, component_id): the smallest key reachable over links.

    One row per input row. Texts without words have fingerprint 0 and link like others. A null key
    gets a component like any row, whose smallest key it can't be unless all keys there are null.
    Repeated keys stay. Equal fingerprints are one node, so exact copies cost no comparison.
    """
    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    marked = materialize(with_fingerprint(narrow, "text", width).drop("text"))
    nodes = materialize(marked.groupBy("fingerprint").agg(F.min("key").alias("low")))
    components = connected_components(fingerprint_links(nodes.select("fingerprint"), threshold))
    rooted = nodes.join(
        components.withColumnRenamed("node", "fingerprint"), "fingerprint", "left"
    ).withColumn("component", F.coalesce("component", "fingerprint"))
    lowest = rooted.groupBy("component").agg(F.min("low").alias("component_id"))
    of_node = rooted.join(lowest, "component").select("fingerprint", "component_id")
    return marked.join(of_node, "fingerprint").select(
        F.col("key").alias(key), "fingerprint", "component_id"
    )


def _longer(hashes: np.ndarray, words: int) -> np.ndarray:
    """``words`` fingerprints of the shingles, each from another mixing of their hashes."""
    out = np.empty(words, np.int64)
    values = np.asarray(hashes).astype(np.uint64)
    for i in range(words):
        mixed = (values ^ (values >> np.uint64(31))) * np.uint64(2 * (0x9E3779B97F4A7C15 >> (i + 1)) + 1)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out[i] = _majority((mixed ^ (mixed >> np.uint64(32))).view(np.int64))
    return out


def _golay_masks(reach: int) -> np.ndarray:
    """(2048, k) masks of at most ``reach`` bits that turn a word of each syndrome into an anchor.

    Anchors are the words whose low 23 bits are in the perfect Golay code, of covering radius 3; bit 23 is
    free. Unused places repeat the first mask.
    """
    signs = [_golay_syndrome(1 << i) for i in range(GOLAY_BITS)]
    found: list[list[int]] = [[] for _ in range(1 << 11)]
    for free in (0, 1):
        for weight in range(reach - free + 1):
            for picks in combinations(range(GOLAY_BITS), weight):
                syndrome = 0
                for i in picks:
                    syndrome ^= signs[i]
                found[syndrome].append(sum(1 << i for i in picks) | free << GOLAY_BITS)
    width = max(map(len, found))
    return np.array([f + [f[0]] * (width - len(f)) for f in found], dtype=np.uint32)


def _golay_syndrome(word: int) -> int:
    """The remainder of a word of 23 bits, as a polynomial, by the generator."""
    for i in range(GOLAY_BITS - 1, 10, -1):
        if word >> i & 1:
            word ^= GOLAY << (i - 11)
    return word


def golay_anchors(words: np.ndarray) -> np.ndarray:
    """(len(words), k) anchors near each word of 24 bits: words up to 2 bits apart share one.

    The middle of the two is within 1 bit of both and within 3 of an anchor, so 4 bits reach it.
    """
    global _masks
    if _masks is None:
        _masks = _golay_masks(4), np.array([_golay_syndrome(1 << i) for i in range(GOLAY_BITS)], np.uint16)
    masks, signs = _masks
    syndrome = np.zeros(len(words), np.uint16)
    for i in range(GOLAY_BITS):
        syndrome ^= np.where(words >> np.uint32(i) & np.uint32(1), signs[i], 0).astype(np.uint16)
    return words[:, None] ^ masks[syndrome]


def _cuts(words: np.ndarray) -> np.ndarray:
    """The blocks of 24 bits of long fingerprints, (rows, words) 64-bit numbers."""
    raw = np.ascontiguousarray(words, dtype="<i8").view(np.uint8)
    raw = raw[:, : raw.shape[1] // 3 * 3].reshape(len(raw), -1, 3).astype(np.uint32)
    return raw[:, :, 0] | raw[:, :, 1] << np.uint32(8) | raw[:, :, 2] << np.uint32(16)


def _most_bits(similarity: float, bits: int) -> int:
    """Bits in which fingerprints of that cosine differ at most, but for one pair in 200."""
    chance = np.arccos(similarity) / np.pi
    return int(bits * chance + 2.6 * np.sqrt(bits * chance * (1 - chance)))


def _near_edges(ids: np.ndarray, words: np.ndarray, side: np.ndarray, most: int) -> list[tuple[int, int, int]]:
    """(u, v, bits) of near pairs: a tree of fewest bits over each component of what is near.

    It holds the nearest one of each row, and is the same wherever the same rows meet. Rows of equal ``side``
    above 0 don't meet.
    """
    step = max(1, PAIRS // len(ids))
    linked = np.zeros(len(ids), bool)
    for at in range(0, len(ids), step):
        part = slice(at, min(len(ids), at + step))
        bits = np.bitwise_count(words[part, None, :] ^ words[None, :, :]).sum(axis=2, dtype=np.uint16)
        bits[np.arange(bits.shape[0]), np.arange(part.start, part.stop)] = most + 1
        bits[(side[part, None] == side[None, :]) & (side[part, None] > 0)] = most + 1
        linked[part] = (bits <= most).any(axis=1)
    left, edges = np.flatnonzero(linked), []
    reach, parent = np.full(len(left), most + 1), np.zeros(len(left), np.int64)
    while len(left):
        k = int(np.argmin(reach))
        row = left[k]
        if reach[k] <= most:
            other = parent[k]
            edges.append((int(min(ids[row], ids[other])), int(max(ids[row], ids[other])), int(reach[k])))
        keep = np.arange(len(left)) != k
        left, reach, parent = left[keep], reach[keep], parent[keep]
        bits = np.bitwise_count(words[left] ^ words[row]).sum(axis=1)
        closer = (bits < reach) & ((side[left] != side[row]) | (side[left] == 0))
        reach[closer], parent[closer] = bits[closer], row
    return edges


def similar_links(nodes: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """(u, v, bits) candidates over nodes (node, words), whose components are those of all pairs found near.

    ``words`` is a long fingerprint. Each block of 24 bits is copied to the anchors near it, with the last two
    words; nodes that share an anchor are near if these differ in no more bits than the cosine
    ``similarity`` lets expect. More than ``block`` nodes of an anchor are cut into parts, whose pairs are
    compared apart.
    """

    def copies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), CHUNK >> 5):
                part = batch.iloc[at : at + (CHUNK >> 5)]
                words, own = np.stack(part["words"].to_numpy()).astype(np.int64), part["node"].to_numpy()
                for number, cut in enumerate(_cuts(words).T):
                    anchors = golay_anchors(cut)
                    first = np.ones(anchors.shape, bool)
                    first[:, 1:] = anchors[:, 1:] != anchors[:, :1]
                    places = np.repeat(np.arange(len(own)), first.sum(axis=1))
                    yield pd.DataFrame({
                        "anchor": anchors[first].astype(np.int64) | number << 24, "node": own[places],
                        "one": words[places, -2], "two": words[places, -1],
                    })

    most = _most_bits(similarity, 2 * BITS)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for nodes, ones, twos, sides in zip(batch["nodes"], batch["ones"], batch["twos"], batch["sides"]):
                words = np.stack([ones, twos], axis=1).astype(np.int64).view(np.uint64)
                ids = np.asarray(nodes, np.int64)
                found += _near_edges(ids, words, np.asarray(sides, np.int64), most)
            yield pd.DataFrame(found, columns=["u", "v", "bits"]).astype({"u": "int64", "v": "int64", "bits": "int32"})

    spread = nodes.mapInPandas(copies, "anchor bigint, node bigint, one bigint, two bigint")
    crowded = materialize(spread.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > block))
    parts = F.coalesce(F.ceil(F.col("n") / block), F.lit(1)).cast("int")
    cut = lookup_join(spread, crowded, ["anchor"], salt_by=["node"]).withColumn("parts", parts)
    own = F.pmod(F.xxhash64("node"), F.col("parts").cast("long")).cast("int")
    paired = cut.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # in a tile of two parts only rows of different parts meet; alone, a part's rows have side 0
    low, high = F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")
    tiled = paired.select("anchor", low, high, "node", "one", "two", F.when(low != high, F.col("own") + 1).otherwise(0).alias("side"))
    lists = [F.collect_list(c).alias(f"{c}s") for c in ("node", "one", "two", "side")]
    # dealt as narrow rows; lists of single nodes made before the shuffle would be several times as large
    dealt = tiled.repartition("anchor", "low", "high")
    members = dealt.groupBy("anchor", "low", "high").agg(*lists).filter(F.size("nodes") > 1)
    found = members.mapInPandas(compare, "u bigint, v bigint, bits int")
    return found.groupBy("u", "v").agg(F.min("bits").alias("bits"))


def proven_components(candidates: DataFrame, sets: DataFrame, share: float) -> DataFrame:
    """(node, component) of the candidates (u, v, bits) that do have ``share`` of their shingles in common.

    ``sets`` has node and h, its distinct shingles. Each node's nearest candidate is looked at first; after that
    the candidates between components that these leave apart, which are joined as nodes of a smaller graph. As
    in ``connected_components``, the lowest id of a component names it and has no row.
    """

    def proven(pairs: DataFrame) -> DataFrame:
        one = pairs.join(sets.select(F.col("node").alias("u"), F.col("h").alias("h_u")), "u")
        two = one.join(sets.select(F.col("node").alias("v"), F.col("h").alias("h_v")), "v")
        common = F.size(F.array_intersect("h_u", "h_v"))
        return two.filter(common >= share * (F.size("h_u") + F.size("h_v") - common)).select(*pairs.columns)

    both = candidates.unionByName(candidates.select(F.col("v").alias("u"), F.col("u").alias("v"), "bits"))
    nearest = both.groupBy("u").agg(F.min(F.struct("bits", "v")).alias("x"))
    first = materialize(nearest.select(F.least("u", "x.v").alias("u"), F.greatest("u", "x.v").alias("v")).distinct())
    labels, rest = connected_components(proven(first)), candidates.select("u", "v").join(first, ["u", "v"], "left_anti")
    for end in ("u", "v"):
        named = labels.select(F.col("node").alias(end), F.col("component").alias(f"label_{end}"))
        rest = lookup_join(rest, named, [end]).withColumn(f"label_{end}", F.coalesce(f"label_{end}", end))
    apart = proven(rest.filter("label_u <> label_v")).select(F.col("label_u").alias("u"), F.col("label_v").alias("v"))
    tops = connected_components(apart)
    top = tops.select(F.col("node").alias("component"), F.col("component").alias("top"))
    raised = lookup_join(labels, top, ["component"], salt_by=["node"])
    return raised.select("node", F.coalesce("top", "component").alias("component")).unionByName(tops)


def one_of_each(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, share: float = SHARE, words: int = WORDS,
) -> DataFrame:
    """``docs`` with one row of each group of near copies: the one of the smallest key.

    Texts are linked that have ``share`` or more of their different shingles of ``width`` words in common.
    Fingerprints of ``words`` times 64 bits propose them over anchors, and shingles prove them; of pairs that
    are just so alike about 98 % are proposed, and more the more alike they are. Texts without words are one group, as
    are texts of one fingerprint. Of rows of one key and text, one stays; a null key comes after all
    others. Other columns are kept as they are.
    """
    own, digest = F.col(key).alias("key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("digest")

    @F.pandas_udf("array<bigint>")
    def long_fingerprint(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for hashes in batches:
            yield pd.Series([_longer(h, words) for h in hashes])

    narrow = docs.select(own, digest, F.col(text).alias("text"))
    marked = with_shingle_hashes(narrow, "text", width, "h").select("key", "digest", long_fingerprint("h").alias("words"))
    marked = materialize(marked)
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "digest"))
    nodes = materialize(
        marked.groupBy("words").agg(first.alias("low")).withColumn("node", F.monotonically_increasing_id())
    )
    # The cosine of shingle counts of which ``share`` of all are in both.
    candidates = materialize(similar_links(nodes.select("node", "words"), 2 * share / (1 + share)))
    asked = candidates.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    sources = materialize(nodes.join(asked, "node").select("node", "low.key", "low.digest"))
    texts = narrow.join(sources.withColumnRenamed("key", "_k"), (F.col("key").eqNullSafe(F.col("_k"))) & (narrow["digest"] == sources["digest"]))
    shingled = with_shingle_hashes(texts.select("node", "text").dropDuplicates(["node"]), "text", width, "h")
    sets = stored(shingled.select("node", F.array_distinct("h").alias("h")), "shingles")
    components = proven_components(candidates, sets, share)
    rooted = nodes.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    kept = rooted.groupBy("component").agg(F.min("low").alias("low")).select("low.key", "low.digest")
    k, d, own_digest, number = (unique_name(docs, n) for n in ("_key", "_digest", "_own", "_number"))
    kept = kept.select(F.col("key").alias(k), F.col("digest").alias(d))
    whole = docs.withColumn(own_digest, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    same = F.col(key).eqNullSafe(F.col(k)) & (F.col(own_digest) == F.col(d))
    chosen = whole.join(kept, same).drop(k, d)
    if marked.groupBy("key", "digest").count().filter("count > 1").isEmpty():
        return chosen.select(*docs.columns)
    rank = Window.partitionBy(key, own_digest).orderBy(*[F.xxhash64(c) for c in docs.columns])
    return chosen.withColumn(number, F.row_number().over(rank)).filter(F.col(number) == 1).select(*docs.columns)


def simhash_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Second stage of the pipeline: one document of each group of near copies stays."""
    return one_of_each(docs)


def hex_word(word: Column) -> Column:
    return F.lower(F.lpad(F.hex(word), 16, "0"))


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.withColumn("fingerprint", hex_word(F.col("fingerprint")))
