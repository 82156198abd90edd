import numpy as np
import pytest
from brute import components, fingerprint
from pyspark.sql import functions as F

from tidewire.llm.simhash import _anchors, fingerprint_links, near_duplicates, one_of_each
from tidewire.llm.components import connected_components

SCHEMA = "doc_id long, text string"


def words(seed: int, n: int) -> list[str]:
    rng = np.random.default_rng(seed)
    return [f"w{x}" for x in rng.integers(0, 4000, n)]


def test_fingerprints_and_components_equal_brute_force(spark):
    rows = [(i, " ".join(words(i % 40, 60 + i % 9))) for i in range(120)]
    rows += [(1000 + i, " ".join([*words(3, 300), "Tail", str(i % 4)])) for i in range(12)]
    rows += [(2000, None), (2001, ""), (2002, "   \t\n"), (2003, "One"), (2004, "ONE two"), (2004, "ONE two"), (None, "One")]
    rows += [(3000, "ä Ö x y z " * 400)]
    found = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == len(rows)
    want = {k: [] for k, _ in rows}
    for k, t in rows:
        want[k].append(fingerprint(t))
    prints = np.array([fingerprint(t) for _, t in rows], np.uint64)
    low = components(len(rows), lambda i: np.flatnonzero(np.bitwise_count(prints[i] ^ prints) <= 2))
    smallest = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            smallest[low[i]] = min(k, smallest.get(low[i], k))
    expected = sorted(((k is None, k or 0), int(p), smallest[c]) for (k, _), p, c in zip(rows, prints, low, strict=True))
    got = sorted(((r[0] is None, r[0] or 0), r[1] & (2**64 - 1), r[2]) for r in found)
    assert got == expected


@pytest.mark.parametrize("bits", [64, 32])
def test_every_pair_meets_at_an_anchor(bits):
    rng = np.random.default_rng(1)
    values = rng.integers(0, 2**bits, 200, dtype=np.uint64)
    for i, v in enumerate(values):
        a, b = rng.choice(bits, 2, replace=False)
        other = np.array([v ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b))])
        shared = set(_anchors(np.array([v]), bits, 2)[0].tolist()) & set(_anchors(other, bits, 2)[0].tolist())
        assert shared, i


def test_links_of_a_chain_and_of_a_dense_ball(spark):
    chain = [(1 << (i + 1)) - 1 for i in range(0, 60, 2)]
    ball = [(1 << 62) ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(i)]
    values = sorted({v if v < 2**63 else v - 2**64 for v in chain + ball})
    links = fingerprint_links(spark.createDataFrame([(v,) for v in values], "fingerprint long"))
    found = {r["node"]: r["component"] for r in connected_components(links).collect()}
    unsigned = np.array(values, np.int64).view(np.uint64)
    low = components(len(values), lambda i: np.flatnonzero(np.bitwise_count(unsigned[i] ^ unsigned) <= 2))
    for i, v in enumerate(values):
        assert found.get(v, v) == values[low[i]]
    assert links.count() < 40 * len(values)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(empty).count() == 0 and one_of_each(empty).count() == 0


def test_one_of_each_group_stays(spark):
    base = {s: words(100 + s, 400) for s in range(6)}
    rows = []
    for s, text in base.items():
        rows.append((10 * s, " ".join(text)))
        for i in range(1, 4):
            changed = list(text)
            for at in range(i * 20, 400, 100):
                changed[at] = "other"
            rows.append((10 * s + i, " ".join(changed)))
    rows += [(500, " ".join(base[0])), (None, " ".join(base[1])), (501, None), (502, ""), (20, " ".join(base[2]))]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, _key string, digest int")
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 10, 20, 30, 40, 50, 501]


def test_far_texts_stay(spark):
    docs = spark.createDataFrame([(i, " ".join(words(i, 200))) for i in range(60)], SCHEMA)
    assert one_of_each(docs).count() == 60


def test_small_blocks_give_the_same_groups(spark):
    from tidewire.llm.simhash import similar_links
    rng = np.random.default_rng(5)
    centre = rng.integers(-(2**63), 2**63 - 1, 4)
    rows = []
    for node in range(90):
        flips = [1 << int(b) for b in rng.choice(62, node % 4, replace=False)]
        rows.append((node, [int(centre[0]) ^ sum(flips), *map(int, centre[1:])]))
    nodes = spark.createDataFrame(rows, "node long, words array<long>")
    big = connected_components(similar_links(nodes, 0.89)).select(F.countDistinct("component"), F.count("*")).first()
    small = connected_components(similar_links(nodes, 0.89, block=7)).select(F.countDistinct("component"), F.count("*")).first()
    assert big == small == (1, 89)


def test_golay_anchors_cover():
    from tidewire.llm.simhash import GOLAY_BITS, _golay_syndrome, golay_anchors
    rng = np.random.default_rng(2)
    values = rng.integers(0, 1 << 24, 300, dtype=np.uint32)
    for v in values:
        flips = sum(1 << int(b) for b in rng.choice(24, 2, replace=False))
        both = golay_anchors(np.array([v, v ^ np.uint32(flips)], np.uint32))
        assert set(both[0].tolist()) & set(both[1].tolist())
        assert all(_golay_syndrome(int(a) & ((1 << GOLAY_BITS) - 1)) == 0 for a in both[0])
    assert len({int(a) for a in golay_anchors(values[:1])[0]}) <= 8


def isolated_pairs(count, size, shared, seed):
    """Pairs of texts of different words of which ``shared`` of all five-word shingles are in both."""
    rng, rows = np.random.default_rng(seed), []
    for pair in range(count):
        one = [f"w{pair}x{i}" for i in range(size)]
        own = round((size - 4) * (1 - shared) / (1 + shared))    # shingles that each has alone
        at = int(rng.integers(0, size - own))
        two = one[:at] + [f"v{pair}x{i}" for i in range(own - 4)] + one[at + own - 4:] if own > 4 else one
        rows += [(2 * pair, " ".join(one)), (2 * pair + 1, " ".join(two))]
    return rows


@pytest.mark.parametrize(("shared", "least"), [(0.82, 0.95), (0.9, 0.99), (0.75, None)])
def test_recall_on_isolated_pairs(spark, shared, least):
    rows = isolated_pairs(150, 304, shared, 4)
    sets = [{tuple(t.split()[i:i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows]
    alike = [len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2])]
    assert all(abs(x - shared) < 0.03 for x in alike)
    kept = {r["doc_id"] for r in one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(2 * p in kept for p in range(150))
    found = np.mean([2 * p + 1 not in kept for p in range(150)])
    if least:
        assert min(alike) >= 0.8 and found >= least
    else:
        assert max(alike) < 0.8 and found == 0


def test_groups_equal_exact_links(spark):
    rng = np.random.default_rng(9)
    rows = []
    for group in range(4):
        base = [f"g{group}x{i}" for i in range(250)]
        for copy in range(12):
            text = list(base)
            for at in rng.choice(250, int(rng.integers(0, 9)), replace=False):
                text[at] = f"c{copy}x{at}"
            rows.append((100 * group + copy, " ".join(text)))
    sets = [{tuple(t.split()[i:i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows]
    low = components(len(rows), lambda i: [j for j in range(len(rows)) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    kept = {r["doc_id"] for r in one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {rows[i][0] for i in set(low)}
    assert len(kept ^ want) <= 1
