import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest

from tidewire.llm import runs as module
from tidewire.llm.runs import COVER, MODULUS, TO_SAMPLES, Suffixes, equal_pairs, periodic_runs, repeated_words, runs_of

SCHEMA = "doc_id long, text string, found string, n_runs int"
SF = "/root/testdata/sf0.001"


def plain_runs(words):
    """Every run by its definition: for each period, the stretches in which equal words follow each other."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                found.setdefault((i, j + q - i), q)    # the smallest period of a stretch comes first
            i = j
    return sorted((s, length, q) for (s, length), q in found.items())


def plain_row(doc_id, text, repeat=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode() if doc_id is not None else b""), len(words)
    if repeat and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    listed = "".join(f"{a},{b},{c}\n" for a, b, c in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    milli = 1000 * best[1] // best[2] if found else None
    return (doc_id, len(found), *best, milli, *(hashlib.sha256(t.encode()).hexdigest() for t in (listed, kept)))


def drawn(draw, n, letters):
    words = [draw.choice(letters) for _ in range(n)]
    for _ in range(draw.randrange(4)):
        if n > 10:
            at, q = draw.randrange(n), draw.randrange(1, max(2, n // 4))
            end = min(n, at + draw.randrange(1, 6) * q + draw.randrange(q))
            for i in range(at + q, end):
                words[i] = words[i - q]
    return words


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")
def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = sorted(plain_row(d["doc_id"], d["text"]) for d in docs if len(d["text"] or "") < 9_000)
    ids = {w[0] for w in want}
    found = module.op12_runs(spark, SF)
    assert found.count() == len(docs)
    assert sorted(tuple(r) for r in found.collect() if r["doc_id"] in ids) == want
    assert sum(w[1] for w in want) > 10


@pytest.mark.parametrize("grid", [8192, 16])
@pytest.mark.parametrize("letters", ["a", "ab", "abcdefgh", "".join(map(chr, range(200, 500)))])
def test_runs_equal_brute_force(monkeypatch, grid, letters):
    module._small_grid.cache_clear()
    monkeypatch.setattr(module, "GRID_WORDS", grid)
    monkeypatch.setattr(module, "GRID_PAIRS", 64)
    draw = random.Random(grid + len(letters))
    texts = [drawn(draw, n, letters) for n in [0, 1, 2, 11, 12, 13, 64, 5, 300, 150, *draw.sample(range(200), 30)]]
    found = runs_of([module._numbered(t) for t in texts])
    module._small_grid.cache_clear()
    for words, rows in zip(texts, found):
        assert [tuple(r) for r in rows.tolist()] == plain_runs(words)


def test_cover_leads_any_two_places_to_samples():
    assert sorted((a - b) % MODULUS for a in COVER for b in COVER if a != b) == list(range(1, MODULUS))
    for i in range(MODULUS):
        for d in range(MODULUS):
            k = TO_SAMPLES[i, d]
            assert k < MODULUS and (i + k) % MODULUS in COVER and (i + d + k) % MODULUS in COVER


@pytest.mark.parametrize("letters", [1, 2, 3])
def test_common_prefixes_of_sampled_suffixes(letters):
    rng = np.random.default_rng(letters)
    parts = [np.append(rng.integers(1, letters + 1, n), letters + 1 + k) for k, n in enumerate([0, 40, 500, 31, 62, 300])]
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    ids, suffixes = np.concatenate(parts), Suffixes(np.concatenate(parts), starts)
    for t, part in enumerate(parts):
        places = [p for p in range(len(part)) if p % MODULUS in COVER]
        one, two = (np.array(x, np.int64) for x in zip(*[(a, b) for a in places for b in places if a < b][:4000] or [((), ())]))
        if one.size:
            got = suffixes.common(one + starts[t], two + starts[t])
            for a, b, n in zip(one, two, got):
                assert (part[a : a + n] == part[b : b + n]).all() and part[a + n] != part[b + n]
    assert len(ids) == starts[-1]


def test_grid_finds_every_equal_pair():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 3, 200)
    want = {(m, q) for q in range(1, 101) for m in range(q, 200, q) if ids[m] == ids[m - q]}
    assert set(zip(*(x.tolist() for x in equal_pairs(ids)))) == want


def test_nulls_ties_repeats_and_long_texts(spark):
    same = "x y " * 10
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, same), (4, same), (None, same), (None, None), (5, "a" * 100_000),
            (6, "w " * 30_000), (7, " ".join(f"w{i % 700}" for i in range(20_000))), (8, " x  " * 12)]
    df = spark.createDataFrame([(*r, "f", 0) for r in rows], SCHEMA)
    found = periodic_runs(df).collect()
    got = sorted(map(str, (tuple(r) for r in found if r["doc_id"] not in (6, 7))))
    assert got == sorted(str(plain_row(k, t, False)) for k, t in rows if k not in (6, 7))
    by_key = {r["doc_id"]: tuple(r)[1:6] for r in found}
    assert by_key[6] == (1, 0, 30_000, 1, 30_000_000) and by_key[7] == (1, 0, 20_000, 700, 28_571)
    empty = periodic_runs(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns[1] == "n_runs"


def test_repeating_follows_the_checksum():
    words = [str(i) for i in range(50)]
    for h in (0, 10, 120, 77_770, 123):
        g, a = h // 10, (h // 10) % 50
        p = 1 + (50 - a) // (3 + g % 8)
        want = [w if h % 10 or i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        assert repeated_words(words, h) == want
