import random

from brute import overlap, words

from tidewire.llm.decontaminate import MASKS, decontaminate, find_contaminated

DOCS, ITEMS = "doc_id long, text string, item string, _k1 int", "item_id long, text string, place int"


def vocabulary(rng, n):
    return [f"w{rng.randint(0, 300)}" for _ in range(n)]


def tables(spark):
    rng = random.Random(4)
    items = [(i, " ".join(vocabulary(rng, 15 + 4 * i))) for i in range(12)]
    items += [(100, "only four words here"), (101, None), (102, ""), (3, items[3][1])]
    docs = []
    for i in range(60):
        text = vocabulary(rng, 80)
        part = words(items[i % 12][1])
        if i % 3 == 0:
            for _ in range(len(part) * (i % 4) // 20):
                part[rng.randrange(len(part))] = "changed"
            text[20:20] = [p.upper() + "," for p in part]
        elif i % 3 == 1:
            text[10:10] = part[: len(part) // 3]
        docs.append((i, " ".join(text)))
    docs += [(200, None), (201, ""), (202, "w1"), (0, docs[0][1]), (None, docs[3][1]), (203, "w7 " * 30_000)]
    return docs, items, spark.createDataFrame([(*d, "x", 1) for d in docs], DOCS), spark.createDataFrame([(*i, 2) for i in items], ITEMS)


def expected(docs, items):
    out = []
    for key, text in docs:
        for number, item in items:
            n = len(words(item))
            if n >= 5 and text and len(text) < 50_000:
                shared = overlap(text, item)
                if shared >= min(-(-n * 8 // 10), 20):
                    out.append((key, number))
    return out


def test_overlaps_equal_brute_force(spark):
    docs, items, d, i = tables(spark)
    found = [(r["doc_id"], r["item_id"]) for r in find_contaminated(d, i).collect()]
    want = expected(docs, list(dict(items).items()))
    assert set(found) == set(want)


def test_shuffled_seeds_give_the_same(spark, monkeypatch):
    docs, items, d, i = tables(spark)
    before = sorted(map(str, find_contaminated(d, i).collect()))
    monkeypatch.setattr("tidewire.llm.decontaminate.BROADCAST_SEEDS", 0)
    monkeypatch.setattr("tidewire.llm.decontaminate.BROADCAST_PLACES", 0)
    assert sorted(map(str, find_contaminated(d, i).collect())) == before


def test_clean_rows_stay_as_they_are(spark):
    docs, items, d, i = tables(spark)
    bad = {k for k, _ in expected(docs, items)}
    left = decontaminate(d, i)
    assert left.columns == d.columns
    assert sorted(map(str, (r["doc_id"] for r in left.collect()))) == sorted(str(k) for k, _ in docs if k not in bad)


def test_empty_tables(spark):
    docs, items, d, i = tables(spark)
    assert find_contaminated(d.limit(0), i).count() == 0
    assert find_contaminated(d, i.limit(0)).count() == 0
    assert decontaminate(d, i.limit(0)).count() == len(docs)


def promised(text, item):
    """Whether the stretches with at least 80 % equal words hold 80 % of the item or 20 words, over all pairs of ends."""
    a, b = words(text), words(item)
    enough, covered = min(-(-len(b) * 4 // 5), 20), set()
    for diagonal in range(-len(b), len(a) + 1):
        flags = [0 <= i + diagonal < len(a) and a[i + diagonal] == b[i] for i in range(len(b))]
        equal = [i for i, f in enumerate(flags) if f]
        for first in equal:
            for last in equal:
                n, same = last - first + 1, sum(flags[first : last + 1])
                if n > 0 and 5 * same >= 4 * n and (n >= enough or 5 * same - 4 * n >= 6):
                    covered.update(range(first, last + 1))
    return len(covered) if len(covered) >= enough else 0


def test_overlaps_before_and_after_changed_words_count(spark):
    rng = random.Random(8)
    plain = lambda n: [f"w{x}" for x in rng.sample(range(5000), n)]
    changes = [(16, [3]), (20, [3, 7]), (38, [17, 18, 19, 20, 21]), (5, []), (24, [2, 9, 16]), (60, list(range(10, 60)))]
    changes += [(n, rng.sample(range(n), n // 10)) for n in (16, 20, 24, 38) for _ in range(5)]
    docs, items = [], []
    for number, (n, changed) in enumerate(changes):
        own = plain(n)
        part = [f"x{i}" if i in changed else w for i, w in enumerate(own)]
        items.append((number, " ".join(own), 0))
        docs.append((number, " ".join(plain(30) + part + plain(30)), "x", 1))
    found = {(r["doc_id"], r["item_id"]): r["overlap"] for r in find_contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    want = {(d[0], i[0]): n for d in docs for i in items if (n := promised(d[1], i[1]))}
    assert {(i, i) for i in range(5)} <= set(want) and (5, 5) not in want
    seeded = {k for k in want if k in found or _has_seed(docs[k[0]][1], items[k[1]][1])}
    assert found == {k: want[k] for k in seeded} and {(i, i) for i in range(5)} <= set(found)


def _has_seed(text, item):
    a, b = words(text), words(item)
    for mask in MASKS:
        ones = [k for k, c in enumerate(mask) if c == "1"]
        laid = [{tuple(w[i + k] for k in ones) for i in range(len(w) - len(mask) + 1)} for w in (a, b)]
        if laid[0] & laid[1]:
            return True
    return False
