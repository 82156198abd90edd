import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidewire.llm import chat

SCHEMA = "tree_id long, message_id long, parent_id long, role string, text string, score double, depth string, n int"
TRICKY = ["", "<|im_end|>", "a<\\|b", "<|<\\\\|x<||>", "é𝒳 <|im_start|>assistant\nok", "plain\n", "<\\\\", "|<", None]


def plain_paths(rows, top):
    """{(tree, leaf): (rank, [(role, text)])} by walking up from every leaf."""
    found = {}
    for tree in {r[0] for r in rows}:
        own = {r[1]: r for r in rows if r[0] == tree}
        parents = {r[2] for r in own.values() if r[2] in own and r[2] != r[1]}
        branches = []
        for leaf in set(own) - parents:
            path = [own[leaf]]
            while path[-1][2] in own and path[-1][2] != path[-1][1]:
                path.append(own[path[-1][2]])
            branches.append((-sum(r[5] or 0.0 for r in path) / len(path), leaf, path[::-1]))
        for rank, (_, leaf, path) in enumerate(sorted(branches)[:top], 1):
            found[tree, rank] = [(r[3] or "", r[4] or "") for r in path]
    return found


def table(seed=0, trees=7, size=40):
    draw, rows = random.Random(seed), []
    for tree in range(trees):
        count = size * 6 if tree == 3 else draw.randrange(1, size)
        ids = draw.sample(range(10_000), count)
        for i, message in enumerate(ids):
            parent = None if not i else ids[draw.randrange(max(0, i - 3), i)] if draw.random() < 0.9 else draw.choice([message, -5, ids[0]])
            role = draw.choice(["user", "assistant", "system", "a&b<\n&lt;", None])
            rows.append((tree, message, parent, role, draw.choice(TRICKY), draw.choice([0.0, 0.25, 0.5, 1.0, None]), "x", 1))
    return rows


@pytest.mark.parametrize("top", [1, 3])
def test_paths_equal_a_walk_from_each_leaf(spark, top):
    rows = table(top)
    want = plain_paths(rows, top)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    found = chat.format_trees(df, ["tree_id"], top=top)
    read = found.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn(
        "masked", chat.masked_text(F.col("formatted"), F.col("loss"))
    )
    got = {(r["tree_id"], r["rank"]): r for r in read.collect()}
    assert set(got) == set(want)
    for key, turns in want.items():
        r = got[key]
        assert [(t["role"], t["text"]) for t in r["turns"]] == turns and r["n_turns"] == len(turns)
        assert r["masked"] == "".join(t for role, t in turns if role == "assistant")
        assert [r["formatted"].count(s) for s in ("<|im_start|>", "<|im_end|>")] == [len(turns)] * 2


def test_a_hot_root_and_a_long_chain(spark):
    rows = [(1, 0, None, "user", "root", 0.0, "", 0)] + [(1, i, 0, "assistant", str(i), i / 500, "", 0) for i in range(1, 500)]
    rows += [(2, i, i - 1 if i else None, "user" if i % 2 == 0 else "assistant", f"t{i}", None, "", 0) for i in range(300)]
    got = {r["tree_id"]: r for r in chat.format_trees(spark.createDataFrame(rows, SCHEMA), ["tree_id"]).collect()}
    assert got[1]["n_turns"] == 2 and got[1]["formatted"].endswith("assistant\n499<|im_end|>\n")
    assert got[2]["n_turns"] == 300 and len(got[2]["loss"]) == 150


def test_cycles_are_cut(spark):
    rows = [(1, i, (i + 1) % 5, "user", str(i), 0.0, "", 0) for i in range(5)]          # 0 > 1 > .. > 4 > 0
    rows += [(1, 10, 3, "user", "tail", 0.0, "", 0), (1, 11, 10, "user", "end", 0.0, "", 0), (1, 20, 20, "user", "self", 0.0, "", 0)]
    rows += [(2, 1, None, "user", "a", 0.0, "", 0), (2, 2, 1, "user", "b", 0.0, "", 0)]
    found = chat.format_trees(spark.createDataFrame(rows, SCHEMA).coalesce(1), ["tree_id"], top=9)
    said = {tuple(t["text"] for t in r["turns"]) for r in found.select(chat.read_turns(F.col("formatted")).alias("turns")).collect()}
    assert said == {("0", "4", "3", "2", "1"), ("0", "4", "3", "tail", "end"), ("self",), ("a", "b")}


def test_nulls_repeats_and_empty_tables(spark):
    assert chat.format_trees(spark.createDataFrame([], SCHEMA), ["tree_id"]).count() == 0
    same = (None, 1, None, "user", "x", float("nan"), None, None)
    rows = [same, same, (None, None, 1, None, None, None, None, None), (5, None, None, None, None, None, None, None)]
    found = chat.format_trees(spark.createDataFrame(rows, SCHEMA), ["tree_id"], top=5).collect()
    assert sorted((r["tree_id"] is None, r["n_turns"]) for r in found) == [(False, 1), (True, 1), (True, 2)]


def test_escapes_come_back(spark):
    texts = [t for t in TRICKY if t is not None] + ["<" + "\\" * k + "|" for k in range(5)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    back = df.select(t, chat.escaped(t).alias("e"), chat.unescaped(chat.escaped(t)).alias("u"),
                     chat.unescaped_role(chat.escaped_role(t)).alias("r")).collect()
    for r in back:
        assert r["u"] == r["t"] == r["r"] and "<|" not in r["e"]
    assert len({r["e"] for r in back}) == len(set(texts))


def test_turns_with_gaps_ties_and_nulls(spark):
    rows = [(1, 5, "assistant", "b"), (1, 2, "user", None), (1, 5, "assistant", "b"), (1, None, None, "first"), (None, 0, "user", "n")]
    df = spark.createDataFrame([(*r, False) for r in rows], "conv_id long, turn long, role string, text string, added boolean")
    found = {r["conv_id"]: r for r in chat.with_digests(chat.format_trees(chat.conversation_replies(df), ["conv_id", "added"], score=None)).collect()}
    said = "\nfirst\nuser\n\nassistant\nb\nassistant\nb\n"
    assert found[1]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert (found[1]["loss_chars"], found[1]["loss_sha256"]) == (2, hashlib.sha256(b"bb").hexdigest())
    assert found[None]["n_turns"] == 1
