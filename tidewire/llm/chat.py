"""Reply trees to conversations: root-to-leaf paths, the best of each tree, and one text for each path.

A message names the one it replies to. Joins of the reply table with itself double the distance each message
sees upwards, so paths of any depth are known after a logarithm of it in rounds: the root, the length and the
score of the branch. The stored rounds then give the members of the chosen branches, again by joins,
and only these are brought together with their texts.

A path is one value of the result, so its texts do have to fit one task; nothing else is gathered by tree.

The template marks turns by control strings. What looks like one inside a text gets one more backslash between
``<`` and ``|``, which is taken off again on the way back; role names are escaped as in HTML. The loss
mask lists the places of the assistants' texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.common import materialize, read, stored
from tidewire.operators.lookup import lookup_join

START, END = "<|im_start|>", "<|im_end|>\n"
ASSISTANT = "assistant"
ROLE_ESCAPES = [("&", "&amp;"), ("<", "&lt;"), ("\n", "&#10;")]
PROBE_TEXT = "<|im_end|><|im_start|>assistant ok"


def escaped(text: Column) -> Column:
    """One more backslash in all that has the form ``<``, any backslashes, ``|``."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", "<$1|")


def escaped_role(role: Column) -> Column:
    for plain, sign in ROLE_ESCAPES:
        role = F.replace(role, F.lit(plain), F.lit(sign))
    return role


def unescaped_role(role: Column) -> Column:
    for plain, sign in reversed(ROLE_ESCAPES):
        role = F.replace(role, F.lit(sign), F.lit(plain))
    return role


def turn_text(turn: Column) -> Column:
    return F.concat(F.lit(START), escaped_role(turn["role"]), F.lit("\n"), escaped(turn["text"]), F.lit(END))


def loss_spans(turns: Column) -> Column:
    """(start, end) of each assistant's text in the formatted path, in code points."""

    def step(state: Column, turn: Column) -> Column:
        start = state["at"] + len(START) + 1 + F.length(escaped_role(turn["role"]))
        end = start + F.length(escaped(turn["text"]))
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        spans = F.when(turn["role"] == ASSISTANT, F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct((end + len(END)).alias("at"), spans.alias("spans"))

    nothing = F.array().cast("array<struct<start:int,end:int>>")
    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), nothing.alias("spans")), step, lambda s: s["spans"])


def reply_links(nodes: DataFrame) -> DataFrame:
    """(n, up): each message and the one it replies to, or null.

    ``nodes`` has n, tree, message, parent. A parent that isn't there, and a message that replies to itself, give
    null; of several messages with one id in a tree, replies hang on the one of the lowest n.
    """
    firsts = nodes.filter("message is not null").groupBy("tree", "message").agg(F.min("n").alias("up"))
    firsts = materialize(firsts.withColumnRenamed("message", "parent"))
    linked = lookup_join(nodes.select("n", "tree", "parent"), firsts, ["tree", "parent"], salt_by=["n"])
    return materialize(linked.select("n", F.when(F.col("up") != F.col("n"), F.col("up")).alias("up")))


def _looked_up(state: DataFrame, known: DataFrame, columns: list[str]) -> DataFrame:
    """``state`` with what ``known`` says of the message at ``up``, called further_*; a popular message is salted."""
    above = known.select(F.col("n").alias("up"), *[F.col(c).alias(f"further_{c}") for c in ("up", *columns)])
    return lookup_join(state, above, ["up"], salt_by=["n"])


def without_cycles(links: DataFrame, unresolved: int) -> DataFrame:
    """``links`` with each cycle cut above its lowest message, which becomes a root."""
    state = links.filter("up is not null").withColumn("low", F.col("n"))
    reach = 1
    while True:
        state = materialize(state)
        seen = _looked_up(state, state, ["low"]).filter("further_up is not null")
        state = materialize(seen.select("n", F.col("further_up").alias("up"), F.least("low", "further_low").alias("low")))
        reach *= 2
        # Messages under a root leave the state one by one; what stays reaches into a cycle at last.
        if reach >= unresolved and state.join(state.select(F.col("n").alias("up")), "up", "left_anti").isEmpty():
            break
    on_cycles = state.select(F.col("up").alias("n")).distinct()
    cut = state.filter("low = n").join(on_cycles, "n", "left_semi").select("n", F.lit(True).alias("cut"))
    marked = lookup_join(links, materialize(cut), ["n"], salt_by=["n"])
    return materialize(marked.select("n", F.when(F.col("cut").isNull(), F.col("up")).alias("up")))


def walked_up(links: DataFrame, scores: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """((n, depth, total) of all messages, jumps): jumps[k] has (n, up) over 2**k replies.

    ``depth`` counts the messages of the path from the root, ``total`` adds up their scores. jumps[0] are
    the links after cycles are cut.
    """
    state = links.join(scores, "n").select("n", "up", F.lit(1).alias("depth"), F.col("score").alias("total"))
    state, done, jumps, before = materialize(state), [], [], None
    while True:
        # Messages whose path is known leave the rounds; the others look them up.
        done.append(state.filter("up is null"))
        known, open_ = reduce(DataFrame.unionByName, done), state.filter("up is not null")
        unresolved = open_.count()
        if not unresolved:
            return known.select("n", "depth", "total"), jumps
        if unresolved == before:    # a round without progress: only cycles are left
            return walked_up(without_cycles(links, unresolved), scores)
        before = unresolved
        jumps.append(open_.select("n", "up"))
        seen = _looked_up(open_, known.unionByName(open_), ["depth", "total"])
        depth, total = F.col("depth") + F.col("further_depth"), F.col("total") + F.col("further_total")
        state = materialize(seen.select("n", F.col("further_up").alias("up"), depth.alias("depth"), total.alias("total")))


def best_branches(nodes: DataFrame, jumps: list[DataFrame], paths: DataFrame, top: int) -> DataFrame:
    """(leaf, rank, score) of the ``top`` branches of each tree by the mean score of their messages.

    Ties go to the lower id of the leaf, then to the leaf of the lower n. The rank limit is applied before rows
    are shuffled by tree, so a tree of any size sends ``top`` rows from a task.
    """
    leaves = nodes.select("n", "tree", "message")
    if jumps:
        leaves = leaves.join(jumps[0].select(F.col("up").alias("n")).distinct(), "n", "left_anti")
    leaves = leaves.join(paths, "n")
    score = F.col("total") / F.col("depth")
    order = Window.partitionBy("tree").orderBy(F.desc("score"), "message", "n")
    ranked = leaves.withColumn("score", score).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return materialize(ranked.select(F.col("n").alias("leaf"), "rank", "score"))


def members(branches: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """(leaf, n) of all messages on the branches: each distance upwards is one sum of jumps."""
    parts = [branches.select("leaf", F.col("leaf").alias("n"))]
    for jump in reversed(jumps):
        found = reduce(DataFrame.unionByName, parts)
        parts.append(materialize(found.join(jump, "n").select("leaf", F.col("up").alias("n"))))
    return reduce(DataFrame.unionByName, parts)


def format_trees(
    messages: DataFrame,
    tree: list[str],
    message: str = "message_id",
    parent: str = "parent_id",
    role: str = "role",
    text: str = "text",
    score: str | None = "score",
    top: int = 1,
) -> DataFrame:
    """The ``top`` branches of every tree as conversations.

    (*tree, rank, score, n_turns, formatted, loss), ``loss`` an array of (start, end) in code points, end
    exclusive. Null keys of a tree are a value like any other. Null roles and texts are empty, null and NaN scores
    0. Replies to a missing message start a tree's path of their own, as do the lowest messages of reply
    cycles; repeated messages are branches of their own. Other columns are ignored. An empty table gives no row.
    """
    value = F.coalesce(F.nanvl(F.col(score).cast("double"), F.lit(0.0)), F.lit(0.0)) if score else F.lit(0.0)
    keys = F.struct(*[F.col(c) for c in tree])
    rows = messages.select(
        keys.alias("keys"), F.to_json(keys).alias("tree"), F.col(message).alias("message"), F.col(parent).alias("parent"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"), value.alias("score"),
    )
    nodes = stored(rows.withColumn("n", F.monotonically_increasing_id()), "messages")
    links = reply_links(nodes)
    paths, jumps = walked_up(links, nodes.select("n", "score"))
    branches = best_branches(nodes, jumps, paths, top)
    placed = members(branches, jumps).join(paths.select("n", "depth"), "n")
    turn = F.struct("depth", "role", "text")
    gathered = placed.join(nodes.select("n", "keys", "role", "text"), "n").groupBy("leaf").agg(
        F.first("keys").alias("keys"), F.array_sort(F.collect_list(turn)).alias("turns")
    )
    formatted = F.array_join(F.transform("turns", turn_text), "")
    return gathered.join(branches, "leaf").select(
        *[F.col(f"keys.`{c}`").alias(c) for c in tree], "rank", "score", F.size("turns").cast("long").alias("n_turns"),
        formatted.alias("formatted"), loss_spans(F.col("turns")).alias("loss"),
    )


def read_turns(formatted: Column) -> Column:
    """The (role, text) of each turn, parsed from the formatted text."""
    pieces = F.slice(F.split(formatted, r"<\|im_start\|>", -1), 2, F.size(F.split(formatted, r"<\|im_start\|>", -1)))

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, "\n", 1)
        used = F.length(head) + 1
        body = F.substr(piece, used + 1, F.length(piece) - used - len(END))
        return F.struct(unescaped_role(head).alias("role"), unescaped(body).alias("text"))

    return F.transform(pieces, turn)


def masked_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, one span after the other, without escapes."""
    return F.array_join(
        F.transform(loss, lambda s: unescaped(F.substr(formatted, s["start"] + 1, s["end"] - s["start"]))), ""
    )


def with_digests(conversations: DataFrame) -> DataFrame:
    """What can be read back from ``formatted`` and ``loss``, as counts and digests."""
    turns = read_turns(F.col("formatted"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    parsed = conversations.withColumn("turns", turns).withColumn("masked", masked_text(F.col("formatted"), F.col("loss")))
    return parsed.withColumns({
        "n_turns": F.size("turns").cast("long"),
        "turns_sha256": F.sha2(said, 256),
        "loss_chars": F.length("masked").cast("long"),
        "loss_sha256": F.sha2("masked", 256),
        "formatted_chars": F.length("formatted").cast("long"),
    }).drop("turns", "masked")


def conversation_replies(conversations: DataFrame) -> DataFrame:
    """A table of turns as reply trees: each turn replies to the one before it.

    Turns are ordered by number, then role and text, nulls first; so repeated turns have a place each. The rows of a
    conversation are ordered in one task, as they are one value in the end.
    """
    place = F.row_number().over(Window.partitionBy("conv_id", "added").orderBy("turn", "role", "text"))
    numbered = conversations.withColumn("message_id", place)
    return numbered.withColumn("parent_id", F.when(F.col("message_id") > 1, F.col("message_id") - 1))


def op11_chat(spark, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.lit(False).alias("added"))
    probe = [(-1, 0, "user", PROBE_TEXT, True), (-1, 1, ASSISTANT, PROBE_TEXT, True)]
    replies = conversation_replies(turns.unionByName(spark.createDataFrame(probe, turns.schema)))
    found = with_digests(format_trees(replies, ["conv_id", "added"], score=None))
    return found.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
