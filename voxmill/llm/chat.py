"""Conversations from reply trees, by DataFrame operations only.

Messages are nodes that name their parent. Root-to-leaf paths come from
iterative self-joins with doubling: round k joins each node to its ancestor 2^k
steps up and carries the score of the way there, so depth d takes log2(d) rounds
over one row a node. Leaves are ranked by the score of their path within their
tree; only the chosen ones' paths are then spelled out, by the same rounds, and
each becomes one formatted conversation.

A turn is ``<|im_start|>`` role, line feed, text, ``<|im_end|>``, line feed.
Inside texts and roles, ``<`` followed by any backslashes and ``|`` gets one
backslash more, so no control string can occur there and the change can be
undone; in roles, ``%`` and line feeds become ``%25`` and ``%0A`` besides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import drop_written, written

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", "<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def climbs(messages: DataFrame) -> list[DataFrame]:
    """``(tree, node, above, score, turns)`` of each round k: the ancestor 2^k steps up (null: none), and what the nodes below it on the way sum to.

    A round holds the nodes that had an ancestor in the round before. A parent
    that is null or not a node of the tree makes a root. Nodes on a cycle, or
    below one, have an ancestor in every round; when only such are left, a round
    ends no more ways, and the last table still has their ancestors.
    """
    nodes = messages.select("tree", "node", "parent", "score")
    parents = nodes.select("tree", F.col("node").alias("parent"), F.col("node").alias("above"))
    rounds = [written(nodes.join(parents, ["tree", "parent"], "left").select("tree", "node", "above", "score", F.lit(1).cast("long").alias("turns")), "climbs")]
    left, before = rounds[0].where("above is not null").count(), None
    while left and left != before:
        now = rounds[-1].where("above is not null")
        up = now.unionByName(arrived(rounds)).select("tree", F.col("node").alias("above"), F.col("above").alias("top"), F.col("score").alias("more"), F.col("turns").alias("further"))
        rounds.append(written(now.join(up, ["tree", "above"]).select("tree", "node", F.col("top").alias("above"), (F.col("score") + F.col("more")).alias("score"), (F.col("turns") + F.col("further")).alias("turns")), "climbs"))
        left, before = rounds[-1].where("above is not null").count(), left
    return rounds


def arrived(rounds: list[DataFrame]) -> DataFrame:
    """The rows of nodes that have reached a root, each from the round in which it did."""
    done = rounds[0].where("above is null")
    for more in rounds[1:]:
        done = done.unionByName(more.where("above is null"))
    return done


def leaves(rounds: list[DataFrame]) -> DataFrame:
    """``(tree, leaf, score, n_turns)`` of the leaves that reach a root."""
    inner = rounds[0].where("above is not null").select("tree", F.col("above").alias("node"))
    return arrived(rounds).join(inner, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), "score", F.col("turns").alias("n_turns"))


def spelled_out(chosen: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    """``(tree, leaf, node, up)``: every node on the way of the ``chosen`` leaves to their root, ``up`` steps above."""
    paths = written(chosen.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("up")), "paths")
    for k, jump in enumerate(rounds[:-1]):
        more = paths.join(jump.where("above is not null").select("tree", "node", "above"), ["tree", "node"])
        before, paths = paths, written(paths.unionByName(more.select("tree", "leaf", F.col("above").alias("node"), (F.col("up") + (1 << k)).alias("up"))), "paths")
        drop_written(before)
    return paths


def reply_paths(messages: DataFrame) -> DataFrame:
    """``(tree, leaf, node, up)``: each leaf with every node on its way to the root, ``up`` steps above it.

    ``messages`` has tree, node, parent; (tree, node) is unique and not null. A
    parent that is null or not a node of the tree makes a root. Nodes on a cycle,
    or below one, reach no root and give no path.
    """
    rounds = climbs(messages.select("tree", "node", "parent", F.lit(0.0).alias("score")))
    return spelled_out(leaves(rounds), rounds)


def format_trees(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """``tree, leaf, rank, score, n_turns, formatted, loss_spans`` for the best ``branches`` paths of each tree (None: all).

    ``messages`` has tree, node, parent, role, text, score. A path's score is the
    sum of its nodes' scores (null: 0); higher first, then the longer path, then
    the smaller leaf. ``loss_spans`` are the code-point spans (start, end
    exclusive) of assistant texts in ``formatted``. Null role or text: empty.
    Other columns are ignored.
    """
    body = messages.select("tree", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rounds = climbs(messages.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")))
    best = Window.partitionBy("tree").orderBy(F.desc("score"), F.desc("n_turns"), "leaf")
    ranked = leaves(rounds).withColumn("rank", F.row_number().over(best))
    if branches is not None:
        ranked = ranked.where(F.col("rank") <= branches)
    ranked = written(ranked, "ranked")
    paths = spelled_out(ranked, rounds)
    drop_written(*rounds)
    head = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n"))
    turn = F.concat(head, escape(F.col("text")), F.lit(CLOSE + "\n"))
    turns = paths.join(body, ["tree", "node"]).select("tree", "leaf", "up", "role", turn.alias("turn"), F.length(head).alias("head"), F.length(turn).alias("size"))
    before = Window.partitionBy("tree", "leaf").orderBy(F.desc("up")).rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0)))
    mask = F.when(F.col("role") == "assistant", F.struct((F.col("at") + F.col("head")).alias("start"), (F.col("at") + F.col("size") - len(CLOSE) - 1).alias("end")))
    made = turns.groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(F.struct("at", "turn"))).alias("turns"), F.sort_array(F.collect_list(mask)).alias("loss_spans"))
    made = made.select("tree", "leaf", F.array_join(F.col("turns.turn"), "").alias("formatted"), "loss_spans")
    return ranked.join(made, ["tree", "leaf"]).select("tree", "leaf", "rank", "score", "n_turns", "formatted", "loss_spans")


def chains(conversations: DataFrame) -> DataFrame:
    """Linear conversations as trees: each row replies to the one before it by turn (then role and text, null first).

    ``tree`` is the conv_id as text after ``c``, or ``n`` for null.
    """
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    keyed = conversations.withColumn("tree", F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n")))
    numbered = keyed.withColumn("node", F.row_number().over(order).cast("long"))
    return numbered.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds ``turns``, (role, text) of each turn, and ``loss_text``, from ``formatted`` and ``loss_spans`` alone."""
    parts = F.split("formatted", r"<\|im_end\|>\n", -1)
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def turn(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        text = F.substr(part, F.length(role) + 2)
        return F.struct(unescape_role(F.substr(role, F.lit(len(OPEN) + 1))).alias("role"), unescape(text).alias("text"))

    loss = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return formatted.withColumns({"turns": F.transform(parts, turn), "loss_text": F.array_join(loss, "")})
