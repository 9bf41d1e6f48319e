"""The prefix trie of conversations, by van Emde Boas recursion.

Sequences of at most 2^(K+1) - 1 turns are cut at half their depth, the prefixes
at the cut are named, and the trie above the cut and the forest below it, whose
roots are the names, are the same problem at half the depth. All subproblems of a
depth are done in one step, so K + 1 steps name every prefix: a prefix of length
d, whose lowest set bit is 2^k, is named in step K - k by the name of the prefix
2^k turns shorter and the digest of the turns between. Digests of 2^(k+1) turns
come from those of 2^k, two rows each. A step's joins are on a conversation and a
place in it, both sides unique, so no prefix, however common, is a hot key; common
prefixes meet only in groupings that Spark combines before the shuffle.

Totals are grafted upward the same way: in step k, the forests that hang from cuts
at depths whose lowest bit is 2^k are whole, and each top sends its total to the
2^k nodes above it in the upper trie, which it finds under its smallest member's
names. That is log2(depth) rows a node at most, half of it on average.

Names are SHA-256 digests; two prefixes count as equal if these are.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbering import ranked
from .shared import drop_written, written

#: Conversation ids in one row before they are hashed, at most: a range of 2^12.
ID_BITS = 12


def turn_digest() -> Column:
    """Of a turn's role and text, each null as empty; the role's length keeps them apart."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))


def turns_of(conversations: DataFrame) -> DataFrame:
    """``conv, nth, digest, size``: the turns of each conversation from 1, by turn (null first), then by their digest; ``size`` in code points.

    Rows without conv_id belong to no conversation and are left out.
    """
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", turn_digest().alias("digest"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("size"))
    return ranked(rows, ["conv"], ["turn", "digest"], "nth").select("conv", "nth", "digest", "size")


def with_shared_openings(turns: DataFrame, every: int = 100, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """``(turns: conv, at, digest, size)`` and ``(lengths: conv, length)`` after conversations have been given openings of others.

    Conversation c starts with the first h turns of conversation c - c % every
    (all if it has fewer, none if there is none), h = crc32(c) % (most + 1), and
    goes on with its own turns after its first h.
    """
    turns = written(turns, "turns")
    convs = written(turns.groupBy("conv").agg(F.count("*").alias("n")), "convs")
    keyed = convs.select("conv", "n", (F.crc32(F.col("conv").cast("string")) % (most + 1)).alias("h"), (F.col("conv") - F.col("conv") % every).alias("base"))
    keyed = keyed.join(convs.select(F.col("conv").alias("base"), F.col("n").alias("n_base")), "base", "left")
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    keyed = written(keyed.select("conv", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "openings")
    opening = turns.where(F.col("nth") <= most).withColumnRenamed("conv", "base")
    opening = keyed.where("taken > 0").join(opening, "base").where("nth <= taken").select("conv", F.col("nth").alias("at"), "digest", "size")
    own = turns.join(keyed, "conv").where("nth > h").select("conv", (F.col("nth") - F.col("h") + F.col("taken")).alias("at"), "digest", "size")
    made = written(opening.unionByName(own), "rebuilt")
    drop_written(turns, convs)
    return made, keyed.select("conv", "length")


def lowest_bit(k: int, depth: str = "depth") -> Column:
    """Depths whose lowest set bit is 2^k."""
    return F.col(depth).bitwiseAND((2 << k) - 1) == 1 << k


def block_digests(turns: DataFrame, top: int) -> list[DataFrame]:
    """For k = 0..top, ``conv, block, digest``: the digest of each whole run of 2^k turns that starts after block * 2^k."""
    levels = [turns.select("conv", (F.col("at") - 1).alias("block"), "digest")]
    for _ in range(top):
        half = lambda odd: F.max(F.when(F.col("block") % 2 == odd, F.col("digest")))
        pairs = levels[-1].groupBy("conv", F.shiftright("block", 1).alias("block")).agg(half(0).alias("a"), half(1).alias("b")).where("a is not null and b is not null")
        levels.append(written(pairs.select("conv", "block", F.unhex(F.sha2(F.concat("a", "b"), 256)).alias("digest")), "blocks"))
    return levels


def prefix_names(turns: DataFrame, lengths: DataFrame, top: int) -> DataFrame:
    """``conv, depth, name`` for every prefix of every conversation, the empty one included."""
    levels = block_digests(turns, top)
    names = lengths.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(b"").alias("name"))
    for k in range(top, -1, -1):
        below = levels[k].where("block % 2 = 0").select("conv", F.shiftleft("block", k).alias("depth"), "digest")
        named = names.join(below, ["conv", "depth"]).select("conv", (F.col("depth") + (1 << k)).alias("depth"), F.unhex(F.sha2(F.concat("name", "digest"), 256)).alias("name"))
        names = names.unionByName(written(named, "names"))
    drop_written(*levels[1:])
    return names


def hashed_ends(ends: DataFrame) -> DataFrame:
    """``depth, name, ends_sha256`` of ``depth, name, conv``: SHA-256 of each node's ids, ascending, joined by commas.

    Ids are joined in short runs before the shuffle's sort, and a node's runs are hashed one after the other, so no row holds them all.
    """
    runs = ends.groupBy("depth", "name", F.shiftright("conv", ID_BITS).alias("run")).agg(F.array_join(F.array_sort(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"))

    def hashes(batches):
        now, digest = None, None
        for batch in batches:
            out = []
            for depth, name, ids in zip(batch["depth"].to_pylist(), batch["name"].to_pylist(), batch["ids"].to_pylist(), strict=True):
                if now == (depth, name):
                    digest.update(b",")
                else:
                    if now is not None:
                        out.append((*now, digest.hexdigest()))
                    now, digest = (depth, name), hashlib.sha256()
                digest.update(ids.encode())
            if out:
                yield rows(out)
        if now is not None:
            yield rows([(*now, digest.hexdigest())])

    def rows(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.string()), strict=True)], names=["depth", "name", "ends_sha256"])

    return runs.repartition("depth", "name").sortWithinPartitions("depth", "name", "run").select("depth", "name", "ids").mapInArrow(hashes, "depth long, name binary, ends_sha256 string")


def grafted(nodes: DataFrame, names: DataFrame, top: int, totals: tuple[str, ...]) -> DataFrame:
    """``depth, name`` and ``totals``, summed over what hangs below each node; nodes with nothing below are left out.

    ``nodes`` has depth, name, conv (a member) and each node's own ``totals``.
    """
    places = names.select("conv", F.col("depth").alias("up"), F.col("name").alias("above"))
    summed = lambda df: df.groupBy("depth", "name").agg(*(F.sum(t).alias(t) for t in totals))
    sent = None
    for k in range(top + 1):
        cut = nodes.where(lowest_bit(k)).select("depth", "name", "conv", *totals)
        if sent is not None:
            below = summed(sent.where(lowest_bit(k))).select("depth", "name", *(F.col(t).alias(f"{t}_") for t in totals))
            cut = cut.join(below, ["depth", "name"], "left").select("depth", "conv", *((F.col(t) + F.coalesce(f"{t}_", F.lit(0))).alias(t) for t in totals))
        upward = cut.select("conv", *totals, F.explode(F.sequence(F.col("depth") - (1 << k), F.col("depth") - 1)).alias("up")).join(places, ["conv", "up"])
        step = written(summed(upward.select(F.col("up").alias("depth"), F.col("above").alias("name"), *totals)), "grafted")
        sent = step if sent is None else sent.unionByName(step)
    return summed(sent)


def prefix_trie(conversations: DataFrame, every: int = 100, most: int = 5) -> DataFrame:
    """A row for each distinct prefix of the conversations, rebuilt by ``with_shared_openings``.

    ``conversations`` has conv_id, turn, role, text; other columns are ignored.
    Null role or text is empty; repeated rows are turns of their own; rows without
    conv_id are left out; an empty table has no node, not even the root. Columns:
    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs,
    n_children, n_leaves and saved_tokens (over the subtree, top included) and
    ends_sha256.
    """
    turns, lengths = with_shared_openings(turns_of(conversations), every, most)
    top = int(lengths.agg(F.coalesce(F.max("length"), F.lit(0))).first()[0]).bit_length() - 1
    names = prefix_names(turns, lengths, top)
    nodes = written(names.groupBy("depth", "name").agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs")), "nodes")
    sizes = turns.select("conv", F.col("at").alias("depth"), "size")
    parents = names.select("conv", (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"))
    placed = nodes.join(sizes, ["conv", "depth"], "left").join(parents, ["conv", "depth"], "left")
    placed = written(placed.select("depth", "name", "parent", "conv", "n_convs", ((F.col("n_convs") - 1) * F.coalesce("size", F.lit(0))).alias("saved_tokens")), "placed")
    children = placed.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    placed = placed.join(children, ["depth", "name"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    placed = written(placed.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")), "counted")
    ends = hashed_ends(lengths.withColumnRenamed("length", "depth").join(names, ["conv", "depth"]).select("depth", "name", "conv"))
    made = placed.join(ends, ["depth", "name"], "left")
    totals = ("n_leaves", "saved_tokens")
    if top >= 0:
        below = grafted(placed, names, top, totals).select("depth", "name", *(F.col(t).alias(f"{t}_") for t in totals))
        made = made.join(below, ["depth", "name"], "left").withColumns({t: F.col(t) + F.coalesce(f"{t}_", F.lit(0)) for t in totals})
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"), F.col("conv").alias("parent_conv_id"))
    made = made.join(above, ["depth", "parent"], "left")
    return made.select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
