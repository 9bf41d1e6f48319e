"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard verification, components.

Rows with equal shingle sets form one class; only classes meet in bands, so any
number of copies is one row there. Within a bucket not all pairs are compared,
yet no link that matters is lost:

1. Every class is compared with the bucket's centre, its member with the largest
   buckets, and then with the one of these classes that has the most of what
   the majority has; verified links give components. A pair inside a component
   needs no comparison: its link would change nothing.
2. Buckets that still hold several components are searched for pairs of different
   ones. With D(x) the symmetric difference of x and a centre, s(x) its size and
   u(x) how many of its shingles no other class near that centre has, the
   difference of x and y is that of D(x) and D(y), at least s(x) - s(y), for x and
   y near the centre at least s(x) - (s(y) - 2 u(y)), and at least the bits in
   which bitmaps of D(x) and D(y) differ. A link allows
   (|x| + |y|) (1 - t) / (1 + t) of it, and if both are linked to the centre they
   are in one component. What the bounds leave is verified. Each class is judged
   against its home, the near centre that most classes were compared with; pairs
   of different homes against the bucket's. A home with very many classes is
   searched in slices, so no task has all its pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import graph, minhash, words
from .shared import written

#: 32 bands of 4 rows miss a pair at 0.8 once in 2e7.
COORDINATES, ROWS = 128, 4
#: 64-bit words of the bitmap of a difference.
WORDS = 8
#: Classes of a home that one slice of its search holds.
SLICE = 1024


#: Two hashes of a row's text and doc_id that name it together.
MARKS = ["mark", "other"]


def set_key(shingle: np.ndarray) -> bytes:
    return hashlib.blake2b(shingle.tobytes(), digest_size=16).digest()


def _sign(n: int):
    def sign(batches):
        for batch in batches:
            data, at = words.utf8(batch.column("text"))
            for lo, hi in words.slices(at):
                w = words.Words(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], lower=True)
                shingle, b = words.shingles(w.hash, w.bounds, n)
                full = np.flatnonzero(np.diff(b))
                band = minhash.bands(minhash.circulant(shingle, b[full], COORDINATES), ROWS)
                size, keys = np.zeros(hi - lo, np.int64), [None] * (hi - lo)
                for d in full:
                    own = np.unique(shingle[b[d] : b[d + 1]])
                    size[d], keys[d] = len(own), set_key(own)
                count = np.zeros(hi - lo + 1, np.int64)
                count[full + 1] = band.shape[1]
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[lo:hi] for c in ("rid", "doc_id", *MARKS)), pa.array(size), pa.array(keys, pa.binary()), words.list_column(words.signed(band.reshape(-1)), np.cumsum(count))], names=["rid", "doc_id", *MARKS, "n_shingles", "key", "bands"])

    return sign


def _sets(n: int):
    def sets(batches):
        for batch in batches:
            data, at = words.utf8(batch.column("text"))
            node, key = batch.column("node").to_pylist(), batch.column("key").to_pylist()
            for lo, hi in words.slices(at):
                w = words.Words(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], lower=True)
                shingle, b = words.shingles(w.hash, w.bounds, n)
                own = [np.unique(shingle[b[d] : b[d + 1]]) for d in range(hi - lo)]
                same = [d for d in range(hi - lo) if set_key(own[d]) == key[lo + d]]
                yield pa.RecordBatch.from_arrays([pa.array([node[lo + d] for d in same], pa.int64()), pa.array([own[d].tobytes() for d in same], pa.binary())], names=["node", "shingles"])

    return sets


def _compare(percent: int):
    def compare(batches):
        for batch in batches:
            link, far, size, delta, bitmap = [], [], [[], []], [], []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                link.append(100 * both >= percent * (len(p) + len(q) - both))
                far.append(len(p) + len(q) - 2 * both)
                size[0].append(len(p))
                size[1].append(len(q))
                apart = np.setxor1d(p, q, assume_unique=True)
                bits = np.zeros(64 * WORDS, dtype=bool)
                bits[(apart >> np.uint64(20)) % np.uint64(64 * WORDS)] = True
                bitmap.append(np.packbits(bits).view(np.int64))
                delta.append(words.signed(apart) if both > far[-1] / 2 else np.zeros(0, np.int64))
            at = np.concatenate(([0], np.cumsum([len(d) for d in delta]))).astype(np.int64)
            lists = words.list_column(np.concatenate(delta) if delta else np.zeros(0, np.int64), at)
            maps = words.list_column(np.concatenate(bitmap) if bitmap else np.zeros(0, np.int64), np.arange(len(bitmap) + 1, dtype=np.int64) * WORDS)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(link, pa.bool_()), pa.array(far, pa.int64()), *(pa.array(n, pa.int64()) for n in size), lists, maps], names=["a", "b", "link", "far", "n_a", "n_b", "delta", "bitmap"])

    return compare


def class_sets(nodes: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """``(node, shingles)``: the full set of each class, from the text of its first document."""
    docs = docs.select(*MARKS, "text").dropDuplicates(MARKS)  # before the join, so repeated rows don't meet there
    return docs.join(nodes, MARKS).select("node", "key", "text").dropDuplicates(["node"]).mapInArrow(_sets(n), "node long, shingles binary")


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b, link``, the size ``far`` of the symmetric difference, both sizes, the difference (empty for distant pairs) and a bitmap of it."""
    x = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    kind = "a long, b long, link boolean, far long, n_a long, n_b long, delta array<long>, bitmap array<long>"
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_compare(percent), kind)


def recentred(tested: DataFrame) -> DataFrame:
    """``(a, b)`` not yet tested: the classes near a centre with a better one, the class that differs least from their majority."""
    near = tested.where(F.size("delta") > 0)
    each = near.select("a", "b", F.explode("delta").alias("shingle"))
    sizes = near.groupBy("a").agg(F.count("*").alias("n"))
    common = each.groupBy("a", "shingle").agg(F.count("*").alias("times")).join(sizes, "a").where("2 * times > n").select("a", "shingle")
    hits = each.join(common, ["a", "shingle"]).groupBy("a", "b").agg(F.count("*").alias("hits"))
    score = near.join(hits, ["a", "b"]).select("a", "b", (F.col("far") - 2 * F.col("hits")).alias("score")).where("score < 0")
    best = score.groupBy("a").agg(F.min(F.struct("score", "b")).alias("best")).select("a", F.col("best.b").alias("centre"))
    pairs = near.join(best, "a").where("b <> centre").select(F.col("centre").alias("a"), "b").distinct()
    return pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")


def open_pairs(members: DataFrame, rooted: DataFrame, tested: DataFrame, percent: int) -> DataFrame:
    """``(a, b)``: pairs of members of a bucket or of one nearest centre, in different components, that the bound leaves.

    ``members`` has bucket, centre, node; ``tested`` what ``verify`` said of (centre, node).
    """
    own = members.where("node <> centre").join(rooted, "node", "left").select("bucket", "centre", "node", F.coalesce("root", "node").alias("root"))
    open_ = own.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("bucket")
    own = own.join(open_, "bucket")
    alone = tested.select("a", "b", F.explode("delta").alias("shingle")).groupBy("a", "shingle").agg(F.count("*").alias("n"), F.min("b").alias("b")).where("n = 1").groupBy("a", "b").agg(F.count("*").alias("u"))
    near = F.size("delta") > 0
    stats = tested.join(alone, ["a", "b"], "left").select(F.col("a").alias("centre"), F.col("b").alias("node"), F.struct(near.alias("near"), F.col("far").alias("s"), (F.col("far") - 2 * F.coalesce("u", F.lit(0))).alias("g"), F.col("n_b").alias("n"), F.col("n_a").alias("m"), *(F.col("bitmap")[w].alias(f"w{w}") for w in range(WORDS))).alias("at"))
    stats = written(stats, "distances")
    stars = tested.where(F.size("delta") > 0).groupBy(F.col("a").alias("centre")).agg(F.count("*").alias("star"))
    weight = F.when(F.col("at.s") < (F.col("at.n") + F.col("at.m")) / 3, F.coalesce("star", F.lit(0))).otherwise(0)  # half their union in common
    best = stats.join(stars, "centre", "left").groupBy("node").agg(F.max(F.struct(weight.alias("star"), (-F.col("at.s")).alias("close"), "centre", "at")).alias("best")).select("node", F.col("best.centre").alias("home"), F.col("best.at").alias("home_at"))
    own = written(own.join(stats, ["centre", "node"]).join(best, "node"), "open")
    share = F.lit((100 - percent) / (100 + percent) * (1 + 1e-12))

    def possible(p: str, q: str) -> Column:
        allowed = (F.col(f"{p}.n") + F.col(f"{q}.n")) * share
        apart = sum(F.bit_count(F.col(f"{p}.w{w}").bitwiseXOR(F.col(f"{q}.w{w}"))) for w in range(WORDS))
        both = F.col(f"{p}.near") & F.col(f"{q}.near")
        one, two = (F.col(f"{x}.s") - F.when(both, F.col(f"{y}.g")).otherwise(F.col(f"{y}.s")) for x, y in ((p, q), (q, p)))
        return (one <= allowed) & (two <= allowed) & (apart <= allowed)

    h = F.col("home_at")
    once = own.select("home", "node", "root", "home_at").distinct()
    # lefts are not linked to their home; rights are held once for lefts near it, by what they share with others, and once for the rest
    held = once.withColumn("close", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("reach", F.when(F.col("close"), h["g"]).otherwise(h["s"]))
    held = held.where(~F.col("close") | h["near"]).where(F.col("reach") > (h["m"] - h["n"]) * share)
    right = held.select("home", "close", F.pmod(F.xxhash64("node"), F.lit(1 << 20)).alias("slice"), F.col("node").alias("node_"), F.col("root").alias("root_"), h.alias("at_"), "reach")
    most = right.groupBy("home", "close").agg(F.max(F.col("reach") + F.col("at_.n") * share).alias("most"), F.ceil(F.count("*") / SLICE).cast("long").alias("slices"))
    left = once.where(h["s"] > (h["n"] + h["m"]) * share).withColumn("close", F.explode(F.when(h["near"], F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))))
    left = left.join(most, ["home", "close"]).where(h["s"] - h["n"] * share <= F.col("most")).withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    right = right.join(most.select("home", "close", "slices"), ["home", "close"]).withColumn("slice", F.pmod("slice", "slices"))
    apart = ~F.col("close") & F.col("home_at.near") & F.col("at_.near")  # met as close ones
    same = left.join(right, ["home", "close", "slice"]).where("node <> node_ and root <> root_").where(~apart).where(possible("home_at", "at_"))
    strange = own.where("home <> centre")
    every = own.select("bucket", F.col("home").alias("home_"), F.col("node").alias("node_"), F.col("root").alias("root_"), F.col("at").alias("at_"))
    cross = strange.join(every, "bucket").where("home <> home_ and root <> root_").where(possible("at", "at_"))
    both = same.select("node", "node_").unionByName(cross.select("node", "node_"))
    return both.select(F.least("node", "node_").alias("a"), F.greatest("node", "node_").alias("b")).distinct()


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``rid``, a number for each row. Write it before it is read twice: another scan may be split otherwise and number other rows."""
    return docs.drop("rid").withColumn("rid", F.monotonically_increasing_id())


def representatives(groups: DataFrame) -> DataFrame:
    """``rid`` of one row of each group of ``near_duplicates``: the smallest doc_id (null last), then the smallest rid. Rows with an empty set are all their own."""
    alone = groups.where("root is null").select("rid")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("first")
    return groups.where("root is not null").groupBy("root").agg(first).select("first.rid").unionByName(alone)


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``, and ``rid`` if it is numbered): doc_id, n_shingles, component_id, kept, rid, root.

    Texts are lower-cased A-Z; a set holds the distinct ``n``-word shingles, or
    the whole text where it has fewer words. Rows link when 100 * intersection
    >= percent * union. component_id is the smallest non-null doc_id reachable;
    kept is doc_id = component_id. Null or empty texts have an empty set and
    link with nothing. Every row is a document of its own, so repeated rows form
    one component; rows without doc_id take part and are never kept, unless they
    reach no doc_id at all, when component_id is null and kept true. Other
    columns are ignored.
    """
    own = F.col("rid") if "rid" in docs.columns else F.monotonically_increasing_id()
    numbered_ = docs.select(own.cast("long").alias("rid"), "doc_id", "text").withColumns({"mark": F.xxhash64("text", "doc_id"), "other": F.xxhash64(F.lit(1), "doc_id", "text")})
    source = numbered_.drop("rid")
    kind = T.StructType([T.StructField("rid", T.LongType()), T.StructField("doc_id", docs.schema["doc_id"].dataType), *T._parse_datatype_string("mark long, other long, n_shingles long, key binary, bands array<long>")])
    signed = written(numbered_.select("rid", "doc_id", *MARKS, "text").mapInArrow(_sign(n), kind), "signatures")
    first = F.min(F.struct("rid", *MARKS))
    nodes = written(signed.where("key is not null").groupBy("key").agg(first.alias("f"), F.min("doc_id").alias("least_id")).select(F.col("f.rid").alias("node"), *(f"f.{c}" for c in MARKS), "key", "least_id"), "classes")
    named = signed.join(nodes.select(F.col("node").alias("rid")), "rid", "left_semi").select(F.col("rid").alias("node"), F.explode("bands").alias("bucket"))
    shared = named.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = written(named.join(shared, "bucket"), "members")
    rank = members.groupBy("node").agg(F.sum("n").alias("rank"))
    centres = members.join(rank, "node").groupBy("bucket").agg(F.max(F.struct("rank", (-F.col("node")).alias("last"))).alias("c")).select("bucket", (-F.col("c.last")).alias("centre"))
    members = written(members.join(centres, "bucket").select("bucket", "node", "centre"), "members")

    sets = written(class_sets(nodes.select("node", *MARKS, "key").join(rank, "node", "left_semi"), source, n), "sets")
    star = members.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    tested = written(verify(star, sets, percent), "verified")
    tested = tested.unionByName(written(verify(recentred(tested), sets, percent), "verified"))
    found = tested.where("link").select("a", "b")
    rooted = graph.components(found, "a", "b")
    rest = written(open_pairs(members, rooted, tested, percent), "pairs")
    if not rest.isEmpty():
        more = verify(rest, sets, percent).where("link").select("a", "b")
        rooted = graph.components(found.unionByName(more), "a", "b")

    home = nodes.select("key", "node", "least_id").join(rooted, "node", "left").select("key", F.coalesce("root", "node").alias("root"), "least_id")
    named = home.groupBy("root").agg(F.min("least_id").alias("component_id"))
    home = home.join(named, "root").select("key", "component_id", F.col("root"))
    out = signed.join(home, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "rid", "root")
