"""Near-equal embeddings by a pigeonhole join over subspaces; exact.

Two unit vectors with a cosine of at least c differ by at most 2 (1 - c) in squared
distance. Rotated and split into blocks of a few dimensions, each block with a
share of that budget in proportion to its variance, they must keep the budget in
some block. Each block is a range join: vectors lie in a grid over the block's
most spread directions, with cells as wide as the budget allows, and meet those of
their own cell and of half the cells around it. Candidates are checked on the
block, then on the whole vectors, where they met; a pair counts only in the first
block whose budget it keeps, so nothing has to be told apart afterwards.

The rotation is the principal axes of a bounded sample of vectors; it decides how
fast the search is, not what it finds. Axes are dealt to blocks in turns, so that
blocks have about the same variance and each has one of the widest axes.

Equal vectors are one class with a size. A cell of any size is cut into chunks that
meet two by two in tasks of their own; a task returns one number and one edge for
each of its vectors at most, however many pairs it found. Its work is the product of
the chunks, so a group of near but different vectors costs the square of its size
in multiplications, spread over tasks, but neither memory nor rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import written

#: Dimensions of a block, directions of its grid, vectors of a chunk, and sampled vectors for the rotation.
WIDTH, GRID, CHUNK, SAMPLED = 16, 2, 16384, 4096
#: Products in single floats are this exact, for vectors of length 1 at most.
SINGLE = 1e-5
#: Pairs this close to a limit are decided by correctly rounded sums, so that every task decides alike.
CLOSE = 1e-9
SCHEMA = "a long, b long, n long"


def usable(v: Column) -> Column:
    """Not null, not zero, and without null or non-finite components."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def units(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


class Subspaces:
    """The rotation, its blocks of columns, and each block's budget; a few numbers for each dimension squared."""

    def __init__(self, sample: np.ndarray, least: float, width: int):
        dims = sample.shape[1]
        variance, axes = np.linalg.eigh(np.cov(sample.T).reshape(dims, dims) if len(sample) > 1 else np.eye(dims))
        order = np.argsort(-variance, kind="stable")
        count = -(-dims // width)
        turns = [n if row % 2 == 0 else count - 1 - n for row in range(-(-dims // count)) for n in range(count)][:dims]
        turns = np.asarray(turns)
        self.columns = [np.flatnonzero(turns == b) for b in range(count)]
        self.rotation = np.ascontiguousarray(axes[:, order])
        spread = np.maximum(variance[order], 0)
        each = np.array([spread[c].sum() for c in self.columns])
        each = each + 1e-3 * each.mean() + 1e-30
        budget = 2 * (1 - least) * each / each.sum()
        self.least, self.limits = least, budget * (1 + CLOSE) + 1e-12
        self.cell = np.sqrt(self.limits) * (1 + 1e-6)


def offsets(grid: int) -> list[tuple[int, ...]]:
    """One of each two opposite neighbours of a cell."""
    every = [tuple(n // 3**a % 3 - 1 for a in range(grid)) for n in range(3**grid)]
    return [o for o in every if o[::-1] > (0,) * grid]


def _homes(space: Subspaces, grid: int):
    def place(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch["v"].flatten().to_numpy(zero_copy_only=False)
            vectors = flat.reshape(batch.num_rows, -1)
            turned = units(vectors.astype(np.float64)) @ space.rotation
            at = np.stack([np.floor(turned[:, c[:grid]] / side) for c, side in zip(space.columns, space.cell, strict=True)], axis=1).astype(np.int32)
            cells = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(space.columns)), pa.ListArray.from_arrays(pa.array(np.arange(at.shape[0] * at.shape[1] + 1, dtype=np.int32) * at.shape[2]), pa.array(at.ravel())))
            yield pa.RecordBatch.from_arrays([batch["cid"], batch["n"], pa.array([x.tobytes() for x in vectors], pa.binary()), cells], names=["cid", "n", "v", "cells"])

    return place


def _exact_dot(a, b) -> float:
    return math.fsum(float(x) * float(y) for x, y in zip(a, b, strict=True))


class Members:
    """The vectors of a task: as units, turned by the rotation, and for one block as single floats whose product is the squared distance there."""

    def __init__(self, space: Subspaces, vectors: np.ndarray, block: int):
        self.space, self.block, self.unit, self.turned = space, block, vectors, vectors @ space.rotation
        own = self.turned[:, space.columns[block]]
        size, one = (own * own).sum(axis=1)[:, None], np.ones((len(own), 1))
        self.first = np.hstack((own, size, one)).astype(np.float32)
        self.second = np.ascontiguousarray(np.hstack((-2 * own, one, size)).astype(np.float32))

    def sums(self, i: np.ndarray, j: np.ndarray, values: np.ndarray, dense: bool) -> np.ndarray:
        """Dot products of pairs of rows of ``values``: by one product of all rows if most pairs are asked for."""
        if dense:
            p, x = np.unique(i, return_inverse=True)
            q, y = np.unique(j, return_inverse=True)
            return (values[p] @ values[q].T)[x, y]
        return np.concatenate([np.einsum("nk,nk->n", values[i[n : n + 32768]], values[j[n : n + 32768]]) for n in range(0, len(i), 32768)])

    def within(self, b: int, i: np.ndarray, j: np.ndarray, dense: bool) -> np.ndarray:
        """Which pairs keep the budget of block b."""
        own, limit = self.turned[:, self.space.columns[b]], self.space.limits[b]
        size = (own * own).sum(axis=1)
        d = size[i] + size[j] - 2 * self.sums(i, j, own, dense)
        ok = d <= limit
        for n in np.flatnonzero(np.abs(d - limit) <= CLOSE):
            axes = self.space.rotation[:, self.space.columns[b]].T
            ok[n] = math.fsum((_exact_dot(self.unit[i[n]], a) - _exact_dot(self.unit[j[n]], a)) ** 2 for a in axes) <= limit
        return ok

    def pairs(self, p: np.ndarray, q: np.ndarray, upper: bool) -> tuple[np.ndarray, np.ndarray]:
        """The linked pairs of members p x q that keep this block's budget and no earlier one's; ``upper``: only pairs above the diagonal."""
        near = self.first[p] @ self.second[q].T <= np.float32(self.space.limits[self.block] + SINGLE)
        if upper:
            near = np.triu(near, 1)
        at = np.flatnonzero(near)
        i, j = p[at // len(q)], q[at % len(q)]
        dense = len(at) * 8 > near.size
        for step in ("block", "whole", *range(self.block)):
            if not len(i):
                break
            if step == "whole":
                cosine = self.sums(i, j, self.unit, dense)
                ok = cosine >= self.space.least
                for n in np.flatnonzero(np.abs(cosine - self.space.least) <= CLOSE):
                    x, y = self.unit[i[n]], self.unit[j[n]]
                    ok[n] = _exact_dot(x, y) / math.sqrt(_exact_dot(x, x) * _exact_dot(y, y)) >= self.space.least
            else:
                ok = self.within(self.block, i, j, dense) if step == "block" else ~self.within(step, i, j, dense)
            i, j = i[ok], j[ok]
        return i, j


def _joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Makes labels equal along the pairs, in place: the smaller of two becomes the other's."""
    while True:
        a, b = label[i], label[j]
        open_ = a != b
        if not open_.any():
            return
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        parent = np.arange(len(label))
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (parent[parent] != parent).any():
            parent = parent[parent]
        label[:] = parent[label]


def _links(space: Subspaces, dtype, step: int = 1024):
    def links(table: pa.Table) -> pa.Table:
        block, same = int(table["block"][0].as_py()), table["first"][0].as_py() == table["second"][0].as_py()
        side = table["side"].to_numpy()
        order = np.argsort(table["cid"].to_numpy(), kind="stable")
        raw = table["v"].combine_chunks()
        vectors = units(np.frombuffer(b"".join(raw.to_pylist()), dtype).reshape(len(side), -1)[order].astype(np.float64))
        side, cid, n = side[order], table["cid"].to_numpy()[order], table["n"].to_numpy()[order]
        left = np.flatnonzero(side == 0)
        right = left if same else np.flatnonzero(side == 1)
        members = Members(space, vectors, block)
        total, label = np.zeros(len(cid), np.int64), np.arange(len(cid))
        for lo in range(0, len(left), step):
            for hi in range(lo if same else 0, len(right), step):
                i, j = members.pairs(left[lo : lo + step], right[hi : hi + step], same and hi == lo)
                if len(i):
                    np.add.at(total, i, n[j])
                    np.add.at(total, j, n[i])
                    _joined(label, i, j)
        some, moved = np.flatnonzero(total), np.flatnonzero(label != np.arange(len(cid)))
        a = np.concatenate((cid[some], cid[moved]))
        b = pa.array(np.concatenate((cid[some], cid[label[moved]])), mask=np.arange(len(a)) < len(some))
        return pa.table({"a": pa.array(a, pa.int64()), "b": b.cast(pa.int64()), "n": pa.array(np.concatenate((total[some], np.zeros(len(moved), np.int64))), pa.int64())})

    return links


def linked_classes(classes: DataFrame, dims: int, least: float, width: int = WIDTH, grid: int = GRID, chunk: int = CHUNK) -> DataFrame:
    """``a, b, n`` of ``cid, n, v``: with b null, n vectors linked to a, part of a sum; else an edge, enough of them to connect what is linked."""
    element = classes.schema["v"].dataType.elementType.typeName()
    dtype = np.float32 if element == "float" else np.float64
    sample = classes.orderBy(F.xxhash64("cid")).limit(SAMPLED).select("v").toPandas()["v"]
    space = Subspaces(units(np.stack([np.asarray(x, np.float64) for x in sample])), least, width)
    grid = min(grid, min(len(c) for c in space.columns))
    given = classes.select("cid", "n", F.col("v") if element in ("float", "double") else F.col("v").cast("array<double>").alias("v"))
    homes = written(given.mapInArrow(_homes(space, grid), "cid long, n long, v binary, cells array<array<int>>"), "homes")
    axes = [f"c{a}" for a in range(grid)]
    key = ["block", *axes]
    own = homes.select("cid", F.posexplode("cells").alias("block", "cell")).select("block", *(F.col("cell")[a].alias(x) for a, x in enumerate(axes)))
    sizes = written(own.groupBy(*key).agg(F.count("*").alias("n_own")), "cells")
    moved = lambda o: [(F.col(x) + d).alias(x) for x, d in zip(axes, o, strict=True)]
    visits = F.explode(F.array(*(F.struct(*(F.lit(d).alias(f"d{a}") for a, d in enumerate(o))) for o in offsets(grid))))
    visitors = sizes.withColumn("o", visits).select("block", *((F.col(x) + F.col(f"o.d{a}")).alias(x) for a, x in enumerate(axes)), F.col("n_own").alias("n_visit")).groupBy(*key).agg(F.sum("n_visit").alias("n_visit"))
    chunks = sizes.join(visitors, key, "left").select(*key, F.ceil(F.col("n_own") / chunk).alias("own"), F.ceil(F.coalesce("n_visit", F.lit(0)) / chunk).alias("visit"))
    chunks = written(chunks, "chunks")
    to = F.explode(F.array(F.struct(F.lit(1).alias("side"), *(F.lit(0).alias(f"d{a}") for a in range(grid))), *(F.struct(F.lit(2).alias("side"), *(F.lit(d).alias(f"d{a}") for a, d in enumerate(o))) for o in offsets(grid))))
    copies = homes.select("cid", F.posexplode("cells").alias("block", "cell")).withColumn("to", to)
    copies = copies.select("cid", "block", F.col("to.side").alias("role"), *((F.col("cell")[a] + F.col(f"to.d{a}")).alias(x) for a, x in enumerate(axes))).join(chunks, key)
    # chunks 0.. are the cell's own, the visitors' follow; each own chunk meets itself and every later one
    mine = F.when(F.col("role") == 1, F.pmod(F.xxhash64("cid"), "own")).otherwise(F.col("own") + F.pmod(F.xxhash64("cid"), F.greatest("visit", F.lit(1))))
    last = F.col("own") + F.col("visit") - 1
    count_to = lambda lo, hi: F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))
    as_first = F.transform(count_to(F.col("mine"), last), lambda k: F.struct(F.col("mine").alias("first"), k.alias("second"), F.lit(0).alias("side")))
    as_second = F.transform(count_to(F.lit(0).cast("long"), F.least(F.col("mine"), F.col("own")) - 1), lambda k: F.struct(k.alias("first"), F.col("mine").alias("second"), F.lit(1).alias("side")))
    dealt = copies.withColumn("mine", mine).withColumn("t", F.explode(F.when(F.col("role") == 1, F.concat(as_first, as_second)).otherwise(as_second)))
    dealt = dealt.select("cid", *key, "t.first", "t.second", "t.side").join(homes.select("cid", "n", "v"), "cid")
    return dealt.groupBy(*key, "first", "second").applyInArrow(_links(space, dtype), SCHEMA)


def near_vectors(vectors: DataFrame, least: float = 0.9, width: int = WIDTH, grid: int = GRID, chunk: int = CHUNK) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, one row for each row of ``vectors`` (vec_id, embedding; other columns are ignored).

    Rows are linked if the cosine of their vectors, in double precision, is at
    least ``least``. Null or zero vectors, empty ones, and those with null or
    non-finite components are linked with nothing, nor are vectors of different
    length. Repeated rows are linked with each other. ``component_id`` is the
    smallest vec_id that is reached, null only where no row reached has one;
    ``kept``: the row has that vec_id. An empty table gives no rows.
    """
    rows = vectors.select("vec_id", F.col("embedding").alias("v"))
    good = usable(F.col("v"))
    classes = written(rows.where(good).groupBy("v").agg(F.count("*").alias("n"), F.min("vec_id").alias("low")).withColumn("cid", F.monotonically_increasing_id()), "classes")
    alone = rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = None
    for r in classes.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n")).orderBy("dims").collect():  # a row for each length of vector
        if r.n > 1:
            links = linked_classes(classes.where(F.size("v") == r.dims), r.dims, least, width, grid, chunk)
            found = links if found is None else found.unionByName(links)
    if found is None:
        found = classes.sparkSession.createDataFrame([], SCHEMA)
    found = written(found, "vector_links")
    counts = found.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("others"))
    roots = components(found.where("b is not null"), "a", "b").select(F.col("node").alias("cid"), "root")
    placed = written(classes.select("cid", "low", "n").join(counts, "cid", "left").join(roots, "cid", "left").select("cid", "low", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "cid").alias("root")), "placed")
    lows = written(placed.groupBy("root").agg(F.min("low").alias("component_id")), "lows")
    placed = written(placed.join(lows, "root").select("cid", "n_links", "component_id"), "placed")
    named = written(classes.select("cid", "v").join(placed, "cid").select("v", "n_links", "component_id"), "named")
    made = rows.where(good).join(named, "v").select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    return made.unionByName(alone)
