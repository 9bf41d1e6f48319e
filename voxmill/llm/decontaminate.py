"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

MinHash tells how much two sets resemble each other, so a short item inside a
long document would go unseen. Items are therefore partitioned by size (powers
of two of their shingle count) and each partition is searched in windows of a
length of its order: any run of shingles as long as an item lies inside one
window, where the resemblance is 0.3 or more. Coordinate minima are computed
once per short block of a text; a window's are the minima of its blocks'. One
equal coordinate makes a candidate, which the document's whole shingle set then
confirms or not.

The benchmark is a stated query set: its distinct texts go to the tasks in blocks
of about ``ITEM_BYTES``, one pass over the documents for each. A pass is written
before the next one is planned, so the driver and a plan hold one block at most.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import minhash, words
from .shared import drop_written, written

COORDINATES = 48
ITEM_BYTES = 2 << 20


class Items:
    """Shingle sets of a block of items, partitioned by size, and a table of each partition's signatures."""

    def __init__(self, ids: list, texts: list, n: int):
        data, at = words.utf8(pa.array(texts, pa.large_string()))
        w = words.Words(data, at, lower=True)
        shingle, b = words.shingles(w.hash, w.bounds, n)
        self.n, self.ids, self.sets = n, [], []
        for d in np.flatnonzero(np.diff(b)):
            self.ids.append(ids[d])
            self.sets.append(np.unique(shingle[b[d] : b[d + 1]]))
        size = np.array([len(s) for s in self.sets], dtype=np.int64)
        level = np.floor(np.log2(np.maximum(size, 1))).astype(np.int64)
        self.block = max(1, (1 << int(level.min())) // 2) if len(size) else 1
        self.parts = []
        for c in np.unique(level).tolist():
            mine = np.flatnonzero(level == c)
            starts = np.concatenate(([0], np.cumsum(size[mine])[:-1]))
            signature = minhash.circulant(np.concatenate([self.sets[i] for i in mine]), starts, COORDINATES)
            step = max(1, (1 << c) // (2 * self.block))
            width = math.ceil((2 << c) / self.block) + step  # blocks of a window: the longest item from any position within a step
            order = np.argsort(signature, axis=0, kind="stable")
            bits = 1 << min(26, max(12, math.ceil(math.log2(64 * len(mine)))))
            seen = np.zeros((COORDINATES, bits), dtype=bool) if bits * COORDINATES < 1 << 26 else None
            if seen is not None:
                seen[np.arange(COORDINATES)[:, None], (signature.T & np.uint32(bits - 1))] = True
            self.parts.append((mine, step, width, np.take_along_axis(signature, order, axis=0), order, seen))

    def candidates(self, shingle: np.ndarray, bounds: np.ndarray) -> set[tuple[int, int]]:
        """``(text, item)`` pairs that share a coordinate in a window."""
        found: set[tuple[int, int]] = set()
        count = np.diff(bounds)
        if not self.sets or not len(shingle):
            return found
        blocks = -(-count // self.block)
        text = np.repeat(np.arange(len(count)), blocks)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        low = minhash.circulant(shingle, bounds[text] + nth * self.block, COORDINATES)
        for mine, step, width, sorted_, order, seen in self.parts:
            pad = np.full((width, COORDINATES), 0xFFFFFFFF, dtype=np.uint32)
            window, size = np.concatenate((low, pad)), 1
            while size * 2 <= width:
                window = np.minimum(window[:-size], window[size:])
                size *= 2
            window = np.minimum(window[: len(low)], window[width - size : width - size + len(low)])[::step]
            for k in range(COORDINATES):
                value = np.ascontiguousarray(window[:, k])
                at = np.arange(len(value)) if seen is None else np.flatnonzero(seen[k][value & np.uint32(seen.shape[1] - 1)])
                first = np.searchsorted(sorted_[:, k], value[at], side="left")
                last = np.searchsorted(sorted_[:, k], value[at], side="right")
                for w, lo, hi in zip(at[last > first].tolist(), first[last > first].tolist(), last[last > first].tolist(), strict=True):
                    d0, d1 = int(text[w * step]), int(text[min(w * step + width, len(text)) - 1])
                    found.update((d, int(mine[i])) for i in order[lo:hi, k] for d in range(d0, d1 + 1))
        return found

    def search(self, column: pa.Array):
        """``(row, item, shingles of the item, those in the row's text)`` of every candidate."""
        data, at = words.utf8(column)
        for lo, hi in words.slices(at):
            w = words.Words(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], lower=True)
            shingle, b = words.shingles(w.hash, w.bounds, self.n)
            own, of = None, -1
            for d, i in sorted(self.candidates(shingle, b)):
                if d != of:
                    own, of = np.unique(shingle[b[d] : b[d + 1]]), d
                if len(own):
                    item = self.sets[i]
                    yield lo + d, i, len(item), int((own[np.minimum(np.searchsorted(own, item), len(own) - 1)] == item).sum())


def item_blocks(items: DataFrame, n: int):
    """``(block, whether it is the last)``: the distinct item texts, each with its smallest item_id, in blocks of bounded size."""
    own = items.where("text is not null").groupBy("text").agg(F.min("item_id").alias("item_id"))
    total = own.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = max(1, math.ceil(total / ITEM_BYTES))
    for b in range(blocks):
        rows = own.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).collect()
        yield Items([r.item_id for r in rows], [r.text for r in rows], n), b == blocks - 1


def contained_items(docs: DataFrame, items: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``(doc_id, item_id, n_shingles, n_shared, containment)`` for items whose distinct ``n``-word shingles are to ``percent`` or more in a document.

    Words are lower-cased A-Z. Items of fewer words are one shingle and match
    only documents that consist of them; items without words match nothing, and
    equal item texts count as the one with the smallest item_id. Null and empty
    documents hold nothing; repeated rows each give their own rows. Other columns
    are ignored.
    """

    kind = to_arrow_type(items.schema["item_id"].dataType)

    def of(block: Items):
        def find(batches):
            for batch in batches:
                hits = [x for x in block.search(batch.column("text")) if 100 * x[3] >= percent * x[2]]
                take = batch.column("doc_id").take(pa.array([x[0] for x in hits], pa.int64()))
                yield pa.RecordBatch.from_arrays([take, pa.array([block.ids[x[1]] for x in hits], kind), pa.array([x[2] for x in hits], pa.int64()), pa.array([x[3] for x in hits], pa.int64()), pa.array([x[3] / x[2] for x in hits], pa.float64())], names=["doc_id", "item_id", "n_shingles", "n_shared", "containment"])

        return find

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("item_id", items.schema["item_id"].dataType), *T._parse_datatype_string("n_shingles long, n_shared long, containment double")])
    out = None
    for block, last in item_blocks(items, n):
        part = docs.select("doc_id", "text").mapInArrow(of(block), schema)
        part = part if last else written(part, "contained")
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no item to ``percent`` or more."""

    def of(block: Items):
        def keep(batches):
            for batch in batches:
                held = np.ones(batch.num_rows, dtype=bool)
                for row, _, size, both in block.search(batch.column(batch.schema.get_field_index("text"))):
                    if 100 * both >= percent * size:
                        held[row] = False
                yield batch.filter(pa.array(held))

        return keep

    for block, last in item_blocks(items, n):
        left = docs.mapInArrow(of(block), docs.schema)
        before, docs = docs, left if last else written(left, "clean")
        if not last:
            drop_written(before)
    return docs
