"""Conflict-constrained best-fit packing of documents into bins of fixed capacity.

Items are dealt to shards of about ``SHARD`` documents by a row number, so a
source with a third of all rows, or a row repeated very often, is spread over
all of them. Within a shard, items come in decreasing size; bins are kept in
order of what room they have left, each with bitmaps of the sources and
duplicate clusters it holds. The search starts at the tightest bin that fits and
goes on to the next until one has neither; runs of bins carry the bits that all
of them hold, so a run that conflicts as a whole is one step. If no bin is
compatible, one is opened.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import written

SHARD = 8192
#: Most bins of a run.
RUN = 128
WORD = r"[^\x20\x09-\x0D]+"


class Bins:
    """Open bins by room left, in runs; ``bits`` holds what each bin conflicts with."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.bits: list[tuple[int, int]] = []
        self.runs: list[list[tuple[int, int]]] = []  # (room, bin) in order
        self.top: list[tuple[int, int]] = []  # each run's last
        self.common: list[tuple[int, int] | None] = []  # bits that all bins of the run hold; None where a bin has left

    def _put(self, room: int, number: int) -> None:
        item, held = (room, number), self.bits[number]
        at = min(bisect_left(self.top, item), len(self.runs) - 1)
        if at < 0:
            self.runs, self.top, self.common = [[item]], [item], [held]
            return
        run, both = self.runs[at], self.common[at]
        insort(run, item)
        self.top[at] = run[-1]
        self.common[at] = both and (both[0] & held[0], both[1] & held[1])
        if len(run) > RUN:
            half = len(run) // 2
            self.runs[at : at + 1] = [run[:half], run[half:]]
            self.top[at : at + 1] = [run[half - 1], run[-1]]
            self.common[at : at + 1] = [None, None]

    def _take(self, at: int, place: int) -> tuple[int, int]:
        run = self.runs[at]
        item = run.pop(place)
        if run:
            self.top[at], self.common[at] = run[-1], None
        else:
            del self.runs[at], self.top[at], self.common[at]
        return item

    def _all_hold(self, at: int) -> tuple[int, int]:
        if self.common[at] is None:
            source = cluster = -1
            for _, number in self.runs[at]:
                source, cluster = source & self.bits[number][0], cluster & self.bits[number][1]
            self.common[at] = source, cluster
        return self.common[at]

    def add(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """The bin of an item and the item's offset there; ``source`` and ``cluster`` are bitmaps, 0 for none."""
        for at in range(bisect_left(self.top, (size, -1)), len(self.runs)):
            held = self._all_hold(at)
            if held[0] & source or held[1] & cluster:
                continue
            run = self.runs[at]
            for place in range(bisect_left(run, (size, -1)), len(run)):
                held = self.bits[run[place][1]]
                if not (held[0] & source or held[1] & cluster):
                    left, number = self._take(at, place)
                    self.bits[number] = (held[0] | source, held[1] | cluster)
                    self._put(left - size, number)
                    return number, self.capacity - left
        self.bits.append((source, cluster))
        self._put(self.capacity - size, len(self.bits) - 1)
        return len(self.bits) - 1, 0


def _pack(capacity: int):
    def pack(key, table):
        shard = key[0].as_py()
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("size", "mark", "doc_id", "source", "cluster")), range(table.num_rows), strict=True), key=lambda r: (-(r[0] % capacity), r[1], r[2] is None, str(r[2]), r[5]))
        bins, out = Bins(capacity), []
        sources, clusters = ({x: 1 << n for n, x in enumerate(k for k, often in Counter(r[at] for r in rows).items() if often > 1 and k is not None)} for at in (3, 4))
        for size, _, doc, source, cluster, _ in rows:  # what only one item has conflicts with nothing
            s, c = sources.get(source, 0), clusters.get(cluster, 0)
            full, rest = divmod(size, capacity)
            pieces = full + (rest > 0 or size == 0)
            if rest or not size:
                number, offset = bins.add(rest, s, c)
                out.append((doc, full, pieces, full * capacity, rest, shard << 32 | number, offset))
            for piece in range(full):  # whole bins of one long document
                bins.bits.append((s, c))
                out.append((doc, piece, pieces, piece * capacity, capacity, shard << 32 | (len(bins.bits) - 1), 0))
        kinds = [table.schema.field("doc_id").type, *[pa.int64()] * 6]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds, strict=True)], names=["doc_id", "piece", "n_pieces", "start_word", "n_words", "bin_id", "offset"])

    return pack


def pack_documents(docs: DataFrame, capacity: int = 2048, cluster=None) -> DataFrame:
    """``doc_id, piece, n_pieces, start_word, n_words, bin_id, offset``: one row for each piece of each row of ``docs``.

    ``docs`` has doc_id, text, source. A document longer than ``capacity`` words
    is cut into full bins and a rest. No bin holds two documents of one source or
    one duplicate cluster (the Column ``cluster``; equal texts unless given); null
    sources and clusters conflict with nothing. Null or empty texts are items of
    size 0. Ties go by a hash of the text, then by doc_id; repeated rows are items
    of their own, in different bins; an empty table gives no row. Other columns
    are ignored.
    """
    cluster = F.xxhash64("text") if cluster is None else cluster
    cluster = F.when(F.coalesce(F.col("text"), F.lit("")) != "", cluster)
    mark = F.xxhash64("text")
    items = docs.select("doc_id", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), "source", cluster.alias("cluster"), mark.alias("mark"))
    items = written(items.withColumn("row", F.monotonically_increasing_id()), "items")  # numbered once
    shards = max(1, math.ceil(items.count() / SHARD))
    items = items.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("long"))
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *T._parse_datatype_string("piece long, n_pieces long, start_word long, n_words long, bin_id long, offset long")])
    return items.groupBy("shard").applyInArrow(_pack(capacity), schema)
