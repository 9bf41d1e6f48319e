"""Removal of long word spans that occur more than once, by compaction of a de Bruijn graph.

Token k-mers are the edges of a de Bruijn graph: an edge leads from its first
k-1 words to its last k-1 words. Only repeated edges matter, so:

1. Anchors. Two equal windows of ``window`` words hold the same minimal short
   k-mer, so windows around an anchor that occurs once in the corpus can't
   repeat. This leaves about the repeated part of the text, and loses nothing.
2. Edges. The distinct k-mers (k = ``window``) that are left in a block are
   joined with those of all other blocks by the blocked exchange, with the words
   before and after them. An edge repeats if it starts at two places. It is the
   end of a path if its occurrences disagree about the next word, or its
   successor's about the previous one.
3. Compaction. Repeated edges that follow each other with no branch between
   them form one path: a second join by block brings each edge's branches back
   to its documents. Every occurrence of one edge of a path is part of an
   occurrence of the whole path, so each occurrence is read off its source
   document as one span, named by the hash of its first edge.
4. Verification. The source words at the span's coordinates are digested
   (128 bits); a join keeps paths whose digest occurs twice or more. A block's
   spans of one path are one row, however many they are.
5. Words covered by a verified span are removed.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared, words

ANCHOR = 16
ROW = "block long, bucket long, n long, hash binary, count binary, near binary"
REPLY = "block long, bucket long, n long, hash binary, flag binary"
SPANS = "block long, path long, digest binary, n long, at binary"
#: A span: its document's place in the block, first word, word after the last.
AT = "<qqq"
#: Bits of a reply: the edge repeats; a path ends before it; a path ends after it.
REPEATS, OPENS, CLOSES = 1, 2, 4


def sliding(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """best over values[i : i + width] for every full window."""
    out, size = values, 1
    while size * 2 <= width:
        out = best(out[:-size], out[size:])
        size *= 2
    return best(out[: len(values) - width + 1], out[width - size : width - size + len(values) - width + 1])


def read_block(table: pa.Table):
    """Word hashes and word bounds of a block's texts."""
    data, at = words.utf8(table.column("text"))
    hashes, bounds = [], [np.zeros(1, np.int64)]
    for lo, hi in words.slices(at):
        w = words.Words(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], lower=False)
        hashes.append(w.hash)
        bounds.append(w.bounds[1:] + bounds[-1][-1])
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.concatenate(bounds)


def anchors(word: np.ndarray, bounds: np.ndarray, window: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the minimal ``size``-mers of all ``window``-word windows inside texts."""
    span = window - size + 1
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(word) < window:
        return none
    mer = words.ngrams(word, size)
    valid = starts_within(bounds, window)[: len(word) - window + 1]
    low = np.where(valid, sliding(mer, span, np.minimum), np.uint64(0))
    around = np.concatenate((np.zeros(span - 1, np.uint64), low, np.zeros(span - 1, np.uint64)))
    chosen = np.flatnonzero((sliding(around, span, np.maximum) == mer) & (mer > 0))
    return chosen, mer[chosen]


def starts_within(bounds: np.ndarray, window: int) -> np.ndarray:
    """Whether a window from each word on ends within the word's text."""
    n = int(bounds[-1])
    return np.arange(n) + window <= np.repeat(bounds[1:], np.diff(bounds))


def by_bucket(hashes: np.ndarray, buckets: int):
    """Stable order of entries by bucket, and each bucket's slice of it."""
    bucket = shared.bucket_of(hashes, buckets)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    return [(int(bucket[part[0]]), part) for part in np.split(order, cuts) if len(part)]


def rows(records: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*records), schema, strict=True)], schema=schema) if records else schema.empty_table()


def arrow(ddl: dict[str, pa.DataType]) -> pa.Schema:
    return pa.schema(list(ddl.items()))


ASK = {"block": pa.int64(), "bucket": pa.int64(), "n": pa.int64(), "hash": pa.binary(), "count": pa.binary(), "near": pa.binary()}
TOLD = {"block": pa.int64(), "bucket": pa.int64(), "n": pa.int64(), "hash": pa.binary(), "flag": pa.binary()}
SPAN = {"block": pa.int64(), "path": pa.int64(), "digest": pa.binary(), "n": pa.int64(), "at": pa.binary()}


def opened(table: pa.Table) -> tuple[int, pa.Table]:
    """A block's number and documents."""
    return table.column("block")[0].as_py(), shared.from_bytes(table.column("rows")[0].as_py())


def column(table: pa.Table, name: str, kind: str) -> np.ndarray:
    """A packed column of all rows, laid end to end."""
    return np.concatenate([shared.unpack(x, kind, m) for x, m in zip(table.column(name).to_pylist(), table.column("n").to_pylist(), strict=True)])


def ask_anchors(window: int, size: int, buckets: int):
    def ask(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                block, table = opened(pa.Table.from_batches([batch.slice(at, 1)]))
                _, mer = anchors(*read_block(table), window, size)
                mer, count = np.unique(mer, return_counts=True)
                yield from rows([(block, b, len(p), shared.pack(mer[p]), shared.pack(np.minimum(count[p], 2).astype(np.uint8)), b"") for b, p in by_bucket(mer, buckets)], arrow(ASK)).to_batches()

    return ask


def tell_anchors(table):
    """To each block, its anchors that occur twice or more in the corpus."""
    table = table.combine_chunks()
    block, bucket, n = (table.column(c).to_pylist() for c in ("block", "bucket", "n"))
    hashes = column(table, "hash", "uint64")
    _, _, which = shared.distinct(hashes)
    often = np.bincount(which, weights=column(table, "count", "uint8"))[which] > 1
    out, at = [], 0
    for b, r, m in zip(block, bucket, n, strict=True):
        keep = hashes[at : at + m][often[at : at + m]]
        at += m
        if len(keep):
            out.append((b, r, len(keep), shared.pack(keep), b""))
    return rows(out, arrow(TOLD))


def ask_edges(window: int, size: int, buckets: int):
    """A block's distinct edges: 1 or 2 for once or more, and the words before and after where all occurrences agree, else 0."""

    def ask(key, table, told):
        if not table.num_rows or not told.num_rows:
            return arrow(ASK).empty_table()
        block, docs = opened(table)
        word, bounds = read_block(docs)
        at, mer = anchors(word, bounds, window, size)
        often = np.sort(column(told.combine_chunks(), "hash", "uint64"))
        at = at[often[np.minimum(np.searchsorted(often, mer), len(often) - 1)] == mer]
        change = np.zeros(len(word) + 2, dtype=np.int32)  # windows that start up to window - size words before an anchor
        np.add.at(change, np.maximum(at - (window - size), 0), 1)
        np.add.at(change, at + 1, -1)
        start = np.flatnonzero((np.cumsum(change)[: len(word)] > 0) & starts_within(bounds, window))
        edge = words.ngrams(word, window)[start]
        short = (word >> np.uint64(33)).astype(np.uint32)  # 0 is kept for "no word"
        first = np.zeros(len(word) + window + 1, dtype=bool)
        first[bounds] = True
        after = np.where(first[start + window], 0, np.append(short | 1, np.zeros(window + 1, np.uint32))[np.minimum(start + window, len(word))])
        before = np.where(first[start], 0, short[start - 1] | 1)
        order = np.argsort(edge)
        own = edge[order]
        head = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.zeros(0, np.int64)
        count = np.minimum(np.diff(np.append(head, len(own))), 2).astype(np.uint8)
        near = np.zeros(len(head), np.uint64)
        for part, shift in ((before, 32), (after, 0)):
            low, high = (f.reduceat(part[order], head) if len(head) else part for f in (np.minimum, np.maximum))
            near |= np.where(low == high, low, 0).astype(np.uint64) << np.uint64(shift)
        own = own[head]
        return rows([(block, b, len(p), shared.pack(own[p]), shared.pack(count[p]), shared.pack(near[p])) for b, p in by_bucket(own, buckets)], arrow(ASK))

    return ask


def tell_edges(table):
    """To each block, its edges that repeat in the corpus: whether paths end before or after them."""
    table = table.combine_chunks()
    block, bucket, n = (table.column(c).to_pylist() for c in ("block", "bucket", "n"))
    hashes, near, count = column(table, "hash", "uint64"), column(table, "near", "uint64"), column(table, "count", "uint8")
    order = np.argsort(hashes)
    sorted_hash, sorted_near = hashes[order], near[order]
    head = np.flatnonzero(np.concatenate(([True], sorted_hash[1:] != sorted_hash[:-1])))
    flag = np.where(np.add.reduceat(count[order].astype(np.int64), head) > 1, REPEATS, 0).astype(np.uint8)
    for part, bit in ((sorted_near >> np.uint64(32), OPENS), (sorted_near & np.uint64(0xFFFFFFFF), CLOSES)):
        low, high = np.minimum.reduceat(part, head), np.maximum.reduceat(part, head)
        flag |= np.where((low != high) | (low == 0), bit, 0).astype(np.uint8)
    out = np.empty(len(order), dtype=np.uint8)
    out[order] = np.repeat(flag, np.diff(np.append(head, len(order))))
    told, at = [], 0
    for b, r, m in zip(block, bucket, n, strict=True):
        keep = np.flatnonzero(out[at : at + m] & REPEATS) + at
        at += m
        if len(keep):
            told.append((b, r, len(keep), shared.pack(hashes[keep]), shared.pack(out[keep])))
    return rows(told, arrow(TOLD))


def where_in(values: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``values`` that are in ``among`` (sorted), and their places there; a bitmap rules most others out."""
    bits = np.uint64((1 << max(16, int(len(among)).bit_length() + 4)) - 1)
    seen = np.zeros(int(bits) + 1, dtype=bool)
    seen[among & bits] = True
    at = np.flatnonzero(seen[values & bits])
    place = np.minimum(np.searchsorted(among, values[at]), len(among) - 1)
    same = among[place] == values[at]
    return at[same], place[same]


def compact(window: int):
    """Spans of compacted paths in a block's documents, a row for each path and digest of the source words."""

    def spans(key, table, told):
        if not table.num_rows or not told.num_rows:
            return arrow(SPAN).empty_table()
        block, docs = opened(table)
        told = told.combine_chunks()
        edges, flags = column(told, "hash", "uint64"), column(told, "flag", "uint8")
        order = np.argsort(edges)
        edges, flags = edges[order], flags[order]
        data, offset = words.utf8(docs.column("text"))
        found: dict[tuple[int, bytes], bytearray] = {}
        for lo, hi in words.slices(offset):
            w = words.Words(data[offset[lo] : offset[hi]], offset[lo : hi + 1] - offset[lo], lower=False, spans=True)
            edge = words.ngrams(w.hash, window)
            mine, place = where_in(edge, edges)
            inside = starts_within(w.bounds, window)[mine]
            mine, bits = mine[inside], flags[place[inside]]
            if not len(mine):
                continue
            doc = np.searchsorted(w.bounds, mine, side="right") - 1
            cut = (np.diff(mine) != 1) | (np.diff(doc) != 0) | (bits[1:] & OPENS > 0) | (bits[:-1] & CLOSES > 0)
            first = np.concatenate(([0], np.flatnonzero(cut) + 1))
            last = np.append(first[1:] - 1, len(mine) - 1)
            text = data[offset[lo] : offset[hi]].tobytes()
            for a, b, d, path in zip(mine[first].tolist(), mine[last].tolist(), doc[first].tolist(), words.signed(edge[mine[first]]).tolist(), strict=True):
                source = b" ".join(text[w.start[a] : w.end[b + window - 1]].split())
                at = int(w.bounds[d])
                name = path, hashlib.blake2b(source, digest_size=16).digest()
                found.setdefault(name, bytearray()).extend(struct.pack(AT, lo + d, a - at, b + window - at))
        return rows([(block, path, digest, len(x) // struct.calcsize(AT), bytes(x)) for (path, digest), x in found.items()], arrow(SPAN))

    return spans


def remove(kept: list[str], with_text: bool):
    def cut(key, table, spans):
        _, docs = opened(table)
        doc, start, stop = np.frombuffer(b"".join(spans.column("at").to_pylist()), np.int64).reshape(-1, 3).T
        order = np.lexsort((start, doc))
        cuts = np.searchsorted(doc[order], np.arange(docs.num_rows + 1))
        n_words, n_removed, left = [], [], []
        data, at = words.utf8(docs.column("text"))
        for d, (lo, hi) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
            word = data[lo:hi].tobytes().split()
            keep, end, mine = [], 0, order[cuts[d] : cuts[d + 1]]
            for a, b in zip(start[mine].tolist(), stop[mine].tolist(), strict=True):
                keep += word[end:a]
                end = max(end, b)
            keep += word[end:]
            rest = b" ".join(keep)
            n_words.append(len(word))
            n_removed.append(len(word) - len(keep))
            left.append(rest.decode() if with_text else hashlib.sha256(rest).hexdigest())
        made = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(left, pa.string())]
        return pa.Table.from_arrays([*(docs.column(c) for c in kept), *made], names=[*kept, "n_words", "n_removed", "kept"])

    return cut


def remove_repeats(docs: DataFrame, window: int = 35, text: str = "text", with_text: bool = True, block_bytes: int = shared.BLOCK_BYTES, bucket_bytes: int = shared.BUCKET_BYTES) -> DataFrame:
    """The other columns of ``docs`` with ``n_words``, ``n_removed`` and ``kept``: the words left, joined by one space (or their SHA-256 without ``with_text``).

    A word goes if a run of ``window`` words that covers it also starts anywhere
    else in ``docs``, in the same row or another. Null text counts as empty: no
    words, nothing kept. Rows are told apart by position, so repeated rows and
    null or repeated ids are separate documents (and so repeat each other).
    Added columns replace columns of the same name; an empty table gives no row.
    Texts are packed into a table of blocks first; each step's answers are a
    written table, so none is computed twice.
    """
    extra = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept", text)]
    total = shared.text_bytes(docs, text)
    buckets = shared.buckets_for(total, bucket_bytes)
    size = min(ANCHOR, max(1, window // 2))
    kept = [f"x{i}" for i in range(len(extra))]
    blocks = shared.packed_blocks(docs.select(*(F.col(f"`{c}`").alias(x) for c, x in zip(extra, kept, strict=True)), F.col(f"`{text}`").alias("text")), block_bytes, total)
    corpus = blocks.groupBy("block")
    told = shared.written(blocks.mapInArrow(ask_anchors(window, size, buckets), ROW).groupBy("bucket").applyInArrow(tell_anchors, REPLY), "anchors")
    edges = corpus.cogroup(told.groupBy("block")).applyInArrow(ask_edges(window, size, buckets), ROW)
    marked = shared.written(edges.groupBy("bucket").applyInArrow(tell_edges, REPLY), "edges")
    spans = shared.written(corpus.cogroup(marked.groupBy("block")).applyInArrow(compact(window), SPANS), "spans")
    shared.drop_written(told, marked)
    repeated = spans.groupBy("path", "digest").agg(F.sum("n").alias("times")).where("times > 1").select("path", "digest")
    verified = spans.join(repeated, ["path", "digest"]).select("block", "at")
    schema = T.StructType([*(T.StructField(x, docs.schema[c].dataType) for c, x in zip(extra, kept, strict=True)), *T._parse_datatype_string("n_words long, n_removed long, kept string")])
    cut = corpus.cogroup(verified.groupBy("block")).applyInArrow(remove(kept, with_text), schema)
    return cut.toDF(*extra, "n_words", "n_removed", "kept")
