"""Deleted interpolation: n-gram maximum-likelihood estimates mixed by context-frequency buckets.

The probability of a token mixes orders from the top down,

    P_k(w | h) = l_k(b) * c(hw) / c(h) + (1 - l_k(b)) * P_{k-1}(w | h'),

where b is the bucket (logarithm to base 2) of the context's frequency c(h) and
P_0 = 1 / (V + 1). The weights l are learned by expectation-maximisation: one
eighth of the training documents is deleted from the counts and its tokens are
the held-out events. Scores use the counts of all training documents.

Texts are tokenised once, into a written table of packed blocks. Counts come from
the blocked exchange (see ``shared``), one order after the other: a block asks
about its distinct n-grams and gets their corpus counts back, so every text is
scored where it lies and no table of n-grams is broadcast. An n-gram occurs at
most as often as its first and its last n-1 words do; where a block's own count
reaches that bound, the n-gram occurs in this block alone and its counts are
known without asking. No n-gram's count is cut or estimated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared, words

END, START = np.uint64(0x1D8E4E27C47D124F), np.uint64(0x2545F4914F6CDD1D)
#: One training document in DELETED gives held-out counts.
DELETED = 8
BUCKETS = 64
#: Rows of packed blocks are compressed already: Parquet need not try again, nor look for equal ones.
PLAIN = {"compression": "none", "parquet.enable.dictionary": "false"}
#: Entries that are worked on at once.
TOKENS = 1 << 18
ROW = "block long, bucket long, n long, hash binary, train binary, deleted binary, held binary"
REPLY = "block long, bucket long, n long, train binary, deleted binary, every binary, types long"
BLOCK = "block long, n_docs long, size binary, held_out binary, deleted binary, words binary, token binary, n_words long, n_tokens long, rest binary"
ASK = {"block": pa.int64(), "bucket": pa.int64(), "n": pa.int64(), "hash": pa.binary(), "train": pa.binary(), "deleted": pa.binary(), "held": pa.binary()}
TOLD = {"block": pa.int64(), "bucket": pa.int64(), "n": pa.int64(), "train": pa.binary(), "deleted": pa.binary(), "every": pa.binary(), "types": pa.int64()}


def _rows(records, kind):
    schema = pa.schema(list(kind.items()))
    return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*records), schema, strict=True)], schema=schema) if records else schema.empty_table()


def _packed(block: int, rows: pa.Table, extra: list[str]) -> pa.RecordBatch:
    """One row: documents' sizes and flags, the block's words (most frequent first) and each token's place among them, other columns as Arrow bytes."""
    data, at = words.utf8(rows.column("text"))
    tokens, sizes = [], []
    for lo, hi in words.slices(at):
        w = words.Words(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], lower=True)
        size = np.diff(w.bounds) + 1
        out = np.full(int(size.sum()), END, dtype=np.uint64)
        out[np.arange(len(w.hash)) + np.repeat(np.arange(len(size)), size - 1)] = w.hash
        tokens.append(out)
        sizes.append(size)
    token, size = np.concatenate(tokens), np.concatenate(sizes)
    own, _, place = shared.distinct(token)
    order = np.argsort(-np.bincount(place), kind="stable")  # words of one frequency in order of hash
    rank = np.empty(len(own), np.uint32)
    rank[order] = np.arange(len(own), dtype=np.uint32)
    flags = [rows.column(c).to_numpy(zero_copy_only=False).astype(np.uint8) for c in ("held_out", "deleted")]
    rest = rows.select(extra) if extra else pa.table({"none": pa.nulls(rows.num_rows)})
    made = [block, len(size), shared.pack(size.astype(np.uint32)), *map(shared.pack, flags), shared.pack(own[order]), shared.pack(rank[place]), len(own), len(token), shared.to_bytes(rest)]
    return pa.RecordBatch.from_arrays([pa.array([x], pa.int64() if isinstance(x, int) else pa.binary()) for x in made], names=["block", "n_docs", "size", "held_out", "deleted", "words", "token", "n_words", "n_tokens", "rest"])


def _pack(extra: list[str], block_bytes: int):
    def pack(batches):
        for block, rows in shared.runs(batches, block_bytes):
            yield _packed(block, rows, extra)

    return pack


class Block:
    """A packed block: per order, the n-gram that ends at each token and what the corpus knows about it."""

    def __init__(self, row: dict, order: int, buckets: int):
        self.size = shared.unpack(row["size"], "uint32", row["n_docs"]).astype(np.int64)
        self.held_out, self.deleted = (shared.unpack(row[c], "uint8", row["n_docs"]).astype(bool) for c in ("held_out", "deleted"))
        token = shared.unpack(row["words"], "uint64", row["n_words"])[shared.unpack(row["token"], "uint32", row["n_tokens"])]
        self.key, self.order, self.buckets = row["block"], order, buckets
        self.first = np.cumsum(self.size) - self.size  # of each document
        padded = np.full(len(token) + (order - 1) * len(self.size), START, dtype=np.uint64)
        self.at = np.arange(len(token)) + np.repeat((order - 1) * np.arange(1, len(self.size) + 1), self.size)
        padded[self.at] = token
        self.padded = padded
        self.flags = [np.repeat(x, self.size) for x in (~self.held_out, self.deleted, self.held_out)]

    def grams(self, k: int):
        """Distinct k-grams in order of hash, where each token's is, how often each occurs in learned, deleted and held-out documents."""
        gram = words.ngrams(self.padded, k)[self.at - k + 1]
        own, first, place = shared.distinct(gram)
        return own, first, place, [np.bincount(place[f], minlength=len(own)) for f in self.flags]

    def asked(self, k: int, own: np.ndarray, first: np.ndarray, mine, every: np.ndarray | None):
        """Places of the k-grams to ask about, and each bucket's slice of them; ``every`` has the counts, over all documents, of the tokens' (k-1)-grams."""
        need = np.arange(len(own))
        if every is not None:
            before = np.concatenate(([np.iinfo(np.int64).max], every[:-1]))
            before[self.first] = np.iinfo(np.int64).max
            need = np.flatnonzero(mine[0] + mine[2] < np.minimum(every, before)[first])
        cuts = np.searchsorted(shared.bucket_of(own[need], self.buckets), np.arange(self.buckets + 1))
        return need, [((k - 1) * self.buckets + b, int(cuts[b]), int(cuts[b + 1])) for b in np.flatnonzero(np.diff(cuts)).tolist()]

    def counts(self, told: list[dict], upto: int):
        """Per order to ``upto``: corpus counts of each token's n-gram: learned, deleted, in all documents."""
        reply = {r["bucket"]: r for r in told}
        every, out = None, []
        for k in range(1, upto + 1):
            own, first, place, mine = self.grams(k)
            need, parts = self.asked(k, own, first, mine, every)
            known = [mine[0].astype(np.int64), mine[1].astype(np.int64), (mine[0] + mine[2]).astype(np.int64)]
            for b, lo, hi in parts:
                for x, c in zip(known, ("train", "deleted", "every"), strict=True):
                    if reply[b][c] is not None:
                        x[need[lo:hi]] = shared.unpack(reply[b][c], "uint64", hi - lo)
            every = known[2][place]
            out.append([x[place] for x in known])
        return out, every

    def ask(self, told: list[dict], k: int) -> pa.Table:
        _, every = self.counts(told, k - 1)
        own, first, _, mine = self.grams(k)
        need, parts = self.asked(k, own, first, mine, every)
        return _rows([(self.key, b, hi - lo, shared.pack(own[need[lo:hi]]), *(shared.pack(x[need[lo:hi]].astype(np.uint32)) for x in mine)) for b, lo, hi in parts], ASK)


def _block(table: pa.Table, order: int, buckets: int) -> tuple[Block, bytes]:
    row = table.to_pylist()[0]
    return Block(row, order, buckets), row["rest"]


def _ask_words(order: int, buckets: int):
    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield from Block(row, order, buckets).ask([], 1).to_batches()

    return ask


def _ask(k: int, order: int, buckets: int):
    return lambda key, table, told: _block(table, order, buckets)[0].ask(told.to_pylist(), k)


def _by_block(told: list[DataFrame]):
    every = told[0]
    for more in told[1:]:
        every = every.unionByName(more)
    return every.groupBy("block")


def _tell(buckets: int, last: bool):
    """Sums of each asked n-gram's counts, to each block that asked; the last order's count over all documents is of no use."""

    def tell(key, table):
        table = table.combine_chunks()
        block, n = table.column("block").to_pylist(), table.column("n").to_pylist()
        hashes = np.concatenate([shared.unpack(x, "uint64", m) for x, m in zip(table.column("hash").to_pylist(), n, strict=True)])
        own, _, place = shared.distinct(hashes)
        sums = []
        for c in ("train", "deleted") if last else ("train", "deleted", "held"):
            count = np.concatenate([shared.unpack(x, "uint32", m) for x, m in zip(table.column(c).to_pylist(), n, strict=True)])
            sums.append(np.bincount(place, weights=count, minlength=len(own)).astype(np.uint64))
        sums[2:] = [sums[0] + x for x in sums[2:]]
        types = int((sums[0] > 0).sum()) if key[0].as_py() < buckets else 0
        cuts, first = np.cumsum(n)[:-1], min(block)
        told = [np.split(s[place], cuts) for s in sums]
        return _rows([(b, key[0].as_py(), m, *map(shared.pack, x), *[None] * last, types * (b == first)) for b, m, *x in zip(block, n, *told, strict=True)], TOLD)

    return tell


def _counted(order: int, buckets: int):
    """A block's row of packed counts: of all its tokens among all learned documents (``all``), of its deleted ones' among the rest (``kept``)."""
    names = [f"{c}{k + 1}" for k in range(order) for c in ("all", "kept")]
    kind = {"size": pa.binary(), "held_out": pa.binary(), "deleted": pa.binary(), "n_docs": pa.int64(), "n_tokens": pa.int64(), "types": pa.int64(), "rest": pa.binary(), "n_kept": pa.int64(), "kept_size": pa.binary(), "kept_docs": pa.int64(), "learned": pa.int64(), "learned_docs": pa.int64(), "rest_tokens": pa.int64(), "rest_docs": pa.int64()} | dict.fromkeys(names, pa.binary())

    def count(key, table, told):
        block, rest = _block(table, order, buckets)
        row, told = table.to_pylist()[0], told.to_pylist()
        counts, _ = block.counts(told, order)
        train, mine = block.flags[0], block.flags[1]
        some = ~block.held_out & ~block.deleted
        packed = [shared.pack(x.astype(np.uint64)) for every, gone, _ in counts for x in (every, (every - gone)[mine])]
        kept = block.size[block.deleted]
        sums = [int(train.sum()), int((~block.held_out).sum()), int(block.size[some].sum()), int(some.sum())]
        return _rows([(row["size"], row["held_out"], row["deleted"], len(block.size), row["n_tokens"], sum(r["types"] for r in told), rest, int(kept.sum()), shared.pack(kept.astype(np.uint32)), len(kept), *sums, *packed)], kind)

    return count, kind


def _orders(counts: list[np.ndarray], at: np.ndarray, tokens: int, docs: int):
    """Per order, the ML estimate of each token and the bucket of its context's frequency."""
    first = at[:-1]
    out = []
    for k, count in enumerate(counts):
        if k:
            context = np.empty_like(counts[k - 1])
            context[1:] = counts[k - 1][:-1]
            context[first] = docs
        else:
            context = np.full(len(count), tokens, dtype=np.int64)
        share = np.where(context > 0, count / np.maximum(context, 1), 0.0)
        bucket = np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))).astype(np.int64) + 1, 0)
        out.append((share, np.minimum(bucket, BUCKETS - 1)))
    return out


def _mix(orders, weights: np.ndarray, types: int):
    """Probability of each token, and per order the probability below it."""
    p, below = np.full(len(orders[0][0]), 1.0 / (types + 1)), []
    for k, (share, bucket) in enumerate(orders):
        below.append(p)
        weight = np.where(bucket > 0, weights[k][bucket], 0.0)
        p = weight * share + (1 - weight) * p
    return p, below


def _stretches(size: np.ndarray, counts: list[np.ndarray]):
    """Runs of whole documents of about ``TOKENS`` tokens: first and last document, their counts, their bounds."""
    at = np.concatenate(([0], np.cumsum(size)))
    for lo, hi in words.slices(at, TOKENS):
        yield lo, hi, [c[at[lo] : at[hi]] for c in counts], at[lo : hi + 1] - at[lo]


def _unpacked(row: dict, name: str, order: int, n: int) -> list[np.ndarray]:
    return [shared.unpack(row[f"{name}{k + 1}"], "uint64", n).astype(np.int64) for k in range(order)]


def _expect(weights: np.ndarray, types: int, tokens: int, docs: int):
    order = len(weights)

    def expect(batches):
        total = np.zeros((order, BUCKETS, 2))
        like, n = 0.0, 0
        for batch in batches:
            pieces = (x for row in batch.to_pylist() for x in _stretches(shared.unpack(row["kept_size"], "uint32", row["kept_docs"]).astype(np.int64), _unpacked(row, "kept", order, row["n_kept"])))
            for _, _, counts, at in pieces:
                orders = _orders(counts, at, tokens, docs)
                p, below = _mix(orders, weights, types)
                like, n = like + float(np.log(p).sum()), n + len(p)
                reach = np.ones(len(p))
                for k in range(order - 1, -1, -1):
                    share, bucket = orders[k]
                    weight = np.where(bucket > 0, weights[k][bucket], 0.0)
                    here = weight * share
                    stop = reach * here / (here + (1 - weight) * below[k])
                    total[k, :, 0] += np.bincount(bucket, weights=stop, minlength=BUCKETS)
                    total[k, :, 1] += np.bincount(bucket, weights=reach, minlength=BUCKETS)
                    reach = reach - stop
        at = np.argwhere(total[:, :, 1] > 0)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at[:, 0], -1)), pa.array(np.append(at[:, 1], 0)), pa.array(np.append(total[at[:, 0], at[:, 1], 0], like)), pa.array(np.append(total[at[:, 0], at[:, 1], 1], float(n)))], names=["k", "bucket", "stop", "reach"])

    return expect


def _score(extra: list[str], weights: np.ndarray, types: int, tokens: int, docs: int):
    order = len(weights)
    made = ["held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def score(batches):
        for row in (row for batch in batches for row in batch.to_pylist()):
            size = shared.unpack(row["size"], "uint32", row["n_docs"]).astype(np.int64)
            held = shared.unpack(row["held_out"], "uint8", row["n_docs"]).astype(bool)
            rest = shared.from_bytes(row["rest"])
            for lo, hi, counts, at in _stretches(size, _unpacked(row, "all", order, row["n_tokens"])):
                p, _ = _mix(_orders(counts, at, tokens, docs), weights, types)
                first = at[:-1]
                base = np.add.reduceat(np.log10((counts[0] + 1) / (tokens + types + 1)), first)
                known = np.add.reduceat((counts[0] > 0).astype(np.int64), first)
                values = [pa.array(held[lo:hi]), pa.array(size[lo:hi]), pa.array(known), pa.array(np.full(hi - lo, tokens, np.int64)), pa.array(base), pa.array(np.add.reduceat(np.log10(p), first))]
                yield pa.RecordBatch.from_arrays([*(rest.column(c).slice(lo, hi - lo).combine_chunks() for c in range(len(extra))), *values], names=[*extra, *made])

    return score


def learn_weights(counted: DataFrame, order: int, types: int, tokens: int, docs: int, iterations: int = 15, tolerance: float = 1e-5) -> np.ndarray:
    """EM over the deleted documents' tokens; what reaches the driver is one row per order and bucket. Stops when the mean log-likelihood gains less than ``tolerance``."""
    held = counted.where("n_kept > 0").select("kept_size", "kept_docs", "n_kept", *(f"kept{k + 1}" for k in range(order)))
    weights, before = np.full((order, BUCKETS), 0.5), -np.inf
    for _ in range(iterations):
        rows = held.mapInArrow(_expect(weights, types, tokens, docs), "k long, bucket long, stop double, reach double").groupBy("k", "bucket").agg(F.sum("stop").alias("stop"), F.sum("reach").alias("reach")).collect()
        mean = next((r.stop / r.reach for r in rows if r.k < 0 and r.reach), None)
        if mean is None:
            break
        for r in rows:
            if r.k >= 0:
                weights[r.k, r.bucket] = min(r.stop / r.reach, 0.999)  # lower orders keep a share, so no token gets probability 0
        if mean - before < tolerance:
            break
        before = mean
    return weights


def score_documents(docs: DataFrame, held_out, order: int = 3, block_bytes: int = shared.BLOCK_BYTES, bucket_bytes: int = shared.BUCKET_BYTES) -> DataFrame:
    """Other columns of ``docs`` with held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    ``docs`` has ``doc_id`` and ``text``; rows where the Column ``held_out`` is
    true are scored but not learned from. A null text is empty: one end token.
    Ties and repeated rows count as often as they occur. Without training rows
    every token has probability 1 / (V + 1) = 1; an empty table gives no row.
    Columns of the same name as an added one are replaced. A block holds texts of
    ``block_bytes``, or one longer text; a bucket the n-grams of ``bucket_bytes``.
    """
    made = {"held_out", "deleted", "n_tokens", "n_known", "train_tokens", "base_score", "score", "text"}
    extra = [c for c in docs.columns if c not in made]
    total = shared.text_bytes(docs)
    buckets = shared.buckets_for(total, bucket_bytes)
    own = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    flagged = docs.withColumn("held_out", F.coalesce(held_out, F.lit(False))).withColumn("deleted", ~F.col("held_out") & (F.floor(own / 7) % DELETED == 0))
    flagged = flagged.select(*(F.col(c).alias(f"x{i}") for i, c in enumerate(extra)), "held_out", "deleted", "text")
    kept = [f"x{i}" for i in range(len(extra))]
    with shared.batches_of(docs.sparkSession, block_bytes):
        blocks = shared.written_by(flagged.mapInArrow(_pack(kept, block_bytes), BLOCK), "blocks", "block", shared.block_buckets(total, block_bytes), **PLAIN)
    told = []
    for k in range(1, order + 1):
        dealt = blocks.groupBy("block")
        asked = dealt.cogroup(_by_block(told)).applyInArrow(_ask(k, order, buckets), ROW) if told else blocks.mapInArrow(_ask_words(order, buckets), ROW)
        told.append(shared.written(asked.groupBy("bucket").applyInArrow(_tell(buckets, k == order), REPLY), "told"))
    count, kind = _counted(order, buckets)
    schema = ", ".join(f"{c} {'long' if x == pa.int64() else 'binary'}" for c, x in kind.items())
    counted = shared.written(blocks.groupBy("block").cogroup(_by_block(told)).applyInArrow(count, schema), "counts")
    shared.drop_written(blocks, *told)
    n = counted.agg(*(F.sum(c).alias(c) for c in ("types", "learned", "learned_docs", "rest_tokens", "rest_docs"))).first()
    types, tokens, some = int(n.types or 0), int(n.learned or 0), int(n.learned_docs or 0)
    with shared.batches_of(docs.sparkSession, block_bytes):
        weights = learn_weights(counted, order, types, int(n.rest_tokens or 0), int(n.rest_docs or 0))
    schema = T.StructType([*(T.StructField(c, docs.schema[c].dataType) for c in extra), *T._parse_datatype_string("held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")])
    return counted.select("size", "held_out", "n_docs", "n_tokens", "rest", *(f"all{k + 1}" for k in range(order))).mapInArrow(_score(extra, weights, types, tokens, some), schema)
