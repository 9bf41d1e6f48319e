"""How the sources of a language differ in their words, with identical texts collapsed.

Texts that are equal within a language are one row with the number of documents
each source has of it, so a text is shuffled and cut into terms once however many
copies there are (once for each ``SOURCES_TOGETHER`` sources, if a language has
more). A task adds up counts and document counts by language, source and term
before they are shuffled. All later steps work on these sums.

Shares are integers, p = 1 + floor(10^9 (count + 5) / (N + 5 V)), taken in decimals, so
nothing is rounded. A pair of sources is compared without the terms neither has:
with b the share of a count of 0, the sum of |p - q| over all V terms is

    V |b_p - b_q|  +  sum over terms of p of (|p - b_q| - |b_p - b_q|), and of q likewise,
                   +  sum over terms of both of (|p - q| - |p - b_q| - |b_p - q| + |b_p - b_q|).

The middle part depends on counts alone, so a source's terms of one count are one
row there; the last part meets terms in blocks and sources in tiles.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Fixed values of the audit: documents a kept term is in, what is added to a count, and the scale of shares.
LEAST_DOCS, ADDED, SCALE = 30, 5, 1_000_000_000
#: Most sources in one row of a text, sums a task holds, cells of a block of terms, and sources of a tile: they bound memory and don't change results.
SOURCES_TOGETHER, HELD, BLOCK_CELLS, TILE_SOURCES = 4096, 400_000, 200_000, 2000
PIECE = 1 << 20
#: Bytes of terms, A-Z lowered; all others become spaces.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def term_pieces(text: bytes, piece: int = PIECE):
    """Lists of the terms of a UTF-8 text, cut at bytes of no term after about ``piece`` bytes each."""
    lo = 0
    while lo < len(text):
        part = text[lo : lo + piece].translate(TERM_BYTES)
        hi = lo + len(part)
        while hi < len(text) and not part.endswith(b" "):  # the rest of a term that goes on
            more = text[hi : hi + piece].translate(TERM_BYTES)
            end = more.find(b" ")
            part += more if end < 0 else more[: end + 1]
            hi += len(more) if end < 0 else end + 1
        yield part.split()
        lo = hi


def collapsed(docs: DataFrame) -> DataFrame:
    """``lang, text, sources``: each different text of a language once, with (source, n): the documents each source has of it."""
    keyed = docs.withColumn("h", F.unhex(F.sha2("text", 256)))
    counts = keyed.groupBy("lang", "h", "source").agg(F.count("*").alias("n"))
    n_sources = docs.agg(F.approx_count_distinct("source")).first()[0]
    part = F.pmod(F.xxhash64("source"), F.lit(max(1, -(-n_sources // SOURCES_TOGETHER))))
    sources = counts.groupBy("lang", "h", part.alias("part")).agg(F.collect_list(F.struct("source", "n")).alias("sources"))
    texts = keyed.groupBy("lang", "h").agg(F.first("text").alias("text"))
    return texts.join(sources, ["lang", "h"]).select("lang", "text", "sources")


def _count_terms(batches):
    held: dict = defaultdict(lambda: (Counter(), Counter()))
    for batch in batches:
        for lang, text, sources in zip(batch["lang"].to_pylist(), batch["text"].cast(pa.large_string()).cast(pa.large_binary()), batch["sources"].to_pylist(), strict=True):
            raw = text.as_py()
            if len(sources) == 1 and sources[0]["n"] == 1 and len(raw) <= PIECE:
                counts, docs = held[lang, sources[0]["source"]]
                for terms in term_pieces(raw):
                    counts.update(terms)
                    docs.update(set(terms))
            else:
                own: Counter = Counter()
                for terms in term_pieces(raw):
                    own.update(terms)
                for s in sources:
                    (counts, docs), n = held[lang, s["source"]], s["n"]
                    for term, k in own.items():
                        counts[term] += k * n
                        docs[term] += n
        if sum(len(c) for c, _ in held.values()) > HELD:
            yield from _summed(held)
            held.clear()
    yield from _summed(held)


def _summed(held):
    for (lang, source), (counts, docs) in held.items():
        terms = pa.array(list(counts), pa.binary()).cast(pa.string())
        n = len(terms)
        arrays = [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), terms, pa.array(list(counts.values()), pa.int64()), pa.array([docs[t] for t in counts], pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, names=["lang", "source", "term", "count", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, count, docs``: occurrences, and documents with the term, of every term."""
    made = collapsed(docs).mapInArrow(_count_terms, "lang string, source string, term string, count long, docs long")
    return made.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 kept)) as a long, exactly; null if there are no kept terms."""
    above = (count + ADDED).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    below = (total + ADDED * kept).cast("decimal(20,0)")
    return F.when(kept > 0, F.call_function("div", above, below) + 1)


def _alone(key, cells: pa.Table, pairs: pa.Table) -> pa.Table:
    """For one source, over its terms: the sum of |p - b_q| - |b_p - b_q| for each other source q."""
    if not pairs.num_rows:
        return pa.table({"lang": pa.array([], pa.string()), "source": pa.array([], pa.string()), "item": pa.array([], pa.string()), "alone": pa.array([], pa.int64())})
    p, m = (np.asarray(cells.column(c).to_numpy(), np.int64) for c in ("p", "terms"))
    order = np.argsort(p, kind="stable")
    p, m = p[order], m[order]
    n, s = np.concatenate(([0], np.cumsum(m))), np.concatenate(([0], np.cumsum(p * m)))
    b, q = (np.asarray(pairs.column(c).to_numpy(), np.int64) for c in ("base", "item_base"))
    at = np.searchsorted(p, q)
    total = (s[-1] - s[at]) - (n[-1] - n[at]) * q + n[at] * q - s[at] - n[-1] * np.abs(b - q)
    return pa.table({"lang": pairs["lang"].cast(pa.string()), "source": pairs["source"].cast(pa.string()), "item": pairs["item"].cast(pa.string()), "alone": pa.array(total)})


def _both(table: pa.Table) -> pa.Table:
    """For a block of terms, and a tile of sources on each side: what a pair's common terms add."""
    side = table["side"].to_numpy()
    source = table["source"].combine_chunks().dictionary_encode()
    term = table["term"].combine_chunks().dictionary_encode().indices.to_numpy()
    p, b, code = table["p"].to_numpy(), table["base"].to_numpy(), source.indices.to_numpy()
    places = [np.unique(code[side == x]) for x in (0, 1)]
    total = np.zeros((len(places[0]), len(places[1])), np.int64)
    order = np.lexsort((side, term))
    term, side, p, b, code = term[order], side[order], p[order], b[order], code[order]
    at = np.where(side == 0, np.searchsorted(places[0], code), np.searchsorted(places[1], code))
    edges = np.concatenate(([0], np.flatnonzero(np.diff(term)) + 1, [len(term)])) if len(term) else np.zeros(1, int)
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        cut = lo + int(np.searchsorted(side[lo:hi], 1))
        if lo < cut < hi:
            x, c, y, d = p[lo:cut, None], b[lo:cut, None], p[None, cut:hi], b[None, cut:hi]
            total[at[lo:cut, None], at[None, cut:hi]] += np.abs(x - y) - np.abs(x - d) - np.abs(c - y) + np.abs(c - d)
    i, j = np.nonzero(total)
    names = source.dictionary.cast(pa.string())
    lang = table["lang"].combine_chunks()[0:1].cast(pa.string()).take(pa.array(np.zeros(len(i), np.int64)))
    return pa.table({"lang": lang, "source": names.take(pa.array(places[0][i])), "item": names.take(pa.array(places[1][j])), "both": pa.array(total[i, j])})


def pair_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value`` for each two sources of a language: the sum of |p - q| over all its kept terms.

    ``kept`` has lang, source, term, count, p, base; ``groups`` lang, source, kept_terms, base.
    """
    other = groups.select("lang", F.col("source").alias("item"), F.col("base").alias("item_base"))
    pairs = written(groups.join(other, "lang").where("source <> item"), "pairs")  # what is asked for: a row for each two sources
    flat = kept.groupBy("lang", "source", "p").agg(F.count("*").alias("terms"))
    known = pairs.where("base is not null").select("lang", "source", "item", "base", "item_base")
    alone = flat.groupBy("lang", "source").cogroup(known.groupBy("lang", "source")).applyInArrow(_alone, "lang string, source string, item string, alone long")
    size = kept.agg(F.count("*").alias("cells"), F.approx_count_distinct("source").alias("sources")).first()
    blocks, tiles = -(-max(1, size.cells) // BLOCK_CELLS), -(-max(1, size.sources) // TILE_SOURCES)
    tile, every = F.pmod(F.xxhash64("source"), F.lit(tiles)), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long")))
    dealt = kept.select("lang", "source", "term", "p", "base", F.pmod(F.xxhash64("term"), F.lit(blocks)).alias("block"), tile.alias("tile"), every.alias("with"))
    sided = dealt.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1)))).withColumns({"left": F.when(F.col("side") == 0, F.col("tile")).otherwise(F.col("with")), "right": F.when(F.col("side") == 0, F.col("with")).otherwise(F.col("tile"))})
    both = sided.groupBy("lang", "block", "left", "right").applyInArrow(_both, "lang string, source string, item string, both long").groupBy("lang", "source", "item").agg(F.sum("both").alias("both"))
    alone = written(alone, "alone")
    back = alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("alone").alias("back"))
    key = ["lang", "source", "item"]
    made = pairs.join(alone, key, "left").join(back, key, "left").join(both, key, "left")
    value = F.col("kept_terms") * F.abs(F.col("base") - F.col("item_base")) + F.coalesce("alone", F.lit(0)) + F.coalesce("back", F.lit(0)) + F.coalesce("both", F.lit(0))
    return made.select(*key, F.when(F.col("base").isNull(), F.lit(0)).otherwise(value).cast("long").alias("value"))


def audit(documents: DataFrame, ranks: int = 50) -> DataFrame:
    """``lang, source, part, item, value, rank``: how each source of a language differs from the others, and by which terms from the whole.

    ``documents`` has text, lang, source; other columns are ignored, and null is
    read as ''. Part ``pair``: every other source of the language. Part ``term``:
    the ``ranks`` terms whose share in the source is most above the language's.
    Ranks go by value, highest first, then by item in UTF-8 order. A source
    without terms has pairs only, a language without kept terms pairs of value 0,
    and an empty table gives no rows.
    """
    docs = documents.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    counts = written(term_counts(docs), "terms")
    vocabulary = counts.groupBy("lang", "term").agg(F.sum("count").alias("lang_count"), F.sum("docs").alias("docs")).where(F.col("docs") >= LEAST_DOCS).drop("docs")
    kept = written(counts.drop("docs").join(vocabulary, ["lang", "term"]), "kept")
    langs = kept.groupBy("lang", "term").agg(F.first("lang_count").alias("n")).groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count("*").alias("kept_terms"))
    totals = kept.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", "lang_total", F.coalesce("kept_terms", F.lit(0)).alias("kept_terms"), F.coalesce("total", F.lit(0)).alias("total"))
    groups = written(groups.withColumn("base", share(F.lit(0).cast("long"), F.col("total"), F.col("kept_terms"))), "groups")
    cells = kept.join(groups, ["lang", "source"]).withColumn("p", share(F.col("count"), F.col("total"), F.col("kept_terms")))
    cells = written(cells.withColumn("q", share(F.col("lang_count"), F.col("lang_total"), F.col("kept_terms"))).select("lang", "source", "term", "p", "q", "base"), "cells")
    terms = cells.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    pairs = pair_values(cells, groups.select("lang", "source", "kept_terms", "base")).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).where(F.col("rank") <= ranks))
