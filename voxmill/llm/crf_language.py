"""Word-level language labels by a linear-chain conditional random field.

Features of a word: byte bigrams and trigrams (with the white space around the
word, averaged), prefixes and suffixes of two and three bytes, and the word
itself (the lexicon), each hashed into a table of its own. Transition weights
are learned with them. Training lays segments of differently labelled documents
end to end, so the chain sees switches of language; each round, every share
of the sample runs one epoch of AdaGrad and the weights are averaged. The model
also holds which byte trigrams the sample has: what share of a word's trigrams
it knows, averaged over a text's words, is a measure of confidence that does not
depend on how many languages there are, and is high for texts that mix them.

Labelling runs forward-backward over whole documents. The chain is cut into
steps of ``CHUNK`` words: transfer matrices of all chunks are multiplied at
once, a short scan over chunks gives the messages at their ends, and a second
pass gives every word's posterior. This equals the word-by-word recursion.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .shared import written

CHUNK = 64
#: Words whose features are held at once; bytes of texts that are labelled at once, unless one is longer.
PART, LABEL_BYTES = 1 << 15, 1 << 19
#: Parts in which a language's texts are ranked for the sample.
PARTS = 64
SIZE = 1 << 14
KINDS = 7
UNKNOWN = "und"


def features(data: np.ndarray, w: words.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Table rows of the byte n-grams (two per byte of a word), those of the words, and each word's first byte among all words' bytes."""
    lower = np.arange(256, dtype=np.uint64)
    lower[65:91] = lower[97:123]
    lower[words.white()] = 32
    code = np.concatenate(([32], lower[data], [32, 32, 32])).astype(np.uint64)
    size = w.end - w.start
    first = np.cumsum(size) - size
    at = np.arange(int(size.sum())) + np.repeat(w.start - first, size) + 1
    two = code[at] | code[at + 1] << np.uint64(8)
    three = two | code[at - 1] << np.uint64(16)

    def slot(value, kind):
        return (words.mix64(value * np.uint64(8) + np.uint64(kind)) & np.uint64(SIZE - 1)).astype(np.int64) + kind * SIZE

    grams = np.stack((slot(two, 0), slot(three, 1)))
    s, e = w.start + 1, w.end + 1
    second = np.minimum(s + 1, e)
    prefix = code[s] | code[second] << np.uint64(8)
    suffix = code[e - 1] | code[e - 2] << np.uint64(8)
    each = np.stack((slot(prefix, 2), slot(prefix | code[np.minimum(s + 2, e)] << np.uint64(16), 3), slot(suffix, 4), slot(suffix | code[np.maximum(e - 3, s - 1)] << np.uint64(16), 5), slot(w.hash, 6)))
    return grams, each, first


def spaced(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts laid end to end with a space after each, so that no word's features see the next text."""
    out = np.full(len(data) + len(at) - 1, 32, dtype=np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(len(at) - 1), np.diff(at))] = data
    return out, at + np.arange(len(at))


def emissions(weights: np.ndarray, grams: np.ndarray, each: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``(words, languages)`` log-potentials."""
    out = np.zeros((len(size), weights.shape[1]), dtype=np.float32)
    if len(size):
        for rows in grams:
            out += np.add.reduceat(weights[rows], first, axis=0)
        out /= size[:, None]
        for rows in each:
            out += weights[rows]
    return out


def posteriors(energy: np.ndarray, moves: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Posterior of each label for each word; ``bounds`` are the chains' word bounds. Messages start and end uniform."""
    n, labels = energy.shape
    if not n:
        return energy
    size = np.diff(bounds)
    chunks = -(-size // CHUNK)
    top = np.cumsum(chunks)
    base = top - chunks
    nth = np.arange(n) - np.repeat(bounds[:-1], size)
    row, col = np.repeat(base, size) + nth // CHUNK, nth % CHUNK
    total = int(top[-1])
    psi = np.ones((CHUNK, total, labels))
    real = np.zeros((CHUNK, total, 1), dtype=bool)
    psi[col, row] = np.exp(energy - energy.max(axis=1, keepdims=True))
    real[col, row] = True
    a = np.exp(moves - moves.max())
    whole = np.broadcast_to(np.eye(labels), (total, labels, labels)).copy()
    for t in range(CHUNK):
        new = (whole @ a) * psi[t][:, None, :]
        new /= new.max(axis=(1, 2), keepdims=True)
        whole = np.where(real[t][:, :, None], new, whole)
    into, out_of = np.ones((total, labels)), np.ones((total, labels))
    for j in range(1, int(chunks.max())):
        c = base[chunks > j] + j
        v = np.einsum("cl,clm->cm", into[c - 1], whole[c - 1])
        into[c] = v / v.max(axis=1, keepdims=True)
        c = top[chunks > j] - 1 - j
        v = np.einsum("clm,cm->cl", whole[c + 1], out_of[c + 1])
        out_of[c] = v / v.max(axis=1, keepdims=True)
    alpha = np.empty((CHUNK, total, labels))
    message = into
    for t in range(CHUNK):
        new = (message @ a) * psi[t]
        message = np.where(real[t], new / new.max(axis=1, keepdims=True), message)
        alpha[t] = message
    message = out_of
    for t in range(CHUNK - 1, -1, -1):
        alpha[t] *= message
        new = (psi[t] * message) @ a.T
        message = np.where(real[t], new / new.max(axis=1, keepdims=True), message)
    p = alpha[col, row]
    return p / p.sum(axis=1, keepdims=True)


def _gradient(energy: np.ndarray, moves: np.ndarray, label: np.ndarray):
    """Of the log-likelihood of ``(T, sequences)`` labels: by emission and by transition."""
    steps, count, labels = energy.shape
    psi = np.exp(energy - energy.max(axis=2, keepdims=True))
    a = np.exp(moves - moves.max())
    alpha, beta = np.empty_like(psi), np.ones_like(psi)
    message = np.ones((count, labels))
    for t in range(steps):
        message = (message @ a) * psi[t]
        message /= message.sum(axis=1, keepdims=True)
        alpha[t] = message
    for t in range(steps - 1, 0, -1):
        message = (psi[t] * beta[t]) @ a.T
        beta[t - 1] = message / message.sum(axis=1, keepdims=True)
    p = alpha * beta
    p /= p.sum(axis=2, keepdims=True)
    truth = np.eye(labels)[label]
    pair = alpha[:-1, :, :, None] * a * (psi[1:] * beta[1:])[:, :, None, :]
    pair /= pair.sum(axis=(2, 3), keepdims=True)
    seen = np.zeros((labels, labels))
    np.add.at(seen, (label[:-1].ravel(), label[1:].ravel()), 1)
    return truth - p, seen - pair.sum(axis=(0, 1))


def _epoch(weights: np.ndarray, moves: np.ndarray, langs: list[str], turn: int, rate: float = 0.5, batch: int = 128):
    """One pass of AdaGrad over a share of the sample; gives its weights and the words it used."""

    def train(table):
        w_, m_ = weights.copy(), moves.copy()
        seen = np.zeros(len(w_), dtype=bool)
        sum_w, sum_m = np.full(w_.shape, 1e-2, np.float32), np.full(m_.shape, 1e-2)
        rng = np.random.default_rng(turn)
        table = table.sort_by("mark").combine_chunks()
        data, at = spaced(*words.utf8(table.column("text")))
        w = words.Words(data, at, lower=True, spans=True)
        tag = np.array([langs.index(x) for x in table.column("lang").to_pylist()])
        label = np.repeat(tag, np.diff(w.bounds))
        cuts = np.unique(np.concatenate((w.bounds, np.arange(0, len(label), 40) + rng.integers(0, 40, -(-len(label) // 40)))))
        parts = [np.arange(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b <= len(label)]
        order = np.concatenate([parts[i] for i in rng.permutation(len(parts))]) if parts else np.zeros(0, np.int64)
        steps = min(CHUNK, len(order))
        for lo in range(0, len(order) - steps + 1, max(1, steps * batch)):
            take = order[lo : lo + steps * batch]
            take = take[: len(take) - len(take) % steps].reshape(-1, steps).T
            flat = take.ravel()
            view = _Part(w, flat)
            grams, each, first = features(data, view)
            seen[grams[1]] = True
            size = view.end - view.start
            energy = emissions(w_, grams, each, first, size).reshape(steps, -1, len(langs))
            by_word, by_move = _gradient(energy.astype(np.float64), m_, label[take])
            g = by_word.reshape(-1, len(langs)) / take.shape[1]
            spread = np.repeat(g / size[:, None], size, axis=0)
            grad = np.empty(w_.shape, np.float32)
            for k in range(len(langs)):
                grad[:, k] = np.bincount(grams.ravel(), weights=np.tile(spread[:, k], 2), minlength=len(w_)) + np.bincount(each.ravel(), weights=np.tile(g[:, k], len(each)), minlength=len(w_))
            grad -= 1e-4 * w_
            sum_w += grad * grad
            w_ += rate * grad / np.sqrt(sum_w)
            by_move = by_move / take.shape[1]
            sum_m += by_move * by_move
            m_ += 0.1 * by_move / np.sqrt(sum_m)
        return pa.Table.from_arrays([pa.array([w_.astype(np.float32).tobytes()], pa.binary()), pa.array([m_.astype(np.float64).tobytes()], pa.binary()), pa.array([float(len(order))]), pa.array([np.packbits(seen).tobytes()], pa.binary())], names=["weights", "moves", "n", "seen"])

    return train


class _Part:
    """Some words of a batch, in any order; ``first`` is the byte their data begins with."""

    def __init__(self, w: words.Words, take, first: int = 0):
        self.hash, self.start, self.end = w.hash[take], w.start[take] - first, w.end[take] - first


class Model:
    """``langs`` in order, the weights of features and transitions, and which feature rows the sample has."""

    def __init__(self, langs: list[str], weights: np.ndarray, moves: np.ndarray, seen: np.ndarray):
        self.langs, self.weights, self.moves, self.seen = langs, weights, moves, seen

    def words(self, data: np.ndarray, at: np.ndarray):
        """The words of texts, each one's posterior of each language, whether it has a letter (or a byte above 127), and the share of its bytes' trigrams that is known."""
        data, at = spaced(data, at)
        w = words.Words(data, at, lower=True, spans=True)
        n = len(w.start)
        energy, known, has = np.empty((n, len(self.langs)), np.float32), np.empty(n), np.empty(n, bool)
        letter = np.zeros(256, dtype=bool)
        letter[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
        for lo in range(0, n, PART):  # features of some words at a time: they take many times a text's room
            hi = min(n, lo + PART)
            a = int(w.start[lo]) - 1 if w.start[lo] else 0
            part = _Part(w, slice(lo, hi), a)
            mine = data[a : int(w.end[hi - 1]) + 1]
            grams, each, first = features(mine, part)
            size = part.end - part.start
            energy[lo:hi] = emissions(self.weights, grams, each, first, size)
            known[lo:hi] = np.add.reduceat(self.seen[grams[1]].astype(np.int64), first) / size
            has[lo:hi] = np.add.reduceat(letter[mine].astype(np.int64), part.start) > 0
        return w, posteriors(energy, self.moves, w.bounds), has, known

    def label(self, data: np.ndarray, at: np.ndarray):
        """Per text: the expected share of its lettered words in each language, and the mean of what share of their trigrams is known."""
        w, p, has, known = self.words(data, at)

        def by_text(values):
            total = np.concatenate((np.zeros((1, values.shape[1])), np.cumsum(values * has[:, None], axis=0)))
            return total[w.bounds[1:]] - total[w.bounds[:-1]]

        share, count = by_text(p), by_text(np.stack((known, np.ones(len(known))), axis=1))
        return share / np.maximum(share.sum(axis=1, keepdims=True), 1e-12), count[:, 0] / np.maximum(count[:, 1], 1)


def sample_texts(labelled: DataFrame, per_language: int, most_languages: int | None, most_chars: int) -> DataFrame:
    """``(text, lang, mark)``: of each language at most ``per_language`` different pieces of texts, chosen by a hash; copies count once.

    A text is one piece, or, if it has more than ``most_chars`` characters, several
    of that length, each a row like any other, so every part of every text may be
    learned from and the sample is bounded in bytes for each language.
    ``most_languages``: only those with most rows (None: all of them).
    """
    rows = labelled.select("text", "lang").where("text is not null and lang is not null")
    if most_languages is not None:
        common = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages).select("lang")
        rows = rows.join(F.broadcast(common), "lang")
    last = F.floor(F.greatest(F.length("text") - 1, F.lit(0)) / most_chars).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), last), lambda n: F.substr(F.col("text"), n * most_chars + 1, F.lit(most_chars)))
    rows = rows.select("lang", F.explode(F.when(last == 0, F.array("text")).otherwise(pieces)).alias("text")).withColumn("mark", F.xxhash64("text"))
    chosen = rows.select("lang", "mark").distinct().withColumn("part", F.pmod(F.hash("mark"), F.lit(PARTS)))
    for group in (["lang", "part"], ["lang"]):  # first of each part of a language, so that no task ranks all of it
        nth = F.row_number().over(Window.partitionBy(*group).orderBy("mark"))
        chosen = chosen.withColumn("nth", nth).where(F.col("nth") <= per_language).drop("nth")
    chosen = written(chosen.select("lang", "mark"), "chosen")
    taken = rows.join(chosen, ["lang", "mark"])  # per_language names and numbers for each language; Spark broadcasts them if they are few
    return taken.groupBy("lang", "mark").agg(F.min("text").alias("text"))


def fit(labelled: DataFrame, per_language: int = 300, rounds: int = 3, shares: int = 4, most_languages: int | None = None, most_chars: int = 50_000) -> Model | None:
    """Trains on ``(text, lang)`` rows with neither null; None if there are none.

    The sample is bounded, see ``sample_texts``. All languages are learned. Weights
    are averaged on the driver: ``shares`` tables a round, of about 0.5 MB a language.
    """
    sample = written(sample_texts(labelled, per_language, most_languages, most_chars), "sample")
    langs = sorted(r.lang for r in sample.select("lang").distinct().collect())
    if not langs:
        return None
    dealt = sample.withColumn("share", F.pmod("mark", F.lit(shares)))
    weights, moves = np.zeros((KINDS * SIZE, len(langs)), np.float32), np.zeros((len(langs), len(langs)))
    seen = np.zeros(KINDS * SIZE, dtype=bool)
    for turn in range(rounds):
        got = dealt.groupBy("share").applyInArrow(_epoch(weights, moves, langs, turn), "weights binary, moves binary, n double, seen binary").collect()
        total = sum(r.n for r in got)
        if total:
            weights = sum(np.frombuffer(r.weights, np.float32) * np.float32(r.n / total) for r in got).reshape(weights.shape)
            moves = sum(np.frombuffer(r.moves, np.float64) * (r.n / total) for r in got).reshape(moves.shape)
        for r in got:
            seen |= np.unpackbits(np.frombuffer(r.seen, np.uint8))[: len(seen)].astype(bool)
    return Model(langs, weights, moves, seen)


def _lettered(text: str):
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def label_documents(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``known``: the language of most of the text's words, its expected share of them, the mean share of their byte trigrams that the model knows.

    ``und``, 0 and 0 where the text is null, has no letter, or there is no model.
    Ties go to the first language in order. Repeated rows get equal labels; columns
    of the added names are replaced; an empty table gives no row. Texts are labelled whole.
    """
    made = ("lang_pred", "score", "known")
    keep = [c for c in docs.columns if c not in made]
    if model is None:
        return docs.select(*keep).withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "known": F.lit(0.0)})
    given = [f"given{i}_" for i in range(len(keep))]

    def label(batches):
        for batch in batches:
            data, at = words.utf8(batch.column("whole"))
            lettered = batch.column("lettered").to_numpy(zero_copy_only=False)
            lang, score, known = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for lo, hi in words.slices(at, LABEL_BYTES):
                share, part = model.label(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                best = share.argmax(axis=1)
                for d in np.flatnonzero(lettered[lo:hi]).tolist():
                    lang[lo + d], score[lo + d], known[lo + d] = model.langs[best[d]], min(1.0, float(share[d, best[d]])), part[d]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in given), pa.array(lang, pa.string()), pa.array(score), pa.array(known)], names=[*given, *made])

    flagged = docs.select(*(F.col(c).alias(g) for c, g in zip(keep, given, strict=True)), F.col(text).alias("whole"), _lettered(text).alias("lettered"))
    schema = T.StructType([*(T.StructField(g, docs.schema[c].dataType) for c, g in zip(keep, given, strict=True)), *T._parse_datatype_string("lang_pred string, score double, known double")])
    return flagged.mapInArrow(label, schema).toDF(*keep, *made)


def label_words(docs: DataFrame, model: Model, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """``doc_id`` and ``runs``: the words' labels, as runs of one language: (lang, first word, word after the last, mean posterior). Words without a letter join the run before them.

    Null and empty texts and those without a letter have no runs.
    """

    def label(batches):
        for batch in batches:
            data, at = words.utf8(batch.column("text"))
            runs = []
            for lo, hi in words.slices(at, LABEL_BYTES):
                w, p, has, _ = model.words(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                best = p.argmax(axis=1)
                for d in range(hi - lo):
                    mine = np.arange(w.bounds[d], w.bounds[d + 1])
                    mine = mine[has[mine]]
                    first = np.flatnonzero(np.concatenate(([True], best[mine][1:] != best[mine][:-1]))) if len(mine) else np.zeros(0, np.int64)
                    start = mine[first] - w.bounds[d]
                    stop = np.append(start[1:], w.bounds[d + 1] - w.bounds[d])
                    mean = [float(p[x, best[x[0]]].mean()) for x in np.split(mine, first[1:])] if len(mine) else []
                    runs.append([{"lang": model.langs[best[m]], "first": int(a), "end": int(b), "score": s} for m, a, b, s in zip(mine[first], start, stop, mean, strict=len(mine) > 0)] if len(mine) else [])
            kind = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(runs, kind)], names=[id_, "runs"])

    schema = T.StructType([T.StructField(id_, docs.schema[id_].dataType), *T._parse_datatype_string("runs array<struct<lang:string,first:bigint,end:bigint,score:double>>")])
    return docs.select(F.col(id_).alias("id"), F.col(text).alias("text")).mapInArrow(label, schema)


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", id_: str = "doc_id", per_language: int = 300) -> DataFrame:
    """Trains on the rows whose crc32 of the id modulo 4 is not 2 and labels all; adds ``held_out`` too (null ids count as empty text)."""
    held_out = F.crc32(F.coalesce(F.col(id_).cast("string"), F.lit(""))) % 4 == 2
    model = fit(docs.where(~held_out).select(F.col(text).alias("text"), F.col(lang).alias("lang")), per_language)
    return label_documents(docs, model, text).withColumn("held_out", held_out)
