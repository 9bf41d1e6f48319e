"""The word-level operators against brute force, with the awkward rows: null, empty, very long, tied, repeated."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxmill.llm import crf_language, decontaminate, interpolated_lm, near_dedup, queries, substring_dedup, words

SF = "/root/testdata/sf0.001"
UP = bytes(range(65, 91))
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text, lower=True):
    raw = (text or "").translate(LOW) if lower else (text or "")
    return raw.encode().split()


def shingle_set(text, n):
    w = split(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


@pytest.fixture(scope="module")
def awkward(spark):
    """Null, empty and blank texts, copies, near copies, repeated rows, null ids, other white space and one very long text."""
    base = [f"w{i}" for i in range(60)]
    near = base[:30] + ["changed"] + base[31:]
    rng = np.random.default_rng(1)
    long_ = " ".join(f"t{int(x)}" for x in rng.integers(0, 5000, 60000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, " ".join(base)), (5, " ".join(base)), (6, "\n".join(near)), (6, "\n".join(near)), (None, " ".join(base)), (None, "alone in its group of words"), (7, "a"), (8, "A"), (9, "x " * 200), (10, long_), (11, long_ + " tail"), (12, "non breaking spaces stay in words"), (13, "f" * 3_000_000 + " end"), (14, "one two\x0bthree\x0cfour\rfive")]
    return spark.createDataFrame([(i, t, "clash", 0, "x", True) for i, t in rows], "doc_id long, text string, kept string, n_words int, extra string, held_out boolean")


def rows_of(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_words_and_ngrams():
    texts = ["Ab  c", "", "ab c\td", "\n", "é ü"]
    import pyarrow as pa

    data, at = words.utf8(pa.array(texts))
    w = words.Words(data, at, lower=True, spans=True)
    assert np.diff(w.bounds).tolist() == [2, 0, 3, 0, 2]
    assert w.hash[0] == w.hash[2] and w.hash[1] == w.hash[3] and len(set(w.hash.tolist())) == 5
    raw = data.tobytes()
    assert [raw[a:b] for a, b in zip(w.start, w.end, strict=True)] == b"".join(b" " + t.encode() for t in texts).split()
    big = words.PIECE
    words.PIECE = 7  # cuts inside and between words
    try:
        assert (words.Words(data, at, lower=True).hash == w.hash).all()
    finally:
        words.PIECE = big


def test_repeats_removed(spark, awkward):
    got = sorted(map(repr, rows_of(substring_dedup.remove_repeats(awkward, window=8), "doc_id", "n_words", "n_removed", "kept")))
    texts = rows_of(awkward, "doc_id", "text")
    seen = Counter()
    for _, t in texts:
        w = split(t, lower=False)
        seen.update(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    want = []
    for i, t in texts:
        w = split(t, lower=False)
        gone = set()
        for p in range(len(w) - 7):
            if seen[tuple(w[p : p + 8])] > 1:
                gone.update(range(p, p + 8))
        kept = [x for p, x in enumerate(w) if p not in gone]
        want.append((i, len(w), len(gone), b" ".join(kept).decode()))
    assert got == sorted(map(repr, want))


def test_repeats_across_small_blocks(spark, awkward):
    whole = rows_of(substring_dedup.remove_repeats(awkward, window=8), "doc_id", "n_removed", "kept", "extra")
    small = rows_of(substring_dedup.remove_repeats(awkward.repartition(5), window=8, block_bytes=400, bucket_bytes=2000), "doc_id", "n_removed", "kept", "extra")
    assert Counter(whole) == Counter(small)


def test_repeats_with_few_buckets(spark):
    """Spark's limit of buckets is met, not run into."""
    key = "spark.sql.sources.bucketing.maxBuckets"
    docs = spark.createDataFrame([(i, f"a b c d e f g h {i} " + "x y z " * i) for i in range(40)], "doc_id long, text string").repartition(4)
    whole = sorted(rows_of(substring_dedup.remove_repeats(docs, window=8), "doc_id", "kept"))
    before = spark.conf.get(key)
    spark.conf.set(key, "3")
    try:
        assert sorted(rows_of(substring_dedup.remove_repeats(docs, window=8, block_bytes=100, bucket_bytes=500), "doc_id", "kept")) == whole
    finally:
        spark.conf.set(key, before)


def test_repeats_on_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = {r[0]: r[1:] for r in rows_of(substring_dedup.remove_repeats(docs, window=35, with_text=False), "doc_id", "n_removed", "kept")}
    texts = {i: split(t, lower=False) for i, t in rows_of(docs, "doc_id", "text")}
    seen = Counter(tuple(w[i : i + 35]) for w in texts.values() for i in range(len(w) - 34))
    for i, w in texts.items():
        gone = {q for p in range(len(w) - 34) if seen[tuple(w[p : p + 35])] > 1 for q in range(p, p + 35)}
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        assert got[i] == (len(gone), hashlib.sha256(kept).hexdigest())


def test_hot_window_is_one_entry_a_block():
    """A text that repeats one passage very often asks about each distinct edge once, and its spans are one row for each path."""
    import pyarrow as pa

    from voxmill.llm import shared

    passage = [f"h{i}" for i in range(20)]
    docs = pa.table({"text": [" ".join(passage * 3000), " ".join(passage * 2000)]})
    table = pa.table({"block": [7], "rows": [shared.to_bytes(docs)]})
    (asked,) = substring_dedup.ask_anchors(35, 16, 1)(table.to_batches())
    told = substring_dedup.tell_anchors(pa.Table.from_batches([asked]))
    edges = substring_dedup.ask_edges(35, 16, 1)(None, table, told)
    assert edges.column("n").to_pylist() == [20]
    spans = substring_dedup.compact(35)(None, table, substring_dedup.tell_edges(edges))
    assert spans.num_rows <= 60 and sum(spans.column("n").to_pylist()) >= 2


def components(sets, percent):
    n = len(sets)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    return [find(x) for x in range(n)]


def check_components(docs, n, percent):
    got = near_dedup.near_duplicates(near_dedup.numbered(docs), n, percent)
    texts = rows_of(near_dedup.numbered(docs), "rid", "doc_id", "text")
    sets = [shingle_set(t, n) for _, _, t in texts]
    roots = components(sets, percent)
    least = {}
    for r, (_, i, _) in zip(roots, texts, strict=True):
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    want = {rid: (len(s), least[r], i == least[r]) for (rid, i, _), s, r in zip(texts, sets, roots, strict=True)}
    assert {r[0]: r[1:] for r in rows_of(got, "rid", "n_shingles", "component_id", "kept")} == want
    return got, roots


def test_near_duplicates(spark, awkward):
    got, roots = check_components(awkward, 3, 80)
    assert near_dedup.representatives(got).count() == len(set(roots))


def test_near_duplicates_of_many_edits(spark):
    """Many copies of one text with a few edits each, about the limit: what the bound prunes must be no link."""
    rng = np.random.default_rng(5)
    rows, base = [], [f"b{i}" for i in range(90)]
    for d in range(160):
        w = list(base)
        for _ in range(int(rng.integers(0, 7))):
            p = int(rng.integers(0, len(w)))
            kind = int(rng.integers(0, 3))
            w[p : p + 1] = [[f"e{d}_{p}"], [], [w[p], f"i{int(rng.integers(0, 9))}"]][kind]
        rows.append((d, " ".join(w)))
    check_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80)


def test_near_duplicates_at_the_edge_of_near(spark, monkeypatch):
    """Classes about a third like a centre, on either side of where differences to it are kept, linked with each other."""
    monkeypatch.setattr(near_dedup, "SLICE", 8)
    rng = np.random.default_rng(8)
    base = [f"b{i}" for i in range(100)]
    rows = [(0, " ".join(base))]
    for d in range(1, 60):
        own = base[: 44 + d % 13] + [f"g{d // 6}_{i}" for i in range(56 - d % 13)]
        for p in rng.integers(0, 100, int(rng.integers(0, 5))):
            own[int(p)] = f"e{d}_{p}"
        rows.append((d, " ".join(own)))
    rows += [(100 + d, " ".join([f"c{i}" if i in set(rng.integers(0, 100, 14).tolist()) else b for i, b in enumerate(base)])) for d in range(40)]
    check_components(spark.createDataFrame(rows, "doc_id long, text string"), 1, 80)


def test_near_duplicates_on_the_table(spark):
    check_components(spark.read.parquet(f"{SF}/documents.parquet"), 4, 80)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert substring_dedup.remove_repeats(none).count() == 0
    assert near_dedup.near_duplicates(none).count() == 0
    assert interpolated_lm.score_documents(none, F.lit(False)).count() == 0
    assert crf_language.identify(none).count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contained_items(none, items).count() == 0
    some = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert decontaminate.contained_items(some, items).count() == 0
    assert decontaminate.drop_contaminated(some, items).count() == 1


def test_language_model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(900001, None), (900002, ""), (None, "x")], "doc_id long, text string"))
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    got = rows_of(interpolated_lm.score_documents(docs, held), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    count, texts = Counter(), {i: [*split(t), None] for i, t in rows_of(docs, "doc_id", "text")}
    out = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    for i, w in texts.items():
        if not out[i]:
            count.update(w)
    n, v = sum(count.values()), len(count)
    for i, h, tokens, known, total, base, score in got:
        w = texts[i]
        assert (h, tokens, known, total) == (out[i], len(w), sum(count[x] > 0 for x in w), n)
        assert math.isclose(base, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert score < 0
    rest = [r for r in got if r[1]]
    assert sum(r[6] for r in rest) > sum(r[5] for r in rest)  # better than the base on held-out texts


@pytest.mark.parametrize("order", [1, 2, 3])
def test_model_sums_to_one(spark, order):
    """Scores of all texts of at most two words over a closed vocabulary, one word unknown in training: each word adds an end, so the mass of those ended is below 1 and that of longer ones is the rest."""
    train = [(i, " ".join(np.random.default_rng(i).choice(["a", "b"], 3))) for i in range(60)]
    texts = ["", *"abz", *(f"{x} {y}" for x in "abz" for y in "abz")]
    docs = spark.createDataFrame([*train, *((1000 + n, t) for n, t in enumerate(texts))], "doc_id long, text string")
    got = {r.doc_id: 10**r.score for r in interpolated_lm.score_documents(docs, F.col("doc_id") >= 1000, order=order).collect()}
    p = dict(zip(texts, (got[1000 + n] for n in range(len(texts))), strict=True))
    assert all(0 < x < 1 for x in p.values()) and sum(p.values()) < 1


def test_query_knows_trigrams(spark, tmp_path):
    held = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 7 == 2]
    learned = [i for i in range(1000) if i not in set(held)][:400]
    rows = [(i, ("a x b", "c x d", "b d", "d b")[n % 4]) for n, i in enumerate(learned)] + [(held[0], "a x b"), (held[1], "a x d")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    score = {r.doc_id: r.score for r in queries.op1_deleted_interpolation(spark, str(tmp_path)).where("held_out").collect()}
    assert score[held[0]] > score[held[1]] + 0.5  # "x b" and "x d" are as frequent, "a x d" is new


def plain_model(texts, held, order, iterations=15):
    """Counts, EM and scores of a list of (id, text), word by word."""
    docs = [[*split(t), None] for _, t in texts]
    gone = [not h and zlib.crc32(("" if i is None else str(i)).encode()) // 7 % interpolated_lm.DELETED == 0 for (i, _), h in zip(texts, held, strict=True)]

    def grams(w, k):
        w = ["<s>"] * (order - 1) + w
        return [tuple(w[p - k + 1 : p + 1]) for p in range(order - 1, len(w))]

    def model(chosen):
        count = [Counter(g for d, c in zip(docs, chosen, strict=True) if c for g in grams(d, k + 1)) for k in range(order)]
        return count, sum(count[0].values()), sum(chosen)

    def steps(w, counts):
        count, tokens, n = counts
        for p in range(len(w)):
            row = []
            for k in range(order):
                g = grams(w, k + 1)[p]
                context = tokens if k == 0 else n if p == 0 else count[k - 1][grams(w, k)[p - 1]]
                row.append((count[k][g] / context if context else 0.0, min(int(math.log2(context)) + 1, 63) if context else 0))
            yield row

    learned = model([not h for h in held])
    v = len(learned[0][0])
    rest = model([not h and not g for h, g in zip(held, gone, strict=True)])
    rows = [r for w, g in zip(docs, gone, strict=True) if g for r in steps(w, rest)]
    weight = [[0.5] * 64 for _ in range(order)]

    def mix(row):
        p, below = 1 / (v + 1), []
        for k, (share, b) in enumerate(row):
            below.append(p)
            w = weight[k][b] if b else 0.0
            p = w * share + (1 - w) * p
        return p, below

    before = -math.inf
    for _ in range(iterations if rows else 0):
        stop, reach, like = Counter(), Counter(), 0.0
        for row in rows:
            p, below = mix(row)
            like += math.log(p)
            left = 1.0
            for k in range(order - 1, -1, -1):
                share, b = row[k]
                w = weight[k][b] if b else 0.0
                here = left * w * share / (w * share + (1 - w) * below[k])
                stop[k, b] += here
                reach[k, b] += left
                left -= here
        for k, b in reach:
            weight[k][b] = min(stop[k, b] / reach[k, b], 0.999)
        if like / len(rows) - before < 1e-5:
            break
        before = like / len(rows)
    return [sum(math.log10(mix(r)[0]) for r in steps(w, learned)) for w in docs]


@pytest.mark.parametrize("block_bytes", [300, 4 << 20])
def test_score_is_brute_force(spark, block_bytes):
    """Small blocks and buckets, so n-grams are asked about, known without asking, and shared by learned and held-out texts."""
    rng = np.random.default_rng(4)
    texts = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.6, int(rng.integers(0, 30))) % 40)) for i in range(150)]
    texts += [(200, None), (201, ""), (7, texts[7][1]), (None, texts[9][1]), (202, "a b c a b c"), (203, "a b c d")]
    held = [i is not None and i % 5 == 2 for i, _ in texts]
    docs = spark.createDataFrame([(i, t, 1.5, "clash") for i, t in texts], "doc_id long, text string, score double, block string").repartition(3)
    got = interpolated_lm.score_documents(docs, F.col("doc_id") % 5 == 2, order=3, block_bytes=block_bytes, bucket_bytes=block_bytes)
    assert got.columns == ["doc_id", "block", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    want = sorted((str(i), round(s, 6)) for (i, _), s in zip(texts, plain_model(texts, held, 3), strict=True))
    for a, b in zip(sorted((str(r.doc_id), r.score) for r in got.collect()), want, strict=True):
        assert a[0] == b[0] and math.isclose(a[1], b[1], rel_tol=1e-5)


def test_order_is_brute_force(spark):
    """Bigram shares of a tiny corpus by hand: EM's weights lie in [0, 1) and mixing stays a probability."""
    orders = interpolated_lm._orders([np.array([2, 1, 0]), np.array([1, 0, 0])], np.array([0, 3]), 10, 4)
    assert orders[0][0].tolist() == [0.2, 0.1, 0.0] and orders[1][0].tolist() == [0.25, 0.0, 0.0]
    assert orders[1][1].tolist() == [3, 2, 1]
    p, _ = interpolated_lm._mix(orders, np.full((2, interpolated_lm.BUCKETS), 0.5), 9)
    assert p[0] == pytest.approx(0.5 * 0.25 + 0.5 * (0.5 * 0.2 + 0.5 * 0.1))


def test_containment(spark, awkward):
    items = [(1, "w3 w4 w5 w6 w7 w8 w9 w10"), (2, "W40 w41"), (3, None), (4, ""), (5, "one two three four five"), (6, "t1 t2 t3 t4 t5 t6"), (7, "w3 w4 w5 w6 w7 w8 w9 w10"), (8, "a")]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = Counter(rows_of(decontaminate.contained_items(awkward, table, n=3, percent=70), "doc_id", "item_id", "n_shingles", "n_shared"))
    want = Counter()
    for i, t in rows_of(awkward, "doc_id", "text"):
        own = shingle_set(t, 3)
        for item, text in items:
            q = shingle_set(text, 3)
            if q and item != 7 and 100 * len(q & own) >= 70 * len(q):
                want[(i, item, len(q), len(q & own))] += 1
    assert got == want
    kept = decontaminate.drop_contaminated(awkward, table, n=3, percent=70)
    held = {i for i, *_ in want}
    assert kept.columns == awkward.columns
    assert Counter(rows_of(kept, "doc_id", "text")) == Counter(r for r in rows_of(awkward, "doc_id", "text") if not any(100 * len(q & shingle_set(r[1], 3)) >= 70 * len(q) for q in (shingle_set(t, 3) for _, t in items) if q))
    assert held


def test_containment_in_several_blocks(spark, awkward, monkeypatch):
    """Item ids of any kind, items in many blocks."""
    items = spark.createDataFrame([("a", "w3 w4 w5 w6 w7 w8 w9 w10"), ("b", "one two three four five"), ("c", "t1 t2 t3 t4 t5 t6"), ("d", "alone in its group of words")], "item_id string, text string")
    whole = Counter(rows_of(decontaminate.contained_items(awkward, items, n=3, percent=70), "doc_id", "item_id"))
    left = Counter(rows_of(decontaminate.drop_contaminated(awkward, items, n=3, percent=70), "doc_id", "text"))
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 20)
    assert Counter(rows_of(decontaminate.contained_items(awkward, items, n=3, percent=70), "doc_id", "item_id")) == whole and whole[(None, "d")] == 1
    assert Counter(rows_of(decontaminate.drop_contaminated(awkward, items, n=3, percent=70), "doc_id", "text")) == left


def test_containment_on_the_table(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    got = set(rows_of(decontaminate.contained_items(docs, items), "doc_id", "item_id"))
    sets = {i: shingle_set(t, 5) for i, t in rows_of(docs, "doc_id", "text")}
    want = {(d, i) for i, t in rows_of(items, "item_id", "text") for d, s in sets.items() if (q := shingle_set(t, 5)) and 100 * len(q & s) >= 80 * len(q)}
    assert got == want and got


def test_posteriors_by_enumeration():
    from itertools import product

    rng = np.random.default_rng(2)
    energy, moves = rng.normal(size=(7, 3)), rng.normal(size=(3, 3))
    bounds = np.array([0, 5, 5, 7])
    got = crf_language.posteriors(energy, moves, bounds)
    for lo, hi in ((0, 5), (5, 7)):
        total = np.zeros((hi - lo, 3))
        for path in product(range(3), repeat=hi - lo):
            e = sum(energy[lo + t, y] for t, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:], strict=False)) + np.log(np.exp(moves[:, path[0]]).sum())
            for t, y in enumerate(path):
                total[t, y] += np.exp(e)
        assert np.allclose(got[lo:hi], total / total.sum(axis=1, keepdims=True))


def test_posteriors_across_chunks():
    rng = np.random.default_rng(3)
    energy, moves = rng.normal(size=(500, 4)), rng.normal(size=(4, 4))
    bounds = np.array([0, 300, 301, 500])
    whole = crf_language.posteriors(energy, moves, bounds)
    size, crf_language.CHUNK = crf_language.CHUNK, 7
    try:
        assert np.allclose(whole, crf_language.posteriors(energy, moves, bounds))
    finally:
        crf_language.CHUNK = size


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(900001, None, "en"), (900002, "", None), (900003, "1234 !?", "de"), (None, "thing and the", None)], "doc_id long, text string, lang string")
    got = rows_of(crf_language.identify(docs.unionByName(odd)), "doc_id", "lang", "held_out", "lang_pred", "score")
    assert {r[0]: (r[3], r[4]) for r in got if r[0] in (900001, 900002, 900003)} == {k: ("und", 0.0) for k in (900001, 900002, 900003)}
    held = [r for r in got if r[2] and r[0] < 900000]
    assert sum(r[1] == r[3] for r in held) >= 0.98 * len(held)
    assert all(0 <= r[4] <= 1 for r in got)


def switched(docs):
    """Texts of two languages, 30 words of one, then 30 of the other, and where the switch is."""
    by = {}
    for r in docs.where("lang is not null").orderBy("doc_id").collect():
        by.setdefault(r.lang, []).extend(r.text.split()[:60])
    langs = sorted(by)
    return [(a, b, " ".join(by[a][40 * n : 40 * n + 30] + by[b][40 * n : 40 * n + 30])) for n in range(8) for a in langs for b in langs if a != b]


def test_words_of_switched_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = crf_language.fit(docs)
    mixed = switched(docs)
    odd = [(900, None), (901, ""), (902, "12 34"), (903, " ".join(t for _, _, t in mixed) * 40), (0, mixed[0][2])]
    table = spark.createDataFrame([(n, t) for n, (_, _, t) in enumerate(mixed)] + odd, "doc_id long, text string")
    got = [(r.doc_id, r.runs) for r in crf_language.label_words(table, model).collect()]
    right = total = 0
    for n, runs in got:
        if n < len(mixed):
            a, b, _ = mixed[n]
            assert runs[-1].end == 60 and all(x.end == y.first for x, y in zip(runs, runs[1:], strict=False))
            right += sum(len(range(max(r.first, lo), min(r.end, hi))) for r in runs for lo, hi, lang in ((0, 30, a), (30, 60, b)) if r.lang == lang)
            total += 60
    assert right >= 0.95 * total
    assert [r for n, r in got if n in (900, 901, 902)] == [[], [], []]
    assert dict(got)[903][-1].end == len(odd[3][1].split())


def test_sample_counts_copies_once_and_is_bounded(spark):
    rows = [(f"text number {i} of one", "aa") for i in range(50)] + [("copied words " * 20, "aa")] * 500 + [("only this text", "bb")] * 300 + [("x" * 999, "cc"), (None, "dd"), ("lost", None)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    got = Counter(r.lang for r in crf_language.sample_texts(docs, 20, 3, 100).collect())
    assert got == {"aa": 20, "bb": 1, "cc": 2}  # nine equal pieces of 100 characters and one of 99
    assert all(len(r.text) <= 100 for r in crf_language.sample_texts(docs, 20, 3, 100).collect())
    assert set(Counter(r.lang for r in crf_language.sample_texts(docs, 20, 2, 100).collect())) == {"aa", "bb"}


def test_confidence_tells_junk_from_mixed_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rng = np.random.default_rng(6)
    junk = [" ".join("".join(rng.choice(list("bcdfghjklmnpqrstvwxz0123456789"), 9)) for _ in range(60)) for _ in range(6)] + ["Широкая электрификация южных губерний даст мощный толчок " * 5]
    mixed = [t for _, _, t in switched(docs)][:12]
    extra = spark.createDataFrame([(900000 + n, t, None) for n, t in enumerate(junk)] + [(910000 + n, t, None) for n, t in enumerate(mixed)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.known for r in crf_language.identify(docs.unionByName(extra)).select("doc_id", "known").collect()}
    assert max(got[900000 + n] for n in range(len(junk))) < 0.6
    assert min(got[910000 + n] for n in range(len(mixed))) > 0.9
    assert sum(v < 0.6 for k, v in got.items() if k < 900000) == 0


def test_labels_with_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "the thing and the other", "en", True, 5.0, "w"), (1, "the thing and the other", "en", True, 5.0, "w"), (3, "la cosa y la otra", "es", False, 1.0, "v")], "doc_id long, text string, lang string, has_letter boolean, known double, whole string")
    got = crf_language.identify(docs)
    assert got.columns == ["doc_id", "text", "lang", "has_letter", "whole", "lang_pred", "score", "known", "held_out"]
    assert rows_of(got.where("doc_id = 1").distinct(), "has_letter", "whole") == [(True, "w")]


def test_labels_do_not_depend_on_neighbours(spark, monkeypatch):
    """A text alone, beside others, and in parts of a few words."""
    import pyarrow as pa

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang")
    model = crf_language.fit(docs, rounds=1)
    texts = [r.text for r in docs.limit(30).collect()]
    whole = model.label(*words.utf8(pa.array(texts)))
    alone = [model.label(*words.utf8(pa.array([t]))) for t in texts]
    assert np.allclose(whole[0], np.concatenate([a[0] for a in alone]), atol=1e-5) and np.allclose(whole[1], np.concatenate([a[1] for a in alone]))
    monkeypatch.setattr(crf_language, "PART", 7)
    parts = model.label(*words.utf8(pa.array(texts)))
    assert np.allclose(whole[0], parts[0], atol=1e-5) and np.allclose(whole[1], parts[1])


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    assert rows_of(crf_language.identify(docs), "lang_pred", "score") == [("und", 0.0)]


def test_long_texts_and_all_languages_are_sampled(spark):
    """Pieces of a long text are rows of their own, also beyond the first; no language is left out."""
    rows = [("first " * 40 + "later " * 400, "aa")] + [(f"word{n} text", f"l{n % 90:02d}") for n in range(180)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    got = crf_language.sample_texts(docs, 50, None, 100).collect()
    assert len({r.lang for r in got}) == 91
    mine = [r.text for r in got if r.lang == "aa"]
    whole = rows[0][0]
    assert set(mine) == {whole[n : n + 100] for n in range(0, len(whole), 100)} and any("first" not in t for t in mine)
    few = crf_language.sample_texts(docs, 3, None, 100).where("lang = 'aa'").collect()
    assert len(few) == 3 and {r.text for r in few} <= set(mine)
