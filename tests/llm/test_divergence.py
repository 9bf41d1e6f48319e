"""The divergence audit against a plain one, in whole numbers."""

import random
import re
from collections import Counter, defaultdict

import pytest

from voxmill.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, n int"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, ranks=50):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = TERM.findall((text or "").translate(LOWER))
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang in {g for g, _ in groups}:
        kept = sorted((t for t, n in docs[lang].items() if n >= 30), key=str.encode)
        sources = sorted(s for g, s in groups if g == lang)

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            over = [(p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, values, most in (("pair", pairs, None), ("term", over, ranks)):
                ordered = sorted(values, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, o, v, n) for n, (v, o) in enumerate(ordered, 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def corpus(seed):
    draw = random.Random(seed)
    words = [f"{a}{b}" for a in ("Foo", "bar", "É", "漢字", "x") for b in ("", "a", "B", "é", "-", "'", "\t", "🙂")] + ["the", "The", "THE", "ı", "\x00", "\x7f", "1a2"]
    rows = []
    for n in range(700):
        lang, source = draw.choice(["en", "de", None]), draw.choice(["s1", "s2", "s3", "é", None])
        mine = words[: 20 + 5 * len(source or "")]
        rows.append((n, draw.choice(["", " ", "\n"]).join(draw.choice(mine) + draw.choice([" ", ". ", ""]) for _ in range(draw.randint(0, 30))), lang, source, "x", n))
    hot = "the common foo bar text"
    rows += [(1000 + n, hot, "en", draw.choice(["s1", "s2", "only hot"]), "x", 0) for n in range(400)]
    rows += [(2000, None, "en", "s1", None, None), (2001, "", "en", "silent", "x", 0), (2002, "rare words", "fr", "a", "x", 0), (2003, "rare", "fr", "b", "x", 0), (2004, "123 !", "xx", "one", "x", 0)]
    return rows


@pytest.mark.parametrize("seed,small", [(1, False), (2, True)])
def test_against_a_plain_audit(spark, seed, small, monkeypatch):
    if small:  # several tiles, blocks, slices of sources and pieces of a text: the results stay
        for name, value in (("SOURCES_TOGETHER", 2), ("HELD", 50), ("BLOCK_CELLS", 20), ("TILE_SOURCES", 2), ("PIECE", 7)):
            monkeypatch.setattr(divergence, name, value)
    rows = corpus(seed)
    assert got(divergence.audit(spark.createDataFrame(rows, SCHEMA).repartition(6))) == plain(rows)


def test_no_kept_terms_and_empty_table(spark):
    rows = [(1, "a b", "en", "x", "", 0), (2, None, None, "x", "", 0), (3, "a", "en", "y", "", 0)]
    assert got(divergence.audit(spark.createDataFrame(rows, SCHEMA))) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)] == plain(rows)
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).collect() == []


def test_top_terms_are_cut_at_ranks(spark):
    rows = [(n, "alpha beta gamma delta" if n % 2 else "alpha", "en", f"s{n % 2}", "", 0) for n in range(80)]
    assert got(divergence.audit(spark.createDataFrame(rows, SCHEMA), ranks=2)) == plain(rows, 2)


@pytest.mark.parametrize("piece", [1, 3, 64])
def test_pieces_of_a_text(piece):
    text = "Ab cd,é" * 40 + "z" * 200 + " end"
    want = TERM.findall(text.translate(LOWER))
    assert [t.decode() for part in divergence.term_pieces(text.encode(), piece) for t in part] == want


def test_very_long_texts_and_large_counts(spark):
    rows = [(n, "word " * 400_000 + "x" * 3_000_000, "en", f"s{n % 3}", "", 0) for n in range(6)] + [(n, "word other", "en", "s1", "", 0) for n in range(40)]
    assert got(divergence.audit(spark.createDataFrame(rows, SCHEMA))) == plain(rows)
    huge = spark.range(1).select(divergence.share(*(divergence.F.lit(x).cast("long") for x in (10**17, 10**18, 10**6))).alias("p")).first().p
    assert huge == 1 + 10**9 * (10**17 + 5) // (10**18 + 5 * 10**6)
