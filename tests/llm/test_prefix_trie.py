"""The prefix trie against a plain one."""

import hashlib
import random
import zlib

import duckdb
import pytest

from voxmill.llm import prefix_trie, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn int, role string, text string, name string, depth int"


def turn_key(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def plain(rows):
    given = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            given.setdefault(conv, []).append(((turn is not None, turn or 0, turn_key(role or "", text or "")), (role or "", text or "")))
    given = {c: [t for _, t in sorted(v)] for c, v in given.items()}
    made = {}
    for c, own in given.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = tuple(given.get(c - (abs(c) % 100) * (1 if c >= 0 else -1), [])[:h] + own[h:])
    members = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    def totals(p):
        leaves, saved = (0 if p in kids else 1), ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
        stack = list(kids.get(p, []))
        while stack:
            q = stack.pop()
            leaves, saved = leaves + (q not in kids), saved + (len(members[q]) - 1) * len(q[-1][1])
            stack += kids.get(q, [])
        return leaves, saved

    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if made[c] == p)))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), *totals(p), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_a_plain_trie(spark, seed):
    draw = random.Random(seed)
    rows = []
    for c in [*range(0, 40), *range(100, 112), *range(205, 212), -1, -7, -100, 10**12]:
        for n in range(draw.randint(1, 9)):
            rows.append((c, draw.choice([n, n, n, None]), draw.choice(["user", "assistant", None]), draw.choice(["a", "b", "", None, "é漢🙂", "1:u"]), "x", 3))
    rows += [(50, n, "user", "deep" if n < 60 else str(n), "x", 0) for n in range(70)] + [(51, n, "user", "deep", "x", 0) for n in range(65)]
    rows += [(None, 1, "user", "lost", "x", 0)] + [(60, 1, "user", "same", "x", 0)] * 4
    rows += [(c, n, "user", f"common {n}", "x", 0) for c in range(300, 360) for n in range(3)]
    assert got(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(5))) == plain(rows)


def test_turnless_and_empty(spark):
    short = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 2)
    rows = [(short, 1, "user", "gone", None, None)]
    assert got(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == plain(rows) == [(short, 0, None, 1, 0, 1, 0, hashlib.sha256(str(short).encode()).hexdigest())]
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []


def test_very_long_text(spark):
    rows = [(c, 0, "user", "long " * 600_000, "", 0) for c in (1, 2)]
    assert got(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), most=0))[-1][6] == 3_000_000


def test_many_ends_are_hashed_in_order(spark):
    ids = [*range(-5, 9000), 10**15]
    ends = spark.createDataFrame([(3, b"n", i) for i in ids] + [(3, b"m", 2), (4, b"n", 1)], "depth long, name binary, conv long").repartition(7)
    made = {(r.depth, bytes(r.name)): r.ends_sha256 for r in prefix_trie.hashed_ends(ends).collect()}
    assert made == {(3, b"n"): hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), (3, b"m"): hashlib.sha256(b"2").hexdigest(), (4, b"n"): hashlib.sha256(b"1").hexdigest()}


def test_query_and_twin(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    df = queries.op11_prefix_trie(spark, SF)
    want = con.execute(queries.ORACLES["op11_prefix_trie"]).fetchall()
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert got(df) == sorted(want, key=repr)
