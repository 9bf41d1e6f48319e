"""Near-equal embeddings against all pairs in plain numbers."""

import numpy as np
import pytest

from voxmill.llm import near_vectors, queries

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int, v string, cid long"


def plain(rows, least=0.9):
    good = []
    for n, (_, e, *_) in enumerate(rows):
        x = None if e is None or any(c is None for c in e) else np.array(e, float)
        if x is not None and len(x) and np.isfinite(x).all() and x.any():
            good.append((n, x / np.linalg.norm(x)))
    reach = list(range(len(rows)))
    links = [0] * len(rows)

    def top(n):
        while reach[n] != n:
            n = reach[n]
        return n

    for a, (n, x) in enumerate(good):
        for m, y in good[:a]:
            if len(x) == len(y) and float(x @ y) >= least:
                links[n] += 1
                links[m] += 1
                reach[max(top(n), top(m))] = min(top(n), top(m))
    low = {}
    for n, r in enumerate(rows):
        if r[0] is not None:
            low[top(n)] = min(low.get(top(n), r[0]), r[0])
    return sorted(((r[0], links[n], low.get(top(n)), r[0] == low.get(top(n))) for n, r in enumerate(rows)), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def cloud(seed, dims=24):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(12, dims))
    rows = []
    for n in range(400):
        c = centres[draw.integers(12)]
        rows.append((int(n), [float(x) for x in np.float32(c + draw.normal(size=dims) * draw.choice([0.05, 0.25, 0.33, 0.4, 3]))], 1, "x", 5))
    rows += [(1000 + n, rows[7][1], 2, "x", 5) for n in range(30)]
    rows += [(2000, [2 * x for x in rows[9][1]], 2, "x", 5), (2001, [-x for x in rows[9][1]], 2, "x", 5)]
    hot = draw.normal(size=dims)
    rows += [(3000 + n, [float(x) for x in np.float32(hot + draw.normal(size=dims) * 0.12)], 3, "x", 5) for n in range(220)]
    odd = [None, [], [0.0] * dims, [1.0, None] + [0.0] * (dims - 2), [float("nan")] * dims, [float("inf")] + [1.0] * (dims - 1), [1.0, 2.0], [1.0, 2.0], [5.0], [1e-38] * dims, [3e38] * dims]
    rows += [(4000 + n, e, None, None, None) for n, e in enumerate(odd)]
    return rows + [(None, rows[3][1], 0, "x", 0), (5, rows[5][1], 0, "x", 0), (None, None, 0, "x", 0)]


@pytest.mark.parametrize("seed,width,grid,chunk", [(1, 16, 2, 8192), (2, 4, 2, 40), (3, 8, 1, 25), (4, 6, 3, 60)])
def test_against_all_pairs(spark, seed, width, grid, chunk):
    rows = cloud(seed)
    made = near_vectors.near_vectors(spark.createDataFrame(rows, SCHEMA).repartition(5), width=width, grid=grid, chunk=chunk)
    assert got(made) == plain(rows)


def test_chains_and_limits(spark):
    turn = [(n, [float(np.cos(n * 0.44)), float(np.sin(n * 0.44)), 0.0], 0, "x", 0) for n in range(6)]  # neighbours have 0.905
    exact = [(10, [3.0, 4.0, 0.0], 0, "", 0), (11, [5.0, 0.0, 0.0], 0, "", 0), (12, [0.0, 0.0, 1.0], 0, "", 0)]
    assert got(near_vectors.near_vectors(spark.createDataFrame(turn, SCHEMA))) == sorted([(n, 1 if n in (0, 5) else 2, 0, n == 0) for n in range(6)], key=repr)
    assert [r[1] for r in got(near_vectors.near_vectors(spark.createDataFrame(exact, SCHEMA), least=0.6))] == [1, 1, 0]
    assert near_vectors.near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
    wide = spark.createDataFrame([(n, [0.1 * n, 1.0]) for n in range(4)], "vec_id long, embedding array<double>")
    assert got(near_vectors.near_vectors(wide)) == plain(wide.collect())


def test_pairs_count_once_over_blocks(spark):
    rows = [(n, [float(x) for x in np.random.default_rng(n // 2).normal(size=64)], 0, "x", 0) for n in range(120)]
    assert all(r[1] == 1 for r in got(near_vectors.near_vectors(spark.createDataFrame(rows, SCHEMA))))
    rows = [(n, [float(x) for x in np.ones(64) + 0.2 * np.random.default_rng(n).normal(size=64)], 0, "x", 0) for n in range(150)]
    assert got(near_vectors.near_vectors(spark.createDataFrame(rows, SCHEMA), width=4, chunk=64)) == plain(rows)


def test_query(spark):
    df = queries.op13_subspace_pigeonhole(spark, SF)
    assert df.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert got(df) == plain(spark.read.parquet(f"{SF}/embeddings.parquet").collect())
