"""Groups of near vertices, also where very many lie in one place."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxmill.operators import mesh


def plain(points, radius):
    reach = list(range(len(points)))

    def top(n):
        while reach[n] != n:
            n = reach[n]
        return n

    for n in range(len(points)):
        for m in np.flatnonzero(((points[:n] - points[n]) ** 2).sum(1) <= radius * radius):
            a, b = sorted((top(n), top(int(m))))
            reach[b] = a
    return {n: top(n) for n in range(len(points))}


def groups(spark, points, radius, axes):
    table = spark.createDataFrame(pd.DataFrame({"vid": np.arange(len(points)), **{x: points[:, n] for n, x in enumerate(axes)}}))
    return {r.node: r.root for r in mesh.near_groups(table, radius, axes).collect()}


@pytest.mark.parametrize("axes", [("x", "y"), ("x", "y", "z")])
def test_groups_are_those_of_all_pairs(spark, axes):
    draw = np.random.default_rng(len(axes))
    points = np.vstack((draw.uniform(-2, 2, (350, len(axes))), draw.normal(size=(80, len(axes))) * 0.02 + 0.5, np.round(draw.uniform(-1, 1, (120, len(axes))), 1)))
    points = np.vstack((points, points[:20]))
    assert groups(spark, points, 0.1, axes) == plain(points, 0.1)


def test_very_many_in_one_place(spark):
    draw = np.random.default_rng(1)
    balls = draw.normal(size=(100_000, 3))
    balls *= 0.4 * draw.uniform(0, 1, (100_000, 1)) / np.linalg.norm(balls, axis=1, keepdims=True)  # all within one radius
    far = np.vstack((balls, balls[:5] + [1.9, 0, 0], [[0.0, 0.0, 1.3999], [0.0, 0.0, 2.4]]))
    got = groups(spark, far, 1.0, ("x", "y", "z"))
    want = plain(far[100_000:], 1.0)
    assert {got[n] for n in range(100_000)} == {0}
    for n, p in enumerate(far[100_000:]):
        touches = (((balls - p) ** 2).sum(1) <= 1).any()
        assert (got[100_000 + n] == 0) == (touches or any(want[n] == want[m] and (((balls - q) ** 2).sum(1) <= 1).any() for m, q in enumerate(far[100_000:])))


def test_estimates_do_not_grow_with_the_rounds(spark):
    """A join's estimated size is the product of its sides'; carried from round to round it filled the driver's memory."""
    nodes = spark.range(1500).select(F.col("id").alias("node"))
    edges = nodes.where("node > 0").select(F.col("node").alias("a"), (F.col("node") - 1).alias("b"))
    roots = mesh.components(nodes, edges)
    assert roots.where("root = 0").count() == 1500
    draw = np.random.default_rng(3)
    points = np.round(draw.uniform(-1000, 10000, (1500, 1)), 2) / 1000
    table = spark.createDataFrame(pd.DataFrame({"vid": np.arange(len(points)), "x": points[:, 0]}))
    near = mesh.near_groups(table, 0.01, ("x",))
    assert {r.node: r.root for r in near.collect()} == plain(points, 0.01)
    for made in (roots, near):
        assert made._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 1000


@pytest.mark.parametrize("axes", [("x",), ("x", "y", "z")])
def test_dense_cells_at_the_radius(spark, axes):
    """Clouds of many points whose distance is the radius, more or less, so that cells are halved before points are compared."""
    draw = np.random.default_rng(7)
    cloud = draw.uniform(0, 0.05, (400, len(axes)))
    step = np.zeros(len(axes))
    points = []
    for n, gap in enumerate((1.0 - 1e-9, 1.0 + 1e-9, 0.999, 1.0)):
        ends = cloud.copy()
        ends[0], ends[1] = 0.025, 0.025
        ends[0][0], ends[1][0] = 0.0, 0.05
        points.append(ends + step)
        step = step + 0
        step[0] += 0.05 + gap
    points = np.vstack(points)
    assert groups(spark, points, 1.0, axes) == plain(points, 1.0)
