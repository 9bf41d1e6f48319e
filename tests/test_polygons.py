"""Points in polygons of any shape and size, against the even-odd rule in plain numbers."""

import math
import random

import numpy as np
import pytest

from voxmill.operators import validation

SIDES, POINTS = "ax double, ay double, bx double, by double", "pid long, x double, y double, name string"


def ring(points):
    return [(*map(float, a), *map(float, b)) for a, b in zip(points, points[1:] + points[:1])]


def plain(points, sides):
    s = np.array(sides)
    inside = set()
    for pid, x, y, *_ in points:
        if x is None or y is None:
            continue
        up = (s[:, 1] > y) != (s[:, 3] > y)
        rise = np.where(s[:, 3] == s[:, 1], 1, s[:, 3] - s[:, 1])
        odd = int((up & (x > s[:, 0] + (y - s[:, 1]) / rise * (s[:, 2] - s[:, 0]))).sum()) % 2
        d = s[:, 2:] - s[:, :2]
        t = np.clip(((x - s[:, 0]) * d[:, 0] + (y - s[:, 1]) * d[:, 1]) / np.maximum((d * d).sum(1), 1e-300), 0, 1)
        if odd or np.hypot(x - s[:, 0] - t * d[:, 0], y - s[:, 1] - t * d[:, 1]).min() <= 1e-12:
            inside.add(pid)
    return inside


def got(spark, points, sides, **more):
    rows = validation.inside_any_polygon(spark.createDataFrame(points, POINTS), spark.createDataFrame(sides, SIDES), **more).collect()
    assert len({r.pid for r in rows}) == len(rows)
    return {r.pid for r in rows}


def shapes():
    draw = random.Random(3)
    star = ring([(math.cos(n * 0.1) * (1 if n % 2 else 0.2), math.sin(n * 0.1) * (1 if n % 2 else 0.2)) for n in range(62)])
    comb = ring([(0, 0), *((n / 100, 1 if n % 2 else 0.1) for n in range(1, 200)), (2, 0)])
    hole = ring([(0, 0), (4, 0), (4, 4), (0, 4)]) + ring([(1, 1), (1, 3), (3, 3), (3, 1)]) + ring([(6, 0), (7, 0), (6.5, 3)])
    wild = ring([(draw.uniform(-3, 3), draw.uniform(-3, 3)) for _ in range(80)])
    return {"star": star, "comb": comb, "hole": hole, "wild": wild}


@pytest.mark.parametrize("name", sorted(shapes()))
def test_shapes(spark, name):
    sides, draw = shapes()[name], random.Random(name)
    xs, ys = [v for s in sides for v in (s[0], s[2])], [v for s in sides for v in (s[1], s[3])]
    points = [(n, draw.uniform(min(xs) - 0.1, max(xs) + 0.1), draw.uniform(min(ys) - 0.1, max(ys) + 0.1), "") for n in range(3000)]
    points += [(5000 + n, s[0], s[1], "corner") for n, s in enumerate(sides)] + [(6000 + n, draw.choice(xs), draw.uniform(min(ys), max(ys)), "") for n in range(50)] + [(7000, None, 1.0, ""), (7001, 1.0, None, "")]
    want = plain(points, sides)
    assert got(spark, points, sides) == want
    assert got(spark, points, sides, cells=3) == want


def test_many_sides(spark):
    n = 100_000
    corners = [((1 + 0.3 * (k % 2) + 0.2 * math.sin(k / 500)) * math.cos(2 * math.pi * k / n), (1 + 0.3 * (k % 2) + 0.2 * math.sin(k / 500)) * math.sin(2 * math.pi * k / n)) for k in range(n)]
    points = [(k, random.Random(k).uniform(-1.6, 1.6), random.Random(-k).uniform(-1.6, 1.6), "") for k in range(400)]
    sides = ring(corners)
    import pandas as pd

    table = spark.createDataFrame(pd.DataFrame(sides, columns=["ax", "ay", "bx", "by"]))
    assert {r.pid for r in validation.inside_any_polygon(spark.createDataFrame(points, POINTS), table).collect()} == plain(points, sides)


def test_no_sides(spark):
    assert validation.inside_any_polygon(spark.createDataFrame([(1, 0.0, 0.0, "")], POINTS), spark.createDataFrame([], SIDES)).count() == 0
