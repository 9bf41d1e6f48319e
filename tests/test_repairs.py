"""Mesh repair to the end, depths near the surface alone, and quantiles of groups of any size."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxmill.functions import numbering
from voxmill.functions.numbering import accumulated, quantiles
from voxmill.operators import lattice, mesh
from voxmill.operators.pipeline import SurfaceMapper
from voxmill.spec import GridSpec

VERTICES, FACES = "vid long, x double, y double, z double", "elem_id long, a long, b long, c long"


def balance(faces):
    sides = Counter((r[x], r[y]) for r in faces for x, y in ("ab", "bc", "ca"))
    return {s for s, n in sides.items() if sides[s[::-1]] != n}


def area(points, faces):
    return sum(np.linalg.norm(np.cross(points[r.b] - points[r.a], points[r.c] - points[r.a])) / 2 for r in faces)


def test_chain_of_thin_faces(spark):
    """Four thin faces in a row on one side of a square: each splits what the one before it left."""
    points = {0: (0, 0), 1: (8, 0), 2: (4, 0), 3: (2, 0), 4: (1, 0), 5: (0.5, 0), 6: (0, 8), 7: (0, -8)}
    points = {v: np.array((*p, 0.0)) for v, p in points.items()}
    # whole faces above and below; between them the chain 0-1 split at 2, 0-2 at 3, 0-3 at 4, 0-4 at 5
    faces = [(0, 0, 1, 6), (1, 0, 2, 1), (2, 0, 3, 2), (3, 0, 4, 3), (4, 0, 5, 4)]
    lower = [(5, 7, 1, 2), (6, 7, 2, 3), (7, 7, 3, 4), (8, 7, 4, 5), (9, 7, 5, 0)]
    vertices = spark.createDataFrame([(v, *map(float, p)) for v, p in points.items()], VERTICES)
    given = spark.createDataFrame(faces + lower, FACES)
    border = balance(given.collect())
    made = mesh.repair(vertices, given).collect()
    assert balance(made) == border and len({r.elem_id for r in made}) == len(made) == 10
    assert area(points, made) == pytest.approx(area(points, given.collect()))
    assert mesh.thin_faces(vertices, spark.createDataFrame(made, FACES)).count() == 0


def flat_mesh(spark):
    """Random faces on a lattice of points, so that many are thin and share sides."""
    draw = random.Random(5)
    vertices = spark.createDataFrame([(v, float(v % 5), float(v // 5), 0.0) for v in range(40)], VERTICES)
    return vertices, mesh.distinct_corners(spark.createDataFrame([(3 * n, *(draw.randrange(41) for _ in "abc")) for n in range(1500)], FACES))


def test_large_meshes_are_repaired_as_small_ones(spark, monkeypatch):
    """Tables that are not broadcast give the same faces."""
    vertices, faces = flat_mesh(spark)
    small = sorted(mesh.repair_thin(vertices, faces).collect())
    monkeypatch.setattr(numbering, "AT_HAND", 0)
    assert mesh.thin_faces(vertices, faces).count() > 50 and sorted(mesh.repair_thin(vertices, faces).collect()) == small


def test_thin_faces_are_found_once_by_compiled_code(spark):
    """Java doesn't compile methods of 8000 bytes; and the result's plan has neither the vertices nor the search for thin faces."""
    vertices, faces = flat_mesh(spark)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        made = mesh.thin_faces(vertices, faces)._jdf.queryExecution().debug().codegenToSeq()
        assert max(made.apply(n)._3().maxMethodCodeSize() for n in range(made.size())) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    plan = mesh.repair_thin(vertices, faces)._jdf.queryExecution().optimizedPlan().toString()
    assert "SQRT" not in plan and plan.count("Join ") <= 3


@pytest.mark.parametrize("seed", [1])
def test_random_slivers(spark, seed):
    """A closed box whose sides are split at points on edges and next to them, again and again."""
    draw = random.Random(seed)
    points = [np.array([float(c >> b & 1) for b in range(3)]) for c in range(8)]
    faces = [(0, 2, 1), (1, 2, 3), (4, 5, 6), (5, 7, 6), (0, 1, 4), (1, 5, 4), (2, 6, 3), (3, 6, 7), (0, 4, 2), (2, 4, 6), (1, 3, 5), (3, 7, 5)]
    for _ in range(14):
        n = draw.randrange(len(faces))
        a, b, c = faces[n]
        t = draw.choice([0.5, 0.25, 0.001])
        points.append(points[a] * (1 - t) + points[b] * t)
        m = len(points) - 1
        if draw.random() < 0.5:  # a sliver: a-b-m, the face above split at m
            faces[n] = (a, m, c)
            faces += [(m, b, c), (a, b, m)]
        else:
            points[-1] = points[a] * 0.3 + points[b] * 0.3 + points[c] * 0.4
            faces[n] = (a, b, m)
            faces += [(b, c, m), (c, a, m)]
    vertices = spark.createDataFrame([(v, *map(float, p)) for v, p in enumerate(points)], VERTICES)
    given = spark.createDataFrame([(n, *f) for n, f in enumerate(faces)], FACES)
    assert mesh.thin_faces(vertices, given).count() > 2 and not balance(given.collect())
    made = mesh.repair(vertices, given)
    rows = made.collect()
    assert not balance(rows) and mesh.thin_faces(vertices, made).count() == 0 and len({r.elem_id for r in rows}) == len(rows)
    assert area(dict(enumerate(points)), rows) == pytest.approx(6.0)


def test_pairs_borders_and_empty(spark):
    vertices = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.4, 0.0, 0.0), (3, 0.6, 0.0, 0.0)], VERTICES)
    assert mesh.repair(vertices, spark.createDataFrame([(0, 0, 1, 2), (1, 1, 0, 3), (2, 1, 1, 2)], FACES)).count() == 0
    assert mesh.repair(vertices, spark.createDataFrame([], FACES)).count() == 0


def test_mapper_cleans_its_mesh(spark):
    """A layer's fill puts the surface a hair off the nodes; slivers and near vertices go, and shares stay whole."""
    size = 0.5 - 1e-10
    spec = GridSpec((0.0,) * 3, (8.0,) * 3, (8,) * 3, size, (2.25, 2.25, 2.25), False)
    rows = spark.range(8**3).select(F.col("id").alias("oid"), *((2.25 + (F.floor(F.col("id") / 8**a) % 8) * size).alias("xyz"[a]) for a in range(3)))
    made = SurfaceMapper(spec).run(rows, check=False)
    assert mesh.near_pairs(made.vertices, 1e-7 * size).count() == 0 and mesh.thin_faces(made.vertices, made.lines).count() == 0
    faces = [r for r in made.lines.collect()]
    assert faces and not balance(faces)
    total = made.weights.groupBy("elem_id").agg(F.sum("frac").alias("s"))
    assert total.where("abs(s - 1) > 1e-9").count() == 0
    raw = SurfaceMapper(spec, clean=False).run(rows, check=False)
    assert made.elements.agg(F.sum("area")).first()[0] == pytest.approx(raw.elements.agg(F.sum("area")).first()[0], rel=1e-6)


@pytest.mark.parametrize("axes", [("i", "j"), ("i", "j", "k")])
def test_depth_near_the_surface_is_the_dense_one(spark, axes):
    draw = random.Random(len(axes))
    solid = {tuple(draw.randint(0, 11) for _ in axes) for _ in range(900 if len(axes) == 3 else 70)} | {p for p in np.ndindex(*(9,) * len(axes)) if sum(p) < 14}
    spec = GridSpec((0.0,) * len(axes), (40.0,) * len(axes), (20,) * len(axes), 1.0)
    table = spark.createDataFrame([tuple(map(int, p)) for p in solid], ", ".join(f"{a} int" for a in axes))
    dense = {tuple(r[a] for a in axes): r.depth for r in lattice.depth(lattice.padded(table, spec), axes).collect()}
    for reach in (1, 4):
        shell = {tuple(r[a] for a in axes): (r.solid, r.depth) for r in lattice.shell_depth(table, axes, reach).collect()}
        assert {p for p, (s, _) in shell.items() if s} == solid
        assert all(d == min(dense[p], reach) for p, (_, d) in shell.items())
        assert {p for p, d in dense.items() if -reach <= d < 0} == {p for p, (s, _) in shell.items() if not s}
    assert lattice.shell_depth(table.limit(0), axes, 2).count() == 0


def test_quantiles_of_one_large_group(spark):
    rows = spark.range(50_000).select(F.when(F.col("id") < 45_000, "hot").when(F.col("id") < 49_990, F.concat(F.lit("g"), F.col("id") % 50)).alias("g"), F.when(F.col("id") % 13 > 0, F.xxhash64("id") % 1000).alias("v"))
    shares = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    got = {r.g: tuple(r)[1:] for r in quantiles(rows, ["g"], "v", shares).collect()}
    want = {r.g: tuple(r)[1:] for r in rows.groupBy("g").agg(*(F.percentile("v", p).alias(n) for n, p in shares.items())).collect()}
    assert got.keys() == want.keys() and None in got
    assert all(a == pytest.approx(want[g]) for g, a in got.items())
    assert tuple(quantiles(rows, [], "v", shares).first()) == pytest.approx(tuple(rows.agg(*(F.percentile("v", p) for p in shares.values())).first()))
    assert quantiles(rows.where("v is null"), ["g"], "v", shares).count() == 0


def test_sums_so_far(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 2500, 1).otherwise(2).alias("g"), F.xxhash64("id").alias("t"), (F.col("id") % 7).alias("v"))
    got = accumulated(rows, ["g"], ["t"], "v", "s").collect()
    total = {}
    for r in sorted(got, key=lambda r: (r.g, r.t)):
        total[r.g] = total.get(r.g, 0) + r.v
        assert r.s == total[r.g]
    assert len(got) == 3000
