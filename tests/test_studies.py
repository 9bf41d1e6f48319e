"""Mesh repair, ablation, validation shapes and plane geometry on small inputs."""

import math

import pytest
from pyspark.sql import functions as F

from voxmill.functions import geometry as g
from voxmill.operators import ablation, mesh, squares, validation
from voxmill.operators.pipeline import SurfaceMapper
from voxmill.sources import dumps, sinks
from voxmill.spec import GridSpec

VERTICES = "vid long, x double, y double, z double"
FACES = "elem_id long, a long, b long, c long"


def test_merging_vertices(spark):
    vertices = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0), (3, 1e-9, 0.0, 0.0), (4, 1.5e-9, 0.0, 0.0), (5, 9.0, 9.0, 9.0)], VERTICES)
    faces = spark.createDataFrame([(0, 0, 1, 2), (1, 4, 2, 1), (2, 0, 3, 1)], FACES)
    v, f = mesh.merge_vertices(vertices, faces, 1e-9)
    assert v.count() == 3 and sorted((r.elem_id, r.a, r.b, r.c) for r in f.collect()) == [(0, 0, 1, 2), (1, 0, 2, 1)]


def test_exact_degenerates(spark):
    vertices = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 0.0, 0.0), (3, 0.0, 1.0, 0.0)], VERTICES)
    v, f = mesh.remove_degenerate(vertices, spark.createDataFrame([(0, 0, 1, 2), (1, 2, 1, 3)], FACES))
    assert [(r.vid, r.x, r.y) for r in v.orderBy("vid").collect()] == [(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 0.0, 1.0)]
    assert [(r.elem_id, r.a, r.b, r.c) for r in f.collect()] == [(1, 0, 1, 2)]


def balanced(faces):
    sides = {}
    for r in faces.collect():
        for p, q in ((r.a, r.b), (r.b, r.c), (r.c, r.a)):
            sides[(p, q)] = sides.get((p, q), 0) + 1
            sides[(q, p)] = sides.get((q, p), 0) - 1
    return {e for e, n in sides.items() if n}


def test_thin_faces_are_repaired(spark):
    vertices = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 2.0, 0.0, 0.0), (2, 1.0, 1.0, 0.0), (3, 1.0, 1e-12, 0.0), (4, 1.0, -1.0, 0.0)], VERTICES)
    faces = spark.createDataFrame([(0, 1, 0, 4), (1, 0, 1, 3), (2, 0, 3, 2), (3, 3, 1, 2)], FACES)
    border = balanced(faces)
    assert [r.elem_id for r in mesh.thin_faces(vertices, faces).collect()] == [1]
    fixed = mesh.repair_thin(vertices, faces)
    assert balanced(fixed) == border and fixed.count() == 4 and mesh.thin_faces(vertices, fixed).count() == 0
    assert mesh.area(vertices, fixed).first().area == pytest.approx(2.0)
    pair = spark.createDataFrame([(0, 0, 1, 3), (1, 1, 0, 3)], FACES)
    assert mesh.repair_thin(vertices, pair).count() == 0


def test_components(spark):
    nodes = spark.range(12).withColumnRenamed("id", "node")
    edges = spark.createDataFrame([(n, n + 1) for n in range(7)] + [(10, 9), (3, 3)], "a long, b long")
    assert {r.node: r.root for r in mesh.components(nodes, edges).collect()} == {**dict.fromkeys(range(8), 0), 8: 8, 9: 9, 10: 9, 11: 11}


def test_plane_geometry(spark):
    row = spark.range(1).select(*(F.struct(*(F.lit(float(v)).alias(x) for v, x in zip(p, "xyz", strict=True))).alias(n) for n, p in {"p": (1, 1, 1), "q": (-1, -1, -1), "n": (0, 0, 1), "o": (0, 0, 0)}.items()))
    v = lambda n: g.vector(f"{n}.x", f"{n}.y", f"{n}.z")
    inner, outer, at = g.clip_to_plane(v("p"), v("q"), v("n"), v("o"), 1e-6)
    got = row.select(inner.alias("p"), outer.alias("q"), *(c.alias(f"c{i}") for i, c in enumerate(at)), g.triangle_area(v("p"), v("q"), v("n")).alias("area")).first()
    assert tuple(got)[:5] == (False, True, 0.0, 0.0, 0.0) and got.area == pytest.approx(math.sqrt(2))
    point = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    square = row.select(g.shoelace(F.array(point(0, 0), point(1, 0), point(1, 1), point(0, 1))).alias("s"), g.shoelace(F.array(point(0, 1), point(0, 0), point(1, 0))).alias("t"), g.shoelace(F.array(point(0, 0), point(1, 0))).alias("u")).first()
    assert tuple(square) == (1.0, 0.5, 0.0)


def test_polygon_study(spark):
    """Voxels of a disc-like polygon: the boundary found comes close to it, and nothing of the flux is lost."""
    sides = validation.regular_polygon(spark, 30, 2.0)
    exact = validation.polygon_measures(sides).first()
    assert exact.perimeter == pytest.approx(30 * 4 * math.sin(math.pi / 30)) and exact.area == pytest.approx(15 * 4 * math.sin(2 * math.pi / 30))
    size = 0.1
    spec = GridSpec((-3.0, -3.0), (3.0, 3.0), (30, 30), size, (-3 + size / 2, -3 + size / 2))
    grid = spark.range(3600).select(F.col("id").alias("oid"), (F.col("id") % 60 * size - 3 + size / 2).alias("x"), (F.floor(F.col("id") / 60) * size - 3 + size / 2).alias("y"))
    voxels = validation.inside_polygon(grid, sides).cache()
    assert voxels.count() * size**2 == pytest.approx(exact.area, rel=0.02)
    surface = SurfaceMapper(spec, digits=9).run(voxels)
    assert squares.perimeter(surface.elements).first().perimeter == pytest.approx(exact.perimeter, rel=0.03)
    points = surface.elements.select(F.col("elem_id").alias("pid"), F.col("ax").alias("x"), F.col("ay").alias("y"))
    away = validation.nearest_element(points, squares.attributes(sides).withColumn("elem_id", F.col("side_id").cast("long")), 0.5)
    assert away.count() == points.count() and away.agg(F.max(F.abs("distance"))).first()[0] < size
    assert validation.distribution(away, "distance").first().highest < size


def test_nearest_element_far_away(spark):
    sides = squares.attributes(validation.regular_polygon(spark, 4, 1.0)).withColumn("elem_id", F.col("side_id").cast("long"))
    points = spark.createDataFrame([(0, 500.0, 1.0), (1, 0.0, 0.0)], "pid long, x double, y double")
    got = {r.pid: r.distance for r in validation.nearest_element(points, sides, 0.01).collect()}
    assert got[0] == pytest.approx(math.hypot(499, 1)) and got[1] == pytest.approx(-math.sqrt(0.5))


def test_ablation(spark):
    state = spark.createDataFrame([(0, 0.0, "Fiber"), (1, 0.5, "Fiber"), (2, 0.9, "Matrix")], "oid long, removed double, phase string")
    got = spark.createDataFrame([(1, 0.6), (2, 0.06)], "oid long, value double")
    assert {r.oid: (round(r.removed, 6), r.alive) for r in ablation.ablate(state, got, 1.0).collect()} == {0: (0.0, True), 1: (1.1, False), 2: (0.96, True)}
    by_phase = ablation.ablate_phases(state, got, {"Matrix": 2.0}, 1.0)
    assert {r.oid: (round(r.removed, 6), r.alive) for r in by_phase.collect()} == {0: (0.0, True), 1: (1.1, False), 2: (0.96, False)}
    assert {r.oid: round(r.removed, 6) for r in ablation.ablate_phases(state, got, {"Matrix": 2.0}, 1.0, compound=True).collect()}[2] == 1.92
    steps = ablation.run_steps(state, lambda alive, n: ablation.ablate(alive.drop("alive"), got, 1.0), 3)
    assert [r.n_alive for r in ablation.remaining(steps).orderBy("step").collect()] == [3, 2, 1, 1]


def test_spillover_keeps_the_total(spark):
    state = spark.createDataFrame([(i, j, 3.0 if (i, j) == (2, 2) else 0.25, 0 if i in (1, 3) else 1 if i == 2 else 2) for i in range(5) for j in range(5)], "i int, j int, removed double, depth int")
    out = ablation.spill(state, capacity=1.0)
    assert out.agg(F.sum("removed")).first()[0] == pytest.approx(state.agg(F.sum("removed")).first()[0])
    got = {(r.i, r.j): r.removed for r in out.collect()}
    assert got[(2, 2)] == 1.0 and got[(1, 1)] == pytest.approx(0.5) and got[(0, 0)] == 0.25
    alone = spark.createDataFrame([(0, 0, 5.0, 0)], "i int, j int, removed double, depth int")
    assert ablation.spill(alone).first().removed == 5.0


def test_small_files(spark, tmp_path):
    sinks.write_volume_fraction(spark.createDataFrame([(0.5,), (1.0,)], "frac double"), 4, str(tmp_path / "f"))
    assert spark.read.text(str(tmp_path / "f")).first().value == "0.375"
    state = spark.createDataFrame([(0, 1.0, 2.0, 3.0, 0.5, "Fiber")], "oid long, x double, y double, z double, removed double, phase string")
    sinks.write_state(state, str(tmp_path / "s"))
    assert tuple(dumps.read_state(spark, str(tmp_path / "s")).first()) == (1.0, 2.0, 3.0, 0.5)
    sinks.write_phases(state, str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "p")).first().phase == "Fiber"
    outputs = spark.createDataFrame([("b", 1), ("a", 1), ("c", 2)], "path string, timestep int")
    assert dumps.file_for_step(outputs, 1) == "a"
    with pytest.raises(dumps.DumpError):
        dumps.file_for_step(outputs, 3)


def test_wear_spills_below(spark):
    state = spark.createDataFrame([(0, 0, 1, 0, 0.5), (1, 1, 1, 0, 1.0), (2, 0, 0, 1, 1.0), (3, 1, 0, 1, 0.05), (4, 5, 5, 0, 0.5)], "oid long, i int, j int, depth int, integrity double")
    got = {r.oid: (round(r.integrity, 6), r.alive, round(r.taken, 6)) for r in ablation.wear(state, spark.createDataFrame([(0, 2.8), (1, 1.0), (4, 9.0)], "oid long, value double"), 4.0).collect()}
    assert got == {0: (0.0, False, 2.0), 1: (0.75, True, 1.0), 2: (0.9, True, 0.4), 3: (0.0, False, 0.2), 4: (0.0, False, 2.0)}


def test_remaining_curve(spark):
    curve = spark.createDataFrame([(0, 200.0), (1, 50.0), (3, 0.0)], "step int, left double")
    got = {r.step: (r.share, round(r.exact, 6)) for r in ablation.remaining_curve(curve, 2.0, 1.0).collect()}
    assert got == {0: (1.0, 1.0), 1: (0.25, 0.25), 3: (0.0, -0.25)}
    assert ablation.remaining_curve(curve.limit(0), 2.0, 1.0).count() == 0
