"""Analytic cases of the voxel-surface mapping in two and three dimensions."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from voxmill.operators import cubes, flux, lattice, nodes, squares
from voxmill.operators.pipeline import SurfaceMapper
from voxmill.spec import GridError, GridSpec, decode, encode


def block(spark, n, size, ndims, low):
    """A regular block of n**ndims voxels, oid in z-outer order."""
    rows = spark.range(n**ndims)
    return rows.select(F.col("id").alias("oid"), *((low + size / 2 + (F.floor(F.col("id") / n**a) % n) * size).alias("xyz"[a]) for a in range(ndims)))


def spec_for(ndims, half, ncells, size, low, weighted):
    return GridSpec((-half,) * ndims, (half,) * ndims, (ncells,) * ndims, size, (low + size / 2,) * ndims, weighted)


@pytest.mark.parametrize("ndims", [2, 3])
def test_node_fractions_of_a_block(spark, ndims):
    size = 2 / 3
    spec = spec_for(ndims, 5.0, 10, size, -4 * size, True)
    got = SurfaceMapper(spec).run(block(spark, 8, size, ndims, -4 * size), check=False).fractions
    axis = {r.ni: r.frac for r in got.where(" and ".join(f"{n} = 5" for n in spec.node_axes[1:])).collect()}
    for step, want in enumerate([1, 140 / 144, 13 / 18, 7 / 18, 1 / 12, 0]):
        assert axis.get(5 + step, 0.0) == pytest.approx(want, abs=1e-6)
        assert axis.get(5 - step, 0.0) == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("ndims", [2, 3])
def test_smallest_surface(spark, ndims):
    edge = 0.75 ** (1 / ndims) * 1e-6
    spec = spec_for(ndims, 2e-6, 4, edge / 2, -edge / 2, False)
    surface = SurfaceMapper(spec, digits=12).run(block(spark, 2, edge / 2, ndims, -edge / 2))
    points = {tuple(round(v * 3e6, 6) + 0.0 for v in r[1:]) for r in surface.vertices.collect()}
    assert points == {tuple(float(s) if a == b else 0.0 for b in range(ndims)) for a in range(ndims) for s in (-1, 1)}
    assert surface.lines.count() == 2**ndims
    if ndims == 3:
        assert SurfaceMapper(spec).area(surface).first().volume == pytest.approx(4 / 3 * (1e-6 / 3) ** 3)


@pytest.mark.parametrize("ndims", [2, 3])
def test_flux_association(spark, ndims):
    """Interior voxels of a face get the element's value times the ratio of areas."""
    size = 1.32e-6 / 26
    spec = spec_for(ndims, 1e-6, 20, size, -0.66e-6, True)
    voxels = block(spark, 26, size, ndims, -0.66e-6)
    mapper = SurfaceMapper(spec)
    surface = mapper.run(voxels)
    planes = [F.col(f"n{'xyz'[a]}") * s for a in range(ndims) for s in (-1, 1)]
    scalar = F.lit(0.0)
    for p, n in enumerate(planes):
        scalar = F.when(F.abs(n - 1) < 1e-6, (p + 1) * 1e-2).otherwise(scalar)
    scalars = surface.elements.select("elem_id", scalar.alias("scalar")).cache()
    shares = surface.weights.cache()
    value = flux.apply_flux(shares, scalars)
    at = {r.oid: r.value for r in value.collect()}
    cell = 0.1e-6
    per = size**2 / (cell**2 / 2) if ndims == 3 else size / cell
    checked = 0
    for p in range(2 * ndims):
        axis, sign = p // 2, (-1, 1)[p % 2]
        inside = [a for a in range(ndims) if a != axis]
        for r in voxels.where(F.lit(sign) * F.col("xyz"[axis]) > 12 * size).collect():
            if all(abs(r["xyz"[a]]) < 13 * size / 4 for a in inside):
                want = (p + 1) * 1e-2 * per
                assert at[r.oid] == pytest.approx(want, rel=2e-6)
                checked += 1
    assert checked == 2 * ndims * 6 ** (ndims - 1)
    total = flux.conservation(scalars, shares, value).first()
    assert total.n_uncovered == 0 and abs(total.error_percent) < 1e-9
    sums = shares.groupBy("elem_id").agg(F.sum("frac").alias("s"), F.count("*").alias("n"), F.count_distinct("oid").alias("d")).agg(F.max(F.abs(F.col("s") - 1)).alias("off"), F.sum(F.col("n") - F.col("d")).alias("twice")).first()
    assert sums.off < 1e-12 and sums.twice == 0


def test_surface_is_closed(spark):
    """Directed edges of the mesh are balanced by their reverses, on noise with many ambiguous faces."""
    spec = GridSpec((0.0,) * 3, (9.0,) * 3, (9,) * 3)
    noise = spark.range(8**3).select(*((F.floor(F.col("id") / 8**a) % 8 + 1).cast("int").alias(n) for a, n in enumerate(("ni", "nj", "nk"))), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("frac"))
    for classic in (False, True):
        _, faces = cubes.indexed(cubes.triangles(cubes.cells(noise), spec, classic=classic))
        sides = None
        for a, b in ("ab", "bc", "ca"):
            part = faces.select(F.col(a).alias("p"), F.col(b).alias("q"))
            sides = part if sides is None else sides.unionByName(part)
        key = F.struct(F.least("p", "q"), F.greatest("p", "q"))
        off = sides.groupBy(key).agg(F.sum(F.when(F.col("p") < F.col("q"), 1).otherwise(-1)).alias("s")).where("s <> 0").count()
        assert off == 0 and faces.count() > 500


def test_depth_is_rook_distance(spark):
    n = 9
    solid = {(i, j) for i, j in itertools.product(range(n), repeat=2) if (i * 7 + j * 13 + i * j) % 5 < 3 and 0 < i < n - 1 and 0 < j < n - 1}
    rows = spark.createDataFrame([(i, j, (i, j) in solid) for i, j in itertools.product(range(n), repeat=2)], "i int, j int, solid boolean")
    void = set(itertools.product(range(n), repeat=2)) - solid
    near = lambda p, others: min(abs(p[0] - q[0]) + abs(p[1] - q[1]) for q in others)
    for r in lattice.depth(rows, ("i", "j")).collect():
        p = (r.i, r.j)
        assert r.depth == (near(p, void) - 1 if p in solid else -near(p, solid))


def test_squares_close(spark):
    noise = spark.range(100).select(*((F.floor(F.col("id") / 10**a) % 10 + 1).cast("int").alias(n) for a, n in enumerate(("ni", "nj"))), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("frac"))
    spec = GridSpec((0.0, 0.0), (12.0, 12.0), (12, 12))
    vertices, lines = squares.indexed(squares.segments(squares.cells(noise), spec))
    ends = lines.select(F.col("a").alias("v"), F.lit(1).alias("s")).unionByName(lines.select(F.col("b").alias("v"), F.lit(-1).alias("s")))
    assert ends.groupBy("v").agg(F.sum("s").alias("s"), F.count("*").alias("n")).where("s <> 0 or n <> 2").count() == 0
    assert vertices.agg(F.max("vid")).first()[0] == vertices.count() - 1


def test_collisions_keep_the_last_row(spark):
    spec = GridSpec((0.0, 0.0), (10.0, 10.0), (5, 5))
    rows = spark.createDataFrame([(0, 1.0, 1.0), (1, 1.2, 0.9), (2, 3.0, 1.0)], "oid long, x double, y double")
    got = {(r.i, r.j): (r.oid, r.n_input) for r in lattice.collapse(lattice.snap(rows, spec), ("i", "j")).collect()}
    assert got == {(1, 1): (1, 2), (3, 1): (2, 1)}


@pytest.mark.parametrize(
    "bad",
    [
        dict(lo=(0.0, 0.0), hi=(-1.0, 1.0), ncells=(4, 4)),
        dict(lo=(0.0,), hi=(1.0, 1.0), ncells=(4, 4)),
        dict(lo=(0.0, 0.0), hi=(1.0, 1.0), ncells=(4.0, 4)),
        dict(lo=(0.0, 0.0), hi=(1.0, 1.0), ncells=(4, 4), voxel_size=0.5),
        dict(lo=(0.0, 0.0), hi=(1.0, 1.0), ncells=(4, 4), voxel_size=0.0),
        dict(lo=(0.0,), hi=(1.0,), ncells=(4,)),
    ],
)
def test_bad_grids(bad):
    with pytest.raises(GridError):
        GridSpec(**{"voxel_size": 0.1} | bad)


def test_voxels_in_the_margin(spark):
    spec = GridSpec((0.0, 0.0), (10.0, 10.0), (10, 10))
    with pytest.raises(GridError):
        spec.check(spark.createDataFrame([(1, 5)], "i int, j int"))
    spec.check(spark.createDataFrame([], "i int, j int"))


def test_codec(spark):
    dims = (5, 4, 3)
    rows = spark.range(60).withColumns(dict(zip(("i", "j", "k"), decode(F.col("id"), dims), strict=True)))
    assert rows.where(encode([F.col("i"), F.col("j"), F.col("k")], dims) != F.col("id")).count() == 0
    assert rows.where("i not between 0 and 4 or j not between 0 and 3 or k not between 0 and 2").count() == 0


def test_overlap_areas():
    import numpy as np

    def clip(poly, a, b):
        out = []
        side = lambda p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
        for p, q in zip(poly, poly[1:] + poly[:1], strict=True):
            if side(p) >= 0:
                out.append(p)
            if side(p) * side(q) < 0:
                t = side(p) / (side(p) - side(q))
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        return out

    rng = np.random.default_rng(3)
    quads, triangles, want = [], [], []
    for n in range(600):
        lo = rng.integers(-3, 3, 2) if n % 2 else rng.normal(size=2)
        w = rng.integers(1, 4, 2) if n % 2 else rng.random(2) + 0.1
        quad = [(lo[0], lo[1]), (lo[0] + w[0], lo[1]), (lo[0] + w[0], lo[1] + w[1]), (lo[0], lo[1] + w[1])]
        tri = [tuple(p) for p in (rng.integers(-3, 4, (3, 2)) if n % 2 else rng.normal(size=(3, 2)))]
        turn = (tri[1][0] - tri[0][0]) * (tri[2][1] - tri[0][1]) - (tri[1][1] - tri[0][1]) * (tri[2][0] - tri[0][0])
        tri = tri if turn >= 0 else tri[::-1]
        poly = quad
        for a, b in zip(tri, tri[1:] + tri[:1], strict=True):
            poly = clip(poly, a, b) if poly else poly
        area = sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(poly, poly[1:] + poly[:1], strict=True)) / 2 if len(poly) > 2 and turn else 0.0
        z = float(rng.normal())
        quads.append([(x, y, z) for x, y in quad])
        triangles.append([(x, y, 0.0) for x, y in tri])
        want.append(area)
    got = flux.overlap_areas(np.array(quads, float), np.array(triangles, float))
    assert np.abs(got - np.array(want)).max() < 1e-9
    one = flux.overlap_areas(np.array([[(0, 0, 0), (2, 0, 0), (2, 2, 0), (0, 2, 0)]], float), np.array([[(0, 0, 0), (1, 0, 0), (0, 1, 0)]], float))
    assert one[0] == pytest.approx(0.5)


def test_complete_nodes(spark):
    spec = GridSpec((0.0, 0.0), (4.0, 4.0), (4, 4))
    one = spark.createDataFrame([(2, 2, 1.0)], "i int, j int, weight double")
    rows = nodes.node_fractions(one, spec, complete=True)
    assert rows.count() == 25 and rows.agg(F.sum("frac")).first()[0] == pytest.approx(1.0)
    assert math.isclose(nodes.fill_total(rows).first().cells_filled, 1.0)


def test_iso_surface_in_one_call(spark):
    """A ball: normals point outward, faces close, each vertex has a value; the level must be met."""
    spec = GridSpec((0.0, 0.0, 0.0), (10.0, 10.0, 10.0), (10, 10, 10))
    axis = lambda n: spark.range(11).select(F.col("id").cast("int").alias(n))
    away = F.sqrt((F.col("ni") - 5.1) ** 2 + (F.col("nj") - 5.2) ** 2 + (F.col("nk") - 4.9) ** 2)
    values = axis("ni").crossJoin(axis("nj")).crossJoin(axis("nk")).withColumn("frac", F.greatest(F.lit(0.0), 1 - away / 6))
    vertices, faces = cubes.iso_surface(values, spec, 0.5)
    v, f = {r.vid: r for r in vertices.collect()}, faces.collect()
    assert len(v) - len(f) * 3 // 2 + len(f) == 2 and {x for t in f for x in (t.a, t.b, t.c)} == set(v)
    for r in v.values():
        assert (r.x - 5.1) * r.nx + (r.y - 5.2) * r.ny + (r.z - 4.9) * r.nz > 2.5 and 0 < r.value <= 1
    with pytest.raises(GridError):
        cubes.iso_surface(values, spec, 2.0)
    import voxmill

    assert voxmill.GridSpec is GridSpec and voxmill.SurfaceMapper.__name__ == "SurfaceMapper"


def test_gradient_normals_of_a_ball(spark):
    """Normals from smooth node values point away from the centre, also where the surface meets nodes exactly."""
    spec = GridSpec((-4.0,) * 3, (4.0,) * 3, (8,) * 3)
    at = [(F.floor(F.col("id") / 9**a) % 9).cast("int") for a in range(3)]
    away = F.sqrt(sum(((c - 4) * (c - 4) for c in at[1:]), (at[0] - 4) * (at[0] - 4)))
    fractions = spark.range(9**3).select(*(c.alias(n) for c, n in zip(at, ("ni", "nj", "nk"), strict=True)), (1 / (1 + F.exp(away - 3))).alias("frac"))
    vertices, faces = cubes.iso_surface(fractions, spec, 0.5, gradients=True)
    rows = vertices.collect()
    assert rows and faces.count() > 0
    for r in rows:
        assert (r.x * r.nx + r.y * r.ny + r.z * r.nz) / math.hypot(r.x, r.y, r.z) > 0.97


def test_split_at_cell_centres(spark):
    spec = GridSpec((0.0, 0.0), (8.0, 8.0), (4, 4))
    at = lambda *voxels: {(r.ni, r.nj): (round(r.frac, 6), r.inside) for r in nodes.centre_fractions(spark.createDataFrame(voxels, "i int, j int, weight double"), spec, 0.1).collect()}
    assert at((3, 3, 1.0)) == {(1, 1): (0.0625, False), (2, 1): (0.0625, False), (1, 2): (0.0625, False), (2, 2): (0.0625, False)}
    assert at((2, 3, 1.0)) == {(1, 1): (0.125, True), (1, 2): (0.125, True)}
    assert at((3, 3, 0.0)) == {} == at((9, 9, 1.0))
