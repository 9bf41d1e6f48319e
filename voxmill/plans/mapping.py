"""Queries of the voxel-surface mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbering import numbered
from ..operators import cubes, flux, lattice, nodes, squares
from ..operators.pipeline import SurfaceMapper
from ..spec import decode, encode
from .lattices import PLANE, SPACE, oracle, plane_points, space_points
from .registry import register


def r6(c: str | Column) -> Column:
    """Six digits, no negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def plane_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.collapse(lattice.snap(plane_points(spark, sf_dir), PLANE), PLANE.voxel_axes)


def space_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.collapse(lattice.snap(space_points(spark, sf_dir), SPACE), SPACE.voxel_axes)


def plane_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.node_fractions(SurfaceMapper(PLANE).weighted(plane_voxels(spark, sf_dir)), PLANE)


def space_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.node_fractions(SurfaceMapper(SPACE).weighted(space_voxels(spark, sf_dir)), SPACE)


def plane_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SurfaceMapper(PLANE, digits=9).elements(plane_nodes(spark, sf_dir))


def plane_pairs(spark: SparkSession, sf_dir: str, elements: DataFrame | None = None) -> DataFrame:
    elements = plane_elements(spark, sf_dir) if elements is None else elements
    return flux.candidates(elements, flux.surface_faces(plane_voxels(spark, sf_dir), PLANE), PLANE)


def plane_weights(spark: SparkSession, sf_dir: str, elements: DataFrame | None = None) -> DataFrame:
    return flux.weights(flux.overlaps_2d(plane_pairs(spark, sf_dir, elements)))


def plane_scalars(elements: DataFrame) -> DataFrame:
    return elements.select("elem_id", (F.lit(2.0) + F.cos("theta")).alias("scalar"))


def plane_received(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each voxel gets: the elements are made once, for their shares and their scalars."""
    elements = plane_elements(spark, sf_dir)
    return flux.apply_flux(plane_weights(spark, sf_dir, elements), plane_scalars(elements))


@register("lattice_snap_2d", oracle(2, "SELECT i, j, n_input FROM vox"))
def _(spark, sf_dir):
    return plane_voxels(spark, sf_dir).select("i", "j", "n_input")


@register("lattice_snap_3d", oracle(3, "SELECT i, j, k, n_input FROM vox"))
def _(spark, sf_dir):
    return space_voxels(spark, sf_dir).select("i", "j", "k", "n_input")


@register("lattice_collision", oracle(2, "SELECT i, j, oid, n_input FROM vox WHERE n_input > 1"))
def _(spark, sf_dir):
    return plane_voxels(spark, sf_dir).where("n_input > 1").select("i", "j", "oid", "n_input")


@register("index_codec", oracle(3, "SELECT CAST(k * 660 + j * 60 + i AS BIGINT) AS flat, i, j, k FROM vox"))
def _(spark, sf_dir):
    dims = (60, 11, 9)
    flat = space_voxels(spark, sf_dir).select(encode([F.col(a) for a in "ijk"], dims).alias("flat"))
    return flat.select("flat", *(c.alias(a) for c, a in zip(decode(F.col("flat"), dims), "ijk", strict=True)))


@register("bbox_padding", oracle(3, "SELECT lo_i, hi_i, lo_j, hi_j, lo_k, hi_k FROM box"))
def _(spark, sf_dir):
    pad = SPACE.padding
    return space_voxels(spark, sf_dir).agg(*(f.alias(f"{n}_{a}") for a in "ijk" for n, f in (("lo", F.min(a) - pad), ("hi", F.max(a) + pad))))


@register("depth_2d", oracle(2, "SELECT i, j, solid, depth FROM dep"))
def _(spark, sf_dir):
    return lattice.depth(lattice.padded(plane_voxels(spark, sf_dir), PLANE), PLANE.voxel_axes).select("i", "j", "solid", "depth")


@register("depth_solid", oracle(3, "SELECT i, j, k, depth FROM dep WHERE solid"))
def _(spark, sf_dir):
    return lattice.depth(lattice.padded(space_voxels(spark, sf_dir), SPACE), SPACE.voxel_axes).where("solid").select("i", "j", "k", "depth")


@register("depth_ghost", oracle(3, "SELECT depth, count(*) AS n FROM dep WHERE NOT solid GROUP BY depth"))
def _(spark, sf_dir):
    return lattice.depth(lattice.padded(space_voxels(spark, sf_dir), SPACE), SPACE.voxel_axes).where("not solid").groupBy("depth").agg(F.count("*").alias("n"))


@register("depth_shell_3d", oracle(3, f"SELECT i, j, k, solid, depth FROM dep WHERE depth BETWEEN -{SPACE.reach} AND {SPACE.reach}"))
def _(spark, sf_dir):
    """Depths of the voxels and positions that can weigh anything but 0 or 1, without a dense lattice."""
    shell = lattice.shell_depth(space_voxels(spark, sf_dir), SPACE.voxel_axes, SPACE.reach + 1)
    return shell.where(F.abs("depth") <= SPACE.reach)


@register("exposed_faces", oracle(3, "SELECT i, j, k, face FROM exp"))
def _(spark, sf_dir):
    return lattice.exposed_faces(space_voxels(spark, sf_dir), SPACE.voxel_axes).select("i", "j", "k", "face")


@register("surface_voxels", oracle(3, "SELECT row_number() OVER (ORDER BY k, j, i) - 1 AS surface_id, i, j, k, n_faces FROM (SELECT i, j, k, count(*) AS n_faces FROM exp GROUP BY i, j, k)"))
def _(spark, sf_dir):
    rows = lattice.exposed_faces(space_voxels(spark, sf_dir), SPACE.voxel_axes).groupBy("i", "j", "k").agg(F.count("*").alias("n_faces"))
    return numbered(rows, ["k", "j", "i"], "surface_id").select("surface_id", "i", "j", "k", "n_faces")


@register("voxel_weights", oracle(2, "SELECT i, j, depth, round(weight, 6) AS weight FROM wei WHERE weight > 0"))
def _(spark, sf_dir):
    return SurfaceMapper(PLANE).weighted(plane_voxels(spark, sf_dir)).where("weight > 0").select("i", "j", "depth", r6("weight").alias("weight"))


@register("node_fraction_2d", oracle(2, "SELECT ni, nj, round(frac, 10) + 0e0 AS frac FROM nod"))
def _(spark, sf_dir):
    return plane_nodes(spark, sf_dir).select("ni", "nj", (F.round("frac", 10) + F.lit(0.0)).alias("frac"))


@register("node_fraction_3d", oracle(3, "SELECT ni, nj, nk, round(frac, 10) + 0e0 AS frac FROM nod"))
def _(spark, sf_dir):
    return space_nodes(spark, sf_dir).select("ni", "nj", "nk", (F.round("frac", 10) + F.lit(0.0)).alias("frac"))


@register("node_inside", oracle(3, "SELECT round(frac, 9) >= 0.5e0 AS inside, count(*) AS n FROM nod GROUP BY 1"))
def _(spark, sf_dir):
    return space_nodes(spark, sf_dir).groupBy((F.round("frac", 9) >= 0.5).alias("inside")).agg(F.count("*").alias("n"))


@register("cell_topology_2d", oracle(2, "SELECT ci, cj, topology FROM top"))
def _(spark, sf_dir):
    return squares.within(squares.cells(plane_nodes(spark, sf_dir), digits=9), PLANE).select("ci", "cj", "topology")


@register("segments_2d", oracle(2, "SELECT elem_id, ci, cj, round(ax, 6) + 0e0 AS ax, round(ay, 6) + 0e0 AS ay, round(bx, 6) + 0e0 AS bx, round(by_, 6) + 0e0 AS by_ FROM ele"))
def _(spark, sf_dir):
    return plane_elements(spark, sf_dir).select("elem_id", "ci", "cj", r6("ax").alias("ax"), r6("ay").alias("ay"), r6("bx").alias("bx"), r6("by").alias("by_"))


@register("vertices_2d_dedup", oracle(2, "SELECT DISTINCT round(x, 6) + 0e0 AS x, round(y, 6) + 0e0 AS y FROM (SELECT ax AS x, ay AS y FROM seg UNION ALL SELECT bx, by_ FROM seg)"))
def _(spark, sf_dir):
    vertices, _ = squares.indexed(plane_elements(spark, sf_dir).drop("elem_id"))
    return vertices.select(r6("x").alias("x"), r6("y").alias("y")).distinct()


@register("perimeter_2d", oracle(2, "SELECT round(sum(length), 6) AS perimeter, count(*) AS n_segments FROM ele"))
def _(spark, sf_dir):
    return squares.perimeter(plane_elements(spark, sf_dir)).select(r6("perimeter").alias("perimeter"), "n_segments")


@register("segment_attributes_2d", oracle(2, "SELECT elem_id, round(length, 6) AS length, round((by_ - ay) / length, 6) + 0e0 AS nx, round((ax - bx) / length, 6) + 0e0 AS ny FROM ele"))
def _(spark, sf_dir):
    return plane_elements(spark, sf_dir).select("elem_id", r6("length").alias("length"), r6("nx").alias("nx"), r6("ny").alias("ny"))


@register("cube_index_3d", oracle(3, "SELECT ci, cj, ck, cube_index FROM cub"))
def _(spark, sf_dir):
    return cubes.cells(space_nodes(spark, sf_dir), digits=9).select("ci", "cj", "ck", "cube_index")


_EDGES = " UNION ALL ".join(
    f"SELECT ci + {a & 1} AS ni, cj + {a >> 1 & 1} AS nj, ck + {a >> 2} AS nk, {(b - a).bit_length() - 1} AS axis, (0.5e0 - v{a}) / (v{b} - v{a}) AS t FROM cub WHERE (v{a} > 0.5e0) <> (v{b} > 0.5e0)" for a, b in cubes.EDGES
)


@register("cube_edge_vertices_3d", oracle(3, f"SELECT ni, nj, nk, axis, round(max(t), 6) + 0e0 AS t FROM ({_EDGES}) GROUP BY ni, nj, nk, axis"))
def _(spark, sf_dir):
    rows = cubes.triangles(cubes.cells(space_nodes(spark, sf_dir), digits=9), SPACE)
    ends = rows.select(F.explode(F.array(*(F.struct(f"e{n}.ni", f"e{n}.nj", f"e{n}.nk", f"e{n}.axis", F.col(f"t{n}").alias("p")) for n in range(3)))).alias("end")).select("end.*").where("axis < 3")
    at = F.when(F.col("axis") == 0, (F.col("p.x") + 10) / 2 - F.col("ni")).when(F.col("axis") == 1, (F.col("p.y") + 10) / 2 - F.col("nj")).otherwise((F.col("p.z") + 10) / 2 - F.col("nk"))
    return ends.groupBy("ni", "nj", "nk", "axis").agg(r6(F.max(at)).alias("t"))


@register("mesh_area_3d", oracle(3, "SELECT round(sum(area), 6) + 0e0 AS area, round(sum(x0 * (y1 * z2 - z1 * y2) + y0 * (z1 * x2 - x1 * z2) + z0 * (x1 * y2 - y1 * x2)) / 6, 6) + 0e0 AS volume, count(*) AS n_triangles FROM tri"))
def _(spark, sf_dir):
    rows = cubes.triangles(cubes.cells(space_nodes(spark, sf_dir), digits=9), SPACE)
    return cubes.surface_area(rows).select(r6("area").alias("area"), r6("volume").alias("volume"), "n_triangles")


@register("spatial_bin_candidates", oracle(2, "SELECT e.elem_id, count(*) AS n_faces FROM ele e JOIN fac f ON abs(e.ci - f.ci) <= 1 AND abs(e.cj - f.cj) <= 1 WHERE f.fx * (by_ - ay) / length + f.fy * (ax - bx) / length > 0 GROUP BY 1"))
def _(spark, sf_dir):
    return plane_pairs(spark, sf_dir).groupBy("elem_id").agg(F.count("*").alias("n_faces"))


@register("facing_faces", oracle(2, "SELECT elem_id, oid, face FROM can"))
def _(spark, sf_dir):
    return plane_pairs(spark, sf_dir).select("elem_id", "oid", "face")


@register("overlap_length_2d", oracle(2, "SELECT elem_id, oid, round(sum(cover), 6) AS cover FROM ovl WHERE cover > 1e-9 GROUP BY elem_id, oid"))
def _(spark, sf_dir):
    return flux.overlaps_2d(plane_pairs(spark, sf_dir)).where("cover > 1e-9").groupBy("elem_id", "oid").agg(r6(F.sum("cover")).alias("cover"))


@register("flux_weights_2d", oracle(2, "SELECT elem_id, oid, round(frac, 6) AS frac FROM shr WHERE frac > 1e-5"))
def _(spark, sf_dir):
    return plane_weights(spark, sf_dir).where("frac > 1e-5").select("elem_id", "oid", r6("frac").alias("frac"))


@register("flux_apply", oracle(2, "SELECT oid, round(value, 5) AS value FROM rec WHERE value > 1e-4"))
def _(spark, sf_dir):
    return plane_received(spark, sf_dir).where("value > 1e-4").select("oid", F.round("value", 5).alias("value"))


@register("conservation_error", oracle(2, "SELECT round((SELECT sum(scalar) FROM sca), 5) AS sent, round((SELECT sum(value) FROM rec), 5) AS received, (SELECT count(*) FROM sca WHERE elem_id NOT IN (SELECT elem_id FROM shr)) AS n_uncovered"))
def _(spark, sf_dir):
    elements = plane_elements(spark, sf_dir)
    scalars, weights = plane_scalars(elements), plane_weights(spark, sf_dir, elements)
    return flux.conservation(scalars, weights, flux.apply_flux(weights, scalars)).select(F.round("sent", 5).alias("sent"), F.round("received", 5).alias("received"), "n_uncovered")


@register("low_coverage_elements", oracle(2, """SELECT elem_id, round(length, 6) AS length FROM ele WHERE elem_id NOT IN (
         SELECT ovl.elem_id FROM ovl JOIN vox ON vox.oid = ovl.oid WHERE cover > 0 AND n_input > 1 GROUP BY ovl.elem_id, ovl.oid HAVING max(cover) > 1e-6 * min(length))"""))
def _(spark, sf_dir):
    """Elements that no voxel of two or more inputs receives anything from."""
    elements = plane_elements(spark, sf_dir)
    dense = plane_pairs(spark, sf_dir, elements).join(plane_voxels(spark, sf_dir).where("n_input > 1").select("oid"), "oid", "left_semi")
    return flux.uncovered(elements, flux.weights(flux.overlaps_2d(dense))).select("elem_id", r6("length").alias("length"))


@register("flux_conserved_3d", oracle(3, "SELECT round(sum(2 + nx), 6) AS sent, 0e0 AS lost, round(sum(2 + nx), 6) AS received, CAST(0 AS BIGINT) AS n_uncovered FROM (SELECT ((y1 - y0) * (z2 - z0) - (z1 - z0) * (y2 - y0)) / (2 * area) AS nx FROM tri WHERE area > 0)"))
def _(spark, sf_dir):
    surface = SurfaceMapper(SPACE, digits=9).run(space_points(spark, sf_dir), check=False)
    scalars = surface.elements.select("elem_id", (F.lit(2.0) + F.col("nx")).alias("scalar"))
    received = flux.apply_flux(surface.weights, scalars)
    return flux.conservation(scalars, surface.weights, received).select(r6("sent").alias("sent"), r6("lost").alias("lost"), r6("received").alias("received"), "n_uncovered")


@register("buffer_check", oracle(2, "SELECT bool_and(i >= -6 AND i <= 106 AND j >= -6 AND j <= 66) AS fits FROM vox"))
def _(spark, sf_dir):
    return PLANE.fits(plane_voxels(spark, sf_dir))


def pairs_of_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rectangle and a right triangle, both with a corner at the origin, for each line item."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), F.lit(0.0).alias("z"))
    zero, p, q = F.lit(0.0), F.col("l_quantity") / 10, F.col("l_extendedprice") / 20000
    a, b = 1 + F.col("l_discount") * 30, 1 + F.col("l_tax") * 40
    quad = [point(zero, zero), point(p, zero), point(p, q), point(zero, q)]
    return rows.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pair_id"), *(c.alias(f"q{n}") for n, c in enumerate(quad)), point(zero, zero).alias("t0"), point(a, zero).alias("t1"), point(zero, b).alias("t2"))


@register(
    "overlap_area_quad_tri",
    """SELECT n.pair_id, round(greatest(0e0, least(q, b) * x0 + b * (p1 - x0) - b * (p1 * p1 - x0 * x0) / (2 * a)), 8) AS area FROM (
         SELECT pair_id, a, b, q, least(p, a) AS p1, greatest(0e0, least(least(p, a), a * (1 - q / b))) AS x0 FROM (
           SELECT l_orderkey * 8 + l_linenumber AS pair_id, l_quantity / 10 AS p, l_extendedprice / 20000 AS q, 1 + l_discount * 30 AS a, 1 + l_tax * 40 AS b FROM lineitem)) n""",
)
def _(spark, sf_dir):
    return flux.overlap_kernel(pairs_of_shapes(spark, sf_dir), ["pair_id"]).select("pair_id", F.round("cover", 8).alias("area"))
