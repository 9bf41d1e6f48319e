"""Queries of surfaces in space, of mesh repair, and of dump files whose lines come from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import clip_to_plane, project, unit
from ..operators import ablation, cubes, lattice, mesh, nodes, validation
from ..operators.pipeline import SurfaceMapper
from ..sources import dumps
from .lattices import PLANE, SPACE, coarse, oracle, space_points, table
from .mapping import plane_elements, plane_voxels, r6, space_nodes
from .registry import register


def space_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cubes.triangles(cubes.cells(space_nodes(spark, sf_dir), digits=9), SPACE)


_N = {"x": "(y1 - y0) * (z2 - z0) - (z1 - z0) * (y2 - y0)", "y": "(z1 - z0) * (x2 - x0) - (x1 - x0) * (z2 - z0)", "z": "(x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0)"}


@register(
    "triangle_attributes_3d",
    oracle(3, "SELECT ci, cj, ck, part, round(area, 6) AS area, " + ", ".join(f"CASE WHEN area > 0 THEN round(({n}) / (2 * area), 6) + 0e0 END AS n{x}" for x, n in _N.items()) + ", " + ", ".join(f"round(({x}0 + {x}1 + {x}2) / 3, 6) + 0e0 AS g{x}" for x in "xyz") + ", round(greatest(" + ", ".join(f"greatest({x}0, {x}1, {x}2) - least({x}0, {x}1, {x}2)" for x in "xyz") + "), 6) AS extent FROM tri WHERE area > 1e-9"),
)
def _(spark, sf_dir):
    rows = cubes.attributes(space_triangles(spark, sf_dir)).where("area > 1e-9")  # slivers have no direction to compare
    return rows.select("ci", "cj", "ck", "part", *(r6(c).alias(c) for c in ("area", "nx", "ny", "nz", "gx", "gy", "gz", "extent")))


_MESH = """, pts AS (""" + " UNION ALL ".join(f"SELECT ci, cj, ck, part, {n} AS corner, x{n} + 0e0 AS x, y{n} + 0e0 AS y, z{n} + 0e0 AS z FROM tri" for n in range(3)) + """),
 vtx AS (SELECT x, y, z, row_number() OVER (ORDER BY z, y, x) - 1 AS vid FROM (SELECT DISTINCT x, y, z FROM pts)),
 nam AS (SELECT ci, cj, ck, part, max(CASE WHEN corner = 0 THEN vid END) AS a, max(CASE WHEN corner = 1 THEN vid END) AS b, max(CASE WHEN corner = 2 THEN vid END) AS c FROM pts JOIN vtx USING (x, y, z) GROUP BY ci, cj, ck, part),
 fce AS (SELECT row_number() OVER (ORDER BY ck, cj, ci, part) - 1 AS elem_id, * FROM nam WHERE a <> b AND b <> c AND a <> c),
 each_ AS (SELECT unnest([a, b, c]) AS vid, """ + ", ".join(f"{n} AS n{x}" for x, n in _N.items()) + """ FROM fce JOIN tri USING (ci, cj, ck, part)),
 dir AS (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS size FROM (SELECT vid, sum(nx) AS nx, sum(ny) AS ny, sum(nz) AS nz FROM each_ GROUP BY vid)),
 spn AS (SELECT x, y, z, max(greatest(0e0, """ + ", ".join(f"v{c}" for c in range(8)) + ") - least(0e0, " + ", ".join(f"v{c}" for c in range(8)) + ")) AS value FROM pts JOIN cub USING (ci, cj, ck) GROUP BY x, y, z)\n"


def meshed(last: str) -> str:
    """``last`` after the tables of the mesh: vtx, fce, dir (summed normals) and spn (values)."""
    return oracle(3, "").rstrip() + _MESH + last


@register("mesh_normals_3d", meshed("SELECT vid, round(x, 6) + 0e0 AS x, round(y, 6) + 0e0 AS y, round(z, 6) + 0e0 AS z, " + ", ".join(f"CASE WHEN size > 1e-9 THEN round(n{x} / size, 6) + 0e0 END AS n{x}" for x in "xyz") + " FROM vtx JOIN dir USING (vid)"))
def _(spark, sf_dir):
    vertices, faces = cubes.indexed(space_triangles(spark, sf_dir))
    return vertices.join(cubes.vertex_normals(vertices, faces), "vid").select("vid", *(r6(c).alias(c) for c in ("x", "y", "z", "nx", "ny", "nz")))


@register("iso_surface_vertices_3d", meshed("SELECT vid, round(x, 6) + 0e0 AS x, round(y, 6) + 0e0 AS y, round(z, 6) + 0e0 AS z, round(value, 6) AS value FROM vtx JOIN spn USING (x, y, z)"))
def _(spark, sf_dir):
    vertices, _ = cubes.iso_surface(space_nodes(spark, sf_dir), SPACE, 0.5, digits=9)
    return vertices.select("vid", *(r6(c).alias(c) for c in ("x", "y", "z", "value")))


@register("iso_surface_faces_3d", meshed("SELECT elem_id, a, b, c FROM fce"))
def _(spark, sf_dir):
    return cubes.iso_surface(space_nodes(spark, sf_dir), SPACE, 0.5, digits=9)[1]


#: For each triangle corner: both ends of its edge, by their corner number, with the cell's values.
_ENDS = "SELECT x, y, z, unnest([lo, lo | (hi - lo)]) AS e, v FROM (" + " UNION ALL ".join(f"SELECT x{n} + 0e0 AS x, y{n} + 0e0 AS y, z{n} + 0e0 AS z, [{', '.join(str(a) for a, _ in cubes.EDGES)}][s{n} + 1] AS lo, [{', '.join(str(b) for _, b in cubes.EDGES)}][s{n} + 1] AS hi, [{', '.join(f'v{c}' for c in range(8))}] AS v FROM tri JOIN cub USING (ci, cj, ck)" for n in range(3)) + ")"
_SUMS = f"SELECT x, y, z, {', '.join(f'sum((v[(e & {7 - (1 << b)}) + 1] - v[(e | {1 << b}) + 1]) / (abs(v[e + 1] - 0.5e0) + {2.0**-52})) AS n{x}' for b, x in enumerate('xyz'))} FROM ({_ENDS}) GROUP BY x, y, z"


@register("gradient_normals_3d", meshed("SELECT vid, " + ", ".join(f"round(n{x} / sqrt(nx * nx + ny * ny + nz * nz), 6) + 0e0 AS n{x}" for x in "xyz") + f" FROM vtx JOIN ({_SUMS}) USING (x, y, z) WHERE nx * nx + ny * ny + nz * nz > 0"))
def _(spark, sf_dir):
    vertices, _ = cubes.iso_surface(space_nodes(spark, sf_dir), SPACE, 0.5, digits=9, gradients=True)
    return vertices.where("nx is not null").select("vid", *(r6(c).alias(c) for c in ("nx", "ny", "nz")))


@register("mesh_classic_masked_3d", coarse("SELECT ci, cj, ck, part, round(area, 6) AS area FROM tri"))
def _(spark, sf_dir):
    """Classic cases, every second node, cells of a mask, winding reversed."""
    fractions = space_nodes(spark, sf_dir)
    mask = fractions.where("ni % 4 < 2").select("ni", "nj", "nk")
    rows = cubes.triangles(cubes.cells(fractions, digits=9, step=2, mask=mask), SPACE, classic=True, flip=True, step=2)
    return cubes.attributes(rows).select("ci", "cj", "ck", "part", r6("area").alias("area"))


def _shares() -> str:
    """DuckDB text: shares of the voxels in the elements, by clipping each edge of a projected face and of its triangle to the other."""
    at = lambda b, n: f"CASE face // 2 WHEN {b} THEN {'ijk'[b]} + face % 2 - 0.5e0 WHEN {(b + 2) % 3} THEN {'ijk'[b]} + {(-0.5, 0.5, 0.5, -0.5)[n]}e0 ELSE {'ijk'[b]} + {(-0.5, -0.5, 0.5, 0.5)[n]}e0 END"
    home = ", ".join(f"CAST(floor(({x} + 10e0) / 2e0) AS INTEGER) AS f{c}" for x, c in zip("ijk", "abc", strict=True))
    faces = f"SELECT oid, {home}, {', '.join(f'CASE face // 2 WHEN {b} THEN face % 2 * 2 - 1 ELSE 0 END AS f{x}' for b, x in enumerate('xyz'))}, {', '.join(f'{at(b, n)} AS q{n}{x}' for n in range(4) for b, x in enumerate('xyz'))} FROM exp"
    elements = f"SELECT *, row_number() OVER (ORDER BY ck, cj, ci, part) - 1 AS elem_id, {', '.join(f'({n}) / (2 * area) AS n{x}' for x, n in _N.items())}, {', '.join(f'CAST(floor((({x}0 + {x}1 + {x}2) / 3 + 10e0) / 2e0) AS INTEGER) AS e{c}' for x, c in zip('xyz', 'abc', strict=True))}, sqrt(power(x1 - x0, 2) + power(y1 - y0, 2) + power(z1 - z0, 2)) AS side FROM tri WHERE area > 0"
    along = ", ".join(f"({x}1 - {x}0) / side AS u{x}" for x in "xyz")
    across = "ny * uz - nz * uy AS vx, nz * ux - nx * uz AS vy, nx * uy - ny * ux AS vz"
    flat = lambda p, w: " + ".join(f"({p.replace('_', x)} - {x}0) * {w}{x}" for x in "xyz")
    plane = ", ".join(f"{flat(f'q{n}_', w)} AS a{n}{w}" for n in range(4) for w in "uv") + ", " + ", ".join(f"{flat(f'_{n}', w)} AS b{n}{w}" for n in range(3) for w in "uv")
    turn = " + ".join(f"(a{n}u * a{(n + 1) % 4}v - a{(n + 1) % 4}u * a{n}v)" for n in range(4))

    def clipped(own: str, sides: int, other: str, others: int, sign: str, swap: bool) -> str:
        """Twice the area under the edges of ``own`` inside ``other``; a face that turns the other way counts by its sign."""
        out = []
        for e in range(sides):
            p, q = f"{own}{e}", f"{own}{(e + 1) % sides}"
            low, high = ["0e0"], ["1e0"]
            for s in range(others):
                o, d = f"{other}{s}", f"{other}{(s + 1) % others}"
                side = lambda r: f"(({d}u - {o}u) * ({r}v - {o}v) - ({d}v - {o}v) * ({r}u - {o}u))" + (f" * {sign}" if swap else "")  # noqa: B023, E731
                a, step = side(p), f"({side(q)} - {side(p)})"
                low.append(f"CASE WHEN {step} > 1e-12 THEN -{a} / {step} WHEN abs({step}) <= 1e-12 AND {a} < 0 THEN 2e0 ELSE 0e0 END")
                high.append(f"CASE WHEN {step} < -1e-12 THEN -{a} / {step} ELSE 1e0 END")
            span = f"greatest(0e0, least({', '.join(high)}) - greatest({', '.join(low)}))"
            out.append(f"({p}u * {q}v - {q}u * {p}v) * {span}" + ("" if swap else f" * {sign}"))
        return " + ".join(out)

    cover = f"({clipped('a', 4, 'b', 3, 'way', False)} + {clipped('b', 3, 'a', 4, 'way', True)}) / 2"
    return oracle(3, "").rstrip() + f""", fce AS ({faces}), elm AS (SELECT *, {across} FROM (SELECT *, {along} FROM ({elements}))),
 flt AS (SELECT elem_id, oid, area, {plane} FROM elm JOIN fce ON abs(ea - fa) <= 1 AND abs(eb - fb) <= 1 AND abs(ec - fc) <= 1 WHERE fx * nx + fy * ny + fz * nz > 0),
 cov AS (SELECT elem_id, oid, area, greatest(0e0, {cover}) AS cover FROM (SELECT *, CASE WHEN {turn} < 0 THEN -1 ELSE 1 END AS way FROM flt)),
 shr AS (SELECT elem_id, oid, cover / sum(cover) OVER (PARTITION BY elem_id) AS frac FROM (SELECT elem_id, oid, sum(cover) AS cover, max(cover) AS most, min(area) AS area FROM cov WHERE cover > 0 GROUP BY elem_id, oid) WHERE most > 1e-6 * area)
 SELECT elem_id, oid, round(frac, 6) AS frac FROM shr WHERE frac > 1e-5"""


@register("flux_weights_3d", _shares())
def _(spark, sf_dir):
    weights = SurfaceMapper(SPACE, digits=9).run(space_points(spark, sf_dir), check=False).weights
    return weights.where("frac > 1e-5").select("elem_id", "oid", r6("frac").alias("frac"))


@register("cells_filled_3d", oracle(3, "SELECT round(sum(frac), 6) AS cells_filled FROM nod"))
def _(spark, sf_dir):
    return nodes.fill_total(space_nodes(spark, sf_dir)).select(r6("cells_filled").alias("cells_filled"))


def _low(a: str, c: str) -> str:
    return f"greatest(0e0, least(1e0, (-10e0 + {c} * 2e0 + 1e0 - ({a} - 0.5e0)) / 1e0))"


@register(
    "centre_fractions_2d",
    oracle(2, f"""SELECT ni, nj, round(sum(share), 9) AS frac, round(sum(share), 9) > 0.499e0 AS inside FROM (
      SELECT ci, cj, ci + dx AS ni, cj + dy AS nj, weight * CASE dx WHEN 0 THEN {_low('i', 'ci')} ELSE 1 - {_low('i', 'ci')} END * CASE dy WHEN 0 THEN {_low('j', 'cj')} ELSE 1 - {_low('j', 'cj')} END / 4 AS share
      FROM (SELECT *, CAST(floor((i + 10e0) / 2e0) AS INTEGER) AS ci, CAST(floor((j + 10e0) / 2e0) AS INTEGER) AS cj FROM wei WHERE weight > 1e-12) CROSS JOIN (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) o(dx, dy))
      WHERE share > 0 AND ci BETWEEN 0 AND 59 AND cj BETWEEN 0 AND 39 GROUP BY ni, nj"""),
)
def _(spark, sf_dir):
    rows = nodes.centre_fractions(SurfaceMapper(PLANE).weighted(plane_voxels(spark, sf_dir)), PLANE)
    return rows.select("ni", "nj", F.round("frac", 9).alias("frac"), "inside")


@register("remaining_curve", "SELECT step, round(left_ / max(CASE WHEN step = 0 THEN left_ END) OVER (), 6) AS share, round(sign(50 - 6e0 * step) * power(abs(50 - 6e0 * step) / 50, 2), 6) + 0e0 AS exact FROM (SELECT CAST(l_linenumber - 1 AS INTEGER) AS step, CAST(count(*) AS DOUBLE) AS left_ FROM lineitem GROUP BY 1)")
def _(spark, sf_dir):
    """Line items by their place in the order, as what is left after so many steps."""
    curve = table(spark, sf_dir, "lineitem").groupBy((F.col("l_linenumber") - 1).cast("int").alias("step")).agg(F.count("*").cast("double").alias("left"))
    return ablation.remaining_curve(curve, 50.0, 6.0).select("step", F.round("share", 6).alias("share"), r6("exact").alias("exact"))


@register("analytic_flux_2d", oracle(2, "SELECT elem_id, round(scalar, 6) AS scalar FROM sca"))
def _(spark, sf_dir):
    return plane_elements(spark, sf_dir).select("elem_id", F.round(validation.analytic_flux(F.col("theta")), 6).alias("scalar"))


_WEAR = """, st AS (SELECT v.oid, v.i, v.j, depth, CASE WHEN depth = 0 THEN n_input * 0.37e0 ELSE 0e0 END AS value FROM vox v JOIN dep d ON d.i = v.i AND d.j = v.j),
 met AS (SELECT o.oid AS source, o.value - 1e0 AS excess, r.oid FROM st o JOIN st r ON abs(o.i - r.i) <= 1 AND abs(o.j - r.j) <= 1 WHERE o.depth = 0 AND o.value >= 1 AND r.depth = 1),
 mor AS (SELECT oid, sum(excess / n) AS more FROM met JOIN (SELECT source, count(*) AS n FROM met GROUP BY source) USING (source) GROUP BY oid)
 SELECT oid, round(greatest(0e0, 1e0 - value - coalesce(more, 0e0)), 6) AS integrity, 1e0 - value - coalesce(more, 0e0) > 0 AS alive, round(least(1e0, value + coalesce(more, 0e0)), 6) AS taken FROM st LEFT JOIN mor USING (oid)"""


@register("wear_step", oracle(2, "").rstrip() + _WEAR)
def _(spark, sf_dir):
    """One step of wear of whole voxels; what is left over goes to those just below."""
    voxels = plane_voxels(spark, sf_dir)
    depth = lattice.depth(lattice.padded(voxels, PLANE), PLANE.voxel_axes).select("i", "j", "depth")
    state = voxels.join(depth, ["i", "j"]).select("oid", "i", "j", "depth", F.lit(1.0).alias("integrity"))
    out = ablation.wear(state, voxels.select("oid", (F.col("n_input") * 0.37).alias("value")), 1.0)
    return out.select("oid", F.round("integrity", 6).alias("integrity"), "alive", F.round("taken", 6).alias("taken"))


def _part(first: int) -> list[Column]:
    return [F.col("embedding")[first + n].cast("double") for n in range(3)]


#: Points p and q, a base and a unit normal, from the first twelve numbers of each embedding.
_SPACE_POINTS = "(SELECT vec_id, " + ", ".join(f"CAST(embedding[{first + n + 1}] AS DOUBLE) AS {name}{x}" for name, first in (("p", 0), ("b", 3), ("w", 6), ("q", 9)) for n, x in enumerate("xyz")) + " FROM embeddings)"
_UNIT_NORMAL = "(SELECT *, " + ", ".join(f"w{x} / sqrt(wx * wx + wy * wy + wz * wz) AS m{x}" for x in "xyz") + f" FROM {_SPACE_POINTS})"
_AWAY = {p: f"(({p}x - bx) * mx + ({p}y - by_) * my + ({p}z - bz) * mz)".replace("by_", "by") for p in "pq"}


@register("plane_projection", f"SELECT vec_id, {', '.join(f'round(p{x} - m{x} * {_AWAY["p"]}, 6) + 0e0 AS {x}' for x in 'xyz')} FROM {_UNIT_NORMAL}".replace("by", '"by"'))
def _(spark, sf_dir):
    out = project(_part(0), _part(3), unit(_part(6)))
    return table(spark, sf_dir, "embeddings").select("vec_id", *(r6(c).alias(x) for c, x in zip(out, "xyz", strict=True)))


@register("plane_crossing", f"SELECT vec_id, dp < 0 AS p_inside, dq < 0 AS q_inside, {', '.join(f'round(p{x} + (q{x} - p{x}) * CASE WHEN dp <> dq THEN dp / (dp - dq) ELSE 0e0 END, 5) + 0e0 AS {x}' for x in 'xyz')} FROM (SELECT *, {_AWAY['p']} AS dp, {_AWAY['q']} AS dq FROM {_UNIT_NORMAL})".replace("by", '"by"'))
def _(spark, sf_dir):
    p_in, q_in, at = clip_to_plane(_part(0), _part(9), unit(_part(6)), _part(3))
    return table(spark, sf_dir, "embeddings").select("vec_id", p_in.alias("p_inside"), q_in.alias("q_inside"), *((F.round(c, 5) + F.lit(0.0)).alias(x) for c, x in zip(at, "xyz", strict=True)))


def supplier_mesh(spark: SparkSession, sf_dir: str, scale: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Suppliers as vertices (balance, nation), line items as faces; ``scale`` rounds the balance down, so that vertices coincide."""
    s = table(spark, sf_dir, "supplier")
    x = F.col("s_acctbal") / 1000 if scale is None else F.floor(F.col("s_acctbal") / scale).cast("double")
    vertices = s.select(F.col("s_suppkey").alias("vid"), x.alias("x"), F.col("s_nationkey").cast("double").alias("y"), F.lit(0.0).alias("z"))
    n = s.agg((F.max("s_suppkey") + 1).alias("n"))
    rows = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("elem_id")).agg(F.min("l_suppkey").alias("a"), F.min("l_partkey").alias("p"), F.min("l_orderkey").alias("o"))
    faces = rows.crossJoin(n).select("elem_id", "a", (F.col("p") % F.col("n")).alias("b"), (F.col("o") % F.col("n")).alias("c"))  # one row
    return vertices, mesh.distinct_corners(faces) if scale is None else faces


def _supplier_mesh(x: str, whole: bool) -> str:
    return f"""WITH v AS (SELECT s_suppkey AS vid, {x} AS x, CAST(s_nationkey AS DOUBLE) AS y FROM supplier),
 f AS (SELECT * FROM (SELECT elem_id, a, p % n AS b, o % n AS c FROM (SELECT l_orderkey * 8 + l_linenumber AS elem_id, min(l_suppkey) AS a, min(l_partkey) AS p, min(l_orderkey) AS o FROM lineitem GROUP BY 1) CROSS JOIN (SELECT max(s_suppkey) + 1 AS n FROM supplier))
  {'WHERE a <> b AND b <> c AND a <> c' if whole else ''})"""


_THIN = _supplier_mesh("s_acctbal / 1000", True) + """,
 s AS (SELECT f.*, sqrt(power(pb.x - pa.x, 2) + power(pb.y - pa.y, 2)) AS ab, sqrt(power(pc.x - pb.x, 2) + power(pc.y - pb.y, 2)) AS bc, sqrt(power(pa.x - pc.x, 2) + power(pa.y - pc.y, 2)) AS ca,
  abs((pb.x - pa.x) * (pc.y - pa.y) - (pb.y - pa.y) * (pc.x - pa.x)) / 2 AS area FROM f JOIN v pa ON pa.vid = a JOIN v pb ON pb.vid = b JOIN v pc ON pc.vid = c),
 t AS (SELECT elem_id, a, b, c, CASE WHEN ab >= bc AND ab >= ca THEN [a, b] WHEN bc >= ca THEN [b, c] ELSE [c, a] END AS e, CASE WHEN ab >= bc AND ab >= ca THEN c WHEN bc >= ca THEN a ELSE b END AS tip FROM s WHERE area < 1e-8 * power(greatest(ab, bc, ca), 2)),
 thin AS (SELECT elem_id, a, b, c, list_min(e) AS lo, list_max(e) AS hi, tip FROM t)"""


@register("thin_faces", _THIN + " SELECT elem_id, lo, hi FROM thin")
def _(spark, sf_dir):
    return mesh.thin_faces(*supplier_mesh(spark, sf_dir)).select("elem_id", F.col("long_edge")[0].alias("lo"), F.col("long_edge")[1].alias("hi"))


@register(
    "repaired_faces",
    _THIN
    + """, alone AS (SELECT lo, hi, min(elem_id) AS elem_id FROM thin GROUP BY lo, hi HAVING count(*) % 2 = 1),
 spl AS (SELECT thin.elem_id AS thin, thin.lo, thin.hi, tip FROM thin JOIN alone USING (elem_id)),
 whole AS (SELECT * FROM f WHERE elem_id NOT IN (SELECT elem_id FROM thin)),
 sides AS (SELECT elem_id, a AS p, b AS q, c AS r FROM whole UNION ALL SELECT elem_id, b, c, a FROM whole UNION ALL SELECT elem_id, c, a, b FROM whole),
 met AS (SELECT thin, elem_id, p, q, r, tip, row_number() OVER (PARTITION BY thin ORDER BY elem_id, p, q, r) AS nth FROM sides JOIN spl ON lo = least(p, q) AND hi = greatest(p, q)),
 chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY elem_id ORDER BY thin) AS turn FROM met WHERE nth = 1) WHERE turn = 1)
 SELECT elem_id, a, b, c FROM whole WHERE elem_id NOT IN (SELECT elem_id FROM chosen)
 UNION ALL SELECT elem_id, p, tip, r FROM chosen
 UNION ALL SELECT (SELECT max(elem_id) FROM f) + row_number() OVER (ORDER BY elem_id), tip, q, r FROM chosen""",
)
def _(spark, sf_dir):
    return mesh.repair_thin(*supplier_mesh(spark, sf_dir)).select("elem_id", "a", "b", "c")


_CLOSED = _supplier_mesh("CAST(floor(s_acctbal / 2500) AS DOUBLE)", False) + """,
 r AS (SELECT vid, min(vid) OVER (PARTITION BY x, y) AS root FROM v),
 m AS (SELECT * FROM (SELECT elem_id, ra.root AS a, rb.root AS b, rc.root AS c FROM f JOIN r ra ON ra.vid = a JOIN r rb ON rb.vid = b JOIN r rc ON rc.vid = c) WHERE a <> b AND b <> c AND a <> c),
 u AS (SELECT vid, row_number() OVER (ORDER BY vid) - 1 AS nth FROM v WHERE vid IN (SELECT unnest([a, b, c]) FROM m))"""


@register("merged_equal_vertices", _CLOSED + " SELECT elem_id, ua.nth AS a, ub.nth AS b, uc.nth AS c FROM m JOIN u ua ON ua.vid = a JOIN u ub ON ub.vid = b JOIN u uc ON uc.vid = c")
def _(spark, sf_dir):
    return mesh.remove_degenerate(*supplier_mesh(spark, sf_dir, 2500))[1].select("elem_id", "a", "b", "c")


@register("mesh_area_by_corners", _supplier_mesh("s_acctbal / 1000", True) + " SELECT round(sum(abs((pb.x - pa.x) * (pc.y - pa.y) - (pb.y - pa.y) * (pc.x - pa.x)) / 2), 3) AS area FROM f JOIN v pa ON pa.vid = a JOIN v pb ON pb.vid = b JOIN v pc ON pc.vid = c")
def _(spark, sf_dir):
    return mesh.area(*supplier_mesh(spark, sf_dir)).select(F.round("area", 3).alias("area"))


@register("non_nan_counts", "SELECT count(s_acctbal) AS s_acctbal, count(*) AS p_retailprice FROM part LEFT JOIN supplier ON s_suppkey = p_partkey")
def _(spark, sf_dir):
    parts, data = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    joined, _ = dumps.attach(parts.select(F.col("p_partkey").alias("tid"), "p_retailprice"), data.select(F.col("s_suppkey").alias("sid"), "s_acctbal"))
    return dumps.non_nan_counts(joined, ["s_acctbal", "p_retailprice"])


def listing(rows: DataFrame, path: Column, order: list[Column], line: Column, head: list[Column | str], tail: list[Column | str] = ()) -> DataFrame:
    """``path, n, line`` as of a file for each ``path``: the head (may use ``path`` and ``size``), a line for each row, the tail."""
    made = rows.groupBy(path.alias("path")).agg(F.array_sort(F.collect_list(F.struct(*(o.alias(f"o{n}") for n, o in enumerate(order)), line.alias("line")))).alias("body"))
    made = made.withColumn("size", F.size("body"))
    text = lambda parts: F.array(*((F.lit(p) if isinstance(p, str) else p).cast("string") for p in parts)).cast("array<string>")
    whole = F.concat(text(head), F.transform("body", lambda r: r["line"]), text(tail))
    return made.select("path", F.posexplode(whole).alias("n", "line")).select("path", (F.col("n") + 1).alias("n"), "line")


def words(*parts: Column | str) -> Column:
    return F.concat_ws(" ", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def customer_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_totalprice") / 8).alias("v"))


@register("weight_file_rows", "SELECT l_orderkey - 1 AS elem_id, CAST(l_linenumber AS BIGINT) AS oid, max(l_discount) AS frac FROM lineitem GROUP BY ALL")
def _(spark, sf_dir):
    """A weight file for each order: a block of its line numbers and discounts."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_discount").alias("d"))
    made = listing(items, F.col("l_orderkey"), [F.col("l_linenumber")], words(F.col("l_linenumber"), F.col("d")), ["weights", words("start", F.col("path"))], ["end"])
    return dumps.parse_weights(made)


@register("flow_dump_rows", "SELECT o_custkey AS path, CAST(o_custkey % 100 AS INTEGER) AS timestep, o_orderkey AS id, o_orderkey % 7 AS xlo, o_orderkey % 7 + 1 AS xhi, CAST(CAST(o_totalprice / 8 AS FLOAT) AS DOUBLE) AS v FROM orders")
def _(spark, sf_dir):
    """A flow dump for each customer: its orders are flat cells."""
    x = F.col("o_orderkey") % 7
    head = ["ITEM: TIMESTEP", F.col("path") % 100, "ITEM: NUMBER OF CELLS", F.col("size"), "ITEM: BOX BOUNDS oo oo", "0 8", "0 1", "ITEM: CELLS id xlo ylo xhi yhi v "]
    made = listing(customer_orders(spark, sf_dir), F.col("o_custkey"), [F.col("o_orderkey")], words(F.col("o_orderkey"), x, "0", x + 1, "1", F.col("v")), head)
    return dumps.parse_flow(made).select("path", "timestep", "id", F.col("xlo").cast("long").alias("xlo"), F.col("xhi").cast("long").alias("xhi"), F.col("v").cast("double").alias("v"))


@register("surface_dump_rows", "SELECT o_custkey AS path, o_orderkey AS id, CAST(CAST(o_totalprice / 8 AS FLOAT) AS DOUBLE) AS v FROM orders")
def _(spark, sf_dir):
    """A surface dump for each customer; what follows a second header of a kind is left out."""
    head = ["ITEM: TIMESTEP", "3", "ITEM: NUMBER OF SURFS", F.col("size"), "ITEM: SURFS id v"]
    made = listing(customer_orders(spark, sf_dir), F.col("o_custkey"), [F.col("o_orderkey")], words(F.col("o_orderkey"), F.col("v")), head, ["ITEM: TIMESTEP", "4", "ITEM: SURFS id v", "1 2.5"])
    return dumps.parse_surface_data(made).select("path", "id", F.col("v").cast("double").alias("v"))


def surface_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A surface file for each customer: a point and a line for each of its orders; the lines follow in a second table of points."""
    rows = customer_orders(spark, sf_dir).withColumn("kind", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    line = F.when(F.col("kind") == 0, words(F.col("o_orderkey") + 1, F.col("v"), F.col("o_orderkey") % 7)).when(F.col("kind") == 2, words(F.col("o_orderkey") + 1, F.col("o_orderkey") + 1, F.col("o_orderkey") + 2))
    title = F.when(F.col("kind") == 1, F.lit("Lines"))
    made = listing(rows, F.concat(F.lit("made."), F.lit("by."), F.col("o_custkey").cast("string"), F.lit(".txt")), [F.col("kind"), F.col("o_orderkey")], F.coalesce(line, title), ["surf file", "", words(F.col("size"), "points"), "Points", ""])
    return dumps.parse_surface(made)


@register("surface_file_points", "SELECT CAST(o_custkey AS INTEGER) AS timestep, o_orderkey AS pid, o_totalprice / 8 AS x, CAST(o_orderkey % 7 AS DOUBLE) AS y FROM orders")
def _(spark, sf_dir):
    return surface_files(spark, sf_dir)[0].select("timestep", "pid", "x", "y")


@register("surface_file_lines", "SELECT CAST(o_custkey AS INTEGER) AS timestep, o_orderkey AS tid, o_orderkey AS a, o_orderkey + 1 AS b FROM orders")
def _(spark, sf_dir):
    return surface_files(spark, sf_dir)[1].select("timestep", "tid", "a", "b")


@register("solid_csv_rows", "SELECT o_custkey AS path, CAST(o_custkey % 100 AS INTEGER) AS timestep, CAST(o_orderkey AS BIGINT) AS id, CAST(CAST(o_totalprice / 8 AS FLOAT) AS DOUBLE) AS temp FROM orders")
def _(spark, sf_dir):
    """A solid file for each customer."""
    made = listing(customer_orders(spark, sf_dir), F.col("o_custkey"), [F.col("o_orderkey")], F.concat_ws(", ", F.col("o_orderkey").cast("string"), F.lit("0"), F.lit("1"), F.lit("2"), F.col("v").cast("string")), ["made", "ITEM: SOLID TIMESTEP", F.col("path") % 100, "id, x, y, z, temp"])
    return dumps.parse_solid(made).select("path", "timestep", F.col("id").cast("long").alias("id"), F.col("temp").cast("double").alias("temp"))


@register("reaction_ranks", "SELECT user_id AS path, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS elem_id, round(value * 2, 6) AS scalar FROM events")
def _(spark, sf_dir):
    """A reaction dump for each user, rows by value: the second block's rows belong to the elements in the order of their ids."""
    header = ["ITEM: TIMESTEP", "1", *("-" for _ in range(7))]
    e = table(spark, sf_dir, "events")
    made = listing(e, F.col("user_id"), [F.col("value"), F.col("event_id")], words(F.col("event_id"), F.col("value")), [*header, "1 5.0", *header])
    return dumps.parse_reactions(made, 2.0).select("path", "elem_id", F.round("scalar", 6).alias("scalar"))
