"""Flux mapping: which voxels an element of the surface sees, in what shares, and what it passes to them.

Candidates come from a binned spatial join: an element meets the exposed, facing
voxel faces in its own grid cell and those around it. The offsets are exploded
on the elements, the rarer side; the faces' cells join on equality. A cell with very
many faces is split into an octree's (or quadtree's) parts, so it is many keys, and
an element meets only the parts that lie along its normal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import overlap_length, vector
from ..spec import GridSpec
from .lattice import exposed_faces, face_corners, face_normal

#: A voxel counts only if one of its faces covers more than this share of the element; an element with less in all is uncovered.
LEAST_COVER = 1e-6


def surface_faces(voxels: DataFrame, spec: GridSpec) -> DataFrame:
    """Exposed faces with the cell of their voxel, corners ``p0``.. and normal."""
    faces = exposed_faces(voxels, spec.voxel_axes, ("oid",))
    corners = [c.alias(f"p{n}") for n, c in enumerate(face_corners(spec))]
    normal = [face_normal(a).cast("double").alias(f"f{'xyz'[a]}") for a in range(spec.ndims)]
    home = [spec.cell_of(a, spec.centre(a)).alias(c) for a, c in enumerate(spec.cell_axes)]
    return faces.select("oid", "face", *home, *corners, *normal)


#: Faces of a cell from which on it is split, into parts of about as many.
CROWDED = 1 << 14


def _middle(corners: list[str], axis: str) -> Column:
    total = F.col(f"{corners[0]}.{axis}")
    for c in corners[1:]:
        total = total + F.col(f"{c}.{axis}")
    return total / len(corners)


def split_cells(faces: DataFrame, spec: GridSpec, crowded: int = CROWDED) -> DataFrame:
    """``(*cell axes, level)`` of cells with more than ``crowded`` faces: halved so often along each axis that a part has about ``crowded`` at most, if they lie on a surface."""
    sizes = faces.groupBy(*spec.cell_axes).agg(F.count("*").alias("n")).where(F.col("n") > crowded)
    level = F.ceil(F.log2(F.col("n") / crowded) / max(1, spec.ndims - 1))
    return sizes.select(*spec.cell_axes, F.least(level, F.lit(20)).cast("int").alias("level"))


def split_candidates(around: DataFrame, faces: DataFrame, cells: DataFrame, spec: GridSpec) -> DataFrame:
    """The candidates in split ``cells``: elements that have been sent to them meet the faces of those parts that a line along the element's normal comes near enough to.

    What is left out shares no area with the element when it is projected onto it.
    """
    axes, size, dims = list(spec.cell_axes), spec.voxel_size, spec.ndims
    corners = [f"p{n}" for n in range(2 ** (dims - 1))]
    part = [f"q{n}" for n in range(dims)]
    inside = [F.floor((_middle(corners, x) - spec.lo[n] - F.col(axes[n]) * spec.cell[n]) / spec.cell[n] * F.pow(F.lit(2.0), F.col("level"))) for n, x in enumerate("xyz"[:dims])]
    placed = faces.join(cells, axes).withColumns({q: v.cast("long") for q, v in zip(part, inside, strict=True)})
    parts = placed.groupBy(*axes, "level", *part).agg(F.count("*").alias("n")).drop("n")
    ends = [("ax", "ay"), ("bx", "by")] if dims == 2 else [(f"t{n}.x", f"t{n}.y", f"t{n}.z") for n in range(3)]
    centre = [sum((F.col(e[n]) for e in ends[1:]), F.col(ends[0][n])) / len(ends) for n in range(dims)]
    reach = F.greatest(*(F.sqrt(sum(((F.col(e[n]) - centre[n]) ** 2 for n in range(1, dims)), (F.col(e[0]) - centre[0]) ** 2)) for e in ends))
    away = [F.lit(spec.lo[n]) + (F.col(axes[n]) + (F.col(part[n]) + 0.5) / F.pow(F.lit(2.0), F.col("level"))) * spec.cell[n] - centre[n] for n in range(dims)]
    normal = [F.col(f"n{x}") for x in "xyz"[:dims]]
    along = sum((a * m for a, m in zip(away[1:], normal[1:], strict=True)), away[0] * normal[0])
    aside = F.sqrt(F.greatest(F.lit(0.0), sum((a * a for a in away[1:]), away[0] * away[0]) - along * along))
    half = F.lit(sum(c * c for c in spec.cell) ** 0.5 / 2) / F.pow(F.lit(2.0), F.col("level"))
    met = around.join(parts, axes).where(aside <= (reach + half + size * dims**0.5 / 2) * (1 + 1e-9))
    return met.join(placed.drop("level"), [*axes, *part]).drop("level", *part)


def candidates(elements: DataFrame, faces: DataFrame, spec: GridSpec, crowded: int | None = None) -> DataFrame:
    """Pairs of an element and an exposed face in a 3 x 3 (x 3) block of cells that faces the element's way.

    ``elements`` has its cell in the cell axes and a normal in nx, ny[, nz]. Cells
    with more than ``crowded`` faces (None: no cell) are split, see
    ``split_candidates``: fewer pairs, the same overlaps.
    """
    block = F.explode(F.array(*(F.struct(*(F.lit(n // 3**a % 3 - 1).alias(f"d{c}") for a, c in enumerate(spec.cell_axes))) for n in range(3**spec.ndims))))
    around = elements.withColumn("around", block)
    for c in spec.cell_axes:
        around = around.withColumn(c, (F.col(c) + F.col(f"around.d{c}")).cast("int"))
    facing = sum((F.col(f"f{x}") * F.col(f"n{x}") for x in "xyz"[1 : spec.ndims]), F.col("fx") * F.col("nx"))
    around = around.drop("around")
    if crowded is None or (cells := split_cells(faces, spec, crowded).checkpoint()).isEmpty():
        return around.join(faces, list(spec.cell_axes)).where(facing > 0)
    calm = around.join(faces.join(cells.select(*spec.cell_axes), list(spec.cell_axes), "left_anti"), list(spec.cell_axes))
    return calm.unionByName(split_candidates(around, faces, cells, spec)).where(facing > 0)


def overlaps_2d(pairs: DataFrame) -> DataFrame:
    covered = overlap_length(vector("ax", "ay"), vector("bx", "by"), vector("p0.x", "p0.y"), vector("p1.x", "p1.y"))
    return pairs.select("elem_id", "oid", F.col("length").alias("size"), covered.alias("cover"))


def overlap_areas(quad: np.ndarray, triangle: np.ndarray) -> np.ndarray:
    """Areas common to the triangles (n, 3, 3) and the quads (n, 4, 3) projected onto their planes.

    Both are convex, so Green's theorem over the edges of each clipped to the
    other gives the area without building the clipped polygon. Clipping an edge to
    half-planes is the largest entering and the smallest leaving parameter. Edges
    that coincide in direction count once, as the quad's.
    """
    u = triangle[:, 1] - triangle[:, 0]
    n = np.cross(u, triangle[:, 2] - triangle[:, 0])
    size = np.linalg.norm(n, axis=1)
    ok = size > 0
    n = n / np.where(ok, size, 1)[:, None]
    u = u / np.where(ok, np.linalg.norm(u, axis=1), 1)[:, None]
    v = np.cross(n, u)

    def plane(points: np.ndarray) -> np.ndarray:
        away = points - triangle[:, :1]
        return np.stack((np.einsum("nkx,nx->nk", away, u), np.einsum("nkx,nx->nk", away, v)), axis=2)

    a, b = plane(quad), plane(triangle)
    x, y = a[:, :, 0], a[:, :, 1]
    turn = np.sum(x * np.roll(y, -1, 1) - np.roll(x, -1, 1) * y, axis=1)
    a = np.where((turn < 0)[:, None, None], a[:, ::-1], a)

    def boundary(own: np.ndarray, other: np.ndarray, ties: bool) -> np.ndarray:
        total = np.zeros(len(own))
        scale = np.abs(other).max(axis=(1, 2)) + 1e-300
        for e in range(own.shape[1]):
            p, q = own[:, e], own[:, (e + 1) % own.shape[1]]
            low, high = np.zeros(len(own)), np.ones(len(own))
            for s in range(other.shape[1]):
                o, d = other[:, s], other[:, (s + 1) % other.shape[1]] - other[:, s]
                at = d[:, 0] * (p[:, 1] - o[:, 1]) - d[:, 1] * (p[:, 0] - o[:, 0])
                step = d[:, 0] * (q[:, 1] - p[:, 1]) - d[:, 1] * (q[:, 0] - p[:, 0])
                flat = np.abs(step) <= 1e-14 * scale * scale
                t = -at / np.where(flat, 1, step)
                low = np.where(~flat & (step > 0), np.maximum(low, t), low)
                high = np.where(~flat & (step < 0), np.minimum(high, t), high)
                on = np.abs(at) <= 1e-14 * scale * scale
                same = np.einsum("nx,nx->n", d, q - p) > 0
                out = flat & np.where(on, not ties or ~same, at < 0)
                high = np.where(out, -1.0, high)
            c, f = p + (q - p) * low[:, None], p + (q - p) * high[:, None]
            total += np.where(high > low, c[:, 0] * f[:, 1] - f[:, 0] * c[:, 1], 0.0)
        return total

    return np.where(ok, np.maximum(0.0, (boundary(a, b, True) + boundary(b, a, False)) / 2), 0.0)


def overlap_kernel(pairs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` with ``cover``: areas of the pairs' quads q0..q3 and triangles t0..t2 (structs x, y, z), batch by batch."""

    def areas(batches):
        for batch in batches:
            def points(names):
                return np.stack([np.stack([batch.column(c).field(x).to_numpy(zero_copy_only=False) for x in range(3)], axis=1) for c in names], axis=1)

            cover = overlap_areas(points(["q0", "q1", "q2", "q3"]), points(["t0", "t1", "t2"])) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(cover)], names=[*keep, "cover"])

    schema = pairs.select(*keep).withColumn("cover", F.lit(0.0)).schema
    corners = ["q0", "q1", "q2", "q3", "t0", "t1", "t2"]
    return pairs.select(*keep, *corners).mapInArrow(areas, schema)


def overlaps_3d(pairs: DataFrame) -> DataFrame:
    named = pairs.select("elem_id", "oid", F.col("area").alias("size"), *(F.col(f"p{n}").alias(f"q{n}") for n in range(4)), "t0", "t1", "t2")
    return overlap_kernel(named, ["elem_id", "oid", "size"])


def weights(overlaps: DataFrame) -> DataFrame:
    """``elem_id, oid, frac``: shares that sum to 1 over each covered element."""
    each = overlaps.where(F.col("cover") > 0).groupBy("elem_id", "oid").agg(F.sum("cover").alias("cover"), F.max("cover").alias("most"), F.first("size").alias("size"))
    each = each.where(F.col("most") > F.col("size") * LEAST_COVER)
    total = F.sum("cover").over(Window.partitionBy("elem_id"))
    return each.withColumn("total", total).where(F.col("total") >= F.col("size") * LEAST_COVER).select("elem_id", "oid", (F.col("cover") / F.col("total")).alias("frac"))


def uncovered(elements: DataFrame, weights_: DataFrame) -> DataFrame:
    """Elements that no voxel receives anything from."""
    return elements.join(weights_.select("elem_id").distinct(), "elem_id", "left_anti")


def apply_flux(weights_: DataFrame, scalars: DataFrame) -> DataFrame:
    """``oid, value``: what the elements' ``scalar`` brings each voxel."""
    return weights_.join(scalars, "elem_id").groupBy("oid").agg(F.sum(F.col("frac") * F.col("scalar")).alias("value"))


def conservation(scalars: DataFrame, weights_: DataFrame, received: DataFrame) -> DataFrame:
    """One row: totals on the surface and on voxels, what uncovered elements lost, and the error in percent."""
    sent = scalars.agg(F.coalesce(F.sum("scalar"), F.lit(0.0)).alias("sent"))
    lost = uncovered(scalars, weights_).agg(F.coalesce(F.sum("scalar"), F.lit(0.0)).alias("lost"), F.count("*").alias("n_uncovered"))
    got = received.agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("received"))
    error = F.when(F.col("sent") != 0, 100 * (F.col("sent") - F.col("received")) / F.col("sent")).otherwise(F.lit(0.0))
    return sent.crossJoin(lost).crossJoin(got).withColumn("error_percent", error)  # one row each
