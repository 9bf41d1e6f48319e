"""The whole mapping in one object: voxels to surface, surface to voxel shares."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbering import ensure_checkpoints, numbered
from ..spec import GridError, GridSpec
from . import cubes, flux, lattice, mesh, nodes, squares

#: Vertices this near each other, in voxels, are one.
NEAR = 1e-7


@dataclass(frozen=True)
class Surface:
    """Tables of one run. The lattice, its fractions and the elements are checkpointed, the rest is computed on action."""

    fractions: DataFrame
    elements: DataFrame
    vertices: DataFrame
    lines: DataFrame
    weights: DataFrame
    collisions: DataFrame


class SurfaceMapper:
    """``SurfaceMapper(spec).run(voxels)``: voxels has oid and centres x, y[, z]."""

    def __init__(self, spec: GridSpec, level: float = 0.5, digits: int | None = None, clean: bool = True):
        """``clean``: near vertices of a surface in space are merged and its thin faces repaired."""
        self.spec, self.level, self.digits, self.clean = spec, level, digits, clean

    def weighted(self, voxels: DataFrame) -> DataFrame:
        """Lattice positions with depth and weight; void ones near the solid too in a weighted grid."""
        axes = self.spec.voxel_axes
        if not self.spec.weighted:
            return voxels.select(*axes).distinct().withColumn("weight", F.lit(1.0))
        return lattice.whole_depth(voxels, axes, self.spec.reach).withColumn("weight", lattice.weight(self.spec))

    def elements(self, fractions: DataFrame) -> DataFrame:
        """Segments or triangles, numbered and checkpointed: the jobs that make them run here."""
        spec = self.spec
        ensure_checkpoints(fractions.sparkSession)
        if spec.ndims == 2:
            made = squares.attributes(squares.segments(squares.within(squares.cells(fractions, self.level, self.digits), spec), spec, self.level))
            return numbered(made, ["cj", "ci", "part"], "elem_id").checkpoint()
        made = cubes.attributes(cubes.triangles(cubes.cells(fractions, self.level, self.digits), spec, self.level)).where("area > 0")
        home = {c: spec.cell_of(a, F.col(f"g{'xyz'[a]}")) for a, c in enumerate(spec.cell_axes)}
        made = numbered(made, ["ck", "cj", "ci", "part"], "elem_id")
        return (self.cleaned(made) if self.clean else made).withColumns(home).checkpoint()

    def cleaned(self, elements: DataFrame) -> DataFrame:
        """``elements`` themselves if no two vertices are near each other and no face is thin; else those of the cleaned mesh, numbered anew, with ``part`` their number in it."""
        vertices, faces = cubes.indexed(elements)
        vertices, radius = vertices.checkpoint(), NEAR * self.spec.voxel_size
        if mesh.near_pairs(vertices, radius).isEmpty() and mesh.thin_faces(vertices, faces).isEmpty():
            return elements
        vertices, faces = mesh.clean(vertices, faces, radius)
        whole = mesh.with_corners(vertices, faces).select(*(F.col(f"p{c}").alias(f"t{n}") for n, c in enumerate("abc")), F.col("elem_id").alias("part"))
        whole = cubes.attributes(whole).withColumns({c: self.spec.cell_of(a, F.col(f"g{'xyz'[a]}")) for a, c in enumerate(self.spec.cell_axes)})
        return numbered(whole, ["ck", "cj", "ci", "part"], "elem_id")

    def run(self, voxels: DataFrame, check: bool = True) -> Surface:
        spec = self.spec
        ensure_checkpoints(voxels.sparkSession)
        snapped = lattice.collapse(lattice.snap(voxels, spec), spec.voxel_axes).checkpoint()
        if check:
            spec.check(snapped)
        fractions = nodes.node_fractions(self.weighted(snapped), spec).checkpoint()
        if check and fractions.where(F.col("frac") >= self.level).isEmpty():
            raise GridError("no node is filled to the level, so there is no surface")
        elements = self.elements(fractions)
        pairs = flux.candidates(elements, flux.surface_faces(snapped, spec), spec, flux.CROWDED)
        shares = flux.weights(flux.overlaps_2d(pairs) if spec.ndims == 2 else flux.overlaps_3d(pairs))
        vertices, lines = squares.indexed(elements.drop("elem_id")) if spec.ndims == 2 else cubes.indexed(elements)
        return Surface(fractions, elements, vertices, lines, shares, snapped.where("n_input > 1"))

    def area(self, surface: Surface) -> DataFrame:
        """Surface area, or perimeter in the plane."""
        return squares.perimeter(surface.elements) if self.spec.ndims == 2 else cubes.surface_area(surface.elements)
