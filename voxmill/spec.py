"""Grid description shared by the voxel operators, with its validity checks."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of voxel, node and cell index columns by axis.
VOXEL, NODE, CELL = ("i", "j", "k"), ("ni", "nj", "nk"), ("ci", "cj", "ck")


class GridError(ValueError):
    """A grid or voxel set that the operators can't work on."""


@dataclass(frozen=True)
class GridSpec:
    """A box ``lo``..``hi`` cut into ``ncells`` cells per axis, and cubic voxels of edge ``voxel_size``.

    Voxel (0, 0[, 0]) of the lattice is centred on ``origin``. Raises GridError for
    2 or 3 axes not met, shapes that differ, inverted limits, cell counts that are
    not positive integers, or voxels that are not positive or larger than a cell.
    """

    lo: tuple[float, ...]
    hi: tuple[float, ...]
    ncells: tuple[int, ...]
    voxel_size: float = 1.0
    origin: tuple[float, ...] | None = None
    weighted: bool = True

    def __post_init__(self):
        if len(self.ncells) not in (2, 3):
            raise GridError("a grid has 2 or 3 axes")
        if len(self.lo) != len(self.ncells) or len(self.hi) != len(self.ncells):
            raise GridError("limits and cell counts differ in length")
        if any(isinstance(n, bool) or int(n) != n or not isinstance(n, int) for n in self.ncells):
            raise GridError("cell counts must be integers")
        if any(n < 1 for n in self.ncells):
            raise GridError("cell counts must be positive")
        if any(h <= low for low, h in zip(self.lo, self.hi, strict=True)):
            raise GridError("upper limits must exceed lower limits")
        if self.voxel_size <= 0:
            raise GridError("the voxel size must be positive")
        if any(self.voxel_size > c * (1 + 1e-12) for c in self.cell):
            raise GridError("a voxel may not be larger than a cell")
        if self.origin is not None and len(self.origin) != len(self.ncells):
            raise GridError("the origin has another number of axes")

    @property
    def ndims(self) -> int:
        return len(self.ncells)

    @property
    def cell(self) -> tuple[float, ...]:
        return tuple((h - low) / n for low, h, n in zip(self.lo, self.hi, self.ncells, strict=True))

    @property
    def nodes(self) -> tuple[int, ...]:
        return tuple(n + 1 for n in self.ncells)

    @property
    def zero(self) -> tuple[float, ...]:
        return self.origin or (0.0,) * self.ndims

    @property
    def voxel_axes(self) -> tuple[str, ...]:
        return VOXEL[: self.ndims]

    @property
    def node_axes(self) -> tuple[str, ...]:
        return NODE[: self.ndims]

    @property
    def cell_axes(self) -> tuple[str, ...]:
        return CELL[: self.ndims]

    @property
    def voxels_per_cell(self) -> float:
        return max(self.cell) / self.voxel_size

    @property
    def reach(self) -> int:
        """Deeper voxels weigh 1, and those farther out 0."""
        return math.ceil(1.5 * self.voxels_per_cell + 0.5)

    @property
    def padding(self) -> int:
        """Voxels around the solid that a dense lattice of it has."""
        return 2 * self.reach

    def centre(self, axis: int) -> Column:
        """Centre of a voxel on an axis, from its index."""
        return F.col(self.voxel_axes[axis]) * F.lit(float(self.voxel_size)) + F.lit(float(self.zero[axis]))

    def cell_of(self, axis: int, position: Column) -> Column:
        return F.floor((position - F.lit(float(self.lo[axis]))) / F.lit(float(self.cell[axis]))).cast("int")

    def node_position(self, axis: int, index: Column) -> Column:
        return F.lit(float(self.lo[axis])) + index * F.lit(float(self.cell[axis]))

    def margin(self) -> float:
        """Distance that voxel centres keep from the box's sides."""
        return 1.5 * max(self.cell) + self.voxel_size if self.weighted else 0.5 * (max(self.cell) + self.voxel_size)

    def fits(self, voxels: DataFrame) -> DataFrame:
        """One row: ``fits``, whether all voxel centres keep the margin (true for no voxel)."""
        inside = F.lit(True)
        for a in range(self.ndims):
            inside = inside & (self.centre(a) >= self.lo[a] + self.margin()) & (self.centre(a) <= self.hi[a] - self.margin())
        return voxels.agg(F.coalesce(F.bool_and(inside), F.lit(True)).alias("fits"))

    def check(self, voxels: DataFrame) -> None:
        if not self.fits(voxels).first().fits:
            raise GridError("voxels are too close to the sides of the grid")


def encode(index: Sequence[Column], dims: Sequence[int]) -> Column:
    """Linear index of a lattice position, first axis fastest."""
    out = index[-1].cast("long")
    for a in range(len(index) - 2, -1, -1):
        out = out * dims[a] + index[a]
    return out


def decode(flat: Column, dims: Sequence[int]) -> list[Column]:
    """Axis indices of a linear index."""
    out, rest = [], flat
    for n in dims[:-1]:
        out.append((rest % n).cast("int"))
        rest = F.floor(rest / n)
    return [*out, rest.cast("int")]
