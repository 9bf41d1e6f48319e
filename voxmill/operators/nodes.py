"""Fill fractions of grid nodes from weighted voxels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spec import GridSpec

#: Weights up to this count as nothing.
LEAST_WEIGHT = 1e-6


def node_overlaps(weighted: DataFrame, spec: GridSpec) -> DataFrame:
    """A row for each voxel and node region that meet, with ``share``: weighted volume there over cell volume.

    A voxel is no larger than a cell, so it meets at most two regions per axis.
    """
    rows, share = weighted.where(F.col("weight") > LEAST_WEIGHT), F.col("weight")
    half = spec.voxel_size / 2
    for a, node in enumerate(spec.node_axes):
        h, lo = float(spec.cell[a]), float(spec.lo[a])
        first = F.floor((spec.centre(a) - half - lo) / h + 0.5)
        last = F.greatest(first, F.ceil((spec.centre(a) + half - lo) / h + 0.5) - 1)
        rows = rows.withColumn(node, F.explode(F.sequence(first.cast("int"), last.cast("int"))))
        middle = spec.node_position(a, F.col(node))
        share = share * (F.greatest(F.lit(0.0), F.least(spec.centre(a) + half, middle + h / 2) - F.greatest(spec.centre(a) - half, middle - h / 2)) / h)
    keep = F.lit(True)
    for node, n in zip(spec.node_axes, spec.nodes, strict=True):
        keep = keep & F.col(node).between(0, n - 1)
    return rows.where(keep).select(*spec.node_axes, share.alias("share"))


def node_fractions(weighted: DataFrame, spec: GridSpec, complete: bool = False) -> DataFrame:
    """``(*node axes, frac)``; with ``complete`` also the nodes that no voxel meets, at 0."""
    filled = node_overlaps(weighted, spec).groupBy(*spec.node_axes).agg(F.sum("share").alias("frac"))
    if not complete:
        return filled
    full, rest, total = weighted.sparkSession, F.col("id"), 1
    for n in spec.nodes:
        total *= n
    full = full.range(total)
    for node, n in zip(spec.node_axes, spec.nodes, strict=True):
        full = full.withColumn(node, (rest % n).cast("int"))
        rest = F.floor(rest / n)
    return full.drop("id").join(filled, list(spec.node_axes), "left").withColumn("frac", F.coalesce("frac", F.lit(0.0)))


def centre_fractions(weighted: DataFrame, spec: GridSpec, level: float = 0.499) -> DataFrame:
    """``(*node axes, frac, inside)``: each voxel is split at the centre of the cell that its own centre lies in, between that cell's nodes.

    Parts of a voxel beyond its cell stay with that cell; voxels in no cell of the grid are left out. ``inside``: more than ``level`` of a cell's volume.
    """
    rows, share = weighted.where(F.col("weight") > 1e-12), F.col("weight")
    size = float(spec.voxel_size)
    for a, node in enumerate(spec.node_axes):
        h = float(spec.cell[a])
        rows = rows.withColumn(node, spec.cell_of(a, spec.centre(a)))
        middle = spec.node_position(a, F.col(node)) + h / 2
        low = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (middle - (spec.centre(a) - size / 2)) / size))
        rows = rows.withColumn(f"low_{node}", low).withColumn(f"up_{node}", F.explode(F.array(F.lit(0), F.lit(1))))
        share = share * F.when(F.col(f"up_{node}") == 0, F.col(f"low_{node}")).otherwise(1 - F.col(f"low_{node}")) * (size / h)
    keep = F.lit(True)
    for node, n in zip(spec.node_axes, spec.ncells, strict=True):
        keep = keep & F.col(node).between(0, n - 1)
    placed = rows.where(keep).select(*((F.col(n) + F.col(f"up_{n}")).alias(n) for n in spec.node_axes), share.alias("share")).where("share > 0")
    return placed.groupBy(*spec.node_axes).agg(F.sum("share").alias("frac")).withColumn("inside", F.col("frac") > level)


def fill_total(fractions: DataFrame) -> DataFrame:
    """One row: the solid's volume in cells."""
    return fractions.agg(F.coalesce(F.sum("frac"), F.lit(0.0)).alias("cells_filled"))
