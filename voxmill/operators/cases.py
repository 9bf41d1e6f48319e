"""A validation case in one call: polygon to voxels to surface, and how far the surface is from what the voxels say."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spec import GridSpec
from . import lattice, squares, validation
from .pipeline import Surface, SurfaceMapper


def regular_block(spark: SparkSession, n: int, size: float, ndims: int = 3, low: float = 0.0) -> DataFrame:
    """``oid, x, y[, z]`` of a block of n voxels a side from ``low`` on; oid counts x first, z last."""
    rows = spark.range(n**ndims)
    return rows.select(F.col("id").alias("oid"), *((low + size / 2 + (F.floor(F.col("id") / n**a) % n) * size).alias("xyz"[a]) for a in range(ndims)))


@dataclass(frozen=True)
class Case:
    """``distances`` has i, j, solid, depth, distance and misplaced of the positions near the surface: a voxel outside it, or a void inside, is misplaced."""

    spec: GridSpec
    voxels: DataFrame
    surface: Surface
    distances: DataFrame


def polygon_case(sides: DataFrame, radius: float, voxel_ratio: int, grid_ratio: int, reach: int = 4) -> Case:
    """Voxels of ``radius / voxel_ratio`` whose centres lie in the polygon of ``sides`` (about the origin, within ``radius``), and their surface on cells of ``radius / grid_ratio``.

    Distances are taken of positions within ``reach`` rook steps of the voxels' own surface. ValueError for voxels larger than cells.
    """
    if voxel_ratio < grid_ratio:
        raise ValueError("voxels may not be larger than cells")
    spark, v, cell = sides.sparkSession, radius / voxel_ratio, radius / grid_ratio
    n = math.ceil((radius + v + 1.5 * cell) / cell)
    spec = GridSpec((-n * cell,) * 2, (n * cell,) * 2, (2 * n, 2 * n), v, (v / 2, v / 2))
    m = math.ceil(radius / v) + 1
    i, j = F.floor(F.col("id") % (2 * m)) - m, F.floor(F.col("id") / (2 * m)) - m
    centres = spark.range(4 * m * m).select(F.col("id").alias("oid"), ((i + 0.5) * v).alias("x"), ((j + 0.5) * v).alias("y"))
    voxels = validation.inside_any_polygon(centres, sides, keep="oid").checkpoint()
    surface = SurfaceMapper(spec, digits=9).run(voxels, check=False)
    near = lattice.shell_depth(lattice.snap(voxels, spec), spec.voxel_axes, reach)
    width = 2 * (m + reach + 1)
    near = near.withColumn("pid", ((F.col("j") + width // 2) * width + F.col("i") + width // 2).cast("long")).checkpoint()
    away = validation.nearest_element(near.select("pid", spec.centre(0).alias("x"), spec.centre(1).alias("y")), surface.elements, cell)
    placed = near.join(away.select("pid", "distance"), "pid").withColumn("misplaced", F.when(F.col("solid"), F.col("distance") > 0).otherwise(F.col("distance") <= 0))
    return Case(spec, voxels, surface, placed.select("i", "j", "solid", "depth", "distance", "misplaced").checkpoint())


def errors(case: Case, sides: DataFrame, radius: float) -> DataFrame:
    """One row: border voxels and misplaced positions (from the surface on, up to the first layer without), in percent of the border and of the polygon's area; the border's least and greatest distance over ``radius``; the perimeter's error in percent."""
    solid = validation.misplaced_by_layer(case.distances.where("solid"))
    void = validation.misplaced_by_layer(case.distances.where("not solid").withColumn("depth", -F.col("depth") - 1))
    wrong = solid.unionByName(void).agg(F.coalesce(F.sum("n_misplaced"), F.lit(0)).alias("n_misplaced"))
    border = case.distances.where("depth = 0").agg(F.count("*").alias("n_border"), (F.min("distance") / radius).alias("lowest"), (F.max("distance") / radius).alias("highest"))
    whole = validation.polygon_measures(sides).select("perimeter", "area")
    made = squares.perimeter(case.surface.elements).select(F.col("perimeter").alias("made"))
    row = border.crossJoin(wrong).crossJoin(whole).crossJoin(made)  # one row each
    share = lambda n, of: F.when(F.col(of) > 0, 100 * n / F.col(of))
    return row.select("n_border", "n_misplaced", share(F.col("n_misplaced"), "n_border").alias("border_percent"), share(F.col("n_misplaced") * case.spec.voxel_size**2, "area").alias("area_percent"), "lowest", "highest", share(F.col("made") - F.col("perimeter"), "perimeter").alias("perimeter_percent"))
