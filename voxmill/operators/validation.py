"""Reference shapes, analytic fluxes and error measures for studies of resolution."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import project, vector
from ..functions.numbering import ensure_checkpoints, quantiles


def regular_polygon(spark: SparkSession, sides: int, radius: float, degrees: float = 0.0) -> DataFrame:
    """``side_id, ax, ay, bx, by`` counter-clockwise, the first vertex at 90 degrees plus the rotation."""
    turn = lambda n: F.lit(math.radians(90 + degrees)) + F.lit(2 * math.pi / sides) * n
    a, b = F.col("id"), F.col("id") + 1
    return spark.range(sides).select(F.col("id").cast("int").alias("side_id"), (radius * F.cos(turn(a))).alias("ax"), (radius * F.sin(turn(a))).alias("ay"), (radius * F.cos(turn(b))).alias("bx"), (radius * F.sin(turn(b))).alias("by"))


def polygon_measures(sides: DataFrame) -> DataFrame:
    """One row: perimeter and area of a closed polygon."""
    half = (F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")) / 2
    return sides.agg(F.sum(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))).alias("perimeter"), F.abs(F.sum(half)).alias("area"))


def inside_polygon(points: DataFrame, sides: DataFrame) -> DataFrame:
    """Rows of ``points`` (x, y) inside a convex counter-clockwise polygon or on its border.

    The sides, one row each, become one array that goes along with the points.
    """
    ring = sides.agg(F.collect_list(F.struct("ax", "ay", "bx", "by")).alias("ring"))
    cross = lambda s: (s["bx"] - s["ax"]) * (F.col("y") - s["ay"]) - (s["by"] - s["ay"]) * (F.col("x") - s["ax"])
    return points.crossJoin(ring).where(F.forall("ring", lambda s: cross(s) >= -1e-12)).drop("ring")  # one row


def inside_any_polygon(points: DataFrame, sides: DataFrame, cells: int | None = None, keep: str = "pid", border: float = 1e-12) -> DataFrame:
    """Rows of ``points`` (``keep``, x, y) inside any closed polygon of ``sides`` (ax, ay, bx, by) by the even-odd rule, or within ``border`` of a side.

    Concave polygons, holes and several rings are fine, of any number of sides in
    either direction; points with null coordinates are outside. The polygon's box
    is cut into slabs by y and cells by x, about as many slabs as the square root of
    the number of sides. Of the sides that cross a point's slab to its left, those
    that go all the way through the slab in cells before the point's are only
    counted, by cell and then summed along the slab; those that begin or end in
    the slab are tried with its points; and those in the point's own cell are
    too. So a point meets few sides however many the polygon has.
    """
    box = sides.agg(F.min(F.least("ax", "bx")).alias("x0"), F.max(F.greatest("ax", "bx")).alias("x1"), F.min(F.least("ay", "by")).alias("y0"), F.max(F.greatest("ay", "by")).alias("y1"), F.count("*").alias("n")).first()
    if not box.n:
        return points.limit(0)
    n = cells or max(1, min(4096, round(box.n**0.5)))
    w, h = ((hi - lo) / n or 1.0 for lo, hi in ((box.x0, box.x1), (box.y0, box.y1)))
    column = lambda x: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((x - F.lit(box.x0)) / w))).cast("int")
    slab = lambda y: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((y - F.lit(box.y0)) / h))).cast("int")
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    cut = sides.select("ax", "ay", "bx", "by", F.explode(F.sequence(slab(low - border), slab(high + border))).alias("slab"))
    # where the side runs within the slab, a little widened
    y0, y1 = F.lit(box.y0) + F.col("slab") * h, F.lit(box.y0) + (F.col("slab") + 1) * h
    at = lambda y: F.col("ax") + (y - F.col("ay")) / (F.col("by") - F.col("ay")) * (F.col("bx") - F.col("ax"))
    flat = F.col("ay") == F.col("by")
    from_x = F.when(flat, F.least("ax", "bx")).otherwise(F.least(at(F.greatest(low, F.least(high, y0))), at(F.greatest(low, F.least(high, y1)))))
    to_x = F.when(flat, F.greatest("ax", "bx")).otherwise(F.greatest(at(F.greatest(low, F.least(high, y0))), at(F.greatest(low, F.least(high, y1)))))
    slack = border + 1e-9 * w
    cut = cut.withColumns({"first": column(from_x - slack), "last": column(to_x + slack), "through": (low < y0 - 1e-9 * h) & (high > y1 + 1e-9 * h)})
    placed = points.where("x is not null and y is not null").where(F.col("x").between(box.x0 - border, box.x1 + border) & F.col("y").between(box.y0 - border, box.y1 + border))
    placed = placed.select(keep, "x", "y", slab(F.col("y")).alias("slab"), column(F.col("x")).alias("column"))
    crosses = ((F.col("ay") > F.col("y")) != (F.col("by") > F.col("y"))) & (F.col("x") > F.col("ax") + (F.col("y") - F.col("ay")) / F.when(~flat, F.col("by") - F.col("ay")) * (F.col("bx") - F.col("ax")))
    near = segment_distance() <= border
    # own cell: every side that touches it; before it: the ends alone, for what goes through is counted
    own = cut.withColumn("column", F.explode(F.sequence("first", "last"))).select("ax", "ay", "bx", "by", "slab", "column")
    here = placed.join(own, ["slab", "column"]).groupBy(keep).agg(F.count_if(crosses).alias("odd"), F.max(near).alias("on"))
    ends = cut.where(~F.col("through")).select("ax", "ay", "bx", "by", "slab", "last")
    passed = placed.join(ends, "slab").where(F.col("last") < F.col("column")).where((F.col("ay") > F.col("y")) != (F.col("by") > F.col("y"))).groupBy(keep).agg(F.count("*").alias("odd"), F.lit(False).alias("on"))
    counted = cut.where("through").where(F.col("last") < n - 1).groupBy("slab", (F.col("last") + 1).alias("column")).agg(F.count("*").alias("n"))
    steps = Window.partitionBy("slab").orderBy("column")
    counted = counted.select("slab", "column", F.sum("n").over(steps).alias("n"), F.coalesce(F.lead("column").over(steps), F.lit(n)).alias("until"))
    counted = counted.select("slab", F.explode(F.sequence("column", F.col("until") - 1)).alias("column"), "n")
    before = placed.join(counted, ["slab", "column"]).select(keep, F.col("n").alias("odd"), F.lit(False).alias("on"))
    total = here.unionByName(passed).unionByName(before).groupBy(keep).agg(F.sum("odd").alias("odd"), F.max("on").alias("on"))
    return points.join(total.where((F.col("odd") % 2 == 1) | F.col("on")).select(keep), keep, "left_semi")


def nearest_element(points: DataFrame, elements: DataFrame, bin_size: float) -> DataFrame:
    """``pid, elem_id, distance``: the segment nearest each point, its distance negative on the solid's side.

    Segments (ax, ay, bx, by, nx, ny) are entered in every bin their bounding box
    touches, points look at their own bin and the eight around it. Points whose
    neighbourhood holds no segment within ``bin_size`` go on to bins of eight times
    the size, until none is left. What is left is checkpointed in each round.
    """
    ensure_checkpoints(points.sparkSession)
    found, size = None, float(bin_size)
    rest, span = points.select("pid", "x", "y"), None
    limit = elements.agg(F.max(F.greatest(F.abs("ax"), F.abs("ay"), F.abs("bx"), F.abs("by"))).alias("m")).first().m
    if limit is None:
        return points.select("pid", F.lit(None).cast("long").alias("elem_id"), F.lit(None).cast("double").alias("distance")).limit(0)
    far = points.agg(F.max(F.greatest(F.abs("x"), F.abs("y"))).alias("m")).first().m or 0.0
    while True:
        last = size > 2 * (limit + far)
        span = lambda lo, hi: F.sequence(F.floor(lo / size).cast("long"), F.floor(hi / size).cast("long"))  # noqa: B023, E731
        entered = elements.withColumn("gx", F.explode(span(F.least("ax", "bx"), F.greatest("ax", "bx")))).withColumn("gy", F.explode(span(F.least("ay", "by"), F.greatest("ay", "by"))))
        around = F.explode(F.array(*(F.struct(F.lit(n % 3 - 1).alias("dx"), F.lit(n // 3 - 1).alias("dy")) for n in range(9))))
        looked = rest.withColumn("o", around).select("pid", "x", "y", (F.floor(F.col("x") / size) + F.col("o.dx")).alias("gx"), (F.floor(F.col("y") / size) + F.col("o.dy")).alias("gy"))
        met = looked.join(entered, ["gx", "gy"]).withColumns({"away": segment_distance(), "side": (F.col("x") - F.col("ax")) * F.col("nx") + (F.col("y") - F.col("ay")) * F.col("ny")})
        best = met.groupBy("pid").agg(F.min_by(F.struct("elem_id", "away", "side"), F.struct("away", "elem_id")).alias("b"))
        sure = best if last else best.where(F.col("b.away") <= size)
        sure = sure.checkpoint()
        part = sure.select("pid", F.col("b.elem_id").alias("elem_id"), (F.col("b.away") * F.when(F.col("b.side") < 0, -1.0).otherwise(1.0)).alias("distance"))
        found = part if found is None else found.unionByName(part)
        if last:
            return found
        rest = rest.join(sure.select("pid"), "pid", "left_anti").checkpoint()
        if rest.isEmpty():
            return found
        size *= 8


def segment_distance() -> Column:
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    size = dx * dx + dy * dy
    t = F.when(size > 0, ((F.col("x") - F.col("ax")) * dx + (F.col("y") - F.col("ay")) * dy) / size).otherwise(F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.hypot(F.col("x") - F.col("ax") - t * dx, F.col("y") - F.col("ay") - t * dy)


def line_distance(point: str, base: str, normal: str) -> Column:
    """Signed distance of a point struct from a line or plane through a base struct with a normal struct."""
    foot = project(vector(f"{point}.x", f"{point}.y"), vector(f"{base}.x", f"{base}.y"), vector(f"{normal}.x", f"{normal}.y"))
    return F.hypot(F.col(f"{point}.x") - foot[0], F.col(f"{point}.y") - foot[1])


def analytic_flux(theta: Column, shape: Callable[[Column], Column] = F.cos, base: float = 2.0) -> Column:
    return shape(theta) + base


def misplaced_by_layer(voxels: DataFrame) -> DataFrame:
    """``depth, n_voxels, n_misplaced`` for layers from the surface on, up to the first with none misplaced.

    ``voxels`` has depth and misplaced (boolean).
    """
    layers = voxels.groupBy("depth").agg(F.count("*").alias("n_voxels"), F.count_if("misplaced").alias("n_misplaced"))
    stop = layers.where("n_misplaced = 0").agg(F.min("depth").alias("stop"))
    return layers.crossJoin(stop).where(F.col("stop").isNull() | (F.col("depth") < F.col("stop"))).drop("stop")  # one row


def flux_error(measured: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: the mean absolute error of value against exact, in percent of exact (zero values left out)."""
    both = measured.join(exact, "oid").where("exact <> 0")
    return both.agg(F.avg(F.abs((F.col("value") - F.col("exact")) / F.col("exact")) * 100).alias("error_percent"), F.count("*").alias("n"))


def distribution(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """Of each group (or of the whole): lowest, quartile_1, middle, quartile_3 and highest value, exactly; null and missing values don't count."""
    return quantiles(df, by or [], column, {"lowest": 0.0, "quartile_1": 0.25, "middle": 0.5, "quartile_3": 0.75, "highest": 1.0})


def medians(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """The exact median of each column within each group, as of repeated measurements."""
    out = None
    for c in columns:
        each = quantiles(df, by, c, {c: 0.5})
        out = each if out is None else out.join(each, by, "full")
    return out


def sweep_matrix(cases: DataFrame, ratios: list[int]) -> DataFrame:
    """A row per ``voxel_ratio`` and a column per ``grid_ratio`` of ``error``; null where the voxel ratio is the smaller."""
    kept = cases.withColumn("error", F.when(F.col("voxel_ratio") >= F.col("grid_ratio"), F.col("error")))
    return kept.groupBy("voxel_ratio").pivot("grid_ratio", ratios).agg(F.first("error", ignorenulls=True))
