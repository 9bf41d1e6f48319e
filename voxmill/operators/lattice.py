"""Voxel lattices: snapping, padding, signed depth, weights and exposed faces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..spec import GridSpec

#: Larger than any rook distance on a lattice.
FAR = 1 << 30


def snap(points: DataFrame, spec: GridSpec, columns: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """``points`` with the indices of the nearest lattice positions, halves to even."""
    for a, name in enumerate(spec.voxel_axes):
        points = points.withColumn(name, F.rint((F.col(columns[a]) - float(spec.zero[a])) / float(spec.voxel_size)).cast("int"))
    return points


def collapse(snapped: DataFrame, axes: tuple[str, ...], oid: str = "oid") -> DataFrame:
    """One row for each lattice position: the last input row wins; ``n_input`` counts those that met there."""
    return snapped.groupBy(*axes).agg(F.max(oid).alias(oid), F.count("*").alias("n_input"))


def bounds(voxels: DataFrame, axes: tuple[str, ...]) -> list[tuple[int, int]]:
    """Lowest and highest index of each axis: one row comes to the driver."""
    row = voxels.agg(*(f(a).alias(f"{n}_{a}") for a in axes for n, f in (("lo", F.min), ("hi", F.max)))).first()
    return [(row[f"lo_{a}"], row[f"hi_{a}"]) for a in axes]


def padded(voxels: DataFrame, spec: GridSpec) -> DataFrame:
    """Every lattice position of the voxels' box with its padding, with ``solid``."""
    spark: SparkSession = voxels.sparkSession
    box = bounds(voxels, spec.voxel_axes)
    if box[0][0] is None:
        return voxels.select(*spec.voxel_axes, F.lit(True).alias("solid")).limit(0)
    pad, full = spec.padding, None
    sizes = [hi - lo + 1 + 2 * pad for lo, hi in box]
    total = 1
    for n in sizes:
        total *= n
    rest, full = F.col("id"), spark.range(total)
    for (lo, _), n, a in zip(box, sizes, spec.voxel_axes, strict=True):
        full = full.withColumn(a, (rest % n + lo - pad).cast("int"))
        rest = F.floor(rest / n)
    solid = voxels.select(*spec.voxel_axes).distinct().withColumn("solid", F.lit(True))
    return full.drop("id").join(solid, list(spec.voxel_axes), "left").withColumn("solid", F.coalesce("solid", F.lit(False)))


def depth(lattice: DataFrame, axes: tuple[str, ...]) -> DataFrame:
    """``lattice`` with ``depth``: rook steps from the surface, 0 on exposed solid and -1 on the nearest void.

    A distance transform in one pass of running minima per axis: no iteration.
    ``lattice`` holds every position of a box; positions outside it count as
    nothing. Where the box has no void (or no solid), depth is ``FAR``.
    """
    out = lattice.withColumns({"void_at": F.when(F.col("solid"), FAR).otherwise(0), "solid_at": F.when(F.col("solid"), 0).otherwise(FAR)})
    for a in axes:
        line = Window.partitionBy(*(x for x in axes if x != a)).orderBy(a)
        up, down = line.rowsBetween(Window.unboundedPreceding, 0), line.rowsBetween(0, Window.unboundedFollowing)
        out = out.withColumns({c: F.least(F.min(F.col(c) - F.col(a)).over(up) + F.col(a), F.min(F.col(c) + F.col(a)).over(down) - F.col(a)) for c in ("void_at", "solid_at")})
    signed = F.when(F.col("solid"), F.col("void_at") - 1).otherwise(-F.col("solid_at"))
    return out.withColumn("depth", F.greatest(F.lit(-FAR), F.least(F.lit(FAR), signed)).cast("int")).drop("void_at", "solid_at")


def surface(voxels: DataFrame, axes: tuple[str, ...]) -> DataFrame:
    """The voxels (indices alone) that end a run of voxels along some axis: those with an exposed face."""
    out, ends = voxels.select(*axes).distinct(), F.lit(False)
    for a in axes:
        line = Window.partitionBy(*(x for x in axes if x != a)).orderBy(a)
        alone = F.coalesce(F.lag(a).over(line) != F.col(a) - 1, F.lit(True)) | F.coalesce(F.lead(a).over(line) != F.col(a) + 1, F.lit(True))
        out, ends = out.withColumn(f"__{a}", alone), ends | F.col(f"__{a}")
    return out.where(ends).select(*axes)


def near_surface(voxels: DataFrame, axes: tuple[str, ...], reach: int) -> DataFrame:
    """``(*axes, steps)``: positions within ``reach`` rook steps of a surface voxel, solid or void, with the fewest steps.

    A shortest way from a solid position to the void, or from the void to the
    solid, meets no other surface voxel before its last step, so these steps are
    depths. Steps are added axis by axis and the fewest kept, so rows grow with the
    surface, not with the box around it.
    """
    out = surface(voxels, axes).withColumn("steps", F.lit(0))
    for a in axes:
        left = F.lit(reach) - F.col("steps")
        moved = out.withColumn("by", F.explode(F.sequence(-left, left)))
        moved = moved.select(*((F.col(x) + F.col("by")).cast("int").alias(x) if x == a else x for x in axes), (F.col("steps") + F.abs("by")).alias("steps"))
        out = moved.groupBy(*axes).agg(F.min("steps").alias("steps"))
    return out


def shell_depth(voxels: DataFrame, axes: tuple[str, ...], reach: int) -> DataFrame:
    """``(*axes, solid, depth)`` of all voxels, and of void positions within ``reach`` steps of one; as ``depth``, but at most ``reach``."""
    solid = voxels.select(*axes).distinct().withColumn("solid", F.lit(True))
    both = near_surface(voxels, axes, reach).join(solid, list(axes), "full").withColumn("solid", F.coalesce("solid", F.lit(False)))
    return both.withColumn("depth", F.when(F.col("solid"), F.coalesce("steps", F.lit(reach))).otherwise(-F.col("steps"))).drop("steps")


def solid_depth(voxels: DataFrame, axes: tuple[str, ...]) -> DataFrame:
    """``(*axes, depth)`` of the voxels, however deep: as ``depth``, but without a box around them.

    The void nearest to a position in a line ends the run of voxels it is in, and
    no way along the line past that void is shorter. So each axis takes running
    minima within runs of voxels, whose ends are one step from a void.
    """
    out = voxels.select(*axes).distinct().withColumn("void_at", F.lit(FAR))
    for a in axes:
        line = Window.partitionBy(*(x for x in axes if x != a)).orderBy(a)
        out = out.withColumn("run", F.col(a) - F.row_number().over(line))
        run = Window.partitionBy(*(x for x in axes if x != a), "run").orderBy(a)
        up, down = run.rowsBetween(Window.unboundedPreceding, 0), run.rowsBetween(0, Window.unboundedFollowing)
        below = F.least(F.min(F.col("void_at") - F.col(a)).over(up), F.min(a).over(up) * -1 + 1) + F.col(a)
        above = F.least(F.min(F.col("void_at") + F.col(a)).over(down), F.max(a).over(down) + 1) - F.col(a)
        out = out.withColumn("void_at", F.least(below, above)).drop("run")
    return out.select(*axes, (F.col("void_at") - 1).cast("int").alias("depth"))


def whole_depth(voxels: DataFrame, axes: tuple[str, ...], reach: int) -> DataFrame:
    """``(*axes, solid, depth)`` of the same positions as ``shell_depth``, the voxels' depths however deep they are."""
    deep = solid_depth(voxels, axes).withColumn("solid", F.lit(True))
    void = near_surface(voxels, axes, reach).join(voxels.select(*axes), list(axes), "left_anti")
    return deep.select(*axes, "solid", "depth").unionByName(void.select(*axes, F.lit(False).alias("solid"), (-F.col("steps")).alias("depth")))


def weight(spec: GridSpec, depth_: Column | None = None) -> Column:
    """A voxel's weight from its depth; 1 or 0 for solid or void in an unweighted grid."""
    d = F.col("depth") if depth_ is None else depth_
    if not spec.weighted:
        return F.when(d >= 0, F.lit(1.0)).otherwise(F.lit(0.0))
    raw = F.lit(0.5) * (F.lit(1.0) + (F.lit(0.5) + d) * F.lit(2.0) / F.lit(3.0 * spec.voxels_per_cell))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def exposed_faces(voxels: DataFrame, axes: tuple[str, ...], carry: tuple[str, ...] = ()) -> DataFrame:
    """``(*axes, face, *carry)`` for the faces of voxels with no voxel beyond; face = 2 * axis + (1 on the upper side).

    An anti join of each voxel's neighbours with the voxels themselves.
    """
    sides = F.explode(F.array(*(F.struct(F.lit(2 * a + s).alias("face"), *(F.lit((1 if s else -1) if a == b else 0).alias(f"d{n}") for b, n in enumerate(axes))) for a in range(len(axes)) for s in (0, 1))))
    each = voxels.select(*axes, *carry, sides.alias("s")).select(*axes, *carry, "s.face", *((F.col(n) + F.col(f"s.d{n}")).cast("int").alias(f"to_{n}") for n in axes))
    taken = voxels.select(*(F.col(n).alias(f"to_{n}") for n in axes)).distinct()
    return each.join(taken, [f"to_{n}" for n in axes], "left_anti").select(*axes, "face", *carry)


def face_corners(spec: GridSpec) -> list[Column]:
    """Corner coordinates of the face in ``face`` as struct columns x, y[, z], counter-clockwise seen from outside."""
    half, dims = spec.voxel_size / 2, spec.ndims
    around = [(0,), (1,)] if dims == 2 else [(0, 0), (1, 0), (1, 1), (0, 1)]
    out = []
    for corner in range(len(around)):
        coordinates = []
        for b in range(dims):
            sign = F.lit(0)
            for face in range(2 * dims):
                a, s = divmod(face, 2)
                if b == a:
                    value = 1 if s else -1
                else:
                    others = [(a + 1) % dims, (a + 2) % dims][: dims - 1]
                    turn = around[corner] if s == (1 if dims == 3 or a == 0 else 0) else around[::-1][corner]
                    value = 2 * turn[others.index(b)] - 1
                sign = F.when(F.col("face") == face, value).otherwise(sign)
            coordinates.append((spec.centre(b) + sign * F.lit(half)).alias("xyz"[b]))
        out.append(F.struct(*coordinates))
    return out


def face_normal(axis: int) -> Column:
    """Component of the outward normal of ``face`` on an axis."""
    return F.when(F.floor(F.col("face") / 2) == axis, F.col("face") % 2 * 2 - 1).otherwise(0)
