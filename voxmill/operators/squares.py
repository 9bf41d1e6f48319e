"""Boundary segments in the plane: marching squares as a grouping and a small case table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbering import numbered
from ..spec import GridSpec

#: Corners of a cell counter-clockwise from the lower left, as node offsets; side n runs from corner n to the next.
CORNERS = ((0, 0), (1, 0), (1, 1), (0, 1))


def cases() -> list[tuple[int, int, int]]:
    """(topology, side where the segment starts, side where it ends), solid on the left.

    Going round a cell, the boundary leaves the solid at some sides and enters it
    at others. A segment leads from each leaving side to the next entering one, so
    in the two ambiguous cases it cuts off an empty corner.
    """
    out = []
    for topology in range(16):
        inside = [topology >> c & 1 for c in range(4)]
        leaves = [s for s in range(4) if inside[s] and not inside[(s + 1) % 4]]
        enters = [s for s in range(4) if not inside[s] and inside[(s + 1) % 4]]
        out += [(topology, s, next((s + d) % 4 for d in range(1, 4) if (s + d) % 4 in enters)) for s in leaves]
    return out


def cells(fractions: DataFrame, level: float = 0.5, digits: int | None = None) -> DataFrame:
    """``ci, cj, topology, f0..f3`` of cells that the boundary crosses.

    Every node is sent to the four cells it belongs to and they meet in one
    grouping. Nodes that are missing count as 0. ``digits`` rounds fractions before
    they are compared, against noise in the last place.
    """
    value = F.col("frac") if digits is None else F.round("frac", digits)
    to = F.explode(F.array(*(F.struct(F.lit(c).alias("corner"), F.lit(-x).alias("dx"), F.lit(-y).alias("dy")) for c, (x, y) in enumerate(CORNERS))))
    sent = fractions.select("ni", "nj", value.alias("f"), to.alias("to")).select((F.col("ni") + F.col("to.dx")).alias("ci"), (F.col("nj") + F.col("to.dy")).alias("cj"), "to.corner", "f")
    made = sent.groupBy("ci", "cj").agg(*(F.coalesce(F.max(F.when(F.col("corner") == c, F.col("f"))), F.lit(0.0)).alias(f"f{c}") for c in range(4)))
    topology = sum((F.when(F.col(f"f{c}") >= level, 1 << c).otherwise(0) for c in range(1, 4)), F.when(F.col("f0") >= level, 1).otherwise(0))
    return made.withColumn("topology", topology.cast("int")).where(~F.col("topology").isin(0, 15))


def within(cells_: DataFrame, spec: GridSpec) -> DataFrame:
    return cells_.where(F.col("ci").between(0, spec.ncells[0] - 1) & F.col("cj").between(0, spec.ncells[1] - 1))


def _crossing(side: Column, spec: GridSpec, level: float) -> tuple[Column, Column]:
    x = y = F.lit(None).cast("double")
    for s in range(4):
        (x0, y0), (x1, y1) = CORNERS[s], CORNERS[(s + 1) % 4]
        a, b = F.col(f"f{s}"), F.col(f"f{(s + 1) % 4}")
        t = (F.lit(level) - a) / (b - a)
        x = F.when(side == s, spec.node_position(0, F.col("ci") + x0 + t * (x1 - x0))).otherwise(x)
        y = F.when(side == s, spec.node_position(1, F.col("cj") + y0 + t * (y1 - y0))).otherwise(y)
    return x, y


def _edge(side: Column) -> Column:
    """The lattice edge a side lies on, shared by the two cells beside it: (node, axis)."""
    return F.struct((F.col("ci") + F.when(side == 1, 1).otherwise(0)).cast("int").alias("ni"), (F.col("cj") + F.when(side == 2, 1).otherwise(0)).cast("int").alias("nj"), (side % 2).cast("int").alias("axis"))


def segments(cells_: DataFrame, spec: GridSpec, level: float = 0.5) -> DataFrame:
    """``ci, cj, part, ax, ay, bx, by, a_edge, b_edge``: boundary segments with the solid on their left."""
    table = cells_.sparkSession.createDataFrame([(t, n, a, b) for t in range(16) for n, (_, a, b) in enumerate(c for c in cases() if c[0] == t)], "topology int, part int, a_side int, b_side int")
    rows = cells_.join(F.broadcast(table), "topology")  # 16 rows at most
    a, b = F.col("a_side"), F.col("b_side")
    (ax, ay), (bx, by) = _crossing(a, spec, level), _crossing(b, spec, level)
    made = rows.select("ci", "cj", "part", ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"), _edge(a).alias("a_edge"), _edge(b).alias("b_edge"))
    return made.where((F.col("ax") != F.col("bx")) | (F.col("ay") != F.col("by")))


def attributes(segments_: DataFrame) -> DataFrame:
    """Adds length, theta and the outward unit normal (nx, ny), a quarter turn clockwise from the direction."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    length = F.hypot(dx, dy)
    return segments_.withColumns({"length": length, "theta": F.atan2(dy, dx), "nx": dy / length, "ny": -dx / length})


def indexed(segments_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(vertices: vid, x, y)`` and ``(lines: elem_id, a, b)``, both counted from 0 in lattice order; one vertex per lattice edge crossed."""
    ends = segments_.select(F.explode(F.array(*(F.struct(F.col(f"{p}_edge").alias("e"), F.col(f"{p}x").alias("x"), F.col(f"{p}y").alias("y")) for p in "ab"))).alias("end")).select("end.*")
    vertices = numbered(ends.groupBy("e").agg(F.min("x").alias("x"), F.min("y").alias("y")).select("e.ni", "e.nj", "e.axis", "x", "y"), ["nj", "ni", "axis"], "vid")
    lines = numbered(segments_, ["cj", "ci", "part"], "elem_id")
    key = F.struct("ni", "nj", "axis")
    for end in ("a", "b"):
        lines = lines.join(vertices.select(key.alias(f"{end}_edge"), F.col("vid").alias(end)), f"{end}_edge")
    return vertices.select("vid", "x", "y"), lines.select("elem_id", "a", "b")


def perimeter(segments_: DataFrame) -> DataFrame:
    return segments_.agg(F.coalesce(F.sum(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))), F.lit(0.0)).alias("perimeter"), F.count("*").alias("n_segments"))
