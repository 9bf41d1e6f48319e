"""Iso-surface triangles in space: a case table made by tracing, joined to cells.

For each pattern of corners inside the solid, and each choice on the ambiguous
faces, the boundary is traced over the six faces of the cell and its loops are
cut into triangles. The choice on a face comes from the sign of the bilinear
saddle, which the two cells at the face share, so the mesh stays closed. Tunnels
inside cells and vertices in their middle are ``topology``'s part.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import cross, minus, norm, triangle_area, vector
from ..functions.numbering import numbered
from ..spec import GridSpec, GridError

#: Corner c of a cell is at (c & 1, c >> 1 & 1, c >> 2): the fixed corner order.
CORNERS = tuple((c & 1, c >> 1 & 1, c >> 2) for c in range(8))
#: Edges as pairs of corners along an axis, lower corner first.
EDGES = tuple((c, c | 1 << a) for a in range(3) for c in range(8) if not c >> a & 1)


@cache
def faces() -> tuple[tuple[int, int, int, int], ...]:
    """Corners of each face, counter-clockwise from outside: 2 * axis + (1 on the upper side)."""
    out = []
    for a in range(3):
        for s in (0, 1):
            u, v = 1 << (a + 1) % 3, 1 << (a + 2) % 3
            ring = [s << a, s << a | u, s << a | u | v, s << a | v]
            out.append(tuple(ring if s else ring[::-1]))
    return tuple(out)


def ambiguous(index: int) -> list[int]:
    """Faces whose inside corners are two diagonal ones."""
    return [f for f, ring in enumerate(faces()) if [index >> c & 1 for c in ring] in ([1, 0, 1, 0], [0, 1, 0, 1])]


def trace(index: int, joined: int) -> list[list[int]]:
    """Loops of crossed edges. Bit f of ``joined``: the inside corners of the ambiguous face f are connected."""
    edge = {frozenset(e): n for n, e in enumerate(EDGES)}
    following: dict[int, int] = {}
    for f, ring in enumerate(faces()):
        inside = [index >> c & 1 for c in ring]
        leaves = [s for s in range(4) if inside[s] and not inside[(s + 1) % 4]]
        enters = [s for s in range(4) if not inside[s] and inside[(s + 1) % 4]]
        step = 1 if len(leaves) < 2 or joined >> f & 1 else -1
        for s in leaves:
            to = next((s + step * d) % 4 for d in range(1, 4) if (s + step * d) % 4 in enters)
            following[edge[frozenset((ring[s], ring[(s + 1) % 4]))]] = edge[frozenset((ring[to], ring[(to + 1) % 4]))]
    loops, seen = [], set()
    for start in sorted(following):
        loop, at = [], start
        while at not in seen:
            seen.add(at)
            loop.append(at)
            at = following[at]
        if loop:
            loops.append(loop)
    return loops


@cache
def cases(classic: bool = False) -> tuple[tuple[int, int, int, int, int, int], ...]:
    """(index, joined, triangle, edge, edge, edge), normals out of the solid; ``classic`` fixes all ambiguous faces as not joined."""
    out = []
    for index in range(1, 255):
        open_ = ambiguous(index)
        for choice in range(1 if classic else 1 << len(open_)):
            joined = sum(1 << f for n, f in enumerate(open_) if choice >> n & 1)
            n = 0
            for loop in trace(index, joined):
                for t in range(1, len(loop) - 1):
                    out.append((index, joined, n, loop[0], loop[t + 1], loop[t]))
                    n += 1
    return tuple(out)


def cells(fractions: DataFrame, level: float = 0.5, digits: int | None = None, step: int = 1, mask: DataFrame | None = None) -> DataFrame:
    """``ci, cj, ck, v0..v7, cube_index`` of cells that the surface crosses.

    Nodes go to the eight cells they belong to. ``step`` takes every step-th node;
    cells then have that size. ``mask`` has the nodes (ni, nj, nk) whose cell, the
    one they are the upper corner of, is to be used. Missing nodes count as 0;
    values are compared as 32-bit floats, and exactly ``level`` is outside.
    """
    value = (F.col("frac") if digits is None else F.round("frac", digits)).cast("float").cast("double")
    nodes = fractions.where((F.col("ni") % step == 0) & (F.col("nj") % step == 0) & (F.col("nk") % step == 0)) if step > 1 else fractions
    to = F.explode(F.array(*(F.struct(F.lit(c).alias("corner"), *(F.lit(-step * p[a]).alias(x) for a, x in enumerate(("dx", "dy", "dz")))) for c, p in enumerate(CORNERS))))
    sent = nodes.select("ni", "nj", "nk", value.alias("v"), to.alias("to")).select(*((F.col(n) + F.col(f"to.{d}")).alias(c) for n, d, c in (("ni", "dx", "ci"), ("nj", "dy", "cj"), ("nk", "dz", "ck"))), "to.corner", "v")
    made = sent.groupBy("ci", "cj", "ck").agg(*(F.coalesce(F.max(F.when(F.col("corner") == c, F.col("v"))), F.lit(0.0)).alias(f"v{c}") for c in range(8)))
    index = sum((F.when(F.col(f"v{c}") > level, 1 << c).otherwise(0) for c in range(1, 8)), F.when(F.col("v0") > level, 1).otherwise(0))
    made = made.withColumn("cube_index", index.cast("int")).where(~F.col("cube_index").isin(0, 255))
    if mask is not None:
        upper = mask.select((F.col("ni") - step).alias("ci"), (F.col("nj") - step).alias("cj"), (F.col("nk") - step).alias("ck")).distinct()
        made = made.join(upper, ["ci", "cj", "ck"], "left_semi")
    return made


def check_level(fractions: DataFrame, level: float | None) -> float:
    """The level, mid-range by default; GridError outside the values' range."""
    row = fractions.agg(F.min("frac").alias("lo"), F.max("frac").alias("hi")).first()
    if row.lo is None:
        raise GridError("there are no node values")
    level = (row.lo + row.hi) / 2 if level is None else level
    if not row.lo <= level <= row.hi:
        raise GridError("the level is outside the range of node values")
    return level


def joined_faces(level: float) -> Column:
    """Bits of the ambiguous faces whose inside corners are connected: the saddle value is inside."""
    bits = F.lit(0)
    for f, ring in enumerate(faces()):
        a, b, c, d = (F.col(f"v{x}") - level for x in ring)
        mixed = ((a > 0) == (c > 0)) & ((b > 0) == (d > 0)) & ((a > 0) != (b > 0))
        inside = F.when(a > 0, a * c - b * d).otherwise(b * d - a * c) > 0
        bits = bits + F.when(mixed & inside, 1 << f).otherwise(0)
    return bits


def located(cells_: DataFrame, level: float = 0.5) -> DataFrame:
    """Adds the keys of the case table: ``joined``, bits of joined faces, and ``inner``, which diagonal inside the cell joins two loops (4: none)."""
    from . import topology

    return cells_.withColumn("joined", joined_faces(level).cast("int")).withColumn("inside", topology.joined_inside(level).cast("int")).withColumn("inner", topology.inner_bit(level)).drop("inside")


def centre(level: float) -> list[Column]:
    """The vertex inside a cell, in cells from its lowest corner: the mean of the corners by one over their distance from the level."""
    strength = [1 / (F.abs(F.col(f"v{c}") - level) + 2.0**-52) for c in range(8)]
    total = sum(strength[1:], strength[0])
    return [sum((s for c, s in enumerate(strength) if c >> b & 1 and c != 1 << b), strength[1 << b]) / total for b in range(3)]


def triangles(cells_: DataFrame, spec: GridSpec, level: float = 0.5, classic: bool = False, flip: bool = False, step: int = 1, interior: bool = True) -> DataFrame:
    """``ci, cj, ck, part, t0, t1, t2, e0, e1, e2``: corners (structs x, y, z) and the lattice edges they lie on.

    Vertices divide an edge in proportion to the level; one inside a cell has that
    cell in place of an edge, with axis 3. ``flip`` reverses the winding, ``classic``
    takes one mesh for each pattern of corners, and without ``interior`` loops are
    never joined inside a cell.
    """
    from . import topology

    spark = cells_.sparkSession
    if classic:
        table = spark.createDataFrame([(i, j, n, *e) for i, j, n, *e in cases(classic)], "cube_index int, joined int, part int, s0 int, s1 int, s2 int")
        rows = cells_.withColumn("joined", F.lit(0)).join(F.broadcast(table), ["cube_index", "joined"])  # a fixed table
    else:
        table = spark.createDataFrame([list(c) for c in topology.cases() if interior or c[2] == 4], "cube_index int, joined int, inner int, part int, s0 int, s1 int, s2 int")
        keyed = located(cells_, level) if interior else cells_.withColumn("joined", joined_faces(level).cast("int")).withColumn("inner", F.lit(4))
        rows = keyed.join(F.broadcast(table), ["cube_index", "joined", "inner"])  # a fixed table
    values = F.array(*(F.col(f"v{c}") for c in range(8)))
    low = F.array(*(F.lit(a) for a, _ in EDGES), F.lit(0))
    high = F.array(*(F.lit(b) for _, b in EDGES), F.lit(0))
    axis = F.array(*(F.lit((b - a).bit_length() - 1) for a, b in EDGES), F.lit(3))
    rows = rows.withColumns({"v": values, "m": F.array(*centre(level))})
    for n in range(3):
        slot = F.col(f"s{n}") + 1
        rows = rows.withColumns({f"c{n}": F.element_at(low, slot), f"a{n}": F.element_at(axis, slot), f"h{n}": F.element_at(high, slot)})
        rows = rows.withColumn(f"w{n}", F.when(F.col(f"a{n}") < 3, (F.lit(level) - F.element_at("v", F.col(f"c{n}") + 1)) / (F.element_at("v", F.col(f"h{n}") + 1) - F.element_at("v", F.col(f"c{n}") + 1))))
    out = []
    for n in (0, 2, 1) if flip else (0, 1, 2):
        at = [F.col(x) + step * F.expr(f"(c{n} >> {b}) & 1") for b, x in enumerate(("ci", "cj", "ck"))]
        point = [spec.node_position(b, x + step * F.when(F.col(f"a{n}") == 3, F.element_at("m", b + 1)).when(F.col(f"a{n}") == b, F.col(f"w{n}")).otherwise(0.0)) for b, x in enumerate(at)]
        m = len(out) // 2
        out += [F.struct(*(p.alias(x) for p, x in zip(point, "xyz", strict=True))).alias(f"t{m}"), F.struct(*(x.cast("int").alias(y) for x, y in zip(at, ("ni", "nj", "nk"), strict=True)), F.col(f"a{n}").alias("axis")).alias(f"e{m}")]
    return rows.select("ci", "cj", "ck", "part", *out)


def attributes(triangles_: DataFrame) -> DataFrame:
    """Adds area, the unit normal (null for area 0), the centroid and the longest extent."""
    a, b, c = (vector(f"t{n}.x", f"t{n}.y", f"t{n}.z") for n in range(3))
    n = cross(minus(b, a), minus(c, a))
    size = norm(n)
    centroid = [(p + q + r) / 3 for p, q, r in zip(a, b, c, strict=True)]
    extent = F.greatest(*(F.greatest(p, q, r) - F.least(p, q, r) for p, q, r in zip(a, b, c, strict=True)))
    return triangles_.withColumns({"area": triangle_area(a, b, c), **{f"n{x}": F.when(size > 0, v / size) for x, v in zip("xyz", n, strict=True)}, **{f"g{x}": v for x, v in zip("xyz", centroid, strict=True)}, "extent": extent})


def surface_area(triangles_: DataFrame) -> DataFrame:
    a, b, c = (vector(f"t{n}.x", f"t{n}.y", f"t{n}.z") for n in range(3))
    volume = sum((x * y for x, y in zip(a[1:], cross(b, c)[1:], strict=True)), a[0] * cross(b, c)[0]) / 6
    return triangles_.agg(F.coalesce(F.sum(triangle_area(a, b, c)), F.lit(0.0)).alias("area"), F.coalesce(F.sum(volume), F.lit(0.0)).alias("volume"), F.count("*").alias("n_triangles"))


def indexed(triangles_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(vertices: vid, x, y, z)`` and ``(faces: elem_id, a, b, c)`` from 0 in lattice order.

    Corners at equal coordinates are one vertex (a node exactly at the level makes
    several edges meet there), and faces left with two equal corners go.
    """
    corners = triangles_.select("ci", "cj", "ck", "part", F.posexplode(F.array("t0", "t1", "t2")).alias("corner", "t"))
    corners = corners.select("ci", "cj", "ck", "part", "corner", *((F.col(f"t.{x}") + F.lit(0.0)).alias(x) for x in "xyz"))
    vertices = numbered(corners.select("x", "y", "z").distinct(), ["z", "y", "x"], "vid")
    named = corners.join(vertices, ["x", "y", "z"]).groupBy("ci", "cj", "ck", "part").agg(*(F.max(F.when(F.col("corner") == n, F.col("vid"))).alias(x) for n, x in enumerate("abc")))
    whole = named.where("a <> b and b <> c and a <> c")
    return vertices.select("vid", "x", "y", "z"), numbered(whole, ["ck", "cj", "ci", "part"], "elem_id").select("elem_id", "a", "b", "c")


def vertex_normals(vertices: DataFrame, faces_: DataFrame) -> DataFrame:
    """``vid`` and a unit normal, the area-weighted mean of its faces'."""
    rows = faces_
    for x in "abc":
        rows = rows.join(vertices.select(F.col("vid").alias(x), F.struct("x", "y", "z").alias(f"p{x}")), x)
    n = cross(minus(vector("pb.x", "pb.y", "pb.z"), vector("pa.x", "pa.y", "pa.z")), minus(vector("pc.x", "pc.y", "pc.z"), vector("pa.x", "pa.y", "pa.z")))
    each = rows.select(F.explode(F.array("a", "b", "c")).alias("vid"), *(v.alias(f"n{x}") for v, x in zip(n, "xyz", strict=True)))
    total = each.groupBy("vid").agg(*(F.sum(f"n{x}").alias(f"n{x}") for x in "xyz"))
    size = norm(vector("nx", "ny", "nz"))
    return total.select("vid", *((F.col(f"n{x}") / F.when(size > 0, size)).alias(f"n{x}") for x in "xyz"))


def gradient_normals(cells_: DataFrame, triangles_: DataFrame, vertices: DataFrame, level: float = 0.5, step: int = 1) -> DataFrame:
    """``vid`` and a unit normal from the node values: the differences along the cell's edges at both ends of the vertex's edge.

    An end counts by one over its distance from the level, in each triangle corner
    at the vertex; a vertex inside a cell has all its corners for ends. Differences are the lower corner's value less the upper
    one's, so normals leave the solid. Null where they cancel.
    """
    corner = F.explode(F.array(*(F.struct(F.col(f"e{n}").alias("e"), F.col(f"t{n}").alias("t")) for n in range(3)))).alias("p")
    low = sum((F.floor((F.col(f"p.e.{n}") - F.col(c)) / step).cast("int") * (1 << b) for b, (n, c) in enumerate((("nj", "cj"), ("nk", "ck")), 1)), F.floor((F.col("p.e.ni") - F.col("ci")) / step).cast("int"))
    values = cells_.select("ci", "cj", "ck", F.array(*(F.col(f"v{c}") for c in range(8))).alias("v"))
    ends = triangles_.select("ci", "cj", "ck", corner).select("ci", "cj", "ck", "p.t", low.alias("low"), F.col("p.e.axis").alias("axis")).join(values, ["ci", "cj", "ck"])
    ends = ends.withColumn("end", F.explode(F.when(F.col("axis") == 3, F.sequence(F.lit(0), F.lit(7))).otherwise(F.array("low", F.col("low").bitwiseOR(F.expr("shiftleft(1, axis)"))))))
    at = lambda c: F.element_at("v", c + 1)
    strength = 1 / (F.abs(at(F.col("end")) - level) + 2.0**-52)
    parts = [((at(F.col("end").bitwiseAND(7 - (1 << b))) - at(F.col("end").bitwiseOR(F.lit(1 << b)))) * strength).alias(f"n{x}") for b, x in enumerate("xyz")]
    total = ends.select(*((F.col(f"t.{x}") + F.lit(0.0)).alias(x) for x in "xyz"), *parts).groupBy("x", "y", "z").agg(*(F.sum(f"n{x}").alias(f"n{x}") for x in "xyz"))
    size = norm(vector("nx", "ny", "nz"))
    return vertices.join(total, ["x", "y", "z"]).select("vid", *((F.col(f"n{x}") / F.when(size > 0, size)).alias(f"n{x}") for x in "xyz"))


def vertex_values(cells_: DataFrame, triangles_: DataFrame) -> DataFrame:
    """``edge, value``: for each crossed lattice edge, the largest range of node values among its cells (0 included)."""
    span = F.greatest(F.lit(0.0), *(F.col(f"v{c}") for c in range(8))) - F.least(F.lit(0.0), *(F.col(f"v{c}") for c in range(8)))
    each = triangles_.select("ci", "cj", "ck", F.explode(F.array("e0", "e1", "e2")).alias("edge")).join(cells_.select("ci", "cj", "ck", span.alias("value")), ["ci", "cj", "ck"])
    return each.groupBy("edge").agg(F.max("value").alias("value"))


def vertex_spans(cells_: DataFrame, triangles_: DataFrame, vertices: DataFrame) -> DataFrame:
    """``vid, value``: for each vertex, the largest range of node values among the cells that meet there (0 included)."""
    span = F.greatest(F.lit(0.0), *(F.col(f"v{c}") for c in range(8))) - F.least(F.lit(0.0), *(F.col(f"v{c}") for c in range(8)))
    each = triangles_.select("ci", "cj", "ck", F.explode(F.array("t0", "t1", "t2")).alias("t")).join(cells_.select("ci", "cj", "ck", span.alias("value")), ["ci", "cj", "ck"])
    each = each.select(*((F.col(f"t.{x}") + F.lit(0.0)).alias(x) for x in "xyz"), "value").groupBy("x", "y", "z").agg(F.max("value").alias("value"))
    return vertices.join(each, ["x", "y", "z"]).select("vid", "value")


def iso_surface(fractions: DataFrame, spec: GridSpec, level: float | None = None, digits: int | None = None, step: int = 1, mask: DataFrame | None = None, classic: bool = False, flip: bool = False, gradients: bool = False, interior: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(vertices: vid, x, y, z, nx, ny, nz, value)`` and ``(faces: elem_id, a, b, c)`` of the surface of node values at ``level`` (mid-range by default).

    Normals are area-weighted means of the faces', or with ``gradients`` those of the node values; ``value`` is the largest range
    of node values about a vertex. GridError for a level outside the values' range.
    """
    level = check_level(fractions, level)
    crossed = cells(fractions, level, digits, step, mask)
    made = triangles(crossed, spec, level, classic, flip, step, interior)
    vertices, faces_ = indexed(made)
    normals = gradient_normals(crossed, made, vertices, level, step) if gradients else vertex_normals(vertices, faces_)
    return vertices.join(normals, "vid", "left").join(vertex_spans(crossed, made, vertices), "vid"), faces_
