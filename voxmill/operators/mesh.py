"""Mesh repair and comparison: near-equal vertices, degenerate faces, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import cross, minus, norm, triangle_area, vector
from ..functions.numbering import at_hand, checkpointed, ensure_checkpoints, numbered, written
from ..spec import GridError


def near_pairs(vertices: DataFrame, radius: float, axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """``(a, b)``, a < b: vertices within ``radius``, by a join of bins of that size and their neighbours."""
    bins = [F.floor(F.col(x) / radius).cast("long").alias(f"b{x}") for x in axes]
    left = vertices.select(F.col("vid").alias("a"), *axes, *bins)
    near = F.explode(F.array(*(F.struct(*(F.lit(n // 3**a % 3 - 1).alias(f"d{x}") for a, x in enumerate(axes))) for n in range(3 ** len(axes)))))
    right = vertices.select(F.col("vid").alias("b"), *(F.col(x).alias(f"{x}_") for x in axes), *bins, near.alias("near"))
    right = right.select("b", *(f"{x}_" for x in axes), *((F.col(f"b{x}") + F.col(f"near.d{x}")).alias(f"b{x}") for x in axes))
    away = sum(((F.col(x) - F.col(f"{x}_")) ** 2 for x in axes[1:]), (F.col(axes[0]) - F.col(f"{axes[0]}_")) ** 2)
    return left.join(right, [f"b{x}" for x in axes]).where("a < b").where(away <= radius * radius).select("a", "b")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, root)``, root the smallest node reachable, by minimum labels with shortcuts; each round is checkpointed.

    ``nodes`` has node; ``edges`` has a and b. Rounds grow with the logarithm of
    the longest path. Needs ``spark.checkpoint.dir`` on a cluster.
    """
    ensure_checkpoints(nodes.sparkSession)
    both = checkpointed(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    label = checkpointed(nodes.select("node", F.col("node").alias("root")).distinct())
    while True:
        low = both.join(label.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("low"))
        hooked = label.join(low, "node", "left").select("node", "root", F.least("root", F.coalesce("low", "root")).alias("next"))
        jump = hooked.select(F.col("node").alias("next"), F.col("next").alias("beyond"))
        new = checkpointed(hooked.join(jump, "next", "left").select("node", F.coalesce("beyond", "next").alias("root"), (F.coalesce("beyond", "next") != F.col("root")).alias("moved")))
        if new.where("moved").isEmpty():
            return new.select("node", "root")
        label = new.select("node", "root")


def _boxes(vertices: DataFrame, axes: tuple[str, ...], side: float) -> DataFrame:
    """``cell`` (array of numbers) and the box of the points in it: lo, hi, and their smallest vid."""
    cell = F.array(*(F.floor(F.col(x) / side).cast("long") for x in axes))
    return vertices.groupBy(cell.alias("cell")).agg(F.array(*(F.min(x) for x in axes)).alias("lo"), F.array(*(F.max(x) for x in axes)).alias("hi"), F.min("vid").alias("vid"))


def _apart(dims: int) -> tuple[Column, Column]:
    """Squares of the least and the greatest distance between points of the boxes lo..hi and lo_..hi_."""
    zero = F.lit(0.0)
    near = [F.greatest(zero, F.col("lo_")[n] - F.col("hi")[n], F.col("lo")[n] - F.col("hi_")[n]) for n in range(dims)]
    far = [F.greatest(F.col("hi_")[n] - F.col("lo")[n], F.col("hi")[n] - F.col("lo_")[n]) for n in range(dims)]
    return sum((x * x for x in near[1:]), near[0] * near[0]), sum((x * x for x in far[1:]), far[0] * far[0])


def _linked(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (node, root) after ``links`` (a, b: nodes that are roots) have joined groups; checkpointed where there are any."""
    links = checkpointed(links.distinct())
    if links.isEmpty():
        return roots
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node")))
    new = components(ends, links).select(F.col("node").alias("root"), F.col("root").alias("new"))
    return checkpointed(roots.join(new, "root", "left").select("node", F.coalesce("new", "root").alias("root")))


def _between(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """``pairs`` with a and b as the groups they are in now; pairs within a group go."""
    for x in "ab":
        pairs = pairs.join(roots.select(F.col("node").alias(x), F.col("root").alias(f"{x}_")), x).drop(x).withColumnRenamed(f"{x}_", x)
    return checkpointed(pairs.where("a <> b"))


#: Two cells are asked point by point if that compares each of their points with so many others at most, in the mean.
FEW = 64


def near_groups(vertices: DataFrame, radius: float, axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """``(node, root)``: for each vertex the smallest one that steps of at most ``radius`` reach, however many lie in one place.

    Cells are so small that the points of one are all near each other, so a cell is
    one node. Whether two cells hold near points is asked of the boxes of their
    points: near if even the farthest corners are, apart if even the nearest are not.
    What is between matters only for cells that are not in one group yet. Where
    the cells have few points these are compared, else the halves of both cells
    are asked again; boxes end as points, so this ends exact. Groups are joined as
    links are found, so what a round plans and holds doesn't grow with the rounds.
    """
    ensure_checkpoints(vertices.sparkSession)
    dims, side = len(axes), radius / len(axes) ** 0.5 * (1 - 1e-12)
    points = vertices.select("vid", *((F.col(x) + F.lit(0.0)).alias(x) for x in axes))
    boxes = checkpointed(_boxes(points, axes, side))
    steps = [o for o in ([n // 5**a % 5 - 2 for a in range(dims)] for n in range(5**dims)) if o[::-1] > [0] * dims]
    around = boxes.withColumn("o", F.explode(F.array(*(F.array(*(F.lit(x) for x in o)) for o in steps))))
    around = around.select(F.col("vid").alias("a"), "cell", "lo", "hi", F.zip_with("cell", "o", lambda c, o: c + o).alias("cell_"))
    other = boxes.select(F.col("vid").alias("b"), F.col("cell").alias("cell_"), F.col("lo").alias("lo_"), F.col("hi").alias("hi_"))
    asked, roots = around.join(other, "cell_"), boxes.select(F.col("vid").alias("node"), F.col("vid").alias("root"))
    near, far = _apart(dims)
    while True:
        known = checkpointed(asked.withColumns({"near": near, "far": far}).where(F.col("near") <= radius * radius).select("a", "b", "cell", "cell_", (F.col("far") <= radius * radius).alias("sure")))
        roots = _linked(roots, known.where("sure").select("a", "b"))
        open_ = _between(known.where("not sure").drop("sure"), roots)
        if open_.isEmpty():
            break
        place = points.withColumn("cell", F.array(*(F.floor(F.col(x) / side).cast("long") for x in axes)))
        wanted = open_.select("cell").unionByName(open_.select(F.col("cell_").alias("cell"))).distinct()
        inside = checkpointed(place.join(wanted, "cell", "left_semi").select("cell", F.array(*axes).alias("lo")).distinct())
        sizes = inside.groupBy("cell").agg(F.count("*").alias("n"))
        open_ = checkpointed(open_.join(sizes, "cell").join(sizes.select(F.col("cell").alias("cell_"), F.col("n").alias("n_")), "cell_").withColumn("few", F.col("n") * F.col("n_") <= FEW * (F.col("n") + F.col("n_"))).drop("n", "n_"))
        mine = inside.withColumn("hi", F.col("lo"))
        theirs = mine.select(*(F.col(x).alias(f"{x}_") for x in mine.columns))
        links = open_.where("few").join(mine, "cell").join(theirs, "cell_").where(near <= radius * radius)
        roots = _linked(roots, links.select("a", "b"))
        open_ = _between(open_.where("not few").drop("few"), roots)
        if open_.isEmpty():
            break
        side /= 2
        wanted = open_.select("cell").unionByName(open_.select(F.col("cell_").alias("cell"))).distinct()
        halves = _boxes(place.withColumnRenamed("cell", "parent").join(wanted.withColumnRenamed("cell", "parent"), "parent", "left_semi"), axes, side)
        halves = checkpointed(halves.withColumn("parent", F.transform("cell", lambda c: F.floor(c / 2))))
        mine = halves.select(F.col("parent").alias("cell"), F.col("cell").alias("half"), "lo", "hi")
        theirs = halves.select(F.col("parent").alias("cell_"), F.col("cell").alias("half_"), F.col("lo").alias("lo_"), F.col("hi").alias("hi_"))
        asked = open_.join(mine, "cell").join(theirs, "cell_").select("a", "b", F.col("half").alias("cell"), "lo", "hi", F.col("half_").alias("cell_"), "lo_", "hi_")
    homes = boxes.join(roots.select(F.col("node").alias("vid"), "root"), "vid").select("cell", "root")
    cell = F.array(*(F.floor(F.col(x) / (radius / dims**0.5 * (1 - 1e-12))).cast("long") for x in axes))
    return points.select(F.col("vid").alias("node"), cell.alias("cell")).join(homes, "cell").select("node", "root")


def merge_vertices(vertices: DataFrame, faces: DataFrame, radius: float, axes: tuple[str, ...] = ("x", "y", "z"), corners: tuple[str, ...] = ("a", "b", "c")) -> tuple[DataFrame, DataFrame]:
    """Vertices within ``radius`` of each other, directly or through others, become the first of them; faces with equal corners go."""
    roots = near_groups(vertices, radius, axes)
    moved = faces
    for c in corners:
        moved = moved.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_")), c).drop(c).withColumnRenamed(f"{c}_", c)
    return compact(vertices, distinct_corners(moved, corners), corners)


def _distinct(corners: tuple[str, ...]) -> Column:
    keep = F.lit(True)
    for n, x in enumerate(corners):
        for y in corners[n + 1 :]:
            keep = keep & (F.col(x) != F.col(y))
    return keep


def distinct_corners(faces: DataFrame, corners: tuple[str, ...] = ("a", "b", "c")) -> DataFrame:
    return faces.where(_distinct(corners))


def equal_corners(faces: DataFrame, corners: tuple[str, ...] = ("a", "b", "c")) -> DataFrame:
    """The faces that ``distinct_corners`` leaves out."""
    return faces.where(~_distinct(corners))


def compact(vertices: DataFrame, faces: DataFrame, corners: tuple[str, ...] = ("a", "b", "c")) -> tuple[DataFrame, DataFrame]:
    """Only vertices that faces use, numbered from 0 in the order of their old numbers."""
    used = faces.select(F.explode(F.array(*corners)).alias("vid")).distinct()
    new = numbered(vertices.join(used, "vid", "left_semi"), ["vid"], "new")
    for c in corners:
        faces = faces.join(new.select(F.col("vid").alias(c), F.col("new").alias(f"{c}_")), c).drop(c).withColumnRenamed(f"{c}_", c)
    return new.drop("vid").withColumnRenamed("new", "vid"), faces


def remove_degenerate(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Exactly equal vertices become the first of them; faces with equal corners go; numbers close up."""
    first = F.min("vid").over(Window.partitionBy("x", "y", "z"))
    roots = vertices.withColumn("root", first).select("vid", "root")
    for c in "abc":
        faces = faces.join(roots.select(F.col("vid").alias(c), F.col("root").alias(f"{c}_")), c).drop(c).withColumnRenamed(f"{c}_", c)
    return compact(vertices, distinct_corners(faces))


def with_corners(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """``faces`` with pa, pb, pc, the coordinates of their corners."""
    for c in "abc":
        faces = faces.join(vertices.select(F.col("vid").alias(c), F.struct("x", "y", "z").alias(f"p{c}")), c)
    return faces


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with ``columns``, each computed once a row: a filter on them isn't moved below and doesn't repeat them."""
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def thin_faces(vertices: DataFrame, faces: DataFrame, least: float = 1e-8) -> DataFrame:
    """Faces of an area below ``least`` times the square of their longest side: a measure free of scale.

    In one expression this is a method too large for Java to compile, so it goes in steps.
    """
    rows = with_corners(at_hand(vertices), faces.select("elem_id", "a", "b", "c"))
    p = {c: vector(f"p{c}.x", f"p{c}.y", f"p{c}.z") for c in "abc"}
    steps = {"ab": minus(p["b"], p["a"]), "bc": minus(p["c"], p["b"]), "ac": minus(p["c"], p["a"])}
    rows = _once(rows.select("elem_id", "a", "b", "c", "pa", "pb", "pc"), **{f"{s}{x}": d for s, v in steps.items() for x, d in zip("xyz", v, strict=True)})
    ab, bc, ac = (vector(f"{s}x", f"{s}y", f"{s}z") for s in steps)
    rows = _once(rows.select("elem_id", "a", "b", "c", *(f"{s}{x}" for s in steps for x in "xyz")), ab=norm(ab), bc=norm(bc), ca=norm(ac), area=norm(cross(ab, ac)) / 2)
    long_ = F.greatest("ab", "bc", "ca")
    ends = F.when(F.col("ab") == long_, F.array("a", "b")).when(F.col("bc") == long_, F.array("b", "c")).otherwise(F.array("c", "a"))
    return rows.where(F.col("area") < least * long_ * long_).select("elem_id", "a", "b", "c", F.array_sort(ends).alias("long_edge"))


def _met(faces: DataFrame, edges: DataFrame) -> DataFrame:
    """``_sides`` of ``faces`` whose ends are among ``edges`` (long_edge): by their hashes first, so that if edges are few no other side is moved."""
    ends = lambda p, q: F.xxhash64(F.least(p, q).cast("long"), F.greatest(p, q).cast("long")).alias("hash")
    side = F.explode(F.array(*(F.struct(*(F.col(n).alias(m) for n, m in zip(t, "pqr", strict=True))) for t in ("abc", "bca", "cab")))).alias("s")
    sides = faces.select("elem_id", side).select("elem_id", "s.*").withColumn("hash", ends(F.col("p"), F.col("q")))
    wanted = at_hand(edges.select(ends(*(F.col("long_edge")[n] for n in (0, 1)))).distinct())
    return sides.join(wanted, "hash", "left_semi").select("elem_id", "p", "q", "r", F.array_sort(F.array("p", "q")).alias("long_edge"))


def repair_thin(vertices: DataFrame, faces: DataFrame, least: float = 1e-8) -> DataFrame:
    """Faces without thin ones. Two thin faces that share their longest side both go; else a thin face goes and the
    first whole face with its longest side is split in two at the thin face's third corner, so the mesh stays closed.

    A whole face that two thin ones would split is split at the first of them
    (smallest elem_id); run again while thin faces are left. New faces take the
    split face's elem_id and the next free ones. The faces, the thin and the
    split ones are written to the checkpoint folder, so each is made once.
    """
    faces = written(faces.select("elem_id", "a", "b", "c"), "faces")
    thin = written(thin_faces(vertices, faces, least), "thin")
    alone = thin.groupBy("long_edge").agg(F.count("*").alias("n"), F.min("elem_id").alias("elem_id")).where("n % 2 = 1").select("elem_id")
    splitting = thin.join(alone, "elem_id").select(F.col("elem_id").alias("thin"), "long_edge", F.element_at(F.array_except(F.array("a", "b", "c"), "long_edge"), 1).alias("tip"))
    splitting = written(splitting, "splitting")
    sides = _met(faces, splitting).join(thin.select("elem_id"), "elem_id", "left_anti")
    first = sides.join(splitting, "long_edge").groupBy("thin").agg(F.min(F.struct("elem_id", "p", "q", "r", "tip")).alias("m")).groupBy("m.elem_id").agg(F.min(F.struct("thin", "m")).alias("s")).select("s.m.*")
    first = written(first, "split")
    halves = first.select("elem_id", F.explode(F.array(F.struct(F.lit(0).alias("half"), F.col("p").alias("a"), F.col("tip").alias("b"), F.col("r").alias("c")), F.struct(F.lit(1).alias("half"), F.col("tip").alias("a"), F.col("q").alias("b"), F.col("r").alias("c")))).alias("h")).select("elem_id", "h.*")
    last = faces.agg(F.coalesce(F.max("elem_id"), F.lit(-1)).alias("last"))
    extra = numbered(halves.where("half = 1"), ["elem_id"], "nth").crossJoin(last).select((F.col("last") + 1 + F.col("nth")).alias("elem_id"), "a", "b", "c")  # one row
    gone = at_hand(thin.select("elem_id").unionByName(first.select("elem_id")))
    kept = faces.join(gone, "elem_id", "left_anti").select("elem_id", "a", "b", "c")
    return kept.unionByName(halves.where("half = 0").select("elem_id", "a", "b", "c")).unionByName(extra)


def _sides(faces: DataFrame) -> DataFrame:
    """``elem_id, p, q, r, long_edge``: each side p-q of each face, its third corner, and its ends in order."""
    side = F.explode(F.array(*(F.struct(F.col(x).alias("p"), F.col(y).alias("q"), F.col(z).alias("r")) for x, y, z in ("abc", "bca", "cab")))).alias("s")
    return faces.select("elem_id", side).select("elem_id", "s.*", F.array_sort(F.array("s.p", "s.q")).alias("long_edge"))


def _repair_round(faces: DataFrame, thin: DataFrame, forced: bool) -> DataFrame:
    """One round of ``repair``. ``forced``: the first thin face may split a thin one."""
    tip = F.element_at(F.array_except(F.array("a", "b", "c"), "long_edge"), 1)
    one = Window.partitionBy("long_edge", "tip")
    paired = thin.withColumn("tip", tip).withColumns({"n": F.count("*").over(one), "turn": F.row_number().over(one.orderBy("elem_id"))})
    left_over = (F.col("turn") == 1) & (F.col("n") % 2 == 1)  # of an odd number of one shape, the first goes on alone
    alone = paired.where(left_over).select(F.col("elem_id").alias("thin"), "long_edge", "tip")
    flat = paired.where(left_over).select("elem_id", F.col("long_edge").alias("own_edge"))
    if forced:
        alone = alone.orderBy("thin").limit(1)
    else:
        gone = paired.where(~left_over).select("elem_id").checkpoint()
        faces = faces.join(gone, "elem_id", "left_anti")
    met = alone.join(_sides(faces), "long_edge").where("elem_id <> thin").join(flat, "elem_id", "left")
    free = F.col("own_edge").isNull() | ((F.col("own_edge") == F.col("long_edge")) & (F.col("elem_id") > F.col("thin")))
    claims = met.where(F.lit(True) if forced else free).groupBy("thin").agg(F.min(F.struct("elem_id", "p", "q", "r", "tip")).alias("m"))
    claimed = claims.groupBy("m.elem_id").agg(F.min(F.struct("thin", "m")).alias("s")).select("s.thin", "s.m.*").checkpoint()
    splits = claimed.join(claimed.select(F.col("elem_id").alias("thin")), "thin", "left_anti").checkpoint()
    bare = alone.join(met.select("thin"), "thin", "left_anti").select(F.col("thin").alias("elem_id"))  # on a border: nothing to split
    gone = bare.unionByName(splits.select(F.col("thin").alias("elem_id"))).unionByName(splits.select("elem_id"))
    halves = splits.select("elem_id", F.explode(F.array(F.struct(F.lit(0).alias("half"), F.col("p").alias("a"), F.col("tip").alias("b"), F.col("r").alias("c")), F.struct(F.lit(1).alias("half"), F.col("tip").alias("a"), F.col("q").alias("b"), F.col("r").alias("c")))).alias("h")).select("elem_id", "h.*")
    last = faces.agg(F.coalesce(F.max("elem_id"), F.lit(-1)).alias("last"))
    extra = numbered(halves.where("half = 1"), ["elem_id"], "nth").crossJoin(last).select((F.col("last") + 1 + F.col("nth")).alias("elem_id"), "a", "b", "c")  # one row
    kept = faces.join(gone.distinct(), "elem_id", "left_anti").select("elem_id", "a", "b", "c")
    return kept.unionByName(halves.where("half = 0").select("elem_id", "a", "b", "c")).unionByName(extra)


def repair(vertices: DataFrame, faces: DataFrame, least: float = 1e-8, rounds: int = 200) -> DataFrame:
    """Faces without thin ones, by rounds that each split what they can at once; a closed mesh stays closed.

    Two thin faces with the same corners and longest side both go. Another one goes
    when a face that has its longest side is split at its third corner: one that is
    not thin, or a thin one of the same longest side and a larger elem_id. A face
    is split once a round, at the thin face with the smallest elem_id; the others,
    and those whose longest side is only a short one of thin faces, wait for a later
    round. If all wait, the first splits what there is. One that shares its longest
    side with no face goes. Faces of two equal corners are dropped first. A round
    is checkpointed; thin faces become fewer, or their longest sides shorter.
    GridError if some are left after ``rounds``.
    """
    ensure_checkpoints(faces.sparkSession)
    now, before, forced = distinct_corners(faces.select("elem_id", "a", "b", "c")).checkpoint(), None, False
    for _ in range(rounds):
        thin = thin_faces(vertices, now, least).checkpoint()
        ids = thin.agg(F.count("*").alias("n"), F.sum(F.xxhash64("elem_id", "a", "b", "c").cast("decimal(38,0)")).alias("sum")).first()
        if not ids.n:
            return now
        forced = (ids.n, ids.sum) == before and not forced
        before = (ids.n, ids.sum)
        now = distinct_corners(_repair_round(now, thin, forced)).checkpoint()
    raise GridError(f"thin faces are left after {rounds} rounds")


def clean(vertices: DataFrame, faces: DataFrame, radius: float, least: float = 1e-8) -> tuple[DataFrame, DataFrame]:
    """Near vertices merged, faces with equal corners dropped, thin faces repaired, vertices without a face dropped."""
    vertices, faces = merge_vertices(vertices, faces, radius)
    ensure_checkpoints(faces.sparkSession)
    vertices, faces = vertices.checkpoint(), faces.checkpoint()
    return compact(vertices, repair(vertices, faces, least))


def area(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    p = [vector(f"p{c}.x", f"p{c}.y", f"p{c}.z") for c in "abc"]
    return with_corners(vertices, faces).agg(F.coalesce(F.sum(triangle_area(*p)), F.lit(0.0)).alias("area"))


def edge_key(a: Column, b: Column) -> Column:
    """The same for an edge in either direction."""
    return F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))
