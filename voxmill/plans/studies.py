"""Queries of ablation, validation, mesh repair and dump handling."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import longest_side, shoelace, vector
from ..functions.numbering import accumulated
from ..operators import ablation, flux, lattice, mesh, squares, validation
from ..sources import dumps
from .lattices import PLANE, oracle, table
from .mapping import plane_nodes, plane_received, plane_voxels, r6
from .registry import register


def plane_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plane_voxels(spark, sf_dir).select("oid", "i", "j", (F.col("n_input") * 0.1).alias("removed"), F.when(F.col("oid") % 3 == 0, "Matrix").otherwise("Fiber").alias("phase"))


@register("ablate_step", oracle(2, "SELECT vox.oid, round(n_input * 0.1e0 + coalesce(value, 0e0), 5) AS removed, n_input * 0.1e0 + coalesce(value, 0e0) <= 2.05e0 AS alive FROM vox LEFT JOIN rec ON rec.oid = vox.oid"))
def _(spark, sf_dir):
    return ablation.ablate(plane_state(spark, sf_dir), plane_received(spark, sf_dir), 2.05).select("oid", F.round("removed", 5).alias("removed"), "alive")


@register("ablate_multiphase", oracle(2, "SELECT vox.oid, CASE WHEN vox.oid % 3 = 0 THEN 'Matrix' ELSE 'Fiber' END AS phase, round(n_input * 0.1e0 + coalesce(value, 0e0), 5) AS removed, (n_input * 0.1e0 + coalesce(value, 0e0)) * CASE WHEN vox.oid % 3 = 0 THEN 2.5e0 ELSE 1e0 END <= 2.05e0 AS alive FROM vox LEFT JOIN rec ON rec.oid = vox.oid"))
def _(spark, sf_dir):
    out = ablation.ablate_phases(plane_state(spark, sf_dir), plane_received(spark, sf_dir), {"Fiber": 1.0, "Matrix": 2.5}, 2.05)
    return out.select("oid", "phase", F.round("removed", 5).alias("removed"), "alive")


@register("ablate_cumulative", "SELECT l_orderkey, l_linenumber, l_partkey, sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS removed FROM lineitem")
def _(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity").cast("long"))
    return accumulated(items, ["l_partkey"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_quantity"], "q", "removed").select("l_orderkey", "l_linenumber", "l_partkey", "removed")


@register("ablate_remaining")
def _(spark, sf_dir):
    """Three driver steps over the plane lattice, remeshed each time."""
    voxels = plane_voxels(spark, sf_dir)

    def step(alive: DataFrame, n: int) -> DataFrame:
        from ..operators.pipeline import SurfaceMapper

        points = alive.select("oid", F.col("i").cast("double").alias("x"), F.col("j").cast("double").alias("y"))
        surface = SurfaceMapper(PLANE, digits=9).run(points, check=False)
        received = flux.apply_flux(surface.weights, surface.elements.select("elem_id", (F.lit(2.0) + F.cos("theta")).alias("scalar")))
        return ablation.ablate(alive.drop("alive"), received, 2.05)

    return ablation.remaining(ablation.run_steps(plane_state(spark, sf_dir).join(voxels.select("oid"), "oid", "left_semi"), step, 3)).withColumn("removed", F.round("removed", 4))


_SPILL = """SELECT s.i, s.j, round(CASE WHEN g.n IS NOT NULL THEN 4e0 ELSE s.removed END + coalesce(gain, 0e0), 6) AS removed FROM st s
 LEFT JOIN gave g ON g.i = s.i AND g.j = s.j LEFT JOIN gain ON gain.i = s.i AND gain.j = s.j"""


@register(
    "spillover_neighbors",
    oracle(2, "SELECT 1").rsplit("\n", 1)[0]
    + """, st AS (SELECT v.i, v.j, CAST(n_input AS DOUBLE) AS removed, depth FROM vox v JOIN dep d ON d.i = v.i AND d.j = v.j),
 met AS (SELECT o.i AS fi, o.j AS fj, o.removed - 4e0 AS excess, r.i, r.j FROM st o JOIN st r ON abs(o.i - r.i) <= 1 AND abs(o.j - r.j) <= 1 AND (o.i <> r.i OR o.j <> r.j) WHERE o.removed > 4 AND r.removed <= 4 AND r.depth IN (0, 1)),
 gave AS (SELECT fi AS i, fj AS j, count(*) AS n FROM met GROUP BY fi, fj),
 gain AS (SELECT met.i, met.j, sum(excess / n) AS gain FROM met JOIN gave ON gave.i = fi AND gave.j = fj GROUP BY met.i, met.j) """
    + _SPILL,
)
def _(spark, sf_dir):
    voxels = plane_voxels(spark, sf_dir)
    depth = lattice.depth(lattice.padded(voxels, PLANE), PLANE.voxel_axes).select("i", "j", "depth")
    state = voxels.join(depth, ["i", "j"]).select("i", "j", F.col("n_input").cast("double").alias("removed"), "depth")
    return ablation.spill(state, ("i", "j"), 4.0).select("i", "j", r6("removed").alias("removed"))


def points_of_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("pid"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


_RING = f"""ring AS (SELECT n AS side_id, 0.15e0 * cos({math.radians(90)} + n * {2 * math.pi / 12}) AS ax, 0.15e0 * sin({math.radians(90)} + n * {2 * math.pi / 12}) AS ay,
 0.15e0 * cos({math.radians(90)} + (n + 1) * {2 * math.pi / 12}) AS bx, 0.15e0 * sin({math.radians(90)} + (n + 1) * {2 * math.pi / 12}) AS by_ FROM range(12) t(n)),
 pts AS (SELECT vec_id AS pid, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)"""


@register("point_in_polygon", f"WITH {_RING} SELECT pid FROM pts WHERE NOT EXISTS (SELECT 1 FROM ring WHERE (bx - ax) * (y - ay) - (by_ - ay) * (x - ax) < -1e-12)")
def _(spark, sf_dir):
    return validation.inside_polygon(points_of_embeddings(spark, sf_dir), validation.regular_polygon(spark, 12, 0.15)).select("pid")


_STAR = """WITH n AS (SELECT count(*) AS n FROM customer), p AS (SELECT c_custkey AS k, (0.05e0 + (c_acctbal + 1000) / 55000e0) * cos(2 * pi() * c_custkey / n) AS x, (0.05e0 + (c_acctbal + 1000) / 55000e0) * sin(2 * pi() * c_custkey / n) AS y FROM customer, n),
 s AS (SELECT a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM p a, n, p b WHERE b.k = (a.k + 1) % n),
 e AS (SELECT vec_id AS pid, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)"""


def customer_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A polygon with a corner for each customer, as far out as the balance says."""
    customers = table(spark, sf_dir, "customer")
    total = customers.agg(F.count("*").alias("n"))
    out, turn = F.lit(0.05) + (F.col("c_acctbal") + 1000) / 55000, 2 * math.pi * F.col("k") / F.col("n")
    corners = customers.select(F.col("c_custkey").alias("k"), "c_acctbal").crossJoin(total).select("k", "n", (out * F.cos(turn)).alias("x"), (out * F.sin(turn)).alias("y"))  # one row
    after = corners.select(F.pmod(F.col("k") - 1, F.col("n")).alias("k"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return corners.join(after, "k").select(F.col("x").alias("ax"), F.col("y").alias("ay"), "bx", "by")


@register("point_in_concave_polygon", f"{_STAR} SELECT pid FROM e JOIN s ON (ay > y) <> (by_ > y) AND x > ax + (y - ay) / (by_ - ay) * (bx - ax) GROUP BY pid HAVING count(*) % 2 = 1")
def _(spark, sf_dir):
    return validation.inside_any_polygon(points_of_embeddings(spark, sf_dir), customer_star(spark, sf_dir)).select("pid")


@register(
    "signed_distance",
    f"""WITH {_RING} SELECT pid, round(min(sqrt(power(x - ax - t * (bx - ax), 2) + power(y - ay - t * (by_ - ay), 2))) * CASE WHEN bool_and((bx - ax) * (y - ay) - (by_ - ay) * (x - ax) > 0) THEN -1e0 ELSE 1e0 END, 6) + 0e0 AS distance FROM (
      SELECT *, greatest(0e0, least(1e0, ((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / (power(bx - ax, 2) + power(by_ - ay, 2)))) AS t FROM pts CROSS JOIN ring) GROUP BY pid""",
)
def _(spark, sf_dir):
    sides = squares.attributes(validation.regular_polygon(spark, 12, 0.15)).select(F.col("side_id").cast("long").alias("elem_id"), "ax", "ay", "bx", "by", "nx", "ny")
    return validation.nearest_element(points_of_embeddings(spark, sf_dir), sides, 0.1).select("pid", r6("distance").alias("distance"))


@register("misplaced_by_layer", oracle(2, "SELECT 1").rsplit("\n", 1)[0] + ", lay AS (SELECT depth, count(*) AS n_voxels, count(*) FILTER (WHERE n_input >= 4) AS n_misplaced FROM dep JOIN vox USING (i, j) GROUP BY depth) SELECT depth, n_voxels, n_misplaced FROM lay WHERE depth < coalesce((SELECT min(depth) FROM lay WHERE n_misplaced = 0), 1000000)")
def _(spark, sf_dir):
    voxels = plane_voxels(spark, sf_dir)
    depth = lattice.depth(lattice.padded(voxels, PLANE), PLANE.voxel_axes).select("i", "j", "depth")
    return validation.misplaced_by_layer(voxels.join(depth, ["i", "j"]).withColumn("misplaced", F.col("n_input") >= 4))


@register("flux_error_percent", oracle(2, "SELECT round(avg(abs((value - 2e0) / 2e0)) * 100, 4) AS error_percent, count(*) AS n FROM rec"))
def _(spark, sf_dir):
    received = plane_received(spark, sf_dir)
    error = validation.flux_error(received, received.select("oid", F.lit(2.0).alias("exact")))
    return error.select(F.round("error_percent", 4).alias("error_percent"), "n")


@register("polygon_measures", oracle(2, "SELECT round(sum(length), 6) AS perimeter, round(abs(sum(ax * by_ - bx * ay)) / 2, 5) AS area FROM ele"))
def _(spark, sf_dir):
    from .mapping import plane_elements

    return validation.polygon_measures(plane_elements(spark, sf_dir)).select(r6("perimeter").alias("perimeter"), F.round("area", 5).alias("area"))


@register("sweep_pivot", "SELECT v AS voxel_ratio, " + ", ".join(f"round(max(CASE WHEN g = {g} AND v >= g THEN e END), 6) AS g{g}" for g in (2, 4, 8)) + " FROM (SELECT CAST(2 << (l_linenumber % 3) AS INTEGER) AS v, CAST(2 << CAST(l_orderkey % 3 AS INTEGER) AS INTEGER) AS g, avg(l_discount) AS e FROM lineitem GROUP BY 1, 2) GROUP BY v")
def _(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.expr("shiftleft(2, l_linenumber % 3)").alias("voxel_ratio"), F.expr("shiftleft(2, cast(l_orderkey % 3 as int))").alias("grid_ratio"), "l_discount")
    cases = li.groupBy("voxel_ratio", "grid_ratio").agg(F.avg("l_discount").alias("error"))
    return validation.sweep_matrix(cases, [2, 4, 8]).select("voxel_ratio", *(F.round(F.col(str(g)), 6).alias(f"g{g}") for g in (2, 4, 8)))


@register("distribution_summary", "SELECT p_brand, min(p_retailprice) AS lowest, round(quantile_cont(p_retailprice, 0.5), 4) AS middle, max(p_retailprice) AS highest FROM part GROUP BY p_brand")
def _(spark, sf_dir):
    return validation.distribution(table(spark, sf_dir, "part"), "p_retailprice", ["p_brand"]).select("p_brand", "lowest", F.round("middle", 4).alias("middle"), "highest")


@register("repeat_medians", "SELECT l_returnflag, round(median(l_extendedprice), 4) AS middle, round(median(l_extendedprice) / median(l_quantity), 6) AS speedup FROM lineitem GROUP BY 1")
def _(spark, sf_dir):
    found = validation.medians(table(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_quantity"], ["l_returnflag"])
    return found.select("l_returnflag", F.round("l_extendedprice", 4).alias("middle"), F.round(F.col("l_extendedprice") / F.col("l_quantity"), 6).alias("speedup"))


@register("quartiles_of_all", "SELECT " + ", ".join(f"round(quantile_cont(CAST(l_extendedprice AS DOUBLE), {p}), 4) AS {n}" for n, p in (("lowest", 0), ("quartile_1", 0.25), ("middle", 0.5), ("quartile_3", 0.75), ("highest", 1))) + " FROM lineitem")
def _(spark, sf_dir):
    """One group of all line items."""
    found = validation.distribution(table(spark, sf_dir, "lineitem"), "l_extendedprice")
    return found.select(*(F.round(c, 4).alias(c) for c in found.columns))


@register("attach_by_id_left_join", "SELECT p_partkey AS tid, s_suppkey IS NULL AS missing, coalesce(s_acctbal, -1e6) AS balance FROM part LEFT JOIN supplier ON s_suppkey = p_partkey")
def _(spark, sf_dir):
    """Every part with the data of the supplier of its number; most have none."""
    data = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sid"), "s_acctbal")
    joined, _ = dumps.attach(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("tid")), data)
    return joined.select("tid", F.isnan("s_acctbal").alias("missing"), F.when(F.isnan("s_acctbal"), -1e6).otherwise(F.col("s_acctbal")).alias("balance"))


@register("unattached_rows", "SELECT p_partkey AS tid FROM part WHERE p_partkey NOT IN (SELECT s_suppkey FROM supplier)")
def _(spark, sf_dir):
    data = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sid"), "p_retailprice")
    return dumps.attach(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("tid")), data)[1].select("tid")


@register("positional_zip", "SELECT nth, s_suppkey, c_custkey FROM (SELECT s_nationkey AS nat, s_suppkey, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS INTEGER) AS nth FROM supplier) JOIN (SELECT c_nationkey AS nat, c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS INTEGER) AS nth FROM customer) USING (nat, nth)")
def _(spark, sf_dir):
    a = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nat"), "s_suppkey")
    b = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nat"), "c_custkey")
    return dumps.zip_rows(a, b, "s_suppkey", "c_custkey", ["nat"]).select("nth", "s_suppkey", "c_custkey")


_STEPS = "(SELECT DISTINCT event_type AS solver, CAST(floor(epoch(ts) / 3600) AS INTEGER) AS timestep FROM events WHERE value > 20)"


@register("synced_timesteps", f"SELECT timestep FROM {_STEPS} WHERE solver IN ('click', 'view') GROUP BY timestep HAVING count(DISTINCT solver) = 2")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value > 20").select(F.col("event_type").alias("solver"), F.floor(F.unix_timestamp(F.date_trunc("second", "ts")) / 3600).cast("int").alias("timestep"))
    return dumps.common_steps(e, ["click", "view"])


@register("file_stride", "SELECT path, nth FROM (SELECT path, CAST(row_number() OVER (ORDER BY k, path) - 1 AS INTEGER) AS nth FROM (SELECT o_custkey AS k, 'dump_' || o_custkey || '.dat' AS path FROM orders GROUP BY o_custkey)) WHERE nth % 3 = 0")
def _(spark, sf_dir):
    files = table(spark, sf_dir, "orders").select(F.concat(F.lit("dump_"), F.col("o_custkey").cast("string"), F.lit(".dat")).alias("path")).distinct()
    return dumps.every_nth(files, 3)


_DUMP = "(SELECT CAST(user_id AS VARCHAR) AS path, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, CASE WHEN event_type = 'click' THEN 'ITEM: TIMESTEP' ELSE CAST(event_id AS VARCHAR) END AS line FROM events)"


@register("block_id_in_dump", f"SELECT path, CAST(n AS INTEGER) AS n, line FROM (SELECT *, row_number() OVER (PARTITION BY path, block ORDER BY n) AS nth FROM (SELECT *, sum(CASE WHEN line = 'ITEM: TIMESTEP' THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY n) AS block FROM {_DUMP})) WHERE block = 2 AND nth > 1")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = e.select(F.col("user_id").cast("string").alias("path"), n.alias("n"), F.when(F.col("event_type") == "click", "ITEM: TIMESTEP").otherwise(F.col("event_id").cast("string")).alias("line"))
    return dumps.second_block(rows, header_lines=1)


@register("volume_slice", "SELECT DISTINCT i - 5 AS i, j - 1 AS j, k - 2 AS k FROM (SELECT CAST(l_quantity AS INTEGER) AS i, CAST(round_even(l_discount * 100, 0) AS INTEGER) AS j, CAST(round_even(l_tax * 100, 0) AS INTEGER) AS k, l_linenumber % 2 AS value FROM lineitem) WHERE i BETWEEN 5 AND 14 AND j BETWEEN 1 AND 10 AND k >= 2 AND k < 6 AND value = 1")
def _(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("int").alias("i"), F.rint(F.col("l_discount") * 100).cast("int").alias("j"), F.rint(F.col("l_tax") * 100).cast("int").alias("k"), (F.col("l_linenumber") % 2).alias("value"))
    return dumps.slice_volume(v, 10, 6, 2, 5, 4).distinct()


@register("phase_labels", "SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'Matrix' ELSE 'Fiber' END AS phase, count(*) AS n FROM lineitem GROUP BY 1")
def _(spark, sf_dir):
    return dumps.label_phases(table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") % 2).alias("value"))).groupBy("phase").agg(F.count("*").alias("n"))


_ALL = "(SELECT CAST(j * 1000 + i AS BIGINT) AS node, i, j FROM vox)"


@register("connected_components", oracle(2, "SELECT 1").rsplit("\n", 1)[0].replace("WITH ", "WITH RECURSIVE ", 1) + f", nd AS {_ALL}, ed AS (SELECT p.node AS a, q.node AS b FROM nd p JOIN nd q ON abs(p.i - q.i) + abs(p.j - q.j) = 1), cl AS (SELECT node, node AS root, 0 AS nth FROM nd UNION ALL SELECT node, root, nth FROM (SELECT *, bool_or(root < was) OVER () AS moved FROM (SELECT cl.node, cl.root AS was, least(cl.root, coalesce(min(o.root), cl.root)) AS root, cl.nth + 1 AS nth FROM cl LEFT JOIN ed ON ed.a = cl.node LEFT JOIN cl o ON o.node = ed.b GROUP BY cl.node, cl.root, cl.nth)) WHERE moved) SELECT node, min(root) AS root FROM cl GROUP BY node")
def _(spark, sf_dir):
    nodes = plane_voxels(spark, sf_dir).select((F.col("j") * 1000 + F.col("i")).cast("long").alias("node"), "i", "j")
    step = F.explode(F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((1, 0), (0, 1)))))
    to = nodes.withColumn("d", step).select(F.col("node").alias("a"), (F.col("i") + F.col("d.x")).alias("i"), (F.col("j") + F.col("d.y")).alias("j"))
    edges = to.join(nodes.select(F.col("node").alias("b"), "i", "j"), ["i", "j"]).select("a", "b")
    return mesh.components(nodes.select("node"), edges)


def _vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("vid"), (F.col("c_acctbal") / 1000).alias("x"), F.col("c_nationkey").cast("double").alias("y"), F.lit(0.0).alias("z"))


@register("near_vertex_pairs", "SELECT p.c_custkey AS a, q.c_custkey AS b FROM customer p JOIN customer q ON p.c_nationkey = q.c_nationkey AND p.c_custkey < q.c_custkey WHERE power(p.c_acctbal / 1000 - q.c_acctbal / 1000, 2) <= 0.05e0 * 0.05e0")
def _(spark, sf_dir):
    return mesh.near_pairs(_vertices(spark, sf_dir), 0.05)


@register("near_vertex_groups", """SELECT vid AS node, min(vid) OVER (PARTITION BY y, part) AS root FROM (SELECT *, sum(gap) OVER (PARTITION BY y ORDER BY x, vid) AS part FROM (
  SELECT c_custkey AS vid, c_nationkey AS y, c_acctbal / 1000 AS x, CASE WHEN power(c_acctbal / 1000 - lag(c_acctbal / 1000) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal / 1000, c_custkey), 2) <= 0.05e0 * 0.05e0 THEN 0 ELSE 1 END AS gap FROM customer))""")
def _(spark, sf_dir):
    """Customers of a nation whose balances are linked by steps of 50."""
    return mesh.near_groups(_vertices(spark, sf_dir), 0.05)


def _faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("elem_id"), (F.col("l_partkey") % 23).alias("a"), (F.col("l_suppkey") % 23).alias("b"), (F.col("l_orderkey") % 23).alias("c"))


@register("degenerate_faces", "SELECT l_orderkey * 8 + l_linenumber AS elem_id FROM lineitem WHERE NOT (l_partkey % 23 <> l_suppkey % 23 AND l_suppkey % 23 <> l_orderkey % 23 AND l_partkey % 23 <> l_orderkey % 23)")
def _(spark, sf_dir):
    faces = _faces(spark, sf_dir)
    return mesh.equal_corners(faces).select("elem_id")


@register("shared_edge_counts", "SELECT least(a, b) AS lo, greatest(a, b) AS hi, count(*) AS n FROM (SELECT l_partkey % 23 AS a, l_suppkey % 23 AS b FROM lineitem) WHERE a <> b GROUP BY 1, 2")
def _(spark, sf_dir):
    faces = _faces(spark, sf_dir).where("a <> b")
    return faces.groupBy(mesh.edge_key(F.col("a"), F.col("b")).alias("e")).agg(F.count("*").alias("n")).select("e.lo", "e.hi", "n")


@register("longest_sides", "SELECT pair_id, CASE WHEN x >= 1e0 AND x >= h THEN 0 WHEN 1e0 >= h THEN 2 ELSE 1 END AS side FROM (SELECT l_orderkey * 8 + l_linenumber AS pair_id, l_quantity / 10 AS x, sqrt(power(l_quantity / 10, 2) + 1) AS h FROM lineitem)")
def _(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pair_id"), (F.col("l_quantity") / 10).alias("x"), F.lit(0.0).alias("o"), F.lit(1.0).alias("y"))
    return li.select("pair_id", longest_side(vector("o", "o"), vector("x", "o"), vector("o", "y")).alias("side"))


@register("polygon_area", "SELECT l_orderkey * 8 + l_linenumber AS pair_id, round(l_quantity * l_extendedprice / 2, 3) AS area FROM lineitem")
def _(spark, sf_dir):
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    zero = F.lit(0.0)
    li = table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pair_id"), F.round(shoelace(F.array(p(zero, zero), p(F.col("l_quantity"), zero), p(zero, F.col("l_extendedprice")))), 3).alias("area"))


@register("cell_to_hex_vertices", oracle(2, "SELECT oid AS id, c AS corner, i - 0.5e0 + c % 2 AS x, j - 0.5e0 + (c // 2) % 2 AS y, CAST(c // 4 AS DOUBLE) AS z FROM vox CROSS JOIN (SELECT CAST(unnest(range(8)) AS INTEGER) AS c)"))
def _(spark, sf_dir):
    boxes = plane_voxels(spark, sf_dir).select(F.col("oid").alias("id"), (F.col("i") - 0.5).alias("xlo"), (F.col("i") + 0.5).alias("xhi"), (F.col("j") - 0.5).alias("ylo"), (F.col("j") + 0.5).alias("yhi"))
    return dumps.boxes_to_points(boxes, flat=True)[0]


@register("uniform_noise", oracle(2, "SELECT ni, nj, round(frac * (1 + 0.01e0 * (2 * (((CAST(ni AS BIGINT) * 7919 + nj * 104729) * 48271) % 2147483647 / 2147483647e0) - 1)), 9) + 0e0 AS frac FROM nod"))
def _(spark, sf_dir):
    """Multiplicative noise of one percent on node fractions, drawn from each node's number, so the same in every run."""
    drawn = ((F.col("ni").cast("long") * 7919 + F.col("nj") * 104729) * 48271) % 2147483647 / F.lit(2147483647.0)
    return plane_nodes(spark, sf_dir).select("ni", "nj", (F.round(F.col("frac") * (1 + 0.01 * (2 * drawn - 1)), 9) + F.lit(0.0)).alias("frac"))
