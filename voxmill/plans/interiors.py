"""Queries of surfaces through a lattice of unrelated values, where every pattern of a cell occurs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import triangle_area, vector
from ..operators import cubes
from ..operators.cubes import EDGES
from ..spec import GridSpec
from .lattices import _CROSSED, _corners, _triangles, located, table
from .registry import register

#: Nodes by quantity, and discount and tax in hundredths; a node's value is drawn from its line items.
NOISE = GridSpec((0.0, 0.0, 0.0), (60.0, 20.0, 20.0), (60, 20, 20))

_NODES = """SELECT CAST(l_quantity AS INTEGER) AS ni, CAST(round_even(l_discount * 100, 0) AS INTEGER) AS nj, CAST(round_even(l_tax * 100, 0) AS INTEGER) AS nk,
  (sum(CAST(l_partkey AS BIGINT) * 7919 + l_suppkey * 104729) * 48271 % 1009) / 1009e0 AS frac FROM lineitem GROUP BY 1, 2, 3"""


def noise_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    key = {"ni": F.col("l_quantity").cast("int"), "nj": F.rint(F.col("l_discount") * 100).cast("int"), "nk": F.rint(F.col("l_tax") * 100).cast("int")}
    drawn = F.sum(F.col("l_partkey").cast("long") * 7919 + F.col("l_suppkey") * 104729) * 48271 % 1009 / F.lit(1009.0)
    return items.groupBy(*(c.alias(n) for n, c in key.items())).agg(drawn.alias("frac"))


def noise_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cubes.cells(noise_nodes(spark, sf_dir), digits=9)


def noisy(last: str) -> str:
    made = {"nod": _NODES, "cor": _corners(), "cub": _CROSSED, "loc": located(), "tri": _triangles(NOISE)}
    return "WITH " + ",\n".join(f"{name} AS ({sql})" for name, sql in made.items()) + "\n" + last


@register("cell_cases_3d", noisy("SELECT cube_index, joined, inner_ AS inner, count(*) AS n FROM loc GROUP BY ALL"))
def _(spark, sf_dir):
    """How many cells have each pattern, choice on faces and choice inside."""
    return cubes.located(noise_cells(spark, sf_dir)).groupBy("cube_index", "joined", "inner").agg(F.count("*").alias("n"))


@register("interior_share_3d", noisy("SELECT count(*) AS n_cells, count(*) FILTER (WHERE inner_ < 4) AS n_joined_inside, round(count(*) FILTER (WHERE inner_ < 4) / CAST(count(*) AS DOUBLE), 9) AS share FROM loc"))
def _(spark, sf_dir):
    """The share of crossed cells whose mesh the interior test changes."""
    found = cubes.located(noise_cells(spark, sf_dir)).agg(F.count("*").alias("n_cells"), F.count_if(F.col("inner") < 4).alias("n_joined_inside"))
    return found.withColumn("share", F.round(F.col("n_joined_inside") / F.when(F.col("n_cells") > 0, F.col("n_cells")), 9))


@register("mesh_interior_3d", noisy("SELECT ci, cj, ck, count(*) AS n_triangles, count(*) FILTER (WHERE 12 IN (s0, s1, s2)) AS n_about_centre, round(sum(area), 5) + 0e0 AS area FROM tri GROUP BY ci, cj, ck"))
def _(spark, sf_dir):
    """Each cell's part of the surface, tunnels and centre vertices included."""
    made = cubes.triangles(noise_cells(spark, sf_dir), NOISE)
    corners = [vector(f"t{n}.x", f"t{n}.y", f"t{n}.z") for n in range(3)]
    about = F.greatest("e0.axis", "e1.axis", "e2.axis") == 3
    return made.groupBy("ci", "cj", "ck").agg(F.count("*").alias("n_triangles"), F.count_if(about).alias("n_about_centre"), (F.round(F.sum(triangle_area(*corners)), 5) + F.lit(0.0)).alias("area"))


def _place(slot: str) -> str:
    ends = [*EDGES, (0, 0)]
    at = [f"{c} + [{', '.join(str(a >> b & 1) for a, _ in ends)}][{slot} + 1]" for b, c in enumerate(("ci", "cj", "ck"))]
    return f"({', '.join(at)}, [{', '.join(str((b - a).bit_length() - 1 if b else 3) for a, b in ends)}][{slot} + 1])"


_SIDES = ", ".join(f"({_place(f's{n}')}, {_place(f's{(n + 1) % 3}')})" for n in range(3))


@register(
    "mesh_euler_3d",
    noisy(f"""SELECT (SELECT count(DISTINCT p) FROM d) AS n_vertices, count(*) AS n_edges, (SELECT count(*) FROM tri) AS n_faces,
      (SELECT count(DISTINCT p) FROM d) - count(*) + (SELECT count(*) FROM tri) AS euler, count(*) FILTER (WHERE forth <> back) AS n_open
      FROM (SELECT least(p, q) AS lo, greatest(p, q) AS hi, count(*) FILTER (WHERE p < q) AS forth, count(*) FILTER (WHERE p > q) AS back FROM d GROUP BY 1, 2)""").replace("\nSELECT (SELECT", f",\nd AS (SELECT s[1] AS p, s[2] AS q FROM (SELECT unnest([{_SIDES}]) AS s FROM tri))\nSELECT (SELECT", 1),
)
def _(spark, sf_dir):
    """Vertices, edges and faces of the surface, and edges not met as often one way as the other: none, for it is closed."""
    made = cubes.triangles(noise_cells(spark, sf_dir), NOISE)
    sides = made.select(F.explode(F.array(*(F.struct(F.col(f"e{n}").alias("p"), F.col(f"e{(n + 1) % 3}").alias("q")) for n in range(3)))).alias("s")).select("s.p", "s.q")
    edges = sides.groupBy(F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi")).agg(F.count_if(F.col("p") < F.col("q")).alias("forth"), F.count_if(F.col("p") > F.col("q")).alias("back"))
    counted = edges.agg(F.count("*").alias("n_edges"), F.count_if(F.col("forth") != F.col("back")).alias("n_open"))
    vertices = sides.select("p").distinct().agg(F.count("*").alias("n_vertices"))
    whole = vertices.crossJoin(counted).crossJoin(made.agg(F.count("*").alias("n_faces")))  # one row each
    return whole.select("n_vertices", "n_edges", "n_faces", (F.col("n_vertices") - F.col("n_edges") + F.col("n_faces")).alias("euler"), "n_open")
