"""The voxel sets that queries take from the driver's tables, in Spark and as DuckDB text.

Orders make a plane lattice (month, price in ten thousands) and line items a space
lattice (quantity, discount and tax in hundredths); an ellipse and an ellipsoid cut
them to shape, in integers, so both engines agree on the border.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spec import GridSpec

PLANE = GridSpec((-10.0, -10.0), (110.0, 70.0), (60, 40))
SPACE = GridSpec((-10.0, -10.0, -10.0), (60.0, 20.0, 20.0), (35, 15, 15))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plane_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """oid, x, y of orders inside the ellipse."""
    o = table(spark, sf_dir, "orders")
    x = (12 * (F.year("o_orderdate") - 1992) + F.month("o_orderdate")).cast("double")
    rows = o.select(F.col("o_orderkey").alias("oid"), x.alias("x"), F.floor(F.col("o_totalprice") / 10000).cast("double").alias("y"))
    return rows.where("324 * (x - 50) * (x - 50) + 1600 * (y - 24) * (y - 24) <= 518400")


def space_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """oid, x, y, z of line items inside the ellipsoid."""
    o = table(spark, sf_dir, "lineitem")
    rows = o.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("oid"), F.col("l_quantity").alias("x"), F.rint(F.col("l_discount") * 100).alias("y"), F.rint(F.col("l_tax") * 100).alias("z"))
    return rows.where("400 * (x - 25) * (x - 25) + 7744 * (y - 5) * (y - 5) + 12100 * (z - 4) * (z - 4) <= 193600")


SQL_POINTS = {
    2: """(SELECT o_orderkey AS oid, CAST(12 * (year(o_orderdate) - 1992) + month(o_orderdate) AS INTEGER) AS i,
           CAST(floor(o_totalprice / 10000) AS INTEGER) AS j FROM orders) p
         WHERE 324 * (i - 50) * (i - 50) + 1600 * (j - 24) * (j - 24) <= 518400""",
    3: """(SELECT l_orderkey * 8 + l_linenumber AS oid, CAST(l_quantity AS INTEGER) AS i,
           CAST(round_even(l_discount * 100, 0) AS INTEGER) AS j, CAST(round_even(l_tax * 100, 0) AS INTEGER) AS k FROM lineitem) p
         WHERE 400 * (i - 25) * (i - 25) + 7744 * (j - 5) * (j - 5) + 12100 * (k - 4) * (k - 4) <= 193600""",
}


def ctes(ndims: int) -> dict[str, str]:
    """DuckDB tables by name, each using those before it."""
    spec = PLANE if ndims == 2 else SPACE
    ax = spec.voxel_axes
    cols = ", ".join(ax)
    pad = spec.padding
    out = {"vox": f"SELECT {cols}, max(oid) AS oid, count(*) AS n_input FROM {SQL_POINTS[ndims]} GROUP BY {cols}"}
    out["box"] = "SELECT " + ", ".join(f"min({a}) - {pad} AS lo_{a}, max({a}) + {pad} AS hi_{a}" for a in ax) + " FROM vox"
    grid = " CROSS JOIN ".join(f"(SELECT CAST(unnest(range(lo_{a}, hi_{a} + 1)) AS INTEGER) AS {a} FROM box) g{a}" for a in ax)
    out["lat"] = f"SELECT {', '.join(f'g{a}.{a}' for a in ax)}, vox.oid IS NOT NULL AS solid FROM {grid} LEFT JOIN vox ON " + " AND ".join(f"vox.{a} = g{a}.{a}" for a in ax)
    out["dt0"] = f"SELECT {cols}, solid, CASE WHEN solid THEN 1073741824 ELSE 0 END AS v, CASE WHEN solid THEN 0 ELSE 1073741824 END AS s FROM lat"
    for n, a in enumerate(ax):
        others = ", ".join(x for x in ax if x != a)
        w = f"PARTITION BY {others} ORDER BY {a} ROWS BETWEEN"
        run = lambda c: f"least(min({c} - {a}) OVER ({w} UNBOUNDED PRECEDING AND CURRENT ROW) + {a}, min({c} + {a}) OVER ({w} CURRENT ROW AND UNBOUNDED FOLLOWING) - {a}) AS {c}"  # noqa: B023, E731
        out[f"dt{n + 1}"] = f"SELECT {cols}, solid, {run('v')}, {run('s')} FROM dt{n}"
    out["dep"] = f"SELECT {cols}, solid, CAST(CASE WHEN solid THEN v - 1 ELSE -s END AS INTEGER) AS depth FROM dt{ndims}"
    out["wei"] = f"SELECT {cols}, depth, greatest(0e0, least(1e0, 0.5e0 * (1e0 + (0.5e0 + depth) * 2e0 / {3.0 * spec.voxels_per_cell}e0))) AS weight FROM dep"
    parts, node, share = [], [], ["weight"]
    for a, n, lo, h in zip(ax, spec.node_axes, spec.lo, spec.cell, strict=True):
        first = f"floor(({a} - 0.5e0 - {lo}e0) / {h}e0 + 0.5e0)"
        last = f"greatest({first}, ceil(({a} + 0.5e0 - {lo}e0) / {h}e0 + 0.5e0) - 1)"
        node.append(n)
        parts.append((a, n, first, last))
        mid = f"({lo}e0 + {n} * {h}e0)"
        share.append(f"greatest(0e0, least({a} + 0.5e0, {mid} + {h / 2}e0) - greatest({a} - 0.5e0, {mid} - {h / 2}e0)) / {h}e0")
    rows = "SELECT * FROM wei WHERE weight > 1e-6"
    for a, n, first, last in parts:
        rows = f"SELECT *, CAST(unnest(range(CAST({first} AS BIGINT), CAST({last} AS BIGINT) + 1)) AS INTEGER) AS {n} FROM ({rows})"
    keep = " AND ".join(f"{n} BETWEEN 0 AND {c}" for n, c in zip(spec.node_axes, spec.ncells, strict=True))
    out["nod"] = f"SELECT {', '.join(node)}, sum({' * '.join(share)}) AS frac FROM ({rows}) WHERE {keep} GROUP BY {', '.join(node)}"
    sides = [(2 * n + s, [(1 if s else -1) if m == n else 0 for m in range(ndims)]) for n in range(ndims) for s in (0, 1)]
    out["sid"] = "SELECT * FROM (VALUES " + ", ".join(f"({f}, {', '.join(map(str, d))})" for f, d in sides) + f") t(face, {', '.join(f'd{a}' for a in ax)})"
    out["exp"] = f"SELECT {', '.join(f'v.{a}' for a in ax)}, v.oid, sid.face FROM vox v CROSS JOIN sid LEFT JOIN vox o ON " + " AND ".join(f"o.{a} = v.{a} + sid.d{a}" for a in ax) + " WHERE o.oid IS NULL"
    if ndims == 2:
        f = lambda x, y: f"coalesce(max(CASE WHEN ni - ci = {x} AND nj - cj = {y} THEN round(frac, 9) END), 0e0)"
        out["cor"] = f"SELECT ci, cj, {f(0, 0)} AS f0, {f(1, 0)} AS f1, {f(1, 1)} AS f2, {f(0, 1)} AS f3 FROM (SELECT ni, nj, frac, ni - dx AS ci, nj - dy AS cj FROM nod CROSS JOIN (VALUES (0, 0), (1, 0), (1, 1), (0, 1)) o(dx, dy)) GROUP BY ci, cj"
        out["top"] = "SELECT * FROM (SELECT *, (f0 >= 0.5e0)::INT + 2 * (f1 >= 0.5e0)::INT + 4 * (f2 >= 0.5e0)::INT + 8 * (f3 >= 0.5e0)::INT AS topology FROM cor) WHERE topology NOT IN (0, 15) AND ci BETWEEN 0 AND 59 AND cj BETWEEN 0 AND 39"
        from ..operators.squares import cases

        table_ = ", ".join(f"({t}, {a}, {b}, {n})" for t in range(16) for n, (_, a, b) in enumerate(c for c in cases() if c[0] == t))
        corner = {0: (0, 0), 1: (1, 0), 2: (1, 1), 3: (0, 1)}

        def cut(side: str, axis: int) -> str:
            when = []
            for s in range(4):
                (x0, y0), (x1, y1) = corner[s], corner[(s + 1) % 4]
                t = f"((0.5e0 - f{s}) / (f{(s + 1) % 4} - f{s}))"
                base, p0, p1 = ("ci", x0, x1) if axis == 0 else ("cj", y0, y1)
                when.append(f"WHEN {side} = {s} THEN -10e0 + ({base} + {p0} + {t} * {p1 - p0}) * 2e0")
            return "CASE " + " ".join(when) + " END"

        out["seg"] = f"SELECT * FROM (SELECT ci, cj, part, {cut('a', 0)} AS ax, {cut('a', 1)} AS ay, {cut('b', 0)} AS bx, {cut('b', 1)} AS by_ FROM top JOIN (VALUES {table_}) c(topology_, a, b, part) ON topology = topology_) WHERE ax <> bx OR ay <> by_"
        out["ele"] = "SELECT *, row_number() OVER (ORDER BY cj, ci, part) - 1 AS elem_id, sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)) AS length FROM seg"
        out["fac"] = """SELECT oid, face, CAST(floor((i + 10e0) / 2e0) AS INTEGER) AS ci, CAST(floor((j + 10e0) / 2e0) AS INTEGER) AS cj,
          CASE face WHEN 0 THEN i - 0.5e0 WHEN 1 THEN i + 0.5e0 ELSE i - 0.5e0 END AS px, CASE face WHEN 2 THEN j - 0.5e0 WHEN 3 THEN j + 0.5e0 ELSE j - 0.5e0 END AS py,
          CASE face WHEN 0 THEN i - 0.5e0 WHEN 1 THEN i + 0.5e0 ELSE i + 0.5e0 END AS qx, CASE face WHEN 2 THEN j - 0.5e0 WHEN 3 THEN j + 0.5e0 ELSE j + 0.5e0 END AS qy,
          CASE face WHEN 0 THEN -1 WHEN 1 THEN 1 ELSE 0 END AS fx, CASE face WHEN 2 THEN -1 WHEN 3 THEN 1 ELSE 0 END AS fy FROM exp"""
        out["can"] = "SELECT e.*, f.oid, f.face, f.px, f.py, f.qx, f.qy FROM ele e JOIN fac f ON abs(e.ci - f.ci) <= 1 AND abs(e.cj - f.cj) <= 1 WHERE f.fx * (by_ - ay) / length + f.fy * (ax - bx) / length > 0"
        par = lambda x, y: f"((({x} - ax) * (bx - ax) + ({y} - ay) * (by_ - ay)) / (length * length))"
        out["ovl"] = f"SELECT elem_id, oid, length, greatest(0e0, least(1e0, greatest({par('px', 'py')}, {par('qx', 'qy')})) - greatest(0e0, least({par('px', 'py')}, {par('qx', 'qy')}))) * length AS cover FROM can"
        out["shr"] = """SELECT elem_id, oid, cover / sum(cover) OVER (PARTITION BY elem_id) AS frac FROM (
          SELECT elem_id, oid, sum(cover) AS cover, max(cover) AS most, min(length) AS length FROM ovl WHERE cover > 0 GROUP BY elem_id, oid) WHERE most > 1e-6 * length"""
        out["sca"] = "SELECT elem_id, 2e0 + cos(atan2(by_ - ay, bx - ax)) AS scalar FROM ele"
        out["rec"] = "SELECT oid, sum(frac * scalar) AS value FROM shr JOIN sca USING (elem_id) GROUP BY oid"
    else:
        out["cor"] = _corners()
        out["cub"] = _CROSSED
        out["tri"] = _triangles(spec)
    return out


#: Cells of ``cor`` that the surface crosses.
_CROSSED = "SELECT * FROM (SELECT *, " + " + ".join(f"{1 << c} * (v{c} > 0.5e0)::INT" for c in range(8)) + " AS cube_index FROM cor) WHERE cube_index NOT IN (0, 255)"


def _corners(step: int = 1) -> str:
    """Corner values of cells of ``step`` nodes a side."""
    v = lambda c: f"coalesce(max(CASE WHEN ni - ci = {step * (c & 1)} AND nj - cj = {step * (c >> 1 & 1)} AND nk - ck = {step * (c >> 2)} THEN CAST(CAST(round(frac, 9) AS FLOAT) AS DOUBLE) END), 0e0) AS v{c}"
    offsets = " ".join(f"CROSS JOIN (VALUES (0), ({step})) {x}(d{x})" for x in "xyz")
    taken = f" WHERE ni % {step} = 0 AND nj % {step} = 0 AND nk % {step} = 0" if step > 1 else ""
    return f"SELECT ci, cj, ck, {', '.join(v(c) for c in range(8))} FROM (SELECT ni, nj, nk, frac, ni - dx AS ci, nj - dy AS cj, nk - dz AS ck FROM nod {offsets}{taken}) GROUP BY ci, cj, ck"


def coarse(last: str) -> str:
    """As ``oracle(3, last)``, with ``tri`` by the classic cases on every second node, in cells whose upper corner's first index is 0 or 1 modulo 4."""
    made = ctes(3) | {"cor": _corners(2)}
    made["cub"] = f"SELECT * FROM ({_CROSSED}) WHERE (ci, cj, ck) IN (SELECT (ni - 2, nj - 2, nk - 2) FROM nod WHERE ni % 4 < 2)"
    made["tri"] = _triangles(SPACE, classic=True, step=2)
    return "WITH " + ",\n".join(f"{name} AS ({sql})" for name, sql in made.items()) + "\n" + last


def _slices(level: str = "0.5e0") -> list[str]:
    """Whether some slice across the third axis joins a diagonal of its corners: one condition for each diagonal and sign, on columns v0..v7."""
    lines = [(0, 4), (1, 5), (3, 7), (2, 6)]
    out = []
    for sign in (1, -1):
        for d in (0, 1):
            x = [tuple(f"({sign if n % 2 == d else -sign} * (v{c} - {level}))" for c in pair) for n, pair in enumerate(lines)]
            x = [x[d], x[d + 2], x[1 - d], x[3 - d]]
            lo = "greatest(0e0, " + ", ".join(f"CASE WHEN {u} > 0 THEN 0e0 WHEN {w} > 0 THEN {u} / ({u} - {w}) ELSE 2e0 END" for u, w in x) + ")"
            hi = "least(1e0, " + ", ".join(f"CASE WHEN {w} > 0 THEN 1e0 WHEN {u} > 0 THEN {u} / ({u} - {w}) ELSE -1e0 END" for u, w in x) + ")"
            (p, p1), (q, q1), (r, r1), (s, s1) = x
            a = f"({p1} - {p}) * ({q1} - {q}) - ({r1} - {r}) * ({s1} - {s})"
            b = f"{p} * ({q1} - {q}) + {q} * ({p1} - {p}) - {r} * ({s1} - {s}) - {s} * ({r1} - {r})"
            out.append(f"{{'lo': {lo}, 'hi': {hi}, 'a': {a}, 'b': {b}, 'c': {p} * {q} - {r} * {s}}}")
    return out


def located(source: str = "cub") -> str:
    """The cells of a table with ``joined``, and with ``inner`` by the cases' keys."""
    from ..operators.cubes import faces
    from ..operators.topology import relevant

    joined = []
    for f, (a, b, c, d) in enumerate(faces()):
        w = [f"(v{x} - 0.5e0)" for x in (a, b, c, d)]
        product = f"{w[0]} * {w[2]} - {w[1]} * {w[3]}"
        joined.append(f"CASE WHEN ({w[0]} > 0) = ({w[2]} > 0) AND ({w[1]} > 0) = ({w[3]} > 0) AND ({w[0]} > 0) <> ({w[1]} > 0) AND (CASE WHEN {w[0]} > 0 THEN {product} ELSE -({product}) END) > 0 THEN {1 << f} ELSE 0 END")
    g = lambda n, t: f"((g{n}.a * {t} + g{n}.b) * {t} + g{n}.c)"
    met = lambda n: f"(g{n}.lo < g{n}.hi AND greatest({g(n, f'g{n}.lo')}, {g(n, f'g{n}.hi')}, CASE WHEN g{n}.a < 0 THEN {g(n, f'least(g{n}.hi, greatest(g{n}.lo, -g{n}.b / (2 * g{n}.a)))')} ELSE {g(n, f'g{n}.lo')} END) > 0)"
    known: dict[int, list[str]] = {}
    for i, j, bit in relevant():
        known.setdefault(bit, []).append(str(i * 64 + j))
    inner = " ".join(f"WHEN {met(bit)} AND cube_index * 64 + joined IN ({', '.join(known[bit])}) THEN {bit}" for bit in sorted(known))
    slices = ", ".join(f"{x} AS g{n}" for n, x in enumerate(_slices()))
    return f"SELECT *, CAST(CASE {inner} ELSE 4 END AS INTEGER) AS inner_ FROM (SELECT *, CAST({' + '.join(joined)} AS INTEGER) AS joined, {slices} FROM {source})"


def _triangles(spec: GridSpec, classic: bool = False, step: int = 1) -> str:
    """Triangles of the crossed cells: joined faces by their saddle value and loops joined inside (neither if ``classic``), cases from the rule, corners on the edges or in the middle."""
    from ..operators import topology
    from ..operators.cubes import EDGES, cases

    at = []
    strength = [f"(1 / (abs(v{c} - 0.5e0) + 2.220446049250313e-16))" for c in range(8)]
    for n, cell in enumerate(spec.cell_axes):
        ends = []
        for a, b in EDGES:
            along = (b - a).bit_length() - 1 == n
            part = f"(0.5e0 - v{a}) / (v{b} - v{a})" if along else "0e0"
            ends.append(f"CASE WHEN (v{a} > 0.5e0) <> (v{b} > 0.5e0) THEN {spec.lo[n]}e0 + ({cell} + {step * (a >> n & 1)} + {step if along else 0} * {part}) * {spec.cell[n]}e0 END")
        ends.append(f"{spec.lo[n]}e0 + ({cell} + {step} * ({' + '.join(s for c, s in enumerate(strength) if c >> n & 1)}) / ({' + '.join(strength)})) * {spec.cell[n]}e0")
        at.append(f"[{', '.join(ends)}] AS e{'xyz'[n]}")
    table_ = ", ".join(f"({i}, {j}, 4, {', '.join(map(str, rest))})" for i, j, *rest in cases(True)) if classic else ", ".join(map(str, topology.cases()))
    keyed = "SELECT *, 0 AS joined, 4 AS inner_ FROM cub" if classic else located()
    corner = ", ".join(f"e{x}[s{n} + 1] AS {x}{n}" for n in range(3) for x in "xyz")
    square = "power((y1 - y0) * (z2 - z0) - (z1 - z0) * (y2 - y0), 2) + power((z1 - z0) * (x2 - x0) - (x1 - x0) * (z2 - z0), 2) + power((x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0), 2)"
    rows = f"SELECT ci, cj, ck, part, s0, s1, s2, {corner} FROM (SELECT *, {', '.join(at)} FROM ({keyed})) u JOIN (VALUES {table_}) c(index_, joined_, inside_, part, s0, s1, s2) ON cube_index = index_ AND joined = joined_ AND inner_ = inside_"
    return f"SELECT *, sqrt({square}) / 2 AS area FROM ({rows})"


def oracle(ndims: int, last: str) -> str:
    """``last`` after the common tables it may use."""
    return "WITH " + ",\n".join(f"{name} AS ({sql})" for name, sql in ctes(ndims).items()) + "\n" + last
