"""Interior cases of the iso-surface against the regions of the trilinear function itself."""

import random
from collections import Counter

import pytest

from voxmill.operators import cubes, topology
from voxmill.operators.cubes import CORNERS, EDGES
from voxmill.spec import GridSpec


def regions(values, axis):
    """Components of the trilinear function's positive and of its negative part, from slices across an axis: the sign pattern of a slice changes only where a line or the saddle does."""
    u, v = (axis + 1) % 3, (axis + 2) % 3
    lines = []
    for a, b in ((0, 0), (1, 0), (1, 1), (0, 1)):
        ends = [next(c for c, p in enumerate(CORNERS) if p[axis] == s and p[u] == a and p[v] == b) for s in (0, 1)]
        lines.append((values[ends[0]], values[ends[1]]))
    events = {0.0, 1.0}
    for a, b in lines:
        if (a > 0) != (b > 0):
            events.add(a / (a - b))
    (p, p1), (q, q1), (r, r1), (s, s1) = lines
    a = (p1 - p) * (r1 - r) - (q1 - q) * (s1 - s)
    b = p * (r1 - r) + r * (p1 - p) - q * (s1 - s) - s * (q1 - q)
    c = p * r - q * s
    if a and b * b - 4 * a * c >= 0:
        for sign in (1, -1):
            t = (-b + sign * (b * b - 4 * a * c) ** 0.5) / (2 * a)
            if 0 < t < 1:
                events.add(t)
    cuts = sorted(events)
    middles = [(x + y) / 2 for x, y in zip(cuts, cuts[1:]) if y - x > 1e-12]
    parent = {}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def join(x, y):
        parent[max(top(x), top(y))] = min(top(x), top(y))

    before = None
    for k, t in enumerate(middles):
        now = [x + (y - x) * t for x, y in lines]
        for n in range(4):
            parent[k, n] = (k, n)
        for n in range(4):
            if (now[n] > 0) == (now[(n + 1) % 4] > 0):
                join((k, n), (k, (n + 1) % 4))
            if before and (now[n] > 0) == (before[n] > 0):
                join((k, n), (k - 1, n))
        positive = now[0] * now[2] - now[1] * now[3] > 0
        for n in (0, 1):
            if (now[n] > 0) == (now[n + 2] > 0) and (now[n] > 0) != (now[n + 1] > 0) and (now[n + 1] > 0) == (now[(n + 3) % 4] > 0) and positive == (n == 0):
                join((k, n), (k, n + 2))
        before = now
    return len({top(x) for x in parent})


@pytest.fixture(scope="module")
def drawn(spark):
    draw = random.Random(4)
    cells = []
    for index in range(1, 255):
        for n in range(100):
            size = lambda: 10 ** draw.uniform(-2, 1) if n % 2 else draw.uniform(0.05, 1)  # noqa: B023, E731
            cells.append((index * 1000 + n, 0, 0, index, *(size() if index >> c & 1 else -size() for c in range(8))))
    schema = "ci int, cj int, ck int, cube_index int, " + ", ".join(f"v{c} double" for c in range(8))
    return spark.createDataFrame(cells, schema), {r[0]: r for r in cells}


def test_regions_and_tunnels(drawn):
    table, cells = drawn
    met = Counter()
    for r in cubes.located(table, 0.0).collect():
        values = cells[r.ci][4:]
        apart = len(set(topology.components(r.cube_index, r.joined)))
        assert regions(values, 0) == regions(values, 1) == regions(values, 2) == apart - (r.inner < 4), r
        met[r.inner < 4] += 1
    assert met[True] > 200 and met[False] > 5000


def test_triangles_follow_the_case(drawn, spark):
    """Each cell's triangles have the cell's loops for their border and as many holes as the regions ask for."""
    table, cells = drawn
    pieces = {}
    for index, joined, inner, _, *t in topology.cases():
        pieces.setdefault((index, joined, inner), []).append(tuple(t))
    for (index, joined, inner), cut in pieces.items():
        sides = Counter((t[n], t[(n + 1) % 3]) for t in cut for n in range(3))
        loops = cubes.trace(index, joined)
        assert max(sides.values()) == 1
        assert {s for s in sides if s[::-1] not in sides} == {(loop[(n + 1) % len(loop)], loop[n]) for loop in loops for n in range(len(loop))}
        euler = len({x for t in cut for x in t}) - len({frozenset(s) for s in sides}) + len(cut)
        assert euler == (len(loops) if inner == 4 else len(loops) - 2)
    counts = {r.ci: r["count"] for r in cubes.triangles(table, GridSpec((0.0,) * 3, (1.0,) * 3, (1,) * 3), 0.0).groupBy("ci").count().collect()}
    for r in cubes.located(table, 0.0).collect():
        assert counts[r.ci] == len(pieces[r.cube_index, r.joined, r.inner])


def test_vertices_lie_where_they_should(drawn):
    table, cells = drawn
    spec = GridSpec((0.0,) * 3, (1.0,) * 3, (1,) * 3)
    n_middle = 0
    for r in cubes.triangles(table, spec, 0.0).where("ci % 7 = 0").collect():
        values = cells[r.ci][4:]
        for t, e in ((r.t0, r.e0), (r.t1, r.e1), (r.t2, r.e2)):
            x, y, z = t.x - r.ci, t.y, t.z
            f = sum(v * (x if p[0] else 1 - x) * (y if p[1] else 1 - y) * (z if p[2] else 1 - z) for v, p in zip(values, CORNERS))
            if e.axis == 3:
                n_middle += 1
                strength = [1 / (abs(v) + 2.0**-52) for v in values]
                assert (x, y, z) == pytest.approx([sum(s for s, p in zip(strength, CORNERS) if p[b]) / sum(strength) for b in range(3)], abs=1e-6)
            else:
                assert f == pytest.approx(0, abs=1e-4)
    assert n_middle > 50


def test_tunnel_through_opposite_corners(spark):
    """Two opposite corners: strong ones are joined through the middle, weak ones are not."""
    for strength, inner, n in ((5.0, True, 6), (0.2, False, 2)):
        values = [strength if c in (0, 7) else -1.0 for c in range(8)]
        row = spark.createDataFrame([(0, 0, 0, 129, *values)], "ci int, cj int, ck int, cube_index int, " + ", ".join(f"v{c} double" for c in range(8)))
        assert (cubes.located(row, 0.0).first().inner < 4) == inner
        made = cubes.triangles(row, GridSpec((0.0,) * 3, (1.0,) * 3, (1,) * 3), 0.0)
        assert made.count() == n
        assert cubes.triangles(row, GridSpec((0.0,) * 3, (1.0,) * 3, (1,) * 3), 0.0, interior=False).count() == 2


def test_noisy_surface_is_closed(spark):
    from voxmill.plans.interiors import NOISE, noise_cells

    sf = "/root/testdata/sf0.01"
    cells = noise_cells(spark, sf)
    made = cubes.triangles(cells, NOISE).collect()
    sides = Counter()
    for r in made:
        for p, q in ((r.e0, r.e1), (r.e1, r.e2), (r.e2, r.e0)):
            sides[p, q] += 1
    assert all(sides[q, p] == n for (p, q), n in sides.items())
    patterns = {r.cube_index for r in cells.select("cube_index").distinct().collect()}
    assert len(patterns) == 254
    vertices, faces = cubes.iso_surface(*(cells.sparkSession.createDataFrame([(0, 0, 0, 5.0), (1, 1, 1, 5.0), (0, 1, 0, -1.0), (1, 0, 0, -1.0)], "ni int, nj int, nk int, frac double"), NOISE), level=0.5, gradients=True)
    assert faces.count() > 0 and vertices.where("nx is null").count() == 0
