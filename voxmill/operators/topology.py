"""What the surface does inside a cell: which of its loops are joined by a tunnel, and how it is cut into triangles.

The corners of a sign that edges or faces connect are a component; the loops on
the cell's faces separate components of the two signs. Inside, two components of
one sign may still be joined through the component between them: the two loops
then bound a tube instead of a disc each.

A slice of the cell across its third axis is bilinear, so a region of it always
reaches one of its four corners, and two that are joined nowhere on the faces can
only be joined across a diagonal of a slice. Whether some slice joins a diagonal
is a question about a parabola between two bounds: ``joined_inside``.

Triangles may not have an edge between two points of one face besides the loops
themselves, for the cell beyond that face could have the same. Loops and tubes
that can't be cut so get a vertex in the cell's middle, slot 12.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cubes import CORNERS, EDGES, ambiguous, faces, trace

#: Slot of the vertex inside a cell, after those of the twelve edges.
CENTRE = len(EDGES)
#: The four lines along the third axis, by lower and upper corner, in the order around a slice; a diagonal has every other one.
LINES = ((0, 4), (1, 5), (3, 7), (2, 6))


def components(index: int, joined: int) -> list[int]:
    """For each corner, the smallest corner of its sign that edges and faces connect it with."""
    links = [e for e in EDGES if index >> e[0] & 1 == index >> e[1] & 1]
    for f in ambiguous(index):
        a, b, c, d = faces()[f]
        pairs = [(a, c), (b, d)]
        links += [p for p in pairs if (index >> p[0] & 1) == (joined >> f & 1)]
    at = list(range(8))
    while True:
        new = list(at)
        for a, b in links:
            new[a] = new[b] = min(new[a], new[b])
        if new == at:
            return at
        at = new


def tunnels(index: int, joined: int) -> dict[int, tuple[int, int]]:
    """For each bit of ``joined_inside`` that would join what is apart on the faces: the two loops it joins."""
    part, loops = components(index, joined), trace(index, joined)
    beside = []
    for loop in loops:
        a, b = EDGES[loop[0]]
        inside, outside = (a, b) if index >> a & 1 else (b, a)
        beside.append((part[inside], part[outside]))
    out = {}
    for bit in range(4):
        diagonal, sign = bit & 1, 1 - (bit >> 1)
        ends = [next((c for c in LINES[n] if index >> c & 1 == sign), None) for n in (diagonal, diagonal + 2)]
        if None in ends or part[ends[0]] == part[ends[1]]:
            continue
        mine, other = (0, 1) if sign else (1, 0)
        first, second = ([n for n, x in enumerate(beside) if x[mine] == part[e]] for e in ends)
        met = [(m, n) for m in first for n in second if beside[m][other] == beside[n][other]]
        if len(met) == 1:
            out[bit] = met[0]
    return out


@cache
def sides(edge: int) -> frozenset[int]:
    return frozenset(f for f, ring in enumerate(faces()) if set(EDGES[edge]) <= set(ring))


def _away(a: int, b: int) -> float:
    """Squared distance of the middles of two edges; far more if they lie on one face."""
    p, q = ([(CORNERS[x][k] + CORNERS[y][k]) / 2 for k in range(3)] for x, y in (EDGES[a], EDGES[b]))
    return sum((x - y) ** 2 for x, y in zip(p, q, strict=True)) + (1000 if sides(a) & sides(b) else 0)


def disc(loop: list[int]) -> list[tuple[int, int, int]]:
    """Triangles of a loop, by the shortest diagonals; about the centre if one of them must lie in a face."""
    n = len(loop)
    best: dict[tuple[int, int], tuple[float, list]] = {(a, a + 1): (0.0, []) for a in range(n - 1)}
    for span in range(2, n):
        for a in range(n - span):
            b, ways = a + span, []
            for m in range(a + 1, b):
                cost = best[a, m][0] + best[m, b][0] + sum(_away(loop[x], loop[y]) for x, y in ((a, m), (m, b)) if y - x > 1)
                ways.append((round(cost, 9), [*best[a, m][1], (a, b, m), *best[m, b][1]]))
            best[a, b] = min(ways)
    cost, cut = best[0, n - 1]
    if cost >= 1000:
        return [(loop[(k + 1) % n], loop[k], CENTRE) for k in range(n)]
    return [(loop[a], loop[b], loop[c]) for a, b, c in cut]


def tube(first: list[int], second: list[int]) -> list[tuple[int, int, int]]:
    """Triangles between two loops that run opposite ways round: the strip with the fewest edges in a face, then the shortest, or with a fan about the centre in place of some of it if that saves such an edge.

    Where three faces join the corners about one, six of a strip's nine edges may
    be in no face, so some are; they never bound the surface.
    """
    n, m = len(first), len(second)
    found = []
    for a, b in ((a, b) for a in range(n) for b in range(m) if _away(first[a], second[b]) < 1000):
        at = lambda i, j: (first[(a + i) % n], second[(b - j) % m])  # noqa: B023, E731
        along = lambda i, j: (at(i + 1, 0)[0], at(i, 0)[0], at(0, j)[1])  # noqa: B023, E731
        back = lambda i, j: (at(0, j)[1], at(0, j + 1)[1], at(i, 0)[0])  # noqa: B023, E731
        # the cheapest strip from a step on round to the start, by how many steps of its kind came before: a whole loop on end would meet itself
        rest: dict = {(n, m, "i", r): (0.0, []) for r in range(n)}
        for i, j in ((i, j) for i in range(n, -1, -1) for j in range(m, -1, -1)):
            here = _away(*at(i, j))
            for kind, r in [("i", r) for r in range(min(i, n - 1) + 1)] + [("j", r) for r in range(min(j, m - 1) + 1)]:
                ways = []
                if i < n and (run := r + 1 if kind == "i" else 1) < n and (i + 1, j, "i", run) in rest:
                    cost, cut = rest[i + 1, j, "i", run]
                    ways.append((cost, [along(i, j), *cut]))
                if j < m and (run := r + 1 if kind == "j" else 1) < m and (i, j + 1, "j", run) in rest:
                    cost, cut = rest[i, j + 1, "j", run]
                    ways.append((cost, [back(i, j), *cut]))
                if ways:
                    cost, cut = min(ways)
                    rest[i, j, kind, r] = (round(cost + here, 9), cut)
        if (0, 1, "j", 1) in rest:  # a strip that turns at the start
            cost, cut = rest[0, 1, "j", 1]
            found.append((round(cost + _away(*at(0, 0)), 9), [back(0, 0), *cut]))
        for i, j in ((i, j) for i in range(1, n) for j in range(1, m) if (i, j, "i", 0) in rest):
            ring = [at(k, 0)[0] for k in range(i + 1)] + [at(0, k)[1] for k in range(j, -1, -1)]
            fan = [(ring[(k + 1) % len(ring)], ring[k], CENTRE) for k in range(len(ring))]
            found.append((round(rest[i, j, "i", 0][0] + _away(*at(0, 0)) + 100, 9), [*fan, *rest[i, j, "i", 0][1]]))
    return min(found)[1]


@cache
def cases() -> tuple[tuple[int, int, int, int, int, int, int], ...]:
    """(index, joined, inner, triangle, slot, slot, slot), normals out of the solid. ``inner``: the bit of ``joined_inside`` that matters, 4 for none."""
    out = []
    for index in range(1, 255):
        open_ = ambiguous(index)
        for choice in range(1 << len(open_)):
            joined = sum(1 << f for n, f in enumerate(open_) if choice >> n & 1)
            loops = trace(index, joined)
            tubes: dict = {}
            for inner, pair in [(4, ()), *tunnels(index, joined).items()]:
                cut = [t for n, loop in enumerate(loops) if n not in pair for t in disc(loop)]
                if pair and pair not in tubes:
                    tubes[pair] = tube(loops[pair[0]], loops[pair[1]])
                cut += tubes.get(pair, [])
                out += [(index, joined, inner, n, *t) for n, t in enumerate(cut)]
    return tuple(out)


@cache
def relevant() -> tuple[tuple[int, int, int], ...]:
    """(index, joined, bit) for every bit that ``tunnels`` has."""
    return tuple(dict.fromkeys((i, j, b) for i, j, b, *_ in cases() if b < 4))


def joined_inside(level: float) -> Column:
    """Bits 1 << (diagonal + 2 * (0 for values above the level, 1 for the others)): some slice across the third axis joins that diagonal."""
    bits = F.lit(0)
    for bit in range(4):
        bits = bits + F.when(_slice_joins(bit & 1, 1 - (bit >> 1), level), 1 << bit).otherwise(0)
    return bits


def _slice_joins(diagonal: int, sign: int, level: float) -> Column:
    own = [LINES[diagonal], LINES[diagonal + 2]]
    others = [LINES[1 - diagonal], LINES[3 - diagonal]]
    value = lambda c, up: (F.col(f"v{c}") - level) if up else (F.lit(level) - F.col(f"v{c}"))
    ends = [(value(a, sign == 1), value(b, sign == 1)) for a, b in own] + [(value(a, sign == 0), value(b, sign == 0)) for a, b in others]
    # the slices where own lines have the sign and the others don't
    low = F.greatest(F.lit(0.0), *(F.when(x > 0, 0.0).otherwise(F.when(y > 0, x / (x - y)).otherwise(2.0)) for x, y in ends))
    high = F.least(F.lit(1.0), *(F.when(y > 0, 1.0).otherwise(F.when(x > 0, x / (x - y)).otherwise(-1.0)) for x, y in ends))
    (p, p1), (q, q1), (r, r1), (s, s1) = ends
    a = (p1 - p) * (q1 - q) - (r1 - r) * (s1 - s)
    b = p * (q1 - q) + q * (p1 - p) - r * (s1 - s) - s * (r1 - r)
    g = lambda t: (a * t + b) * t + (p * q - r * s)
    top = F.when(a < 0, g(F.least(high, F.greatest(low, -b / (2 * a))))).otherwise(g(low))
    return (low < high) & (F.greatest(g(low), g(high), top) > 0)


def inner_bit(level: float) -> Column:
    """The lowest bit of ``joined_inside`` that joins two loops in this case; 4 for none. Needs cube_index and joined."""
    known: dict[int, list[int]] = {}
    for index, joined, bit in relevant():
        known.setdefault(bit, []).append(index << 6 | joined)
    key, bits, out = F.col("cube_index") * 64 + F.col("joined"), F.col("inside"), F.lit(4)
    for bit in sorted(known, reverse=True):
        out = F.when(key.isin(known[bit]) & (F.shiftright(bits, bit).bitwiseAND(F.lit(1)) == 1), bit).otherwise(out)
    return out.cast("int")
