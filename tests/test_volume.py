"""Signed distances and volumetric reconstruction against plain loops and what must hold of the result."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from meshloom.operators import volume
from meshloom.sources.store import materialise


def frames(spark, points, faces):
    v = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "vid long, x double, y double, z double")
    return v, spark.createDataFrame([(i, *t) for i, t in enumerate(faces)], "fid long, a long, b long, c long")


def box(x, y, z):
    """A box about the origin, two triangles a side, outwards."""
    points = [(sx * x / 2, sy * y / 2, sz * z / 2) for sz in (-1, 1) for sy in (-1, 1) for sx in (-1, 1)]
    quads = [(0, 2, 3, 1), (4, 5, 7, 6), (0, 1, 5, 4), (2, 6, 7, 3), (0, 4, 6, 2), (1, 3, 7, 5)]
    return points, [t for p, q, r, s in quads for t in ((p, q, r), (p, r, s))]


def ball(times):
    """A ball of radius 1 from an octahedron whose sides are halved."""
    points = [np.array(p, float) for p in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))]
    faces = [(0, 2, 4), (2, 1, 4), (1, 3, 4), (3, 0, 4), (2, 0, 5), (1, 2, 5), (3, 1, 5), (0, 3, 5)]
    for _ in range(times):
        named, more = {}, []

        def middle(p, q, named=named):
            if frozenset((p, q)) not in named:
                m = points[p] + points[q]
                named[frozenset((p, q))] = len(points)
                points.append(m / np.linalg.norm(m))
            return named[frozenset((p, q))]

        for a, b, c in faces:
            ab, bc, ca = middle(a, b), middle(b, c), middle(c, a)
            more += [(a, ab, ca), (ab, b, bc), (ca, bc, c), (ab, bc, ca)]
        faces = more
    return points, faces


def plain_distance(p, a, b, c):
    """By the plane's foot, the sides and the corners."""
    n = np.cross(b - a, c - a)
    n = n / np.linalg.norm(n)
    foot = p - ((p - a) @ n) * n
    if all(np.cross(r - q, foot - q) @ n >= 0 for q, r in ((a, b), (b, c), (c, a))):
        return abs((p - a) @ n)
    out = []
    for q, r in ((a, b), (b, c), (c, a)):
        t = min(max((p - q) @ (r - q) / ((r - q) @ (r - q)), 0), 1)
        out.append(np.linalg.norm(p - q - t * (r - q)))
    return min(out)


def measured(v, f):
    """Places, triangles, volume and area of the collected surface."""
    at = {r["vid"]: np.array((r["x"], r["y"], r["z"])) for r in v.collect()}
    tri = [(r["a"], r["b"], r["c"]) for r in f.collect()]
    assert {k for t in tri for k in t} == set(at)
    return at, tri, sum(at[a] @ np.cross(at[b], at[c]) for a, b, c in tri) / 6, sum(np.linalg.norm(np.cross(at[b] - at[a], at[c] - at[a])) for a, b, c in tri) / 2


def is_closed(tri):
    """Each side once either way, and Euler's number of a ball."""
    sides = Counter(s for a, b, c in tri for s in ((a, b), (b, c), (c, a)))
    assert all(n == 1 and sides[q, p] == 1 for (p, q), n in sides.items())
    return len({k for t in tri for k in t}) - len(sides) // 2 + len(tri)


def test_cases_fit_together():
    """Every edge of a case's triangles lies on a face of the tetrahedron or is met from the other side."""
    table = volume.cases()
    assert len({c[:3] for c in table}) == len(table) == 6 * (8 + 6 * 2)
    for tet, mask in {c[:2] for c in table}:
        tri = [c[3] for c in table if c[:2] == (tet, mask)]
        inner = [n for n in Counter(frozenset((p, q)) for t in tri for p, q in zip(t, t[1:] + t[:1], strict=True)).values() if n == 2]
        assert len(inner) == len(tri) - 1
        # the opposite mask has the same edges
        assert {e for t in tri for e in t} == {e for c in table if c[:2] == (tet, 15 - mask) for e in c[3]}


@pytest.mark.parametrize(("shape", "size", "truth"), [("box", 0.17, 1.5 * 1.0 * 0.8), ("ball", 0.15, 4 / 3 * math.pi)])
def test_solids_keep_their_volume(spark, shape, size, truth):
    v, f = frames(spark, *(box(1.5, 1.0, 0.8) if shape == "box" else ball(3)))
    at, tri, held, area = measured(*volume.reconstructed(v, f, size))
    assert is_closed(tri) == 2
    assert abs(held - truth) < size * area and held > 0
    assert abs(held - truth) < 0.05 * truth  # far less than a voxel all round
    if shape == "ball":
        assert all(abs(np.linalg.norm(p) - 1) < size / 4 for p in at.values())


def test_distances_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(volume, "PIECE", 2)  # so that triangles are met in pieces
    points, faces = ball(0)
    rng = random.Random(5)
    points = [p * (1 + 0.3 * rng.random()) for p in points]
    size = 0.21
    v, f = frames(spark, points, faces + [(0, 0, 1)])
    got = {(r["i"], r["j"], r["k"]): r for r in volume.distances(v, f, size).collect()}
    reach, n = volume.REACH * size, 8
    for i, j, k in [(i, j, k) for i in range(-n, n + 1) for j in range(-n, n + 1) for k in range(-n, n + 1)]:
        p = np.array((i, j, k)) * size
        d = min(plain_distance(p, *(points[c] for c in t)) for t in faces)
        if abs(d - reach) < 1e-9:
            continue
        assert ((i, j, k) in got) == (d < reach)
        if d < reach:
            # each octant's face bounds the solid, which is a star about the origin
            inside = any(np.all(np.linalg.solve(np.stack([points[c] for c in t], axis=1), p) >= -1e-12) and np.linalg.solve(np.stack([points[c] for c in t], axis=1), p).sum() < 1 for t in faces)
            assert got[i, j, k]["value"] == pytest.approx(-d if inside else d, abs=1e-9) and not got[i, j, k]["rim"]
    assert len({r["node"] for r in got.values()}) == len(got)


def test_open_sheet_ends_near_its_boundary(spark):
    n = 8
    points = [(i * 0.25, j * 0.25, 0.03) for i in range(n) for j in range(n)]
    faces = [t for i in range(n - 1) for j in range(n - 1) for p in [i * n + j] for t in ((p, p + n, p + 1), (p + 1, p + n, p + n + 1))]
    v, f = frames(spark, points, faces)
    size, side = 0.1, 0.25 * (n - 1)
    at, tri, _, area = measured(*volume.reconstructed(v, f, size))
    assert all(-1e-9 <= p[0] <= side + 1e-9 and -1e-9 <= p[1] <= side + 1e-9 and abs(p[2] - 0.03) < 1e-9 for p in at.values())
    assert (side - 4 * size) ** 2 < area <= side**2
    sides = Counter(frozenset(s) for a, b, c in tri for s in ((a, b), (b, c), (c, a)))
    assert set(sides.values()) == {1, 2}


def test_two_parts_and_a_hollow(spark):
    outer, inner = ball(2), ball(2)
    points = [p * 1.0 for p in outer[0]] + [p * 0.5 for p in inner[0]] + [p * 0.6 + np.array((3, 0, 0)) for p in outer[0]]
    k = len(outer[0])
    faces = outer[1] + [(a + k, c + k, b + k) for a, b, c in inner[1]] + [(a + 2 * k, b + 2 * k, c + 2 * k) for a, b, c in outer[1]]
    _, tri, held, _ = measured(*volume.reconstructed(*frames(spark, points, faces), 0.12))
    assert is_closed(tri) == 6
    assert held == pytest.approx(4 / 3 * math.pi * (1 - 0.125 + 0.216), rel=0.12)


def test_nothing_and_bad_sizes(spark):
    v, f = frames(spark, *box(1, 1, 1))
    for empty in (volume.reconstructed(v, f.limit(0), 0.1), volume.reconstructed(v.limit(0), f, 0.1)):
        assert empty[0].count() == 0 and empty[1].count() == 0
    with pytest.raises(ValueError, match="above zero"):
        volume.distances(v, f, 0.0)
    with pytest.raises(Exception, match="too fine"):
        volume.distances(v, f.limit(1), 1e-6).collect()
    with pytest.raises(ValueError, match="no extent"):
        volume.size_of(v.limit(1), 0.5)
    assert volume.size_of(v, 50) == pytest.approx(math.sqrt(3) / 2)


def test_given_field(spark):
    """A field by a formula: a torus has Euler's number 0."""
    size, n = 0.25, 8
    rows = [(i, j, k, math.hypot(math.hypot(i, j) * size - 1.2, k * size) - 0.5) for i in range(-n, n + 1) for j in range(-n, n + 1) for k in range(-4, 5)]
    nodes = spark.createDataFrame(rows, "i long, j long, k long, value double")
    zero = 1 << (volume.BITS - 1)
    nodes = materialise(nodes.selectExpr(f"(((i + {zero}) * {1 << volume.BITS}) + (j + {zero})) * {1 << volume.BITS} + (k + {zero}) AS node", "i", "j", "k", "value", "false AS rim"), "nodes")
    _, tri, held, _ = measured(*volume.extracted(nodes, size))
    assert is_closed(tri) == 0
    assert held == pytest.approx(2 * math.pi**2 * 1.2 * 0.25, rel=0.15)
