"""Repair, orientation, holes, thickness, decimation and subdivision against plain loops and what must hold of the result."""

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from meshloom.operators import decimate, repair, subdivide


def frames(spark, points, faces):
    v = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "vid long, x double, y double, z double")
    return v, spark.createDataFrame([(i, *t) for i, t in enumerate(faces)], "fid long, a long, b long, c long")


def collected(faces):
    return {r["fid"]: (r["a"], r["b"], r["c"]) for r in faces.collect()}


def sides(t):
    return [(t[0], t[1]), (t[1], t[2]), (t[2], t[0])]


def incidence(faces):
    return Counter(frozenset(s) for t in faces for s in sides(t))


def plain_fans(faces):
    """vid -> list of sets of fids that hang together at it; faces is a dict by fid."""
    at = defaultdict(set)
    for f, t in faces.items():
        for v in t:
            at[v].add(f)
    out = {}
    for v, mine in at.items():
        groups = []
        for f in sorted(mine):
            near = [g for g in groups if any(set(faces[f]) & set(faces[o]) - {v} for o in g)]
            groups = [g for g in groups if g not in near] + [{f}.union(*near)]
        out[v] = groups
    return out


def soup(seed, n_points, n_faces):
    rng = random.Random(seed)
    points = [(rng.random(), rng.random(), rng.random()) for _ in range(n_points)]
    return points, [tuple(rng.sample(range(n_points), 3)) for _ in range(n_faces)] + [(0, 0, 1), (2, 3, 2)]


def grid(n, m, height=lambda i, j: 0.0):
    """An open sheet of n by m points."""
    points = [(i, j, height(i, j)) for i in range(n) for j in range(m)]
    faces = []
    for i, j in itertools.product(range(n - 1), range(m - 1)):
        p = i * m + j
        faces += [(p, p + m, p + 1), (p + 1, p + m, p + m + 1)]
    return points, faces


def ball(n=10, m=16):
    """A closed surface of latitudes."""
    points = [(0.0, 0.0, 1.0)] + [(math.sin(t) * math.cos(f), math.sin(t) * math.sin(f), math.cos(t)) for t in (math.pi * i / n for i in range(1, n)) for f in (2 * math.pi * j / m for j in range(m))] + [(0.0, 0.0, -1.0)]
    at = lambda i, j: 1 + (i - 1) * m + j % m
    faces = [(0, at(1, j), at(1, j + 1)) for j in range(m)]
    for i, j in itertools.product(range(1, n - 1), range(m)):
        faces += [(at(i, j), at(i + 1, j), at(i, j + 1)), (at(i, j + 1), at(i + 1, j), at(i + 1, j + 1))]
    return points, faces + [(at(n - 1, j), len(points) - 1, at(n - 1, j + 1)) for j in range(m)]


def volume(points, faces):
    p = {i: np.array(x) for i, x in points.items()} if isinstance(points, dict) else [np.array(x, float) for x in points]
    return sum(np.dot(p[a], np.cross(p[b], p[c])) for a, b, c in faces) / 6


def agree(faces):
    """Whether every edge of two faces is run along in both directions."""
    directed = Counter(s for t in faces for s in sides(t))
    return all(n == 1 for n in directed.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_repaired_soup_is_a_manifold(spark, seed):
    points, faces = soup(seed, 12, 60)
    v, f = frames(spark, points, faces)
    new_v, new_f = repair.manifold(v, f)
    got, places = collected(new_f), {r["vid"]: (r["x"], r["y"], r["z"]) for r in new_v.collect()}
    assert max(incidence(got.values()).values()) <= 2
    assert all(len(g) == 1 for g in plain_fans(got).values())
    # the same faces at the same places, and the two largest of each crowded edge
    area = {i: round(float(np.linalg.norm(np.cross(*(np.array(points[t[k]]) - points[t[0]] for k in (1, 2)))) / 2), 12) for i, t in enumerate(faces)}
    sound = {i: t for i, t in enumerate(faces) if len(set(t)) == 3}
    best = defaultdict(list)
    for i, t in sorted(sound.items(), key=lambda x: (-area[x[0]], x[0])):
        for s in sides(t):
            best[frozenset(s)].append(i)
    want = {i: t for i, t in sound.items() if all(i in best[frozenset(s)][:2] for s in sides(t))}
    assert {i: [places[k] for k in t] for i, t in got.items()} == {i: [points[k] for k in t] for i, t in want.items()}
    assert len(places) == 12 + sum(len(g) - 1 for g in plain_fans(want).values())


def test_fans_of_two_cones_that_touch(spark):
    points, faces = [(0, 0, 0)] + [(math.cos(k), math.sin(k), s) for s in (1, -1) for k in range(6)], []
    faces = [(0, 1 + o + k, 1 + o + (k + 1) % 6) for o in (0, 6) for k in range(6)]
    v, f = frames(spark, points, faces)
    new_v, new_f = repair.split_vertices(v, f)
    got = collected(new_f)
    assert new_v.count() == 14 and {t[0] for t in got.values()} == {0, 13}
    assert [got[i][0] for i in range(12)] == [0] * 6 + [13] * 6


def test_turned_faces_agree_again(spark):
    points, faces = ball()
    rng = random.Random(1)
    mixed = [t if rng.random() < 0.5 else (t[0], t[2], t[1]) for t in faces]
    v, f = frames(spark, points, mixed)
    got = collected(repair.oriented(f))
    assert agree(got.values()) and got[0] == mixed[0]
    assert volume(points, collected(repair.oriented(f, v)).values()) == pytest.approx(abs(volume(points, faces)))


def test_a_band_with_one_side_has_no_flips(spark):
    n = 7
    faces = [(2 * k, 2 * k + 1, 2 * k + 2) for k in range(n)] + [(2 * k + 1, 2 * k + 3, 2 * k + 2) for k in range(n)]
    turn = {2 * n: 1, 2 * n + 1: 0}
    twisted = [tuple(turn.get(x, x) for x in t) for t in faces]
    _, f = frames(spark, [(0, 0, 0)] * (2 * n), twisted + [(100, 101, 102), (101, 100, 103)])
    got = {r["fid"]: (r["part"], r["flip"]) for r in repair.orientation(f).collect()}
    assert all(got[i] == (0, None) for i in range(2 * n)) and got[2 * n] == (2 * n, False) and got[2 * n + 1] == (2 * n, False)
    assert collected(repair.oriented(f)) == collected(f)


def plain_area(points, faces):
    return sum(np.linalg.norm(np.cross(points[b] - points[a], points[c] - points[a])) / 2 for a, b, c in faces)


@pytest.mark.parametrize("n", [3, 4, 5, 7])
def test_fillings_have_the_least_area(n):
    rng = np.random.default_rng(n)

    def all_of(i, j):
        """Every triangulation of the places i to j."""
        if j - i < 2:
            return [[]]
        return [[(i, k, j), *x, *y] for k in range(i + 1, j) for x in all_of(i, k) for y in all_of(k, j)]

    for barred in (set(), {(0, 2)}, {(0, 2), (1, 3), (0, 3)}):
        points = rng.normal(size=(n, 3))
        barred = {(i, j) for i, j in barred if j < n and (i, j) != (0, n - 1)}
        fine = [t for t in all_of(0, n - 1) if not any((min(s), max(s)) in barred and abs(s[0] - s[1]) > 1 for x in t for s in sides(x))]
        cost, got = repair.least_area(points, barred)
        if not fine:
            assert math.isinf(cost) and not got
            continue
        assert len(got) == n - 2 and cost == pytest.approx(min(plain_area(points, t) for t in fine)) and plain_area(points, got) == pytest.approx(cost)


def test_holes_are_ranked_and_closed(spark):
    points, faces = ball(12, 20)
    at = np.array(points)
    open_ = [t for t in faces if not (at[list(t)][:, 2] > 0.9).any() and not np.linalg.norm(at[list(t)] - [1, 0, 0], axis=1).min() < 0.3 and not (at[list(t)][:, 2] < -0.8).any()]
    v, f = frames(spark, points, open_)
    boundary = [s[::-1] for t in open_ for s in sides(t) if incidence(open_)[frozenset(s)] == 1]
    ahead = dict(boundary)
    want, seen = {}, set()
    for start in sorted(ahead):
        ring = []
        x = start
        while x not in seen:
            seen.add(x)
            ring.append(x)
            x = ahead[x]
        want |= {x: (start, k, len(ring)) for k, x in enumerate(ring)}
    got = {r["vid"]: (r["loop"], r["place"], r["n"]) for r in repair.loop_ranks(repair.boundary_next(f)).collect()}
    assert got == want and len({x[0] for x in want.values()}) == 3
    short = min(x[2] for x in want.values())
    some = collected(repair.closed_holes(v, f, short))
    assert sum(n == 1 for n in incidence(some.values()).values()) == sum(x[2] > short for x in want.values())
    whole = collected(repair.closed_holes(v, f))
    assert set(incidence(whole.values()).values()) == {2} and agree(whole.values())
    assert {k: whole[k] for k in range(len(open_))} == dict(enumerate(open_))


def test_a_strip_has_no_hole_that_edges_bar(spark):
    """The loop of two triangles is a quadrangle whose only chords are an edge of the mesh and the other diagonal."""
    v, f = frames(spark, [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0)], [(0, 1, 2), (0, 2, 3)])
    got = collected(repair.closed_holes(v, f))
    assert set(incidence(got.values()).values()) == {2} and agree(got.values()) and len(got) == 4


def test_solid_sheet(spark):
    points, faces = grid(5, 4)
    v, f = frames(spark, points, faces)
    for offset in (1.0, 0.0, -1.0):
        new_v, new_f = repair.solidified(v, f, 0.5, offset)
        got, at = collected(new_f), {r["vid"]: (r["x"], r["y"], r["z"]) for r in new_v.collect()}
        assert set(incidence(got.values()).values()) == {2} and agree(got.values())
        assert volume(at, got.values()) == pytest.approx(4 * 3 * 0.5)
        assert {p[2] for p in at.values()} == {-(1 - offset) / 4, (1 + offset) / 4}


# decimation


def plain_quadrics(points, faces):
    q = defaultdict(lambda: np.zeros((4, 4)))
    count = incidence(faces)
    for t in faces:
        a, b, c = (np.array(points[k], float) for k in t)
        n = np.cross(b - a, c - a)
        area = np.linalg.norm(n) / 2
        n /= 2 * area
        plane = np.append(n, -n @ a)
        for k in t:
            q[k] += area * np.outer(plane, plane)
        for s, e in sides(t):
            if count[frozenset((s, e))] == 1:
                along = np.array(points[e], float) - points[s]
                m = np.cross(n, along) / np.linalg.norm(along)
                m = np.append(m, -m @ points[s])
                for k in (s, e):
                    q[k] += along @ along * np.outer(m, m)
    return q


def test_quadrics_and_bids_equal_plain_forms(spark):
    points, faces = grid(6, 5, lambda i, j: math.sin(i) * math.cos(1.3 * j) + 0.01 * i)
    v, f = frames(spark, points, faces)
    want = plain_quadrics(points, faces)
    form = decimate.quadrics(v, f)
    rows = {r["vid"]: r for r in form.collect()}
    for vid, m in want.items():
        got = np.array([[rows[vid]["".join(sorted(x + y, key="xyzw".index))] for y in "xyzw"] for x in "xyzw"])
        assert np.allclose(got, m, atol=1e-12)
    edges = spark.createDataFrame([(min(e), max(e), n) for e, n in incidence(faces).items()], "u long, w long, inc long")
    for r in decimate.bids(v.join(form, "vid"), edges).collect():
        m, at = want[r["u"]] + want[r["w"]], np.array([r["px"], r["py"], r["pz"], 1.0])
        assert r["cost"] == pytest.approx(max(at @ m @ at, 0), abs=1e-9)
        one, two = np.array(points[r["u"]]), np.array(points[r["w"]])
        ends = [np.append(x, 1.0) for x in (one, two, (one + two) / 2)]
        assert r["cost"] <= min(max(x @ m @ x, 0) for x in ends) + 1e-9


def test_winners_share_no_face(spark):
    points, faces = grid(12, 12, lambda i, j: math.sin(i * j))
    v, f = frames(spark, points, faces)
    got = decimate.one_round(v.join(decimate.quadrics(v, f), "vid"), f).collect()
    near = defaultdict(set)
    for e in incidence(faces):
        u, w = e
        near[u].add(w)
        near[w].add(u)
    reach = [{r["u"], r["w"]} | near[r["u"]] | near[r["w"]] for r in got]
    assert len(got) > 6 and all(not reach[i] & {got[j]["u"], got[j]["w"]} for i in range(len(got)) for j in range(len(got)) if i != j)


@pytest.mark.parametrize("kind", ["ball", "sheet"])
def test_decimated_surface(spark, kind):
    points, faces = ball(10, 16) if kind == "ball" else grid(11, 11, lambda i, j: 0.3 * math.sin(i / 3) * math.cos(j / 4))
    v, f = frames(spark, points, faces)
    target, rounds = (180 if kind == "ball" else 110), []
    new_v, new_f = decimate.decimated(v, f, target, rounds)
    got, at = collected(new_f), {r["vid"]: (r["x"], r["y"], r["z"]) for r in new_v.collect()}
    assert target - 2 <= len(got) <= target
    count = incidence(got.values())
    assert agree(got.values()) and all(len(g) == 1 for g in plain_fans(got).values()) and set(at) == {x for t in got.values() for x in t}
    if kind == "ball":
        assert set(count.values()) == {2} and len(at) - len(count) + len(got) == 2
        assert volume(at, got.values()) == pytest.approx(volume(points, faces), rel=0.05)
        assert max(abs(math.dist(p, (0, 0, 0)) - 1) for p in at.values()) < 0.1
    else:
        assert set(count.values()) == {1, 2} and len(at) - len(count) + len(got) == 1
        assert sequential_error(points, faces, at, got) < 4 and sum(n for _, n in rounds) >= (len(faces) - len(got)) / 2


def sequential_error(points, faces, at, got):
    """The largest distance of the new places from the sheet's surface, over that of collapsing always the cheapest edge to its better end or middle."""
    height = lambda i, j: 0.3 * math.sin(i / 3) * math.cos(j / 4)
    q = plain_quadrics(points, faces)
    place, left = {i: np.array(p, float) for i, p in enumerate(points)}, {i: t for i, t in enumerate(faces)}

    def options(u, w):
        m = q[u] + q[w]
        return min((max(np.append(x, 1) @ m @ np.append(x, 1), 0), tuple(x)) for x in (place[u], place[w], (place[u] + place[w]) / 2))

    while len(left) > len(got):
        count = incidence(left.values())
        near = defaultdict(set)
        for e in count:
            u, w = e
            near[u].add(w)
            near[w].add(u)
        rim = {x for e, n in count.items() if n == 1 for x in e}
        best = None
        for e, n in count.items():
            u, w = sorted(e)
            if len(near[u] & near[w]) != n or n == 2 and u in rim and w in rim:
                continue
            cost, x = options(u, w)
            if best is None or cost < best[0]:
                around = [t for t in left.values() if (u in t) != (w in t)]
                normal = lambda t, moved: np.cross(*(((np.array(x) if moved and t[k] in (u, w) else place[t[k]]) - (np.array(x) if moved and t[0] in (u, w) else place[t[0]])) for k in (1, 2)))
                if all(normal(t, False) @ normal(t, True) > 0 for t in around):
                    best = (cost, u, w, x)
        _, u, w, x = best
        q[u] = q[u] + q[w]
        place[u] = np.array(x)
        left = {i: tuple(u if k == w else k for k in t) for i, t in left.items() if not (u in t and w in t)}
    far = lambda ps: max(abs(p[2] - height(p[0], p[1])) for p in ps)
    return far(at.values()) / max(far(place[k] for t in left.values() for k in t), 1e-3)


# subdivision


def test_cut_edges_leave_no_vertex_hanging(spark):
    """All ways to cut a face occur, and the sheet stays what it was."""
    rng = random.Random(5)
    points, faces = grid(7, 6)
    points = [(x + rng.uniform(-0.3, 0.3), y + rng.uniform(-0.3, 0.3), 0.0) for x, y, _ in points]
    v, f = frames(spark, points, faces)
    new_v, new_f = subdivide.subdivided(v, f, 1.1, steps=2, smooth=False)
    at, got = {r["vid"]: np.array((r["x"], r["y"], r["z"])) for r in new_v.collect()}, collected(new_f)
    count = incidence(got.values())
    assert agree(got.values()) and len(at) - len(count) + len(got) == 1
    area = lambda ps, ts: sum(np.cross(ps[b] - ps[a], ps[c] - ps[a])[2] / 2 for a, b, c in ts)
    assert area(at, got.values()) == pytest.approx(area([np.array(p) for p in points], faces))
    assert all(np.cross(at[b] - at[a], at[c] - at[a])[2] != 0 for a, b, c in got.values())
    once = {i // 4: 0 for i in range(4 * len(faces))}
    for i in collected(subdivide.subdivided(v, f, 1.1, smooth=False)[1]):
        once[i // 4] += 1
    assert set(once.values()) == {1, 2, 3, 4}


def test_smooth_subdivision_of_a_ball(spark):
    points, faces = ball(6, 8)
    v, f = frames(spark, points, faces)
    new_v, new_f = subdivide.subdivided(v, f, 0.0)
    got, at = collected(new_f), {r["vid"]: (r["x"], r["y"], r["z"]) for r in new_v.collect()}
    assert len(got) == 4 * len(faces) and set(incidence(got.values()).values()) == {2} and agree(got.values())
    near = {p for e in incidence(faces) if 0 in e for p in e} - {0}
    mean = np.mean([points[p] for p in near], axis=0)
    assert np.allclose(at[0], 5 / 8 * np.array(points[0]) + 3 / 8 * mean)
    assert subdivide.subdivided(v, f, 9.0)[1].count() == len(faces)
