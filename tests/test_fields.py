"""Fields, selections and files against dense solutions and plain loops on small meshes."""

import heapq
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshloom.functions import colour
from meshloom.operators import fields, metrics, sampling, topology
from meshloom.sources import ply
from meshloom.sources.store import shared_dir

RING, RINGS = 8, 9


@pytest.fixture(scope="module")
def limb(spark):
    """An open limb of uneven rings: vertices, faces, and both as arrays."""
    rng = np.random.default_rng(4)
    v = [(i, float(r * math.cos(2 * math.pi * (i % RING) / RING)), float(r * math.sin(2 * math.pi * (i % RING) / RING)), 0.4 * (i // RING) + float(z)) for i, (r, z) in enumerate(zip(rng.uniform(0.8, 1.3, RING * RINGS), rng.uniform(0, 0.2, RING * RINGS), strict=True))]
    f = []
    for a in range(RING * (RINGS - 1)):
        b = a // RING * RING + (a + 1) % RING
        f += [(2 * a, a, b, a + RING), (2 * a + 1, b, b + RING, a + RING)]
    frames = spark.createDataFrame(v, "vid long, x double, y double, z double"), spark.createDataFrame(f, "fid long, a long, b long, c long")
    return *frames, v, f


def dense_of(entries, n):
    out = np.zeros((n, n))
    for r in entries.collect():
        out[r["i"], r["j"]] += r["val"]
    return out


@pytest.mark.parametrize(("leaf", "top"), [(10, 8), (256, 2048)])
def test_harmonic_field_equals_dense_solution(spark, limb, leaf, top):
    v, f, points, _ = limb
    n = len(points)
    entries = metrics.cotan_laplacian(f, v)
    ends = spark.createDataFrame([(i, 0.0) for i in range(RING)] + [(i, 1.0) for i in range(n - RING, n)], "vid long, value double")
    got = {r["vid"]: r["t"] for r in fields.solve_harmonic(entries, ends, v, leaf=leaf, top=top).collect()}
    a, t = dense_of(entries, n), np.zeros(n)
    t[n - RING :] = 1
    free = np.arange(RING, n - RING)
    t[free] = np.linalg.solve(a[np.ix_(free, free)], -a[free] @ t)
    t = (t - t.min()) / (t.max() - t.min())
    assert max(abs(got[i] - t[i]) for i in range(n)) < 1e-8


@pytest.mark.parametrize(("leaf", "top"), [(20, 8), (256, 2048)])
def test_diffusion_map_equals_dense_vectors(limb, leaf, top):
    v, f, points, _ = limb
    n, k, t = len(points), 5, 0.01
    entries, mass = metrics.cotan_laplacian(f, v), metrics.lumped_mass(f, v)
    got = {r["vid"]: r["coordinates"] for r in fields.diffusion_embedding(entries, mass, k, t, vertices=v, tolerance=1e-7, leaf=leaf, top=top).collect()}
    m = np.array([r["mass"] for r in mass.orderBy("vid").collect()])
    values, vectors = np.linalg.eigh(dense_of(entries, n) / np.sqrt(m)[:, None] / np.sqrt(m)[None, :])
    want = vectors[:, 1 : k + 1] / np.sqrt(m)[:, None] * np.exp(-values[1 : k + 1] * t)
    assert np.abs(np.abs([got[i] for i in range(n)]) - np.abs(want)).max() < 1e-4


def adjacency(limb):
    _, _, points, faces = limb
    place = {i: p for i, *p in points}
    near = {i: {} for i in place}
    for _, a, b, c in faces:
        for u, w in ((a, b), (b, c), (c, a)):
            near[u][w] = near[w][u] = math.dist(place[u], place[w])
    return near


def test_geodesic_selection_equals_one_after_the_other(spark, limb):
    v, f, points, _ = limb
    rng = np.random.default_rng(5)
    rows = [(i, float(rng.integers(6)) / 5, float(rng.uniform(0.5, 1.2))) for i, *_ in points]
    edges = topology.with_lengths(topology.edge_incidence(f), v)
    got = {r["vid"]: r["place"] for r in sampling.geodesic_select(edges, spark.createDataFrame(rows, "vid long, w double, radius double")).collect()}
    near, dist, label, want = adjacency(limb), {}, {}, []
    for vid, _, radius in sorted(rows, key=lambda r: (-r[1], r[0])):
        if vid in dist and dist[vid] < (radius + label[vid]) / 2:
            continue
        want.append(vid)
        heap, dist[vid], label[vid] = [(0.0, vid)], 0.0, radius
        while heap:
            d, u = heapq.heappop(heap)
            for w, length in near[u].items() if d <= dist[u] else ():
                if d + length < dist.get(w, math.inf) - 1e-12:
                    dist[w], label[w] = d + length, radius
                    heapq.heappush(heap, (d + length, w))
    assert got == {vid: k for k, vid in enumerate(want)}
    assert sampling.geodesic_select(edges, spark.createDataFrame([], "vid long, w double, radius double")).isEmpty()


def test_centre_weighted_sample_keeps_its_rules(limb):
    v, f, _, _ = limb
    holed = f.filter("fid <> 61")
    config = sampling.SampleConfig(n_points=60, oversample=5, rmin=0.3, rmax_mult=3.0, delta=0.1, eps=0.2, hole_keepout=0.25)
    out = sampling.center_weighted(v, holed, config).collect()
    assert 10 < len(out) <= 60
    for i, p in enumerate(out):
        assert 0.1 <= p["t"] <= 0.9 and 0 <= p["w"] <= 1
        for q in out[:i]:
            assert math.dist((p["x"], p["y"], p["z"]), (q["x"], q["y"], q["z"])) >= (p["radius"] + q["radius"]) / 2
    ends, holes = sampling.end_sets(v, holed, config)
    assert {(r["vid"] < RING, r["value"]) for r in ends.collect()} in ({(True, 0.0), (False, 1.0)}, {(True, 1.0), (False, 0.0)}) and ends.count() == 2 * RING
    place = {r["vid"]: (r["x"], r["y"], r["z"]) for r in v.collect()}
    assert holes.count() == 3 and all(math.dist((p["x"], p["y"], p["z"]), place[h["vid"]]) >= 0.25 for p in out for h in holes.collect())
    with pytest.raises(ValueError, match="no candidate"):
        sampling.center_weighted(v, f, sampling.SampleConfig(n_points=5, oversample=2, delta=0.5, eps=0.1))


def test_cleaning_keeps_the_largest_part(spark):
    v = spark.createDataFrame([(i, float(i % 3), float(i // 3), 0.0) for i in range(12)], "vid long, x double, y double, z double")
    f = spark.createDataFrame([(0, 0, 1, 3), (1, 1, 4, 3), (2, 7, 8, 10), (3, 5, 5, 6), (4, 0, 1, 2)], "fid long, a long, b long, c long")
    vertices, faces = sampling.largest_clean(v, f)
    assert {r["fid"] for r in faces.collect()} == {0, 1} and {r["vid"] for r in vertices.collect()} == {0, 1, 3, 4}
    with pytest.raises(ValueError, match="no face"):
        sampling.largest_clean(v, f.filter("fid > 2"))


def test_exact_sample(spark):
    rng = np.random.default_rng(6)
    points = spark.createDataFrame([(i, *map(float, p), float(w)) for i, (p, w) in enumerate(zip(rng.uniform(0, 1, (300, 3)) * [4, 4, 0], rng.uniform(0, 1, 300), strict=True))], "id long, x double, y double, z double, w double")
    out = [(r["x"], r["y"]) for r in sampling.poisson_exact(points, 20, 16.0).collect()]
    assert len(out) == 20 and min(math.dist(p, q) for i, p in enumerate(out) for q in out[:i]) > 0.4
    with pytest.raises(ValueError, match="fewer"):
        sampling.poisson_exact(points, 301, 16.0)


# contracts


@pytest.mark.parametrize("bad", [(0, 1), (1, 0), (math.inf, 1), (1, math.nan)])
def test_bad_calibrations_are_errors(spark, bad):
    with pytest.raises(ValueError, match="finite"):
        metrics.scale_factor(*map(float, bad))
    with pytest.raises(Exception, match="finite and above zero"):
        spark.createDataFrame([tuple(map(float, bad))], "m double, a double").select(metrics.scale_factors(F.col("m"), F.col("a"))).collect()


def test_scaling_leaves_its_input(spark):
    v = spark.createDataFrame([(0, 1.0, 0.0, 0.5, 0.25)], "vid long, x double, y double, z double, nx double")
    assert metrics.scale_factor(40, 100) == 2.5
    assert tuple(metrics.scaled(v, metrics.scale_factor(2, 10)).first()) == (0, 5.0, 0.0, 2.5, 0.25) and v.first()["x"] == 1.0
    with pytest.raises(ValueError, match="finite"):
        metrics.scaled(v, math.inf)


def test_mesh_contract(spark):
    with pytest.raises(Exception, match="non-integer"):
        topology.checked_faces(spark.createDataFrame([(0, 0.0, 1.5, 2.0)], "fid long, a double, b double, c double")).collect()
    with pytest.raises(Exception, match="non-finite"):
        topology.checked_vertices(spark.createDataFrame([(0, math.inf, 0.0, 0.0)], "vid long, x double, y double, z double")).collect()
    with pytest.raises(Exception, match="no triangle"):
        topology.padded_triangles(spark.createDataFrame([(0, [3, 0, 1, 2, 4, 0, 1, 2, 3])], "chunk long, padded array<long>")).collect()


def test_contract_of_attributes(spark):
    rows = lambda *r: spark.createDataFrame([r], "nx double, ny double, nz double, r double, g double, b double")
    n, c = ["nx", "ny", "nz"], ["r", "g", "b"]
    assert tuple(topology.checked_attributes(rows(0.0, 0.0, -1.0, 0.0, 0.5, 1.0), n, c).first()) == (0.0, 0.0, -1.0, 0.0, 0.5, 1.0)
    for bad in ((math.nan, 0.0, 1.0), (None, 0.0, 1.0), (0.0, -math.inf, 1.0)):
        with pytest.raises(Exception, match="non-finite normal"):
            topology.checked_attributes(rows(*bad, 0.0, 0.0, 0.0), n, c).collect()
    for bad in ((0.0, 1.5, 0.0), (-0.1, 0.0, 0.0), (0.0, 0.0, None), (0.0, math.nan, 0.0)):
        with pytest.raises(Exception, match="colour outside"):
            topology.checked_attributes(rows(0.0, 0.0, 1.0, *bad), n, c).collect()
    with pytest.raises(ValueError, match="three columns"):
        topology.checked_attributes(rows(*[0.0] * 6), ["nx"])
    with pytest.raises(ValueError, match="three or four"):
        topology.checked_attributes(rows(*[0.0] * 6), None, ["r", "g"])


def test_colour_finder(spark):
    row = lambda **c: spark.createDataFrame([tuple(c.values())], ", ".join(f"{k} array<double>" for k in c))
    assert colour.find(row(a=[1.0, 2.0, 3.0], rgb=[0.0, 0.0, 300.0])) == "rgb"
    assert colour.find(row(Normals=[0.0, 0.0, 1.0], a=[-1.0, 0.0, 0.0], b=[1.0, 2.0], c=[1.0, 2.0, 3.0, 255.0])) == "c"
    assert colour.find(row(Normals=[0.0, 0.0, 1.0], c=[math.nan, 1.0, 1.0])) is None and colour.find(spark.range(2)) is None


def test_binary_files(spark, tmp_path):
    for order, name in (("<", "binary_little_endian"), (">", "binary_big_endian")):
        vertex = np.array([(0, 0, 0, 0.2, 7), (1, 0, 0, 0.1, 255), (0, 1, 0, 0.3, 0)], [("x", order + "f4"), ("y", order + "f4"), ("z", order + "f8"), ("q", order + "f4"), ("red", "u1")])
        face = np.array([(3, (0, 1, 2)), (3, (2, 1, 0))], [("n", "u1"), ("i", order + "i4", 3)])
        head = f"ply\nformat {name} 1.0\ncomment made by hand\nelement vertex 3\nproperty float x\nproperty float32 y\nproperty double z\nproperty float q\nproperty uchar red\nelement face 2\nproperty list uchar int vertex_indices\nend_header\n"
        path = tmp_path / f"{name}.ply"
        path.write_bytes(head.encode() + vertex.tobytes() + face.tobytes())
        v, f = ply.read_named(spark, str(path), ["q", "red"])
        assert [tuple(r) for r in v.orderBy("vid").collect()] == [(i, float(x), float(y), float(z), float(np.float32(q)), float(r)) for i, (x, y, z, q, r) in enumerate(vertex.tolist())]
        assert [tuple(r) for r in f.orderBy("fid").collect()] == [(0, 0, 1, 2), (1, 2, 1, 0)]
        (tmp_path / "short.ply").write_bytes(path.read_bytes()[:-1])
        with pytest.raises(ValueError, match="another length"):
            ply.read_binary(spark, str(tmp_path / "short.ply"))


def test_export_endings(spark, limb):
    v, f, *_ = limb
    with pytest.raises(KeyError, match="mine"):
        ply.export_mesh(v, f, f"{shared_dir(spark)}/a.ply", "mine")
    with pytest.raises(ValueError, match="ending"):
        ply.export_mesh(v, f, f"{shared_dir(spark)}/a.obj", "mine")


def test_written_file_is_plain_text(spark, limb, tmp_path):
    v, f, points, _ = limb
    path = ply.write_file(v, f.select("fid", F.array("a", "b", "c").alias("idx")), f"{tmp_path}/limb.ply", ["x", "y", "z"], face_property="property list uchar int vertex_index")
    lines = (tmp_path / "limb.ply").read_text().splitlines()
    assert lines[0] == "ply" and "property list uchar int vertex_index" in lines and lines[lines.index("end_header") + 1] == " ".join(f"{x:.9g}" for x in points[0][1:])
    back, faces = ply.read_ply(spark, path)
    assert back.count() == len(points) and faces.count() == f.count()
    with pytest.raises(Exception, match="another number of values"):
        (tmp_path / "bad.ply").write_text((tmp_path / "limb.ply").read_text().replace(lines[lines.index("end_header") + 2], "1 2"))
        ply.read_ply(spark, f"{tmp_path}/bad.ply")[0].collect()


def test_nearest_in_more_dimensions(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(rng.normal(size=(40, 6)))]
    table = spark.createDataFrame(rows, "vid long, coordinates array<double>")
    got = {r["vid"]: r["d"] for r in sampling.nearest_embedded(table, table.filter("vid % 5 = 1").select("vid")).collect()}
    assert all(abs(got[i] - min(math.dist(p, q) for j, q in rows if j % 5 == 1)) < 1e-12 for i, p in rows)
