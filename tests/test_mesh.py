"""Meshes with known measures, and queries against their SQL on the smallest tables."""

import math
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from meshloom.jobs import more_queries, shape_queries  # noqa: F401
from meshloom.jobs.queries import ORACLES, QUERIES
from meshloom.operators import graph, metrics, nearest, planes, sampling, topology
from meshloom.sources import ply
from meshloom.sources.store import shared_dir

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def mesh(spark, v, f):
    vertices = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(v)], "vid long, x double, y double, z double")
    return vertices, spark.createDataFrame([(i, *t) for i, t in enumerate(f)], "fid long, a long, b long, c long")


TETRA = ([(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)], [(0, 2, 1), (0, 1, 3), (0, 3, 2), (1, 2, 3)])


def box(spark):
    v = [(x, y, z) for x in (0, 1) for y in (0, 2) for z in (0, 3)]
    q = [(0, 1, 3, 2), (4, 6, 7, 5), (0, 4, 5, 1), (2, 3, 7, 6), (0, 2, 6, 4), (1, 5, 7, 3)]
    return mesh(spark, v, [t for a, b, c, d in q for t in ((a, b, c), (a, c, d))])


def origin(spark):
    return spark.createDataFrame([(0.0, 0.0, 0.0)], "rx double, ry double, rz double")


def test_volume_and_area(spark):
    for (v, f), volume, area in ((mesh(spark, *TETRA), 1 / 6, 1.5 + math.sqrt(3) / 2), (box(spark), 6.0, 22.0)):
        assert abs(metrics.volume_about(f, v, origin(spark)).first()["volume"]) == pytest.approx(volume)
        assert metrics.with_area(f, v).agg(F.sum("area")).first()[0] == pytest.approx(area)


def test_closed_mesh_has_no_boundary(spark):
    _, f = mesh(spark, *TETRA)
    e = topology.edge_incidence(f)
    assert e.count() == 6 and e.filter("inc <> 2").isEmpty()
    assert topology.boundary_edges(f).isEmpty()


def test_fan_of_quad_and_two_gon(spark):
    p = spark.createDataFrame([(0, [0, 1, 2, 3]), (1, [4, 5])], "fid long, idx array<long>")
    assert [tuple(r) for r in topology.fan_triangles(p).orderBy("part").collect()] == [(0, 0, 0, 1, 2), (0, 1, 0, 2, 3)]


def test_components_over_blocks(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20) if i != 9], "u long, w long")
    vertices = spark.range(21).withColumnRenamed("id", "vid")
    got = {r["vid"]: r["root"] for r in graph.components(edges, vertices).collect()}
    assert got == {i: 0 if i <= 9 else 10 for i in range(21)}


def test_distances_over_blocks(spark):
    edges = spark.createDataFrame([(i, (i + 1) % 30, 1.0) for i in range(30)], "u long, w long, len double")
    got = {r["vid"]: (r["d"], r["label"]) for r in graph.distances(edges, spark.createDataFrame([(0,), (10,)], "vid long"), block=4).collect()}
    want = {i: min((min((i - s) % 30, (s - i) % 30), s) for s in (0, 10)) for i in range(30)}
    assert got == {i: (float(d), s) for i, (d, s) in want.items()}


def test_shuffled_ids_cost_few_more_rounds(spark):
    """Blocks by place: a sheet whose ids are shuffled takes about the rounds of one whose ids follow it; by id it takes far more."""
    n, rng = 20, random.Random(3)
    name = list(range(n * n))
    rng.shuffle(name)
    found = {}
    for kind, ids in (("ordered", range(n * n)), ("shuffled", name)):
        at = lambda i, j, ids=ids: ids[i * n + j]
        v = spark.createDataFrame([(at(i, j), float(i), float(j), 0.0) for i in range(n) for j in range(n)], "vid long, x double, y double, z double")
        e = spark.createDataFrame([(at(i, j), at(i + a, j + b), 1.0 + (i * 7 + j * 3) % 5 / 10) for i in range(n) for j in range(n) for a, b in ((0, 1), (1, 0)) if i + a < n and j + b < n], "u long, w long, len double")
        source = spark.createDataFrame([(at(0, 0),)], "vid long")
        for dealt, places in (("by place", v), ("by id", None)):
            if (kind, dealt) != ("ordered", "by id"):
                rounds = []
                found[kind, dealt] = {ids.index(r["vid"]) if kind == "shuffled" else r["vid"]: r["d"] for r in graph.distances(e, source, places, block=64, rounds=rounds).collect()}, rounds[0]
    (one, a), (two, b), (three, c) = found.values()
    assert one.keys() == two.keys() == three.keys() and all(abs(one[k] - two[k]) < 1e-9 and abs(one[k] - three[k]) < 1e-9 for k in one)
    assert b <= 2 * a and c > 2 * b


def test_overlap_keeps_not_a_number(spark):
    v = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, float("nan"), 0.0, 0.0), (2, 5.0, 0.0, 0.0)], "vid long, x double, y double, z double")
    cut = spark.createDataFrame([(0, -0.0, 0.0, 0.0), (1, float("nan"), 0.0, 0.0)], "vid long, x double, y double, z double")
    assert sorted(r["vid"] for r in topology.without_overlap(v, cut).collect()) == [1, 2]


def test_nearest_against_brute_force(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    p, q = rng.normal(size=(60, 3)), rng.normal(size=(25, 3)) * 3
    frame = lambda x: spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, x double, y double, z double")
    for size in (4, 512):
        monkeypatch.setattr(nearest, "BLOCK", size)
        for places in (p, p + [300, -40, 7]):  # around the targets, and far from all of them
            got = {r["id"]: r["target"] for r in nearest.nearest(frame(places), frame(q)).collect()}
            assert got == {i: int(np.linalg.norm(q - r, axis=1).argmin()) for i, r in enumerate(places)}
    assert nearest.nearest(frame(p), frame(q).limit(0)).isEmpty() and nearest.nearest(frame(p).limit(0), frame(q)).isEmpty()


def test_closest_places_against_brute_force(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(nearest, "BLOCK", 4)
    rng = np.random.default_rng(2)
    p, t = rng.normal(size=(30, 3)) * 3, rng.normal(size=(20, 9))
    t[0, 3:6] = t[0, :3]  # a degenerate one
    points = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(p)], "id long, x double, y double, z double")
    corners = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(t)], "fid long, " + ", ".join(f"{c}{k} double" for c in "abc" for k in "xyz"))
    s, u = (x.ravel() for x in np.meshgrid(np.linspace(0, 1, 90), np.linspace(0, 1, 90)))
    weights = np.stack([(1 - s), s * (1 - u), s * u], axis=1)
    some = nearest.closest_on_triangles(points.filter("id < 9"), corners).collect()  # by one scan
    assert {r["id"] for r in some} == set(range(9))
    for r in [*some, *nearest.closest_on_triangles(points, corners).collect()]:
        spots = np.einsum("nk,tkc->tnc", weights, t.reshape(-1, 3, 3))
        least = np.linalg.norm(spots - p[r["id"]], axis=2).min()
        assert r["d"] <= least + 1e-9 and r["d"] >= least - 0.05
        assert abs(np.linalg.norm(np.array([r["x"], r["y"], r["z"]]) - p[r["id"]]) - r["d"]) < 1e-9


def test_one_path_and_blocks_by_place(spark):
    n = 7  # a grid of unit steps has many shortest paths
    v = spark.createDataFrame([(i * n + j, float(i), float(j), 0.0) for i in range(n) for j in range(n)], "vid long, x double, y double, z double")
    e = [(i * n + j, i * n + j + s, 1.0) for i in range(n) for j in range(n) for s, ok in ((1, j < n - 1), (n, i < n - 1)) if ok]
    edges = spark.createDataFrame(e, "u long, w long, len double")
    one = lambda i: spark.createDataFrame([(i,)], "vid long")
    path = {r["d"]: r["vid"] for r in graph.one_shortest_path(edges, one(0), one(n * n - 1)).collect()}
    assert sorted(path) == list(range(2 * n - 1)) and path[0] == 0 and path[2 * n - 2] == n * n - 1
    assert all((min(path[k], path[k + 1]), max(path[k], path[k + 1]), 1.0) in e for k in range(2 * n - 2))
    placed = graph.blocks_by_place(v, 8)
    assert placed.groupBy("block").count().agg({"count": "max"}).first()[0] <= 8
    got = {r["vid"]: (r["d"], r["label"]) for r in graph.relax(edges, one(24).select("vid", F.lit(0.0).alias("d"), F.lit(5).cast("long").alias("label")), placed=placed).collect()}
    assert got == {i * n + j: (float(abs(i - 3) + abs(j - 3)), 5) for i in range(n) for j in range(n)}


def test_poisson_select_is_the_greedy_set(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    rows = [(i, *map(float, rng.uniform(0, 3, 3)), float(w), float(r)) for i, (w, r) in enumerate(zip(rng.uniform(0, 1, 80), rng.uniform(0.5, 1, 80), strict=True))]
    got = sorted(r["id"] for r in sampling.poisson_select(spark.createDataFrame(rows, "id long, x double, y double, z double, w double, radius double"), 1.0).collect())
    kept = []
    for r in sorted(rows, key=lambda r: (-r[4], r[0])):
        if all(math.dist(r[1:4], k[1:4]) >= (r[5] + k[5]) / 2 for k in kept):
            kept.append(r)
    assert got == sorted(r[0] for r in kept)


def test_ply_round_trip_and_errors(spark):
    v, f = box(spark)
    path = ply.write_ply(v, f.select("fid", F.array("a", "b", "c").alias("idx")), f"{shared_dir(spark)}/box.ply", ["x", "y", "z"])
    back, faces, header = ply.read_folder(spark, path)
    assert (header.n_vertices, header.n_faces) == (8, 12)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, v.collect()))
    assert [r["idx"] for r in faces.orderBy("fid").collect()] == [[r["a"], r["b"], r["c"]] for r in f.orderBy("fid").collect()]
    with pytest.raises(ValueError, match="ASCII"):
        ply.parse_header(["ply", "format binary_little_endian 1.0", "end_header"])


def test_ply_file(spark, tmp_path):
    text = "ply\nformat ascii 1.0\nelement vertex 3\nproperty float x\nproperty float y\nproperty float z\nproperty float q\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n0 0 0 0.2\n1 0 0 0.1\n0 1 0 0.3\n3 0 1 2\n"
    (tmp_path / "a.ply").write_text(text)
    v, f = ply.read_named(spark, str(tmp_path / "a.ply"), ["q"])
    assert v.filter("vid = 0").first()["q"] > 0.2  # narrowed to single precision
    assert f.first()["c"] == 2
    with pytest.raises(ValueError, match="missing"):
        ply.read_named(spark, str(tmp_path / "a.ply"), ["nothing"])


def test_modes():
    assert planes.modes([" Normal", "transverse"]) == ("normal", "transverse")
    for bad in (["normal"], ["normal", "normal"], ["normal", "other"]):
        with pytest.raises(ValueError, match="two different modes"):
            planes.modes(bad)


def test_open_volume_is_an_error(spark):
    v, f = mesh(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 0)], [(0, 1, 2)])
    with pytest.raises(Exception, match="about zero"):
        metrics.volume_about(f, v, origin(spark)).collect()


@pytest.mark.parametrize("name", ["face_vertex_join", "edge_incidence", "signed_volume", "cotan_laplacian", "rgb_to_hsv", "overlap_subtract", "geodesic_to_band", "radius_conflicts", "plane_normal", "boundary_loops", "src_ply_faces", "reconstructed_faces"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    want = con.sql(ORACLES[name])
    columns = sorted(want.columns)
    got = QUERIES[name](spark, SF).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, con.sql(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM want").fetchall()))
