"""Rounds of the field solvers do not grow with the number of blocks."""

import math

import numpy as np
from pyspark.sql import functions as F

from meshloom.operators import fields, graph, metrics, topology

RING, RINGS = 8, 20


def test_harmonic_field_over_many_blocks_takes_two_rounds(spark):
    rng = np.random.default_rng(4)
    v = [(i, float(r * math.cos(2 * math.pi * (i % RING) / RING)), float(r * math.sin(2 * math.pi * (i % RING) / RING)), 0.4 * (i // RING)) for i, r in enumerate(rng.uniform(0.8, 1.3, RING * RINGS))]
    f = []
    for a in range(RING * (RINGS - 1)):
        b = a // RING * RING + (a + 1) % RING
        f += [(2 * a, a, b, a + RING), (2 * a + 1, b, b + RING, a + RING)]
    v, f = spark.createDataFrame(v, "vid long, x double, y double, z double"), spark.createDataFrame(f, "fid long, a long, b long, c long")
    n = RING * RINGS
    entries = metrics.cotan_laplacian(f, v)
    ends = v.filter((F.col("vid") < RING) | (F.col("vid") >= n - RING)).select("vid", (F.col("vid") >= RING).cast("double").alias("value"))
    rounds = []
    got = {r["vid"]: r["t"] for r in fields.solve_harmonic(entries, ends, v, leaf=8, top=16, rounds=rounds).collect()}
    a = np.zeros((n, n))
    for r in entries.collect():
        a[r["i"], r["j"]] += r["val"]
    t, free = np.zeros(n), np.arange(RING, n - RING)
    t[n - RING :] = 1
    t[free] = np.linalg.solve(a[np.ix_(free, free)], -a[free] @ t)
    assert rounds[0] <= 2 and max(abs(got[i] - (t[i] - t.min()) / (t.max() - t.min())) for i in range(n)) < 1e-8


def test_paths_on_a_long_limb_take_few_rounds(spark):
    """Blocks are pieces of the limb and not strips along it: a path does not pass between them again and again."""
    rng = np.random.default_rng(5)
    n, block = RING * 96, 64
    v = [(i, float(r * math.cos(2 * math.pi * (i % RING) / RING)), float(r * math.sin(2 * math.pi * (i % RING) / RING)), 0.4 * (i // RING)) for i, r in enumerate(rng.uniform(0.5, 1.5, n))]
    e = [(min(a, b), max(a, b)) for a in range(n) for b in (a // RING * RING + (a + 1) % RING, a + RING) if b < n]
    v, e = spark.createDataFrame(v, "vid long, x double, y double, z double"), spark.createDataFrame(e, "u long, w long")
    edges, rounds = topology.with_lengths(e, v), []
    assert graph.distances(edges, v.filter("vid = 0").select("vid"), v, block=block, rounds=rounds).count() == n
    assert rounds[0] <= 2 * n // block


def test_both_ends_of_a_path_share_their_rounds(spark):
    n, block = 64, 8
    edges = spark.createDataFrame([(i, i + 1, 1.0 + i % 3) for i in range(n - 1)], "u long, w long, len double")
    one, two = (spark.createDataFrame([(i,)], "vid long") for i in (0, n - 1))
    alone, both = [], []
    want = [sorted(map(tuple, graph.distances(edges, x, block=block, rounds=alone).collect())) for x in (one, two)]
    got = graph.from_both(edges, one, two, block=block, rounds=both)
    assert [sorted(map(tuple, g.collect())) for g in got] == want and both[0] <= max(alone)
