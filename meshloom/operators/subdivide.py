"""Subdivision of long edges.

An edge longer than a threshold gets a vertex, one for the edge and so for both of its faces; a face is cut by which of its sides have
one, so neighbours always meet in whole edges. New and old vertices are placed by the weights of a smooth surface, which are sums over
edges and faces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.functions import vec3
from meshloom.operators.topology import CORNERS, both_ways, edge_incidence, numbered_along, with_lengths
from meshloom.sources.store import materialise

_ROUND = {"a": ("b", "c"), "b": ("c", "a"), "c": ("a", "b")}


def long_edges(vertices: DataFrame, faces: DataFrame, threshold: float) -> DataFrame:
    """u, w, inc and vid of the new vertex of each edge longer than ``threshold``, numbered on from the largest vid by (u, w)."""
    edges = with_lengths(edge_incidence(faces).filter("u <> w"), vertices).filter(F.col("len") > threshold).select("u", "w", "inc")
    most = vertices.agg((F.max("vid") + 1).alias("__first"))
    return numbered_along(edges, [F.col("u"), F.col("w")], "place").join(F.broadcast(most)).select("u", "w", "inc", (F.col("__first") + F.col("place")).alias("vid"))


def new_places(vertices: DataFrame, faces: DataFrame, split: DataFrame, smooth: bool = True) -> DataFrame:
    """vid, x, y, z of the new vertices: the middle of the edge, or, inside the surface and if ``smooth``, 3/8 of both ends and 1/8 of the two corners across."""
    ends = split
    for end in "uw":
        ends = ends.join(vertices.select(F.col("vid").alias(end), *(F.col(k).alias(f"{end}{k}") for k in "xyz")), end)
    middle = {k: (F.col(f"u{k}") + F.col(f"w{k}")) / 2 for k in "xyz"}
    if not smooth:
        return ends.select("vid", *(c.alias(k) for k, c in middle.items()))
    across = faces.select(F.inline(F.array(*(F.struct(F.least(p, q).alias("u"), F.greatest(p, q).alias("w"), F.col(k).alias("far")) for k, (p, q) in _ROUND.items()))))
    sums = across.join(vertices.select(F.col("vid").alias("far"), *"xyz"), "far").groupBy("u", "w").agg(*(F.sum(k).alias(f"s{k}") for k in "xyz"))
    return ends.join(sums, ["u", "w"]).select("vid", *(F.when(F.col("inc") == 2, 0.75 * c + F.col(f"s{k}") / 8).otherwise(c).alias(k) for k, c in middle.items()))


def kept_places(vertices: DataFrame, faces: DataFrame, split: DataFrame) -> DataFrame:
    """``vertices`` with those moved all of whose edges are split: inside the surface 5/8 (7/16 at three neighbours) and the mean of the neighbours, on its rim 3/4 and 1/8 of both neighbours there."""
    edges = edge_incidence(faces).filter("u <> w").join(split.select("u", "w", F.lit(1).alias("cut")), ["u", "w"], "left")
    arcs = both_ways(edges.select("u", "w", "inc", F.coalesce("cut", F.lit(0)).alias("cut")), "inc", "cut")
    near = arcs.join(vertices.select(F.col("vid").alias("w"), *"xyz"), "w")
    rim = F.col("inc") != 2
    sums = near.groupBy(F.col("u").alias("vid")).agg(F.count("*").alias("n"), F.min("cut").alias("all_cut"), F.count_if(rim).alias("n_rim"), *(F.avg(k).alias(f"m{k}") for k in "xyz"), *(F.sum(F.when(rim, F.col(k)).otherwise(0.0)).alias(f"r{k}") for k in "xyz"))
    own = F.when(F.col("n") == 3, 7 / 16).otherwise(5 / 8)

    def place(k: str):
        inner = own * F.col(k) + (1 - own) * F.col(f"m{k}")
        outer = 0.75 * F.col(k) + F.col(f"r{k}") / 8
        return F.when(F.col("all_cut") == 1, F.when(F.col("n_rim") == 0, inner).when(F.col("n_rim") == 2, outer).otherwise(F.col(k))).otherwise(F.col(k))

    return vertices.join(sums, "vid", "left").select("vid", *(place(k).alias(k) for k in "xyz"))


def cut_faces(vertices: DataFrame, faces: DataFrame, split: DataFrame) -> DataFrame:
    """fid (4 times that of the face, and 0 to 3), a, b, c: a face with three new vertices becomes four, with two three (its other part cut along the shorter diagonal, by the middles), with one two. A face that names a vertex without a place is left out."""
    rows = faces.select("fid", *CORNERS)
    for name, (p, q) in {"ab": "ab", "bc": "bc", "ca": "ca"}.items():
        side = split.select(F.col("u").alias("__u"), F.col("w").alias("__w"), F.col("vid").alias(name))
        rows = rows.join(side, (F.least(p, q) == F.col("__u")) & (F.greatest(p, q) == F.col("__w")), "left").drop("__u", "__w")
    for k in CORNERS:
        rows = rows.join(vertices.select(F.col("vid").alias(k), F.struct(*"xyz").alias(f"{k}_at")), k)
    turned = lambda p, q, r: F.struct(*(F.col(c).alias(n) for c, n in ((p, "p"), (q, "q"), (r, "r"), (p + q, "pq"), (q + r, "qr"), (r + p, "rp"), (f"{p}_at", "p_at"), (f"{q}_at", "q_at"), (f"{r}_at", "r_at"))))
    has = {s: F.col(s).isNotNull() for s in ("ab", "bc", "ca")}
    count = sum(c.cast("int") for c in has.values())
    # one new vertex: on the first side; two: not on the last
    which = F.when(count == 1, F.when(has["ab"], turned("a", "b", "c")).when(has["bc"], turned("b", "c", "a")).otherwise(turned("c", "a", "b")))
    which = which.when(count == 2, F.when(~has["ca"], turned("a", "b", "c")).when(~has["ab"], turned("b", "c", "a")).otherwise(turned("c", "a", "b"))).otherwise(turned("a", "b", "c"))
    rows = rows.select("fid", count.alias("n"), which.alias("t")).select("fid", "n", "t.*")
    at = lambda p: tuple(F.col(f"{p}_at")[k] for k in "xyz")
    middle = lambda p, q: vec3.scale(vec3.add(at(p), at(q)), 0.5)
    first = vec3.distance(at("p"), middle("q", "r")) <= vec3.distance(middle("p", "q"), at("r"))
    face = lambda j, a, b, c: F.struct((4 * F.col("fid") + j).alias("fid"), F.col(a).alias("a"), F.col(b).alias("b"), F.col(c).alias("c"))
    parts = (
        F.when(F.col("n") == 0, F.array(face(0, "p", "q", "r")))
        .when(F.col("n") == 1, F.array(face(0, "p", "pq", "r"), face(1, "pq", "q", "r")))
        .when((F.col("n") == 2) & first, F.array(face(0, "pq", "q", "qr"), face(1, "p", "pq", "qr"), face(2, "p", "qr", "r")))
        .when(F.col("n") == 2, F.array(face(0, "pq", "q", "qr"), face(1, "p", "pq", "r"), face(2, "pq", "qr", "r")))
        .otherwise(F.array(face(0, "p", "pq", "rp"), face(1, "q", "qr", "pq"), face(2, "r", "rp", "qr"), face(3, "pq", "qr", "rp")))
    )
    return rows.select(F.inline(parts))


def subdivided(vertices: DataFrame, faces: DataFrame, threshold: float, steps: int = 1, smooth: bool = True) -> tuple[DataFrame, DataFrame]:
    """Vertices (vid, x, y, z) and faces (fid, a, b, c) after ``steps`` rounds of cutting all edges longer than ``threshold``; a round without such an edge is the last."""
    v, f = vertices.select("vid", *"xyz"), faces.select("fid", *CORNERS)
    for _ in range(steps):
        split = materialise(long_edges(v, f, threshold), "split")
        if split.isEmpty():
            break
        old = kept_places(v, f, split) if smooth else v
        v, f = materialise(old.unionByName(new_places(v, f, split, smooth)), "vertices"), materialise(cut_faces(v, f, split), "faces")
    return v, f
