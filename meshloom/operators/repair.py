"""Making a surface fit for use: non-manifold edges and vertices, orientation, holes, thickness.

All of it is relational: fans and orientations are components of graphs of corners and of signed faces (``graph.components`` contracts
them), boundary loops are ranked by pointer doubling, and only the triangulation of one loop of bounded size runs in Python.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.functions import vec3
from meshloom.operators import graph, metrics
from meshloom.operators.topology import CORNERS, edge_incidence, is_degenerate, numbered_along, with_corners
from meshloom.sources.store import materialise

#: Loops of more edges stay open.
MOST_HOLE_EDGES = 50


def directed_sides(faces: DataFrame, *more: str) -> DataFrame:
    """fid, k (0, 1, 2), s and e of the three sides of each face in its own direction, with u < w for the undirected edge."""
    sides = F.array(*(F.struct(F.lit(k).alias("k"), F.col(p).alias("s"), F.col(q).alias("e")) for k, (p, q) in enumerate((("a", "b"), ("b", "c"), ("c", "a")))))
    return faces.select("fid", *more, F.inline(sides)).withColumns({"u": F.least("s", "e"), "w": F.greatest("s", "e")})


# non-manifold parts


def without_crowded_edges(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Faces that are among the two largest (then least fid) on each of their edges, so that no edge has more than two; degenerate faces go first.

    Ranks are taken on edges with more than two faces only. An edge's faces meet in one task; of one with very many only the two best are looked for.
    """
    sound = materialise(metrics.with_area(faces.filter(~is_degenerate()), vertices).select(*faces.columns, F.round("area", 12).alias("__area")), "sound")
    sides = directed_sides(sound, "__area").select("fid", "u", "w", "__area")
    crowded = sides.groupBy("u", "w").agg(F.count("*").alias("n")).filter("n > 2").select("u", "w")
    mine = F.struct((-F.col("__area")).alias("minus"), "fid")
    met = materialise(sides.join(crowded, ["u", "w"]), "crowded")
    first = met.groupBy("u", "w").agg(F.min(mine).alias("first"))
    rest = met.join(first, ["u", "w"]).filter(F.col("fid") != F.col("first.fid"))
    second = rest.groupBy("u", "w").agg(F.min(mine).alias("second"))
    gone = rest.join(second, ["u", "w"]).filter(F.col("fid") != F.col("second.fid")).select("fid").distinct()
    return sound.join(gone, "fid", "left_anti").select(*faces.columns)


def fans(faces: DataFrame) -> DataFrame:
    """fid, k (0, 1, 2), vid and fan (the least corner number 3 * fid + k) of each corner: corners of a vertex are one fan where their faces share an edge at it. No edge may have more than two faces."""
    sides = directed_sides(faces)
    at = lambda v: F.when(F.col("s") == F.col(v), F.col("k")).otherwise((F.col("k") + 1) % 3) + 3 * F.col("fid")
    met = sides.groupBy("u", "w").agg(F.count("*").alias("n"), *(f(at(v)).alias(f"{n}_{v}") for v in "uw" for n, f in (("one", F.min), ("two", F.max))))
    many = F.when(F.col("n") > 2, F.raise_error(F.lit("an edge has more than two faces")).cast("long"))
    # of two corners of different faces the least and the largest are these two
    links = met.filter("n > 1").select(F.inline(F.array(*(F.struct(F.coalesce(many, F.col(f"one_{v}")).alias("u"), F.col(f"two_{v}").alias("w")) for v in "uw"))))
    corners = faces.select("fid", F.posexplode(F.array(*CORNERS)).alias("k", "vid")).withColumn("corner", 3 * F.col("fid") + F.col("k"))
    roots = graph.components(links, corners.select(F.col("corner").alias("vid")))
    return corners.join(roots.select(F.col("vid").alias("corner"), F.col("root").alias("fan")), "corner").select("fid", F.col("k").cast("int").alias("k"), "vid", "fan")


def split_vertices(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces in which each vertex has one fan: the first keeps the vertex, the others get copies, numbered on from the largest vid by (vid, fan)."""
    corners = materialise(fans(faces), "fans")
    own = corners.groupBy("vid").agg(F.min("fan").alias("first"))
    more = corners.select("vid", "fan").distinct().join(own, "vid").filter("fan > first").select("vid", "fan")
    most = vertices.agg(F.max("vid").alias("most"))
    copies = numbered_along(more, [F.col("vid"), F.col("fan")], "place").join(F.broadcast(most)).select("vid", "fan", (F.col("most") + 1 + F.col("place")).alias("new_vid"))
    copies = materialise(copies, "copies")
    split = corners.join(copies, ["vid", "fan"], "left").select("fid", "k", F.coalesce("new_vid", "vid").alias("vid"))
    cornered = split.groupBy("fid").agg(*(F.max(F.when(F.col("k") == k, F.col("vid"))).alias(c) for k, c in enumerate(CORNERS)))
    rest = [c for c in faces.columns if c not in CORNERS]
    others = [c for c in vertices.columns if c != "vid"]
    grown = vertices.join(copies, "vid").select(F.col("new_vid").alias("vid"), *others)
    return vertices.select("vid", *others).unionByName(grown), faces.select(*rest).join(cornered, "fid").select(*rest, *CORNERS)


def manifold(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """No edge with more than two faces, no vertex with more than one fan."""
    return split_vertices(vertices, materialise(without_crowded_edges(faces, vertices), "uncrowded"))


# orientation


def orientation(faces: DataFrame) -> DataFrame:
    """fid, part (the least fid that it reaches over edges) and flip (whether it runs against that face; null in a part that has no two sides). Edges with more than two faces do not count.

    Each face is two vertices of a graph, as it is and turned. Neighbours that run along their edge in opposite directions agree, and
    otherwise one agrees with the other turned; so a part is two components, or one where it has no two sides.
    """
    sides = directed_sides(faces)
    met = sides.groupBy("u", "w").agg(F.count("*").alias("n"), F.min(F.struct("fid", "s")).alias("p"), F.max(F.struct("fid", "s")).alias("q")).filter("n = 2 and p.fid <> q.fid")
    turn = (F.col("p.s") == F.col("q.s")).cast("long")
    links = met.select(F.inline(F.array(*(F.struct((2 * F.col("p.fid") + x).alias("u"), (2 * F.col("q.fid") + F.lit(x).bitwiseXOR(turn)).alias("w")) for x in (0, 1)))))
    both = faces.select(F.explode(F.array(2 * F.col("fid"), 2 * F.col("fid") + 1)).alias("vid"))
    roots = graph.components(links, both)
    ends = roots.groupBy(F.floor(F.col("vid") / 2).alias("fid")).agg(F.max(F.when(F.col("vid") % 2 == 0, F.col("root"))).alias("plain"), F.max(F.when(F.col("vid") % 2 == 1, F.col("root"))).alias("turned"))
    return ends.select("fid", F.floor(F.least("plain", "turned") / 2).alias("part"), F.when(F.col("plain") != F.col("turned"), F.col("plain") > F.col("turned")).alias("flip"))


def oriented(faces: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """``faces``, all of a part turned as its first one; with ``vertices``, parts whose volume about the mesh's centre is negative are turned outwards. Parts with no two sides stay."""
    turned = faces.join(materialise(orientation(faces), "orientation"), "fid")
    swap = lambda flip: {"b": F.when(flip, F.col("c")).otherwise(F.col("b")), "c": F.when(flip, F.col("b")).otherwise(F.col("c"))}
    even = turned.withColumns(swap(F.coalesce("flip", F.lit(False))))
    if vertices is None:
        return even.select(*faces.columns)
    even = materialise(even, "even")
    centre = vertices.agg(*(F.avg(k).alias(f"r{k}") for k in "xyz"))
    p = with_corners(even, vertices).join(F.broadcast(centre))
    r = tuple(F.col(f"r{k}") for k in "xyz")
    a, b, c = (vec3.sub(vec3.vec(k), r) for k in CORNERS)
    inside = p.groupBy("part").agg((F.sum(vec3.dot(a, vec3.cross(b, c))) < 0).alias("inside"), F.count("flip").alias("sided"))
    return even.join(inside, "part").withColumns(swap(F.col("inside") & (F.col("sided") > 0))).select(*faces.columns)


# holes


def boundary_next(faces: DataFrame) -> DataFrame:
    """vid and next around each hole: against the direction of the face at each boundary side. Vertices with more than one way on, and what leads to them, are left out."""
    sides = directed_sides(faces)
    single = sides.join(edge_incidence(faces).filter("inc = 1").select("u", "w"), ["u", "w"]).select(F.col("e").alias("vid"), F.col("s").alias("next"))
    single = materialise(single, "boundary")
    clear = single.groupBy("vid").count().filter("count = 1").select("vid")
    entered = single.groupBy("next").count().filter("count = 1").select(F.col("next").alias("vid"))
    return single.join(clear, "vid", "left_semi").join(entered.withColumnRenamed("vid", "next"), "next", "left_semi").select("vid", "next")


def loop_ranks(boundary: DataFrame, most: int | None = None) -> DataFrame:
    """vid, loop (its least vid), place (0, 1, ... from there along ``next``) and n (edges) of each vertex on a closed loop of at most ``most`` edges, by doubling jumps."""
    ends = boundary.select(F.explode(F.array("vid", "next")).alias("vid")).distinct()
    roots = graph.components(boundary.select(F.col("vid").alias("u"), F.col("next").alias("w")), ends)
    rows = materialise(boundary.join(roots, "vid").select("vid", "next", "root"), "rings")
    # a chain that does not close has a vertex without a way on
    sizes = roots.groupBy("root").agg(F.count("*").alias("ends")).join(rows.groupBy("root").agg(F.count("*").alias("n")), "root").filter("n = ends")
    if most is not None:
        sizes = sizes.filter(F.col("n") <= most)
    rows = rows.join(sizes.select("root", "n"), "root")
    # steps to the least vertex; its own jump goes nowhere
    jumps = rows.select("vid", "root", "n", F.when(F.col("vid") == F.col("root"), F.col("vid")).otherwise(F.col("next")).alias("to"), F.when(F.col("vid") == F.col("root"), 0).otherwise(1).cast("long").alias("steps"))
    jumps = materialise(jumps, "jumps")
    while not jumps.filter("to <> root").isEmpty():
        beyond = jumps.select(F.col("vid").alias("to"), F.col("to").alias("beyond"), F.col("steps").alias("more"))
        jumps = materialise(jumps.join(beyond, "to").select("vid", "root", "n", F.col("beyond").alias("to"), (F.col("steps") + F.col("more")).alias("steps")), "jumps")
    return jumps.select("vid", F.col("root").alias("loop"), F.pmod(F.col("n") - F.col("steps"), F.col("n")).alias("place"), "n")


def least_area(points: np.ndarray, barred: set[tuple[int, int]] = frozenset()) -> tuple[float, list[tuple[int, int, int]]]:
    """The triangulation of a closed polygon (n by 3) of least area that uses no barred chord (i < j), as (i, j, k) places; infinite and none where there is none. The first of equals. As few triangles as can be have a corner without a place (NaN); what those count is more than all others."""
    n = len(points)
    known = ~np.isnan(points).any(axis=1)
    large = 1 + n * float((np.ptp(points[known], axis=0) ** 2).sum()) if known.any() else 1.0
    cost, cut = np.zeros((n, n)), np.zeros((n, n), int)
    for span in range(2, n):
        for i in range(n - span):
            j = i + span
            k = np.arange(i + 1, j)
            areas = np.linalg.norm(np.cross(points[k] - points[i], points[j] - points[i]), axis=1) / 2
            total = cost[i, k] + cost[k, j] + np.where(np.isnan(areas), large, areas)
            best = int(total.argmin())
            cost[i, j], cut[i, j] = total[best], k[best]
            if (i, j) in barred and span < n - 1:
                cost[i, j] = np.inf
    if not np.isfinite(cost[0, n - 1]):
        return float("inf"), []
    out, stack = [], [(0, n - 1)]
    while stack:
        i, j = stack.pop()
        if j - i >= 2:
            k = int(cut[i, j])
            out.append((i, k, j))
            stack += [(i, k), (k, j)]
    return float(cost[0, n - 1]), sorted(out)


def _fill(key, ring: pd.DataFrame, chords: pd.DataFrame) -> pd.DataFrame:
    ring = ring.sort_values("place")
    barred = {(min(i, j), max(i, j)) for i, j in zip(chords["i"], chords["j"], strict=True)}
    vids = ring["vid"].to_numpy()
    cost, triangles = least_area(ring[list("xyz")].to_numpy(float), barred) if len(ring) > 2 else (0.0, [])
    cost = cost if np.isfinite(ring[list("xyz")].to_numpy(float)).all() else None
    rows = [(key[0], at, *(int(vids[i]) for i in t), cost) for at, t in enumerate(triangles)]
    return pd.DataFrame(rows, columns=["loop", "at", "a", "b", "c", "area"]).astype({"loop": "int64", "at": "int64", "a": "int64", "b": "int64", "c": "int64", "area": "float64"})


def hole_fillings(vertices: DataFrame, faces: DataFrame, most: int = MOST_HOLE_EDGES) -> DataFrame:
    """loop, at (0, 1, ... within it), a, b, c and area (of the whole filling) of the triangles that close each hole of at most ``most`` edges with least area.

    A chord that is an edge of the mesh already is not used; a loop that cannot be closed so stays open. A loop with a vertex that has no place is closed too, and its area is null. A task has one loop, of at most ``most`` vertices.
    """
    ranks = materialise(loop_ranks(boundary_next(faces), most), "ranks")
    ends = ranks.select(F.col("vid").alias("u"), F.col("loop").alias("lu"), F.col("place").alias("i")), ranks.select(F.col("vid").alias("w"), F.col("loop").alias("lw"), F.col("place").alias("j"), "n")
    chords = edge_incidence(faces).join(ends[0], "u").join(ends[1], "w").filter("lu = lw").select(F.col("lu").alias("loop"), "i", "j")
    # neighbours on the loop are its own edges
    chords = chords.join(ranks.filter("place = 0").select("loop", "n"), "loop").filter("abs(i - j) > 1 and abs(i - j) < n - 1").select("loop", "i", "j")
    rings = ranks.join(vertices.select("vid", *"xyz"), "vid", "left")
    return rings.groupBy("loop").cogroup(chords.groupBy("loop")).applyInPandas(_fill, "loop long, at long, a long, b long, c long, area double")


def closed_holes(vertices: DataFrame, faces: DataFrame, most: int = MOST_HOLE_EDGES) -> DataFrame:
    """fid, a, b, c of the faces and of those that close its holes, numbered on from the largest fid by (loop, at)."""
    found = numbered_along(materialise(hole_fillings(vertices, faces, most), "fillings"), [F.col("loop"), F.col("at")], "place")
    last = faces.agg(F.max("fid").alias("last"))
    return faces.select("fid", *CORNERS).unionByName(found.join(F.broadcast(last)).select((F.col("last") + 1 + F.col("place")).alias("fid"), *CORNERS))


# thickness


def solidified(vertices: DataFrame, faces: DataFrame, thickness: float, offset: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """A shell around a consistently oriented surface: vertices moved along their normals to both sides, faces on both, and a rim along the boundary.

    ``offset`` 1 puts the whole thickness on the side of the normals, -1 on the other, 0 half on each. Copies are numbered on from the largest vid.
    A face f becomes 8 f (the back, turned) and 8 f + 1; the rim at its side k are 8 f + 2 + 2 k and the one after.
    """
    low = -(1 - offset) / 2 * thickness
    normals = metrics.vertex_normals(faces, vertices)
    most = F.broadcast(vertices.agg((F.max("vid") + 1).alias("__more")))
    placed = materialise(vertices.join(normals, "vid"), "normals")
    at = lambda d: [(F.col(k) + F.lit(d) * F.col(f"n{k}")).alias(k) for k in "xyz"]
    others = [c for c in vertices.columns if c not in ("vid", *"xyz")]
    shell = placed.select("vid", *at(low), *others).unionByName(placed.join(most).select((F.col("vid") + F.col("__more")).alias("vid"), *at(low + thickness), *others))
    here, there = {c: F.col(c) for c in CORNERS}, {c: F.col(c) + F.col("__more") for c in CORNERS}
    face = lambda fid, a, b, c: F.struct(fid.alias("fid"), a.alias("a"), b.alias("b"), c.alias("c"))
    fid = 8 * F.col("fid")
    both = faces.join(most).select(F.inline(F.array(face(fid, here["a"], here["c"], here["b"]), face(fid + 1, there["a"], there["b"], there["c"]))))
    edge = directed_sides(faces).join(edge_incidence(faces).filter("inc = 1").select("u", "w"), ["u", "w"]).join(most)
    s, e, s2, e2 = F.col("s"), F.col("e"), F.col("s") + F.col("__more"), F.col("e") + F.col("__more")
    first = fid + 2 + 2 * F.col("k")
    rim = edge.select(F.inline(F.array(face(first, s, e, e2), face(first + 1, s, e2, s2))))
    return shell, both.unionByName(rim)

