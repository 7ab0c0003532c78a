"""Volumetric reconstruction: signed distances on a sparse grid near a surface, and the surface on which they change sign.

Node (i, j, k) of the grid lies at (i, j, k) * size. Only nodes within REACH sizes of the surface are rows, so tables grow with the
area over the square of the size and never with the box. Cells are cut along the same diagonals everywhere and their surface follows
from a case table; its vertices are named by the grid's edges, so triangles of different cells and tasks meet without a search.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshloom.functions import vec3
from meshloom.operators import metrics, nearest, topology
from meshloom.sources.store import materialise

#: Corners of a cell that the surface crosses are never farther than the root of three from it.
REACH = 1.75
#: Bits of a grid number; it lies within 2^18 of zero.
BITS = 19
#: Large triangles are met in pieces of so many sizes.
PIECE = 8
_ZERO = 1 << (BITS - 1)
_STEP = {"i": 1 << (2 * BITS), "j": 1 << BITS, "k": 1}


def _offset(corner: int) -> int:
    """How far a corner (bits 1, 2, 4 for i, j, k) is from its cell's node, in node numbers."""
    return sum(step for bit, step in zip((1, 2, 4), _STEP.values(), strict=True) if corner & bit)


def cases() -> list[tuple[int, int, int, list[tuple[int, int]]]]:
    """tet, mask, part and the three grid edges (low, high corner) of each triangle: a cell is six tetrahedra, each a walk from corner 0 to 7 along the axes in some order; bit m of mask says that corner m of the walk is inside. Triangles face outwards."""
    place = lambda c: np.array([c & 1, c >> 1 & 1, c >> 2], float)
    out = []
    for tet, (first, second, _) in enumerate(permutations((1, 2, 4))):
        walk = (0, first, first | second, 7)
        for mask in range(1, 15):
            inside, outside = [c for m, c in enumerate(walk) if mask >> m & 1], [c for m, c in enumerate(walk) if not mask >> m & 1]
            ring = [(p, q) for p in inside for q in outside]
            if len(ring) == 4:
                ring[2:] = ring[:1:-1]  # around the quadrilateral
            at = [(place(p) + place(q)) / 2 for p, q in ring]
            if np.cross(at[1] - at[0], at[2] - at[0]) @ (sum(map(place, outside)) / len(outside) - sum(map(place, inside)) / len(inside)) < 0:
                ring.reverse()
            edges = [(min(e), max(e)) for e in ring]
            out += [(tet, mask, part, [edges[0], edges[part + 1], edges[part + 2]]) for part in range(len(edges) - 2)]
    return out


def size_of(vertices: DataFrame, percent: float) -> float:
    """``percent`` of the diagonal of the vertices' box."""
    diagonal = metrics.bounds(vertices).select("diag").first()["diag"]
    if not diagonal:
        raise ValueError("the vertices have no extent")
    return diagonal * percent / 100


def _with_rims(faces: DataFrame) -> DataFrame:
    """Faces with side_ab, side_bc, side_ca and rim_a, rim_b, rim_c: which sides and corners lie on the mesh's boundary."""
    rim = materialise(topology.boundary_edges(faces), "rim")
    ends = rim.select(F.explode(F.array("u", "w")).alias("vid")).distinct().withColumn("on", F.lit(True))
    for p, q in ("ab", "bc", "ca"):
        sides = rim.select(F.col("u").alias("__u"), F.col("w").alias("__w"), F.lit(True).alias(f"side_{p}{q}"))
        faces = faces.join(sides, (F.least(p, q) == F.col("__u")) & (F.greatest(p, q) == F.col("__w")), "left").drop("__u", "__w")
        faces = faces.join(ends.select(F.col("vid").alias(p), F.col("on").alias(f"rim_{p}")), p, "left")
    return faces.fillna(False, [f"side_{s}" for s in ("ab", "bc", "ca")] + [f"rim_{k}" for k in "abc"])


def _met(corners: DataFrame, size: float) -> DataFrame:
    """Each triangle with each node (i, j, k, px, py, pz) in the boxes, grown by the reach, of its pieces."""
    sides = [vec3.sub(vec3.vec(q), vec3.vec(p)) for p, q in ("ab", "bc", "ca")]
    n = F.greatest(F.lit(1), F.ceil(F.greatest(*map(vec3.norm, sides)) / (PIECE * size)).cast("int"))
    rows = corners.withColumn("n", n).withColumn("s", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("n") - 1 - F.col("s"))))
    last, spans = F.col("s") + F.col("t") == F.col("n") - 1, {}
    for k, grid in zip("xyz", _STEP, strict=True):
        du, dv = (F.col(f"b{k}") - F.col(f"a{k}")) / F.col("n"), (F.col(f"c{k}") - F.col(f"a{k}")) / F.col("n")
        base, zero = F.col(f"a{k}") + F.col("s") * du + F.col("t") * dv, F.lit(0.0)
        low = base + F.when(last, F.least(zero, du, dv)).otherwise(F.least(zero, du, dv, du + dv))
        high = base + F.when(last, F.greatest(zero, du, dv)).otherwise(F.greatest(zero, du, dv, du + dv))
        spans[f"{grid}0"], spans[f"{grid}1"] = F.ceil((low - REACH * size) / size).cast("long"), F.floor((high + REACH * size) / size).cast("long")
    rows = rows.withColumns(spans)
    most = F.greatest(*(F.greatest(F.abs(f"{g}0"), F.abs(f"{g}1")) for g in _STEP))
    rows = rows.withColumn("i0", F.when(most < _ZERO - 1, F.col("i0")).otherwise(F.raise_error(F.lit("the grid is too fine for the mesh's places")).cast("long")))
    # pieces of a large triangle are work for many tasks; a stated number, as few small rows would be drawn together in one task and grow there
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fid", "s", "t")
    for g in _STEP:
        rows = rows.withColumn(g, F.explode(F.sequence(f"{g}0", f"{g}1")))
    return rows.withColumns({f"p{k}": F.col(g) * F.lit(size) for k, g in zip("xyz", _STEP, strict=True)})


def distances(vertices: DataFrame, faces: DataFrame, size: float) -> DataFrame:
    """node, i, j, k, value, rim of each node within reach: its distance from the surface, below zero behind it; rim where the closest place is on the boundary.

    Of faces that are equally close (on an edge, at a corner) the one that faces the node most says which side it is on. Faces without
    an area and of unknown vertices are left out; a mesh without faces has no nodes.
    """
    if not size > 0:
        raise ValueError("the size has to be above zero")
    p, a, b, c = (vec3.vec(k) for k in "pabc")
    corners = topology.with_corners(_with_rims(faces.select("fid", *topology.CORNERS).filter(~topology.is_degenerate())), vertices)
    cross = vec3.cross(vec3.sub(b, a), vec3.sub(c, a))
    corners = corners.withColumns(vec3.named(cross, "n")).withColumn("area", vec3.norm(vec3.vec("n"))).filter("area > 0").withColumns({f"n{k}": F.col(f"n{k}") / F.col("area") for k in "xyz"})
    within, inside, sides = nearest.closest_options(p, a, b, c)
    # in steps of columns: one expression of all would name its parts thousands of times
    met = _met(corners, size)
    met = met.withColumns({"ok0": within, **vec3.named(inside, "q0"), **{f"t{n}": t for n, (t, _) in enumerate(sides, 1)}, **{c: e for n, (_, place) in enumerate(sides, 1) for c, e in vec3.named(place, f"q{n}").items()}})
    away = {n: vec3.sub(p, vec3.vec(f"q{n}")) for n in range(4)}
    met = met.withColumns({f"d{n}": vec3.norm(u) for n, u in away.items()} | {f"front{n}": vec3.dot(u, vec3.vec("n")) for n, u in away.items()})

    def option(n: int, rim: Column, ok: Column) -> Column:
        d, front = F.col(f"d{n}"), F.col(f"front{n}")
        facing = F.coalesce(F.abs(front) / F.nullif(d, F.lit(0.0)), F.lit(1.0))
        return F.when(ok & (d <= REACH * size), F.struct(F.round(d / size, 6).alias("d"), (-F.round(facing, 6)).alias("facing"), F.col("fid").alias("fid"), F.lit(n).alias("part"), F.when(front < 0, -d).otherwise(d).alias("value"), rim.alias("rim")))

    def on(s: str, t: Column) -> Column:
        return F.when(t <= 0, F.col(f"rim_{s[0]}")).when(t >= 1, F.col(f"rim_{s[1]}")).otherwise(F.col(f"side_{s}"))

    # one row at most of a triangle and a node goes to the aggregation
    options = F.array(option(0, F.lit(False), F.col("ok0")), *(option(n, on(s, F.col(f"t{n}")), F.lit(True)) for n, s in enumerate(("ab", "bc", "ca"), 1)))
    near = met.select(*_STEP, F.explode(F.array_compact(F.array(F.array_min(F.array_compact(options))))).alias("best"))
    node = sum((F.col(g) + _ZERO) * step for g, step in _STEP.items())
    least = near.groupBy(*_STEP).agg(F.min("best").alias("best"))
    return least.select(node.alias("node"), *_STEP, F.col("best.value").alias("value"), F.col("best.rim").alias("rim"))


def extracted(nodes: DataFrame, size: float) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces (outwards) of the surface of value 0 between nodes (node, i, j, k, value, rim).

    Only cells all of whose corners are rows, and no rim, hold surface. A value of zero is outside.
    """
    corner = F.array(*(F.struct(F.lit(c).alias("corner"), F.lit(_offset(c)).alias("off")) for c in range(8)))
    rows = nodes.select("node", "value", "rim", F.inline(corner)).select((F.col("node") - F.col("off")).alias("cell"), "corner", "value", "rim")
    at = F.array(*(F.max(F.when(F.col("corner") == c, F.col("value"))) for c in range(8)))
    cells = rows.groupBy("cell").agg(F.count("*").alias("n"), F.bool_or("rim").alias("rim"), F.min("value").alias("low"), F.max("value").alias("high"), at.alias("at"))
    cells = cells.filter("n = 8 and not rim and low < 0 and high >= 0").select("cell", "at")
    walks = [(0, p, p | q, 7) for p, q, _ in permutations((1, 2, 4))]
    masks = F.array(*(sum(F.when(F.col("at")[c] < 0, 1 << m).otherwise(0) for m, c in enumerate(w)) for w in walks))
    table = nodes.sparkSession.createDataFrame([(t, m, part, [{"low": p, "high": q} for p, q in e]) for t, m, part, e in cases()], "tet int, mask int, part int, edges array<struct<low int, high int>>")
    met = cells.select("*", F.posexplode(masks).alias("tet", "mask")).join(F.broadcast(table), ["tet", "mask"])

    def vertex(e: Column) -> Column:
        low, high = e["low"], e["high"]
        p, q = F.get("at", low), F.get("at", high)
        along, grid = p / (p - q), low.bitwiseXOR(high)
        bit = lambda v, n: F.shiftright(v, n).bitwiseAND(F.lit(1))
        moved = sum((bit(low, n).cast("long") * step for n, step in enumerate(_STEP.values())), F.col("cell"))
        places = {k: (F.shiftright("cell", (2 - n) * BITS).bitwiseAND(F.lit((1 << BITS) - 1)) - _ZERO + bit(low, n) + along * bit(grid, n)) * size for n, k in enumerate("xyz")}
        return F.struct((moved * 8 + grid).alias("vid"), *(v.alias(k) for k, v in places.items()))

    named = met.select((F.col("cell") * 16 + F.col("tet") * 2 + F.col("part")).alias("fid"), F.array(*(vertex(F.col("edges")[n]) for n in range(3))).alias("corners"))
    triangles = materialise(named, "triangles")
    vertices = triangles.select(F.inline("corners")).groupBy("vid").agg(*(F.first(k).alias(k) for k in "xyz"))
    return vertices, triangles.select("fid", *(F.col("corners")[n]["vid"].alias(k) for n, k in enumerate(topology.CORNERS)))


def reconstructed(vertices: DataFrame, faces: DataFrame, size: float) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces of the surface anew, at the resolution of a grid. A closed surface gives a closed one; an open one ends within two sizes of its boundary."""
    return extracted(distances(vertices, faces, size), size)
