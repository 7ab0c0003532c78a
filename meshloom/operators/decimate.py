"""Decimation by quadric error: rounds of independent edge collapses.

Every vertex carries the sum of the squared distances to the planes of its faces (weighed by area, with planes that hold boundary sides in
place) as ten numbers, which add up when two vertices become one. A collapse puts both ends where that sum is least. In a
round each edge that may collapse (the surface stays a manifold, no face turns over) bids its error; it wins if no edge bids less
that ends at its ends or beside them, so winners share no face and all collapse at once. Only the cheapest share of the edges bids,
so that a round takes what one collapse after the other would take, and the last round stops at the target.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshloom.functions import vec3
from meshloom.operators.repair import directed_sides
from meshloom.operators.topology import CORNERS, both_ways, corner, corner_rows, edge_incidence, is_degenerate, numbered_along, with_corners
from meshloom.sources.store import materialise

#: The symmetric form of a plane (x, y, z, w): xx, xy, ...
FORM = ("xx", "xy", "xz", "xw", "yy", "yz", "yw", "zz", "zw", "ww")
#: The share of edges that may bid in a round, and how many bid for each collapse still needed.
SHARE, BIDS = 0.3, 4
#: A face may turn by the angle of this cosine at most.
LEAST_COSINE = 0.2


def _plane_form(n: vec3.Vec, at: vec3.Vec, weight: Column) -> list[Column]:
    p = dict(zip("xyzw", (*n, -vec3.dot(n, at)), strict=True))
    return [(p[k[0]] * p[k[1]] * weight).alias(k) for k in FORM]


def quadrics(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """vid and the ten numbers of each vertex that a face uses."""
    p = with_corners(faces, vertices)
    n = vec3.cross(vec3.sub(corner("b"), corner("a")), vec3.sub(corner("c"), corner("a")))
    p = materialise(p.select("fid", *CORNERS, *(F.col(f"{k}{x}") for k in CORNERS for x in "xyz"), vec3.norm(n).alias("l"), *(c.alias(f"n{k}") for k, c in zip("xyz", n, strict=True))).filter("l > 0"), "planes")
    unit = tuple(F.col(f"n{k}") / F.col("l") for k in "xyz")
    of_faces = corner_rows(p.select("fid", *CORNERS, *_plane_form(unit, corner("a"), F.col("l") / 2)), *FORM).select("vid", *FORM)
    places = F.create_map(*(x for k in CORNERS for x in (F.col(k), F.struct(*(F.col(f"{k}{i}").alias(i) for i in "xyz")))))
    sides = directed_sides(p.withColumn("at", places), "at", *(f"n{k}" for k in "xyz"), "l").join(edge_incidence(faces).filter("inc = 1").select("u", "w"), ["u", "w"])
    s, e = (tuple(F.col("at")[F.col(v)][k] for k in "xyz") for v in "se")
    along = vec3.sub(e, s)
    across = vec3.cross(tuple(F.col(f"n{k}") / F.col("l") for k in "xyz"), along)
    held = sides.select("s", "e", *(c.alias(f"s{k}") for k, c in zip("xyz", s, strict=True)), *(c.alias(f"m{k}") for k, c in zip("xyz", across, strict=True)), vec3.norm(along).alias("side")).filter("side > 0")
    at_sides = held.select(F.explode(F.array("s", "e")).alias("vid"), *_plane_form(tuple(F.col(f"m{k}") / F.col("side") for k in "xyz"), vec3.vec("s"), F.col("side") * F.col("side")))
    return of_faces.unionByName(at_sides).groupBy("vid").agg(*(F.sum(k).alias(k) for k in FORM))


def _error(q: dict[str, Column], at: vec3.Vec) -> Column:
    x = dict(zip("xyzw", (*at, F.lit(1.0)), strict=True))
    return F.greatest(reduce(Column.__add__, (q[k] * x[k[0]] * x[k[1]] * (1 if k[0] == k[1] else 2) for k in FORM)), F.lit(0.0))


def bids(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """u, w, inc, cost and the place (px, py, pz) where the quadric of both ends (vertices carry FORM) is least, of edges (u, w, inc).

    Where the least place is not determined, or farther from the middle than the edge is long, it is the best of the two ends and the middle.
    """
    for end in "uw":
        edges = edges.join(vertices.select(F.col("vid").alias(end), *(F.col(c).alias(f"{end}{c}") for c in ("x", "y", "z", *FORM))), end)
    u, w = vec3.vec("u"), vec3.vec("w")
    rows = edges.select("u", "w", "inc", *(F.col(f"u{k}") for k in "xyz"), *(F.col(f"w{k}") for k in "xyz"), *((F.col(f"u{k}") + F.col(f"w{k}")).alias(k) for k in FORM))
    q = {k: F.col(k) for k in FORM}
    xx, xy, xz, xw, yy, yz, yw, zz, zw, _ = (q[k] for k in FORM)
    det = xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz)
    scale = (xx + yy + zz) / 3
    rows = rows.withColumns({"det": det, "fine": det > 1e-6 * scale * scale * scale})
    safe = F.when(F.col("fine"), F.col("det"))
    solved = (
        -(xw * (yy * zz - yz * yz) - xy * (yw * zz - yz * zw) + xz * (yw * yz - yy * zw)) / safe,
        -(xx * (yw * zz - yz * zw) - xw * (xy * zz - yz * xz) + xz * (xy * zw - yw * xz)) / safe,
        -(xx * (yy * zw - yw * yz) - xy * (xy * zw - yw * xz) + xw * (xy * yz - yy * xz)) / safe,
    )
    rows = rows.withColumns({f"o{k}": c for k, c in zip("xyz", solved, strict=True)}).withColumns({f"m{k}": (F.col(f"u{k}") + F.col(f"w{k}")) / 2 for k in "xyz"})
    near = F.col("fine") & (vec3.distance(vec3.vec("o"), vec3.vec("m")) <= vec3.distance(u, w))
    option = lambda at, first: F.struct(_error(q, at).alias("cost"), F.lit(first).alias("first"), *(c.alias(k) for k, c in zip("xyz", at, strict=True)))
    best = F.when(near, option(vec3.vec("o"), 0)).otherwise(F.least(option(vec3.vec("m"), 1), option(u, 2), option(w, 3)))
    return rows.withColumn("best", best).select("u", "w", "inc", "best.cost", *(F.col(f"best.{k}").alias(f"p{k}") for k in "xyz"))


def may_collapse(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """``rows`` (u, w, inc, ...) of a surface's ``edges`` whose collapse leaves a manifold: ends share only the neighbours that their faces give, an inner edge has an inner end, and more than one face or a tetrahedron is left."""
    arcs = both_ways(edges).withColumnsRenamed({"u": "v", "w": "x"})
    degree = arcs.groupBy("v").agg(F.count("*").alias("deg"))
    rim = both_ways(edges.filter("inc = 1")).select(F.col("u").alias("v"), F.lit(True).alias("rim")).distinct()
    ends = materialise(degree.join(rim, "v", "left").select("v", "deg", F.coalesce("rim", F.lit(False)).alias("rim")), "ends")
    pairs = rows.select("u", "w").join(arcs.withColumnRenamed("v", "u"), "u").filter("x <> w")
    third = edges.select(F.col("u").alias("p"), F.col("w").alias("q"))
    shared = pairs.withColumns({"p": F.least("w", "x"), "q": F.greatest("w", "x")}).join(third, ["p", "q"]).groupBy("u", "w").agg(F.count("*").alias("shared"))
    met = rows.join(shared, ["u", "w"])
    for end in "uw":
        met = met.join(ends.select(F.col("v").alias(end), F.col("deg").alias(f"deg_{end}"), F.col("rim").alias(f"rim_{end}")), end)
    inner = (F.col("inc") == 2) & ~(F.col("rim_u") & F.col("rim_w")) & ~((F.col("deg_u") == 3) & (F.col("deg_w") == 3))
    outer = (F.col("inc") == 1) & ~((F.col("deg_u") == 2) & (F.col("deg_w") == 2))
    return met.filter((F.col("shared") == F.col("inc")) & (inner | outer)).select(*rows.columns)


def keeps_faces(rows: DataFrame, vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """``rows`` (u, w, px, py, pz, ...) whose collapse turns none of the faces left around both ends by more than LEAST_COSINE says."""
    p = with_corners(faces, vertices)
    around = p.select("*", F.explode(F.array(*CORNERS)).alias("v"))
    moved = rows.select(F.explode(F.array("u", "w")).alias("v"), F.struct(*rows.columns).alias("row")).join(around, "v")
    u, w = F.col("row.u"), F.col("row.w")
    moved = moved.filter(reduce(Column.__add__, (((F.col(k) == u) | (F.col(k) == w)).cast("int") for k in CORNERS)) == 1)
    new = {k: tuple(F.when(F.col(k) == F.col("v"), F.col(f"row.p{x}")).otherwise(F.col(f"{k}{x}")) for x in "xyz") for k in CORNERS}
    normal = lambda a, b, c: vec3.cross(vec3.sub(b, a), vec3.sub(c, a))
    named = lambda n, s: [c.alias(f"{s}{k}") for k, c in zip("xyz", n, strict=True)]
    normals = moved.select("row", *named(normal(*(corner(k) for k in CORNERS)), "old_"), *named(normal(*(new[k] for k in CORNERS)), "new_"))
    old, turned = vec3.vec("old_"), vec3.vec("new_")
    fine = vec3.dot(old, turned) > LEAST_COSINE * vec3.norm(old) * vec3.norm(turned)
    bad = normals.filter(~fine).select("row.u", "row.w").distinct()
    return rows.join(bad, ["u", "w"], "left_anti").select(*rows.columns)


def winners(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """``rows`` (u, w, cost, ...) that bid least of all that have an end at or beside theirs (by cost, then by a fixed shuffle of the ends): no end of one is a neighbour of another's, so no face and no neighbourhood knows both."""
    shuffle = F.pmod(F.col("u") * 40503 + F.col("w") * 30011, F.lit(65521))
    bid = materialise(rows.withColumn("bid", F.struct("cost", shuffle.alias("shuffle"), "u", "w")), "bids")
    reach = bid.select(F.explode(F.array("u", "w")).alias("vid"), "bid").groupBy("vid").agg(F.min("bid").alias("bid"))
    told = reach.select(F.col("vid").alias("u"), "bid").join(both_ways(edges.select("u", "w")), "u").select(F.col("w").alias("vid"), "bid")
    reach = materialise(reach.unionByName(told).groupBy("vid").agg(F.min("bid").alias("bid")), "reach")
    met = bid
    for end in "uw":
        met = met.join(reach.select(F.col("vid").alias(end), F.col("bid").alias(f"least_{end}")), end)
    return met.filter("bid = least_u and bid = least_w").select(*rows.columns)


def one_round(vertices: DataFrame, faces: DataFrame, share: float = 1.0) -> DataFrame:
    """The collapses of a round: u (stays), w (goes), inc, cost, px, py, pz. ``vertices`` carry FORM. Only the cheapest ``share`` of the edges bids."""
    edges = materialise(edge_incidence(faces), "edges")
    all_ = materialise(bids(vertices, edges), "costs")
    if share < 1:
        most = all_.agg(F.percentile_approx("cost", share, 1000)).first()[0]
        all_ = all_.filter(F.col("cost") <= most)
    return winners(keeps_faces(materialise(may_collapse(all_, edges), "sound"), vertices, faces), edges)


def collapsed(vertices: DataFrame, faces: DataFrame, collapses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces after ``collapses``: w is u at its new place with the sum of both quadrics."""
    moved = collapses.select(F.col("u").alias("vid"), "px", "py", "pz", F.col("w").alias("__gone"))
    gone = vertices.select(F.col("vid").alias("__gone"), *(F.col(k).alias(f"g{k}") for k in FORM))
    met = vertices.join(moved.join(gone, "__gone"), "vid", "left").join(collapses.select(F.col("w").alias("vid")), "vid", "left_anti")
    place = {k: F.coalesce(f"p{k}", k) for k in "xyz"} | {k: F.col(k) + F.coalesce(f"g{k}", F.lit(0.0)) for k in FORM}
    new_vertices = met.withColumns(place).select(*vertices.columns)
    for k in CORNERS:
        faces = faces.join(collapses.select(F.col("w").alias(k), F.col("u").alias("__to")), k, "left").withColumn(k, F.coalesce("__to", k)).drop("__to")
    return new_vertices, faces.select("fid", *CORNERS).filter(~is_degenerate())


def decimated(vertices: DataFrame, faces: DataFrame, target: int, rounds: list | None = None) -> tuple[DataFrame, DataFrame]:
    """Vertices (vid, x, y, z) and faces (fid, a, b, c) of a mesh of at most ``target`` faces, or of as few as collapses can give. No edge may have more than two faces.

    What stays keeps its vid and fid. ``rounds`` gets (faces, collapses) of each round appended.
    """
    form = quadrics(vertices, faces)
    v = materialise(vertices.select("vid", *"xyz").join(form, "vid"), "vertices")
    f = materialise(faces.select("fid", *CORNERS).filter(~is_degenerate()), "faces")
    n, widen = f.count(), 1
    while n > target:
        need = -(-(n - target) // 2)
        share = min(1.0, widen * max(min(SHARE, BIDS * need / (1.5 * n)), 64 / n))
        found = materialise(one_round(v, f, share), "collapses")
        many = found.count()
        if not many:
            if share == 1:
                break
            widen *= 4  # none of the cheapest edges may collapse
            continue
        if many > need:
            found = materialise(numbered_along(found, [F.col("cost"), F.col("u"), F.col("w")], "place").filter(F.col("place") < need).drop("place"), "cheapest")
            many = need
        v, f = collapsed(v, f, found)
        v, f = materialise(v, "vertices"), materialise(f, "faces")
        if rounds is not None:
            rounds.append((n, many))
        n = f.count()
    return v.join(corner_rows(f).select("vid").distinct(), "vid", "left_semi").select("vid", *"xyz"), f
