"""Nearest neighbours and range joins without cross joins.

A range join deals points in grid cells and joins those of cells nearby.

A nearest search deals the targets in blocks of bounded size along a curve through space and keeps each block's box. The
boxes, of which there are never more than MAX_BLOCKS, go to all tasks. A point first meets the block whose box is nearest, which
bounds its distance, then those blocks alone whose boxes lie within that bound. Points travel to a block in bundles, so a block that
all points ask for is met in many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshloom.functions import vec3
from meshloom.operators.topology import numbered_along
from meshloom.sources.store import materialise

#: Targets of a block, at least; and blocks, at most (56 bytes each in every task).
BLOCK = 512
MAX_BLOCKS = 1 << 18
BUNDLE = 512
#: Points that are compared with every triangle in one scan.
FEW = 16
_BUNDLES = "block long, ids array<long>, places array<double>"


def _cell(k: str, size) -> F.Column:
    return F.floor(F.col(k) / size).cast("long")


def _around(reach: int):
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    return steps


def cell_neighbours(rows: DataFrame, size, reach: int = 1) -> DataFrame:
    """Each row once for each cell (cx, cy, cz) within ``reach`` of its own."""
    out = rows
    for k in "xyz":
        out = out.withColumn(f"__d{k}", F.explode(_around(reach)))
    return out.select(*rows.columns, *((_cell(k, size) + F.col(f"__d{k}")).alias(f"c{k}") for k in "xyz"))


def range_pairs(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """(left id, right id, d) of all pairs within ``radius``; both tables have id, x, y, z."""
    cells = ["cx", "cy", "cz"]
    near = cell_neighbours(left.select(F.col("id").alias("l"), *(F.col(k).alias(k) for k in "xyz")), radius).select("l", *(F.col(k).alias(f"l{k}") for k in "xyz"), *cells)
    other = right.select(F.col("id").alias("r"), *(F.col(k).alias(f"r{k}") for k in "xyz"), *(_cell(k, radius).alias(f"c{k}") for k in "xyz"))
    return near.join(other, cells).withColumn("d", vec3.distance(vec3.vec("l"), vec3.vec("r"))).filter(F.col("d") <= radius).select("l", "r", "d")


def along_curve(rows: DataFrame, axes: Sequence[str] = "xyz", bits: int = 21) -> Column:
    """The place along the curve that interleaves the bits of the first three coordinates within the rows' box.

    All axes are divided by the longest side of the box, so that runs of the curve are compact: by its own side each, runs on a long limb would
    be strips along it, and what spreads along the surface would pass between them again and again.
    """
    axes = axes[:3]
    box = rows.agg(*(F.min(k).alias(f"l{k}") for k in axes), *(F.max(k).alias(f"h{k}") for k in axes)).first()
    total = F.lit(0).cast("long")
    span = max((box[f"h{k}"] or 0.0) - (box[f"l{k}"] or 0.0) for k in axes) or 1.0
    for i, k in enumerate(axes):
        v = F.least(F.greatest(((F.col(k) - F.lit(box[f"l{k}"])) / span * (1 << bits)).cast("long"), F.lit(0)), F.lit((1 << bits) - 1))
        for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        total = total.bitwiseOR(F.shiftleft(v, i))
    return total


def _gap(low: np.ndarray, high: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Distance of places from boxes."""
    return np.sqrt((np.maximum(np.maximum(low - at, at - high), 0) ** 2).sum(axis=-1))


def _near_together(places: np.ndarray) -> Iterator[np.ndarray]:
    """Runs of at most BUNDLE places that lie near each other."""
    span = np.maximum(np.ptp(places, axis=0), 1e-300) if len(places) else 1
    cell = ((places - places.min(axis=0)) / span * 15.99).astype(np.int64)[:, :3] if len(places) else np.zeros((0, 3), np.int64)
    order = np.lexsort(cell.T)
    for i in range(0, len(order), BUNDLE):
        yield order[i : i + BUNDLE]


def _bundles(point: np.ndarray, block: np.ndarray, ids: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    """Rows of _BUNDLES for pairs of a point and a block."""
    order = np.argsort(block, kind="stable")
    point, block = point[order], block[order]
    first = np.flatnonzero(np.diff(block, prepend=-1))
    rank = np.arange(len(block)) - np.repeat(first, np.diff(first, append=len(block)))
    cuts = np.flatnonzero(rank % BUNDLE == 0)
    at = np.append(cuts, len(block)).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(block[cuts]), pa.ListArray.from_arrays(pa.array(at), pa.array(ids[point])), pa.ListArray.from_arrays(pa.array(at * places.shape[1]), pa.array(places[point].ravel()))], names=["block", "ids", "places"])


def _search(points: DataFrame, targets: DataFrame, measure: Callable[[np.ndarray, np.ndarray], np.ndarray], axes: Sequence[str] = "xyz") -> DataFrame:
    """id, target, d: for each of ``points`` (id and a column for each axis) the target of least ``measure`` (the least id of equals).

    ``targets`` has target, a place, its box (an l and an h column for each axis) and ``data``, numbers that ``measure`` compares places with.
    """
    spark, dims = points.sparkSession, len(axes)
    schema = ", ".join(["id long", *(f"{k} double" for k in axes), "block long, target long, d double"])
    n = targets.count()
    size = max(BLOCK, -(-n // MAX_BLOCKS))
    placed = numbered_along(targets, [along_curve(targets, axes), F.col("target")], "place").withColumn("block", F.floor(F.col("place") / size).cast("long"))
    corners = [*(F.min(f"l{k}").alias(f"l{k}") for k in axes), *(F.max(f"h{k}").alias(f"h{k}") for k in axes)]
    blocks = materialise(placed.groupBy("block").agg(F.collect_list("target").alias("targets"), F.flatten(F.collect_list("data")).alias("data"), *corners), "blocks")
    table = blocks.select("block", *(f"{e}{k}" for e in "lh" for k in axes)).orderBy("block").toPandas()  # at most MAX_BLOCKS rows
    boxes = spark.sparkContext.broadcast((table["block"].to_numpy(), *(table[[f"{e}{k}" for k in axes]].to_numpy(float) for e in "lh")))

    def places_of(batch: pa.RecordBatch) -> np.ndarray:
        return np.stack([batch.column(k).to_numpy() for k in axes], axis=1)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, low, high = boxes.value
        for batch in batches:
            ids, at = batch.column("id").to_numpy(), places_of(batch)
            best = np.zeros(len(ids), np.int64)
            for some in _near_together(at):
                l, h = at[some].min(axis=0), at[some].max(axis=0)
                # no place of this run is farther from some box than ``most``
                most = np.sqrt((np.maximum(np.maximum(low - l, h - high), 0) ** 2).sum(axis=1)).min()
                may = np.flatnonzero(np.sqrt((np.maximum(np.maximum(low - h, l - high), 0) ** 2).sum(axis=1)) <= most * (1 + 1e-12))
                best[some] = may[_gap(low[may][None], high[may][None], at[some][:, None]).argmin(axis=1)]
            if len(ids):
                yield _bundles(np.arange(len(ids)), names[best], ids, at)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, low, high = boxes.value
        for batch in batches:
            ids, at, met, bound = batch.column("id").to_numpy(), places_of(batch), batch.column("block").to_numpy(), batch.column("d").to_numpy() * (1 + 1e-12)
            for some in _near_together(at):
                l, h = at[some].min(axis=0), at[some].max(axis=0)
                may = np.flatnonzero(np.sqrt((np.maximum(np.maximum(low - h, l - high), 0) ** 2).sum(axis=1)) <= bound[some].max())
                point, box = np.nonzero(_gap(low[may][None], high[may][None], at[some][:, None]) <= bound[some][:, None])
                point, box = some[point], names[may[box]]
                new = box != met[point]
                if new.any():
                    yield _bundles(point[new], box[new], ids, at)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, targets_, data = (batch.column(c)[k].values.to_numpy() for c in ("ids", "targets", "data"))
                at, data = batch.column("places")[k].values.to_numpy().reshape(-1, dims), data.reshape(len(targets_), -1)
                order = np.argsort(targets_, kind="stable")  # so that of equals the least id comes first
                targets_, data = targets_[order], data[order]
                d, which, step = np.empty(len(ids)), np.empty(len(ids), np.int64), max(1, (1 << 19) // len(targets_))
                for i in range(0, len(ids), step):
                    gaps = measure(at[i : i + step], data)
                    which[i : i + step] = gaps.argmin(axis=1)
                    d[i : i + step] = gaps.min(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(at[:, c]) for c in range(dims)), pa.array(np.full(len(ids), batch.column("block")[k].as_py())), pa.array(targets_[which]), pa.array(d)], names=[c.split()[0] for c in schema.split(", ")])

    rows = points.select(F.col("id").cast("long").alias("id"), *(F.col(k).cast("double").alias(k) for k in axes))
    data = blocks.select("block", "targets", "data")
    near = materialise(rows.mapInArrow(first, _BUNDLES).join(data, "block").mapInArrow(meet, schema), "near")
    far = near.mapInArrow(others, _BUNDLES).join(data, "block").mapInArrow(meet, schema)
    both = near.unionByName(far).groupBy("id").agg(F.min(F.struct("d", "target")).alias("s"))
    return both.select("id", "s.target", "s.d")


def _to_places(at: np.ndarray, data: np.ndarray) -> np.ndarray:
    total = np.zeros((len(at), len(data)))
    for k in range(at.shape[1]):
        gap = at[:, k, None] - data[None, :, k]
        total += gap * gap
    return np.sqrt(total)


def _to_triangles(at: np.ndarray, data: np.ndarray) -> np.ndarray:
    p, (a, b, c) = at[:, None, :], (data[None, :, 3 * k : 3 * k + 3] for k in range(3))
    dot = lambda u, v: (u * v).sum(axis=-1)
    ab, ac, ap = b - a, c - a, p - a
    d00, d01, d11, d20, d21 = dot(ab, ab), dot(ab, ac), dot(ac, ac), dot(ap, ab), dot(ap, ac)
    det = d00 * d11 - d01 * d01
    with np.errstate(divide="ignore", invalid="ignore"):
        v, w = (d11 * d20 - d01 * d21) / det, (d00 * d21 - d01 * d20) / det
        on_face = np.sqrt(dot(*(2 * [ap - v[..., None] * ab - w[..., None] * ac])))
        best = np.where((v >= 0) & (w >= 0) & (v + w <= 1), on_face, np.inf)
        for q, r in ((a, b), (b, c), (c, a)):
            side = r - q
            t = np.clip(np.nan_to_num(dot(p - q, side) / dot(side, side)), 0, 1)
            gap = p - q - t[..., None] * side
            best = np.fmin(best, np.sqrt(dot(gap, gap)))
    return best


def nearest(points: DataFrame, targets: DataFrame, axes: Sequence[str] = "xyz") -> DataFrame:
    """Id, target, d: for each of ``points`` (id and a column for each axis) the nearest of ``targets`` (the least id of equals); no row where there is no target."""
    boxes = [F.col(k).cast("double").alias(f"{e}{k}") for e in "lh" for k in axes]
    data = F.array(*(F.col(k).cast("double") for k in axes)).alias("data")
    return _search(points, targets.select(F.col("id").cast("long").alias("target"), *axes, *boxes, data), _to_places, axes)


def closest_options(p: vec3.Vec, a: vec3.Vec, b: vec3.Vec, c: vec3.Vec) -> tuple[Column, vec3.Vec, list[tuple[Column, vec3.Vec]]]:
    """Whether the foot of ``p`` on a triangle's plane lies within it, that foot, and for the sides ab, bc, ca how far along (0 to 1) the place closest to ``p`` is, and that place."""
    ab, ac, ap = vec3.sub(b, a), vec3.sub(c, a), vec3.sub(p, a)
    d00, d01, d11, d20, d21 = vec3.dot(ab, ab), vec3.dot(ab, ac), vec3.dot(ac, ac), vec3.dot(ap, ab), vec3.dot(ap, ac)
    det = d00 * d11 - d01 * d01
    v, w = (d11 * d20 - d01 * d21) / F.nullif(det, F.lit(0.0)), (d00 * d21 - d01 * d20) / F.nullif(det, F.lit(0.0))
    inside = vec3.add(a, vec3.add(vec3.scale(ab, v), vec3.scale(ac, w)))

    def on_side(q, r):
        side = vec3.sub(r, q)
        t = F.coalesce(vec3.dot(vec3.sub(p, q), side) / F.nullif(vec3.dot(side, side), F.lit(0.0)), F.lit(0.0))
        t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
        return t, vec3.add(q, vec3.scale(side, t))

    return F.coalesce((v >= 0) & (w >= 0) & (v + w <= 1), F.lit(False)), inside, [on_side(a, b), on_side(b, c), on_side(c, a)]


def closest_on_triangles(points: DataFrame, corners: DataFrame) -> DataFrame:
    """For each of ``points`` (id, x, y, z) the closest place on the triangles ``corners`` (fid, ax, .. cz): id, fid, x, y, z, d; the least fid of equals.

    At most FEW points, such as a mesh's centroid, are a query set that one scan of the triangles answers; more are searched by blocks.
    """
    p, a, b, c = (vec3.vec(k) for k in "pabc")
    within, inside, sides_ = closest_options(p, a, b, c)
    pick = lambda q, ok=None: F.when(F.lit(True) if ok is None else ok, F.struct(vec3.distance(p, q).alias("d"), q[0].alias("x"), q[1].alias("y"), q[2].alias("z")))
    best = F.array_min(F.filter(F.array(pick(inside, within), *(pick(place) for _, place in sides_)), lambda s: s.isNotNull()))
    named = points.select("id", *(F.col(k).alias(f"p{k}") for k in "xyz"))
    if points.limit(FEW + 1).count() <= FEW:
        met = corners.join(F.broadcast(named)).select("id", "fid", best.alias("s")).select("id", F.struct(F.col("s.d").alias("d"), "fid", F.col("s.x").alias("x"), F.col("s.y").alias("y"), F.col("s.z").alias("z")).alias("s"))
        return met.groupBy("id").agg(F.min("s").alias("s")).select("id", "s.fid", "s.x", "s.y", "s.z", "s.d")
    ends = {k: [F.col(f"{e}{k}") for e in "abc"] for k in "xyz"}
    middle = [(sum(ends[k][1:], ends[k][0]) / 3).alias(k) for k in "xyz"]
    boxes = [*(F.least(*ends[k]).alias(f"l{k}") for k in "xyz"), *(F.greatest(*ends[k]).alias(f"h{k}") for k in "xyz")]
    data = F.array(*(F.col(f"{e}{k}") for e in "abc" for k in "xyz")).alias("data")
    found = _search(points, corners.select(F.col("fid").alias("target"), *middle, *boxes, data), _to_triangles)
    sides = corners.select("fid", *(f"{e}{k}" for e in "abc" for k in "xyz"))
    met = found.select("id", F.col("target").alias("fid")).join(named, "id").join(sides, "fid")
    return met.select("id", "fid", best.alias("s")).select("id", "fid", "s.x", "s.y", "s.z", "s.d")
