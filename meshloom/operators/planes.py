"""Planes through a mesh and signed distance fields along them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshloom.functions import vec3
from meshloom.operators import graph, metrics, nearest, topology
from meshloom.sources.store import materialise

MODES = ("normal", "transverse", "longitudinal")
#: Values of each mode's quality that a mask keeps, ends included.
BOUNDS = {"normal": (-0.8, 0.8), "transverse": (-0.75, 0.75), "longitudinal": (-1.0, 0.2)}
BAND_SHARE = 0.01


def modes(names: list[str]) -> tuple[str, str]:
    """Exactly two known, different modes."""
    out = tuple(n.strip().lower() for n in names)
    if len(out) != 2 or len(set(out)) != 2 or not set(out) <= set(MODES):
        raise ValueError(f"two different modes of {', '.join(MODES)} are needed, not {names}")
    return out


def axis_least_parallel(n: np.ndarray) -> np.ndarray:
    """The coordinate axis along which ``n`` has the least component (the first of equals)."""
    return np.eye(3)[np.abs(n).argmin()]


def plane_normal(n: np.ndarray, axes: list[np.ndarray], mode: str) -> np.ndarray:
    """The plane's normal from the mesh normal and its principal axes; an axis whose part across ``n`` is shorter than 1e-6 gives way to the next."""
    if mode == "normal":
        return n
    for u in (*axes[: 2 if mode == "longitudinal" else 3], axis_least_parallel(n)):
        across = u - (u @ n) * n
        length = np.linalg.norm(across)
        if length >= 1e-6:
            return np.cross(n, across / length) if mode == "longitudinal" else across / length
    raise ValueError("no axis across the normal")


def context(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """C1, one row: box centre, diagonal, volume centroid (c), mesh normal (n) to the closest surface place, axes (u0..u2), band half-width (ep)."""
    box = materialise(metrics.bounds(vertices), "box")
    reference = box.select(*(F.col(f"centre_{k}").alias(f"r{k}") for k in "xyz"))
    volume = materialise(metrics.volume_about(faces, vertices, reference), "volume")
    centre = volume.select(F.lit(0).cast("long").alias("id"), *(F.col(f"centroid_{k}").alias(k) for k in "xyz"))
    close = nearest.closest_on_triangles(centre, topology.with_corners(faces, vertices)).select(*(F.col(k).alias(f"q{k}") for k in "xyz"))
    axes = metrics.principal_axes(metrics.covariance(vertices, centre.select(*(F.col(k).alias(f"r{k}") for k in "xyz"))))
    row = box.select("diag").join(volume).join(close).join(axes)  # each is one row
    c = tuple(F.col(f"centroid_{k}") for k in "xyz")
    n = vec3.normalised(vec3.sub(vec3.vec("q"), c))
    out = row.select("diag", "volume", *(p.alias(f"c{k}") for k, p in zip("xyz", c, strict=True)), *(p.alias(f"n{k}") for k, p in zip("xyz", n, strict=True)), *(F.col(f"u{i}{k}") for i in range(3) for k in "xyz"), F.when(F.col("diag") > 0, F.col("diag") * BAND_SHARE).otherwise(BAND_SHARE).alias("ep"))
    return materialise(out, "context")


def with_plane(ctx: DataFrame, mode: str) -> DataFrame:
    """Context rows (one for each mesh) with the plane's normal mx, my, mz."""

    def solve(frames):
        for f in frames:
            rows = [plane_normal(r[["nx", "ny", "nz"]].to_numpy(float), [r[[f"u{i}x", f"u{i}y", f"u{i}z"]].to_numpy(float) for i in range(3)], mode) for _, r in f.iterrows()]
            yield f.assign(**{f"m{k}": [m[i] for m in rows] for i, k in enumerate("xyz")})

    return ctx.mapInPandas(solve, ", ".join(f"`{c}` double" for c in (*ctx.columns, "mx", "my", "mz")))


def signed_distances(vertices: DataFrame, plane: DataFrame) -> DataFrame:
    """Vid, s and whether in the band, for a one-row plane (m, c, ep)."""
    row = F.broadcast(plane.select(*(f"m{k}" for k in "xyz"), *(f"c{k}" for k in "xyz"), "ep"))
    s = vec3.dot(vec3.vec("m"), vec3.vec()) - vec3.dot(vec3.vec("m"), vec3.vec("c"))
    return vertices.join(row).select("vid", *("xyz"), s.alias("s"), (F.abs(s) <= F.col("ep")).alias("in_band"))


def band(distances: DataFrame) -> DataFrame:
    """The vids of the band; if it is empty the vertex nearest to the plane (the least vid of equals)."""
    best = distances.agg(F.max("in_band").alias("any"), F.min(F.struct(F.abs("s").alias("a"), "vid")).alias("s"))
    return distances.join(F.broadcast(best.select("any", F.col("s.vid").alias("nearest")))).filter(F.when(F.col("any"), F.col("in_band")).otherwise(F.col("vid") == F.col("nearest"))).select("vid")


def clamped(rows: DataFrame, value: str) -> DataFrame:
    """Values that are null or not finite become the largest finite one, or 0 if there is none."""
    finite = F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(F.col(value)) != float("inf"))
    most = rows.agg(F.coalesce(F.max(F.when(finite, F.col(value))), F.lit(0.0)).alias("__most"))
    return rows.join(F.broadcast(most)).withColumn(value, F.when(finite, F.col(value)).otherwise(F.col("__most"))).drop("__most")


def signed(value: Column, s: Column) -> Column:
    """The value with the side of the plane as sign (on the plane: plus); never a negative zero."""
    return F.when(s < 0, -value).otherwise(value) + 0.0


def quality(vertices: DataFrame, faces: DataFrame, plane: DataFrame, distance: str = "geodesic", flat: float = 0.0) -> DataFrame:
    """Vid, s, distance, norm and quality (signed) of every vertex for a one-row plane; ``flat`` is the norm where all distances are equal, as when the band holds the whole mesh."""
    placed = materialise(signed_distances(vertices, plane), "signed")
    near = materialise(band(placed), "band")
    if distance == "geodesic":
        edges = topology.with_lengths(topology.edge_incidence(faces), vertices)
        found = graph.distances(edges, near, vertices).select("vid", F.col("d").alias("distance"))
    elif distance == "euclidean":
        ids = lambda v: v.select(F.col("vid").alias("id"), *("xyz"))
        found = nearest.nearest(ids(vertices), ids(vertices.join(near, "vid", "left_semi"))).select(F.col("id").alias("vid"), F.col("d").alias("distance"))
    else:
        raise ValueError(f"unknown distance {distance}")
    rows = clamped(placed.select("vid", "s").join(found, "vid", "left"), "distance")
    return metrics.normalised01(rows, "distance", "norm", flat).withColumn("quality", signed(F.col("norm"), F.col("s")))


def two_modes(vertices: DataFrame, faces: DataFrame, names: list[str], flat: float = 0.0) -> DataFrame:
    """C4: vertices with quality_<mode> for two modes that share one context; ``quality`` is the first. ``flat`` as in ``quality``."""
    first, second = modes(names)
    ctx = context(vertices, faces)
    out = vertices
    for mode in (first, second):
        out = out.join(quality(vertices, faces, with_plane(ctx, mode), flat=flat).select("vid", F.col("quality").alias(f"quality_{mode}")), "vid")
    return out.withColumn("quality", F.col(f"quality_{first}"))


def within_bounds(names: list[str], bounds: dict[str, tuple[float, float]] = BOUNDS) -> Column:
    """Every named mode's quality lies in its bounds, ends included."""
    keep = F.lit(True)
    for m in names:
        low, high = bounds[m]
        if low > high:
            raise ValueError(f"the bounds of {m} are the wrong way round")
        keep = keep & F.col(f"quality_{m}").between(low, high)
    return keep


def masked_surface(vertices: DataFrame, faces: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """Faces all of whose corners are kept, the vertices they use, both renumbered densely in vid order (after exact merging of places)."""
    kept = vertices.filter(keep)
    left = materialise(topology.faces_of_kept(faces, kept), "kept-faces")  # three things are built from it
    merged = topology.merged_points(topology.referenced(kept, left))
    left = materialise(topology.remapped(left, merged), "merged-faces")
    numbered = topology.renumbered(topology.referenced(kept, left))
    return numbered, topology.remapped(left, numbered, "vid", "new_vid")
