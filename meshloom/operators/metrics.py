"""Bounds, areas, volumes, moments and the matrices of a mesh as aggregations."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshloom.functions import vec3
from meshloom.operators.topology import corner, corner_rows, with_corners


def bounds(vertices: DataFrame) -> DataFrame:
    """A1: least and most of each axis, the diagonal and the centre of the box."""
    b = vertices.agg(*(F.min(k).alias(f"min_{k}") for k in "xyz"), *(F.max(k).alias(f"max_{k}") for k in "xyz"))
    extent = tuple(F.col(f"max_{k}") - F.col(f"min_{k}") for k in "xyz")
    return b.select("*", vec3.norm(extent).alias("diag"), *(((F.col(f"min_{k}") + F.col(f"max_{k}")) / 2).alias(f"centre_{k}") for k in "xyz"))


def with_area(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Faces with corners and area."""
    p = with_corners(faces, vertices)
    n = vec3.cross(vec3.sub(corner("b"), corner("a")), vec3.sub(corner("c"), corner("a")))
    return p.withColumn("area", vec3.norm(n) / 2)


def volume_about(faces: DataFrame, vertices: DataFrame, reference: DataFrame) -> DataFrame:
    """A5: signed volume and volume centroid of tetrahedra about a reference point (one row: rx, ry, rz)."""
    p = with_corners(faces, vertices).join(F.broadcast(reference))
    r = tuple(F.col(f"r{k}") for k in "xyz")
    a, b, c = (vec3.sub(corner(k), r) for k in "abc")
    v = vec3.dot(a, vec3.cross(b, c)) / 6
    mid = vec3.add(r, vec3.scale(vec3.add(vec3.add(a, b), c), 0.25))
    sums = p.select(v.alias("v"), *((v * m).alias(f"v{k}") for k, m in zip("xyz", mid, strict=True))).agg(F.sum("v").alias("volume"), *(F.sum(f"v{k}").alias(f"s{k}") for k in "xyz"))
    safe = F.when(F.abs("volume") <= 1e-8, F.raise_error(F.lit("the volume is about zero: the mesh may be open")).cast("double")).otherwise(F.col("volume"))
    return sums.select("volume", *((F.col(f"s{k}") / safe).alias(f"centroid_{k}") for k in "xyz"))


def normalised01(rows: DataFrame, value: str, out: str, flat: float = 0.0) -> DataFrame:
    """(value - least) / range, ``flat`` where the range is below 1e-12."""
    ends = rows.agg(F.min(value).alias("__low"), F.max(value).alias("__high"))
    span = F.col("__high") - F.col("__low")
    return rows.join(F.broadcast(ends)).withColumn(out, F.when(span < 1e-12, F.lit(flat)).otherwise((F.col(value) - F.col("__low")) / F.nullif(span, F.lit(0.0)))).drop("__low", "__high")


def covariance(vertices: DataFrame, centre: DataFrame) -> DataFrame:
    """The six second moments about a given centre (one row: rx, ry, rz)."""
    d = {k: F.col(k) - F.col(f"r{k}") for k in "xyz"}
    rows = vertices.join(F.broadcast(centre)).select(*(d[k].alias(f"d{k}") for k in "xyz"))
    pairs = ("xx", "xy", "xz", "yy", "yz", "zz")
    return rows.agg(*((F.sum(F.col(f"d{i}") * F.col(f"d{j}")) / F.greatest(F.count("*"), F.lit(1))).alias(f"c{i}{j}") for i, j in pairs))


def principal_axes(moments: DataFrame) -> DataFrame:
    """The eigenvalues (descending) and unit axes of covariance rows; the largest component of an axis is positive."""

    def solve(frames):
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                values, axes = np.linalg.eigh(np.array([[r.cxx, r.cxy, r.cxz], [r.cxy, r.cyy, r.cyz], [r.cxz, r.cyz, r.czz]]))
                row = {}
                for k, i in enumerate((2, 1, 0)):
                    axis = axes[:, i] * np.sign(axes[np.abs(axes[:, i]).argmax(), i])
                    row |= {f"e{k}": values[i]} | {f"u{k}{x}": v for x, v in zip("xyz", axis, strict=True)}
                out.append(row)
            yield pd.DataFrame(out, columns=_AXES)

    return moments.mapInPandas(solve, ", ".join(f"{c} double" for c in _AXES))


_AXES = [c for k in range(3) for c in (f"e{k}", f"u{k}x", f"u{k}y", f"u{k}z")]


def lumped_mass(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """A third of the area of its faces for each vertex, at least 1e-18."""
    shares = corner_rows(with_area(faces, vertices), "area").groupBy("vid").agg((F.sum("area") / 3).alias("m"))
    return vertices.select("vid").join(shares, "vid", "left").select("vid", F.greatest(F.coalesce("m", F.lit(0.0)), F.lit(1e-18)).alias("mass"))


def cotan_laplacian(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """I, j, val of the cotangent Laplacian: half the cotangent at a corner weighs the opposite side; entries of one place are summed."""
    p = with_corners(faces, vertices)
    entries = []
    for k, i, j in (("a", "b", "c"), ("b", "c", "a"), ("c", "a", "b")):
        to_i, to_j = vec3.sub(corner(i), corner(k)), vec3.sub(corner(j), corner(k))
        w = vec3.dot(to_i, to_j) / F.greatest(vec3.norm(vec3.cross(to_i, to_j)), F.lit(1e-18)) / 2
        for r, c, sign in ((i, j, -1), (j, i, -1), (i, i, 1), (j, j, 1)):
            entries.append(F.struct(F.col(r).alias("i"), F.col(c).alias("j"), (sign * w).alias("val")))
    return p.select(F.inline(F.array(*entries))).groupBy("i", "j").agg(F.sum("val").alias("val"))


def face_tangents(faces: DataFrame, vertices: DataFrame, factor: float = 1.0) -> DataFrame:
    """P25: from each face's centroid a segment along its first side that is longer than 1e-12 (of the two at corner a); faces without one are dropped."""
    p = with_corners(faces, vertices)
    n = faces.agg(F.count("*").alias("n"))
    one, two = vec3.sub(corner("b"), corner("a")), vec3.sub(corner("c"), corner("a"))
    first = vec3.norm(one) > 1e-12
    e = tuple(F.when(first, s).otherwise(t) for s, t in zip(one, two, strict=True))
    mid = vec3.scale(vec3.add(vec3.add(corner("a"), corner("b")), corner("c")), F.lit(1 / 3))
    clip = F.least(F.greatest(F.pow(F.lit(1000.0) / F.col("n"), F.lit(1 / 3)), F.lit(0.15)), F.lit(2.0))
    rows = p.select("fid", *(v.alias(f"m{k}") for k, v in zip("xyz", mid, strict=True)), *(v.alias(f"e{k}") for k, v in zip("xyz", e, strict=True)), vec3.norm(e).alias("l")).filter("l > 1e-12")
    size = F.col("diag") * 0.05 * clip * factor
    rows = rows.join(F.broadcast(bounds(vertices).select("diag"))).join(F.broadcast(n))
    return rows.select("fid", *(F.col(f"m{k}").alias(f"from_{k}") for k in "xyz"), *((F.col(f"m{k}") + F.col(f"e{k}") / F.col("l") * size).alias(f"to_{k}") for k in "xyz"))


def smoothstep(low: float, high: float, x: Column) -> Column:
    """P10."""
    if high <= low:
        return F.when(x >= high, 1.0).otherwise(0.0)
    t = F.least(F.greatest((x - low) / (high - low), F.lit(0.0)), F.lit(1.0))
    return t * t * (3 - 2 * t)


def sample_weight(t: Column, delta: float, eps: float) -> Column:
    """0 near both ends of [0, 1], 1 between."""
    return smoothstep(delta, delta + eps, t) * smoothstep(delta, delta + eps, 1 - t)


def poisson_radius(w: Column, r_min: float, most: float, floor: float) -> Column:
    """P12."""
    r = r_min / F.sqrt(F.least(F.greatest(w, F.lit(floor)), F.lit(1.0)))
    return F.least(F.greatest(r, F.lit(r_min)), F.lit(r_min * most))


def scale_factor(mesh_distance: float, actual_distance: float) -> float:
    """Actual over mesh distance; both have to be finite and above zero."""
    for name, x in (("mesh", mesh_distance), ("actual", actual_distance)):
        if not (math.isfinite(x) and x > 0):
            raise ValueError(f"the {name} distance has to be finite and above zero, not {x}")
    return actual_distance / mesh_distance


def scale_factors(mesh_distance: Column, actual_distance: Column) -> Column:
    """P3 by row; a pair that is not finite and above zero (or null) fails the query."""
    fine = lambda x: (x > 0) & (x < float("inf")) & ~F.isnan(x)
    ok = F.coalesce(fine(mesh_distance.cast("double")) & fine(actual_distance.cast("double")), F.lit(False))
    return F.when(ok, actual_distance / mesh_distance).otherwise(F.raise_error(F.lit("distances have to be finite and above zero")).cast("double"))


def scaled(vertices: DataFrame, factor: float) -> DataFrame:
    """``vertices`` with x, y, z times a factor (finite, above zero), in single precision; other columns stay."""
    if not (math.isfinite(factor) and factor > 0):
        raise ValueError(f"the factor has to be finite and above zero, not {factor}")
    return vertices.withColumns({k: (F.col(k).cast("float").cast("double") * factor).cast("float") for k in "xyz"})


def vertex_normals(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """vid and nx, ny, nz: the unit sum of the area-weighted normals of a vertex's faces (zero where they cancel)."""
    p = with_corners(faces, vertices)
    n = vec3.cross(vec3.sub(corner("b"), corner("a")), vec3.sub(corner("c"), corner("a")))
    sums = corner_rows(p.select("fid", "a", "b", "c", *(c.alias(f"s{k}") for k, c in zip("xyz", n, strict=True))), "sx", "sy", "sz").groupBy("vid").agg(*(F.sum(f"s{k}").alias(f"s{k}") for k in "xyz"))
    length = vec3.norm(vec3.vec("s"))
    return sums.select("vid", *(F.when(length > 0, F.col(f"s{k}") / F.nullif(length, F.lit(0.0))).otherwise(0.0).alias(f"n{k}") for k in "xyz"))


def rank_before(rows: DataFrame, value: str, key: str) -> DataFrame:
    """The running total of ``value`` in key order over a table dealt in blocks of keys."""
    blocks = rows.withColumn("__block", F.floor(F.col(key) / (1 << 16)))
    totals = blocks.groupBy("__block").agg(F.sum(value).alias("__sum"))
    shift = totals.select("__block", F.coalesce(F.sum("__sum").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("__before"))
    own = F.sum(value).over(Window.partitionBy("__block").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return blocks.withColumn("__own", own).join(shift, "__block").withColumn("upto", F.col("__before") + F.col("__own")).drop("__block", "__own", "__before")
