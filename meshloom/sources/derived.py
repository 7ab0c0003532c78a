"""Meshes derived from the given tables.

``tube`` is an open limb from ``embeddings``: rings of 20 vertices, two boundary loops. ``soup`` is a bag of triangles over
the tube's vertices from ``lineitem``: degenerate, repeated and non-manifold faces, as scans have them. ``colours`` and
``samples`` are per-row attributes from ``lineitem``. Tables are vertices (vid, x, y, z) and faces (fid, a, b, c).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RING = 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tube_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vid, x, y, z and mesh_id (the label of the vector)."""
    e = read(spark, sf_dir, "embeddings")
    angle = 2 * F.pi() * F.pmod("vec_id", F.lit(RING)) / F.lit(float(RING))
    radius = 1 + 0.5 * F.col("embedding")[0].cast("double")
    return e.select(
        F.col("vec_id").alias("vid"),
        (radius * F.cos(angle)).alias("x"),
        (radius * F.sin(angle)).alias("y"),
        (0.3 * F.floor(F.col("vec_id") / RING) + 0.1 * F.col("embedding")[1].cast("double")).alias("z"),
    )


def tube_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fid, a, b, c: two triangles for each cell between two rings."""
    e = read(spark, sf_dir, "embeddings")
    n = e.agg(F.count("*").alias("n"))
    p00 = F.col("vec_id")
    p01 = F.floor(p00 / RING) * RING + F.pmod(p00 + 1, F.lit(RING))
    cells = e.join(F.broadcast(n)).filter(p00 + RING < F.col("n")).select(p00.alias("p00"), p01.alias("p01"))
    faces = F.array(
        F.struct((2 * F.col("p00")).alias("fid"), F.col("p00").alias("a"), F.col("p01").alias("b"), (F.col("p00") + RING).alias("c")),
        F.struct((2 * F.col("p00") + 1).alias("fid"), F.col("p01").alias("a"), (F.col("p01") + RING).alias("b"), (F.col("p00") + RING).alias("c")),
    )
    return cells.select(F.inline(faces))


def soup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a, b, c of a bag of faces over the tube's vertices."""
    n = read(spark, sf_dir, "embeddings").agg(F.count("*").alias("n"))
    rows = read(spark, sf_dir, "lineitem").join(F.broadcast(n))
    return rows.select((F.col("l_partkey") % F.col("n")).alias("a"), (F.col("l_suppkey") % F.col("n")).alias("b"), (F.col("l_orderkey") % F.col("n")).alias("c"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sid (not unique), t in [0, 1] and a colour (r, g, b, alpha in [0, 1]) of each row of ``lineitem``."""
    rows = read(spark, sf_dir, "lineitem")
    return rows.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("sid"), (F.col("l_quantity") / 50.0).alias("t"), (F.col("l_tax") * 12.5).alias("r"), (F.col("l_discount") * 10.0).alias("g"), (F.col("l_quantity") / 50.0).alias("b"), F.lit(1.0).alias("alpha"))


#: The same meshes for DuckDB, as common table expressions.
SQL = f"""
n AS (SELECT count(*) AS n FROM embeddings),
v AS (SELECT vec_id AS vid,
        (1 + 0.5 * embedding[1]::DOUBLE) * cos(2 * pi() * (vec_id % {RING}) / {RING}.0::DOUBLE) AS x,
        (1 + 0.5 * embedding[1]::DOUBLE) * sin(2 * pi() * (vec_id % {RING}) / {RING}.0::DOUBLE) AS y,
        0.3::DOUBLE * (vec_id // {RING}) + 0.1::DOUBLE * embedding[2]::DOUBLE AS z FROM embeddings),
cell AS (SELECT vec_id AS p00, (vec_id // {RING}) * {RING} + (vec_id + 1) % {RING} AS p01 FROM embeddings, n WHERE vec_id + {RING} < n),
f AS (SELECT 2 * p00 AS fid, p00 AS a, p01 AS b, p00 + {RING} AS c FROM cell
      UNION ALL SELECT 2 * p00 + 1, p01, p01 + {RING}, p00 + {RING} FROM cell),
soup AS (SELECT l_partkey % n AS a, l_suppkey % n AS b, l_orderkey % n AS c FROM lineitem, n),
samples AS (SELECT l_orderkey * 8 + l_linenumber AS sid, l_quantity / 50.0::DOUBLE AS t, l_tax * 12.5::DOUBLE AS r, l_discount * 10.0::DOUBLE AS g,
                   l_quantity / 50.0::DOUBLE AS b, 1.0::DOUBLE AS alpha FROM lineitem),
p AS (SELECT f.fid, f.a, f.b, f.c, va.x AS ax, va.y AS ay, va.z AS az, vb.x AS bx, vb.y AS by_, vb.z AS bz, vc.x AS cx, vc.y AS cy, vc.z AS cz
      FROM f JOIN v va ON va.vid = f.a JOIN v vb ON vb.vid = f.b JOIN v vc ON vc.vid = f.c),
edge AS (SELECT least(u, w) AS u, greatest(u, w) AS w, count(*) AS inc
         FROM (SELECT a AS u, b AS w FROM f UNION ALL SELECT b, c FROM f UNION ALL SELECT c, a FROM f) GROUP BY ALL),
len AS (SELECT edge.u, edge.w, edge.inc, sqrt((p.x-q.x)*(p.x-q.x) + (p.y-q.y)*(p.y-q.y) + (p.z-q.z)*(p.z-q.z)) AS len
        FROM edge JOIN v p ON p.vid = edge.u JOIN v q ON q.vid = edge.w)"""
