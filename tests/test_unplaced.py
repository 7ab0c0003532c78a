"""A tube whose last ring is not whole has one face that names a vertex without a place; queries say of it what their SQL says."""

import math

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from meshloom.operators import planes
from meshloom.sources import ply

GIVEN = "/root/testdata/sf0.001"
#: Rows of a tube of 22 rings and 16 vertices of the next.
N = 456


@pytest.fixture(scope="module")
def cut_short(tmp_path_factory):
    path = tmp_path_factory.mktemp("tube")
    rows = pq.read_table(f"{GIVEN}/embeddings.parquet")
    pq.write_table(rows.slice(0, N), path / "embeddings.parquet")
    pq.write_table(pq.read_table(f"{GIVEN}/lineitem.parquet"), path / "lineitem.parquet")
    return str(path)


def by_sql(path, name):
    with duckdb.connect() as c:
        for table in ("embeddings", "lineitem"):
            c.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}/{table}.parquet')")
        found = c.execute(entry.oracle_sql()[name])
        return [x[0] for x in found.description], sorted(found.fetchall())


@pytest.mark.parametrize("name", ["obj_faces", "mesh_contract", "smooth_uniform", "stl_roundtrip", "stl_welded", "subdivision_faces", "hole_fillings", "closed_holes", "load_surface"])
def test_equals_its_sql(spark, cut_short, name):
    columns, want = by_sql(cut_short, name)
    assert sorted(tuple(r) for r in entry.queries()[name](spark, cut_short).select(*columns).collect()) == want


def test_exported_qualities_keep_their_digits(spark, tmp_path):
    """Nine digits make 12.18115 of the first, which rounds up."""
    values = [12.181149953976274, 0.1, 3.0]
    v = spark.createDataFrame([(i, 0.0, 0.0, 0.0, x, x, x) for i, x in enumerate(values)], "vid long, x double, y double, z double, mine double, quality_longitudinal double, quality_transverse double")
    f = spark.createDataFrame([(0, 0, 1, 2)], "fid long, a long, b long, c long")
    back = ply.read_ply(spark, ply.export_mesh(v, f, f"{tmp_path}/a.ply", "mine"))[0]
    assert [r[0] for r in back.orderBy("vid").select(F.col("quality")).collect()] == values


def test_quality_of_a_mesh_within_its_band(spark):
    v = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, -1.0)], "vid long, x double, y double, z double")
    f = spark.createDataFrame([(0, 0, 1, 2)], "fid long, a long, b long, c long")
    plane = spark.createDataFrame([(0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 9.0)], ", ".join(f"{k} double" for k in ("mx", "my", "mz", "cx", "cy", "cz", "ep")))
    assert [r["quality"] for r in planes.quality(v, f, plane).collect()] == [0.0] * 3
    q = planes.quality(v, f, plane, flat=float("nan")).withColumn("quality_transverse", F.col("quality"))
    assert all(math.isnan(r["quality"]) for r in q.collect()) and q.filter(planes.within_bounds(["transverse"])).isEmpty()
