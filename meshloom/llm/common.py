"""What every operator needs: reading tables, the shared folder, materialising a table, a checked broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share; it goes when the driver's JVM ends.

    Only where the session names none and all tasks run in this process (tests, a laptop) a local temporary folder is set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: lineage is cut and a lost executor costs no rework."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_only(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and the named columns; whatever else ``docs`` carries is left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *(F.col(c).cast("string").alias(c) for c in more))


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def row_hash(*columns: str) -> Column:
    """A hash of the columns as strings, a null apart from an empty string."""
    return F.xxhash64(*(x for c in columns for x in (F.col(c).isNull(), F.coalesce(F.col(c).cast("string"), F.lit("")))))


def met(docs: DataFrame, other: DataFrame, hashed: Column, how: str) -> DataFrame:
    """Rows of ``docs`` as a column ``row`` beside those of ``other`` (doc_id, row_hash and more) with their doc_id (null equals null) and hash.

    The row is one struct, so no column of ``docs`` clashes with one made here.
    """
    keys = [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none")]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *keys, hashed.alias("hash"))
    more = [c for c in other.columns if c not in ("doc_id", "row_hash")]
    return rows.join(other.select(*keys, F.col("row_hash").alias("hash"), *more), ["id", "none", "hash"], how)


def without(docs: DataFrame, gone: DataFrame, hashed: Column) -> DataFrame:
    """``docs`` without the rows whose doc_id and hash are in ``gone`` (doc_id, row_hash)."""
    return met(docs, gone.select("doc_id", "row_hash").distinct(), hashed, "left_anti").select("row.*")


def salted(params: DataFrame, salts: int) -> DataFrame:
    """Each row once for each salt, so that the rows of one hot key meet it in ``salts`` tasks."""
    return params.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def salt_of(column: str, salts: int):
    return F.pmod(F.xxhash64(column), F.lit(salts)).cast("int")
