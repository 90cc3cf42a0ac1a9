"""Inputs shared by the queries: driver tables seen as point, sensor and descriptor tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str, scale: float = 10.0) -> DataFrame:
    """embeddings as points: frame = label, pos = vec_id, x, y, z = the first three dimensions, scaled."""
    at = lambda i: (F.col("embedding")[i].cast("double") * scale)
    return read(spark, sf_dir, "embeddings").select(
        F.col("label").cast("long").alias("frame"), F.col("vec_id").alias("pos"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z")
    )


def descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as 8 x 8 descriptors, row-major doubles."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("d"))


def sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a sensor stream: key = user_id, t = seconds, r = value, order (ts, event_id)."""
    return read(spark, sf_dir, "events").select(
        "user_id", "event_id", "event_type", "ts", "value", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t")
    )


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounds, with negative zero made plain zero, so that sums in another order give the same value."""
    return F.round(c, digits) + F.lit(0.0)


def scratch(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one only in local mode where that is unset."""
    import re
    import tempfile

    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="pointlake-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root}/pointlake-{spark.sparkContext.applicationId}"


def stored(df: DataFrame) -> DataFrame:
    """Cuts lineage: the rows as a Parquet table in the scratch folder, read back with the same schema; clean() deletes all of them."""
    import uuid

    path = f"{scratch(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Deletes the scratch folder of this application, once its results are stored."""
    at = spark._jvm.org.apache.hadoop.fs.Path(scratch(spark))
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
