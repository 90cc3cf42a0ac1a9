"""Trajectories, nodes, instances, caches, messages and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointlake.functions.geometry import axes_changed, from_euler

TUM = "ts double, x double, y double, z double, qx double, qy double, qz double, qw double"
NAMES = [f"t{i}{j}" for i in range(3) for j in range(4)]


def read_tum(spark: SparkSession, path: str) -> DataFrame:
    """S19."""
    return spark.read.schema(TUM).option("sep", " ").option("comment", "#").csv(path)


def write_tum(df: DataFrame, path: str, digits: int = 6) -> None:
    """Fixed precision."""
    cols = [c.split()[0] for c in TUM.split(", ")]
    df.select(F.concat_ws(" ", *[F.format_string(f"%.{digits}f", F.col(c)) for c in cols]).alias("value")).write.mode("overwrite").text(path)


def read_kitti(spark: SparkSession, path: str) -> DataFrame:
    """12 numbers a line; the row number is that within the file (one file is one trajectory)."""
    lines = spark.read.text(path, wholetext=True)
    rows = lines.select(F.posexplode(F.split(F.regexp_replace("value", r"\s+$", ""), "\n")).alias("row", "line"))
    v = F.transform(F.split(F.trim("line"), r"\s+"), lambda s: s.cast("double"))
    return rows.select("row", v.alias("v")).select("row", *[F.col("v")[i].alias(n) for i, n in enumerate(NAMES)])


def read_kitti_axes(spark: SparkSession, path: str, g: list[float]) -> DataFrame:
    """S20 with an axis change applied."""
    df = read_kitti(spark, path)
    return df.select("row", *[c.alias(n) for c, n in zip(axes_changed([F.col(n) for n in NAMES], g), NAMES)])


def write_kitti(df: DataFrame, path: str, digits: int = 9) -> None:
    """In row order."""
    df.orderBy("row").select(F.concat_ws(" ", *[F.format_string(f"%.{digits}f", F.col(n)) for n in NAMES]).alias("value")).write.mode("overwrite").text(path)


def read_relative_odometry(spark: SparkSession, path: str) -> DataFrame:
    """The steps as transforms, ready for the running product."""
    schema = "src string, dst string, dx double, dy double, dz double, droll double, dpitch double, dyaw double"
    df = spark.read.schema(schema).option("header", True).csv(path)
    t = from_euler(*[F.col(c) for c in ("dx", "dy", "dz", "droll", "dpitch", "dyaw")], lib=F)
    return df.select("src", "dst", *[F.lit(v).cast("double").alias(n) if not isinstance(v, Column) else v.alias(n) for v, n in zip(t, NAMES)])


def read_gps(spark: SparkSession, path: str) -> DataFrame:
    """S25."""
    return spark.read.schema("ts long, latitude double, longitude double, altitude double").option("header", True).csv(path)


def read_ins(spark: SparkSession, path: str, offset: tuple = (0.0, 0.0, 0.0)) -> DataFrame:
    """Time first, position in columns 5-7, angles last; positions less a fixed offset."""
    df = spark.read.option("header", True).csv(path)
    c = df.columns
    pos = [(F.col(f"`{c[5 + i]}`").cast("double") - offset[i]).alias(n) for i, n in enumerate("xyz")]
    return df.select(F.col(f"`{c[0]}`").cast("long").alias("ts"), *pos, *[F.col(f"`{c[i - 3]}`").cast("double").alias(n) for i, n in enumerate(("roll", "pitch", "yaw"))])


def read_tracklets(spark: SparkSession, path: str, row_tag: str = "item") -> DataFrame:
    """Nested boxes."""
    return spark.read.format("xml").option("rowTag", row_tag).load(path)


def topic(messages: DataFrame, name: str) -> DataFrame:
    """One topic's rows in time order; with the table partitioned by topic this prunes partitions."""
    return messages.where(F.col("topic") == name).orderBy("stamp")


def topic_counts(messages: DataFrame) -> DataFrame:
    """S15."""
    return messages.groupBy("topic").agg(F.count("*").alias("n"))


def nth_message(messages: DataFrame, name: str, n: int) -> DataFrame:
    """The n-th message of a topic from 0: the n + 1 first rows are kept by each task, no whole sort."""
    return messages.where(F.col("topic") == name).orderBy("stamp").offset(n).limit(1)


def write_topics(streams: dict[str, DataFrame], path: str) -> None:
    """Typed streams into one table partitioned by topic."""
    out = None
    for name, df in streams.items():
        df = df.withColumn("topic", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    out.write.mode("overwrite").partitionBy("topic").parquet(path)


NODE = "id long, x double, y double, z double, flag int, point_num long, cloud_path string, sc array<array<double>>, ts double"


def write_nodes(df: DataFrame, path: str) -> None:
    """S27."""
    df.write.mode("overwrite").parquet(path)


def read_nodes(spark: SparkSession, path: str, pose_only: bool = False, first: int | None = None) -> DataFrame:
    """Nodes; pose_only reads no descriptor; first: the smallest ids."""
    df = spark.read.schema(NODE).parquet(path)
    df = df.select("id", "x", "y", "z") if pose_only else df
    return df.orderBy("id").limit(first) if first is not None else df


def write_instances(df: DataFrame, path: str) -> None:
    """Nested hull and points."""
    df.write.mode("overwrite").parquet(path)


def read_instances(spark: SparkSession, path: str) -> DataFrame:
    """Instances with a hull of three points at least."""
    return spark.read.parquet(path).where(F.size("hull") >= 3)


def stage_cache(spark: SparkSession, path: str, compute) -> DataFrame:
    """The table at path, computed and written if it isn't there. Existence is asked of the path's own store."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def class_list(spark: SparkSession, text: str) -> DataFrame:
    """`labels` and the comma list `interest` of a small YAML text -> (label, name, wanted)."""
    names, wanted, inside = {}, set(), False
    for line in text.splitlines():
        key, _, value = line.partition(":")
        if not line.startswith((" ", "\t")):
            inside = key.strip() == "labels"
            if key.strip() == "interest":
                wanted = {int(v) for v in value.strip().strip("[]\"'").split(",") if v.strip()}
        elif inside and key.strip().isdigit():
            names[int(key)] = value.strip().strip("\"'")
    return spark.createDataFrame([(k, v, k in wanted) for k, v in sorted(names.items())] or [], "label int, name string, wanted boolean")


def read_samples(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """Training vectors of `dim` float64 after a header of two int32 (size, dimension)."""
    import numpy as np
    import pandas as pd

    def run(batches):
        for pdf in batches:
            for content in pdf["content"]:
                yield pd.DataFrame({"v": list(np.frombuffer(content[8:], "<f8").reshape(-1, dim).astype(float))})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "v array<double>")


def write_report(metrics: DataFrame, pairs: DataFrame, path: str) -> None:
    """Metrics and the judged pairs, two tables."""
    metrics.write.mode("overwrite").parquet(f"{path}/metrics")
    pairs.write.mode("overwrite").parquet(f"{path}/pairs")


def monotone_fixes(fixes: DataFrame, first: float, last: float, key: list[str], least: float = 10_000.0) -> DataFrame:
    """S46 (Q30): fixes of [first, last + 1] whose time is later than all before it."""
    w = Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    ok = fixes.where(F.col("t") >= least).withColumn("_m", F.max("t").over(w))
    return ok.where((F.col("_m").isNull() | (F.col("t") > F.col("_m"))) & F.col("t").between(first, last + 1)).drop("_m")
