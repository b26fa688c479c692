"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only where it is unset, as in tests on one machine, a temporary folder is made and set for the session; on a cluster that
    is an error, as executors do not share it.
    """
    found = spark.conf.get("spark.checkpoint.dir", "")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Whether Spark deletes what a query shuffled as soon as the query has ended, and not when the driver next collects garbage.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The tables that ``written`` made, by application.
MADE: dict[str, list[str]] = {}


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: lineage ends there, and lost executors lose nothing.

    What was shuffled on the way is deleted at once, so a chain of such tables needs the disk of its largest step.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    was = spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN, was)
    out = spark.read.schema(df.schema).parquet(path)
    out.lodestone_path = path
    return out


def forget_written(spark: SparkSession) -> int:
    """Deletes the tables that ``written`` made for this application; how many there were.

    For long sessions, between jobs: results that are still to be read from such tables must have been written elsewhere.
    """
    return forget_paths(spark, MADE.pop(spark.sparkContext.applicationId, []))


def made_so_far(spark: SparkSession) -> list[str]:
    """Where the tables are that ``written`` made for this application."""
    return list(MADE.get(spark.sparkContext.applicationId, []))


def forget_paths(spark: SparkSession, paths: list[str]) -> int:
    """Deletes some of the tables that ``written`` made; how many."""
    mine = MADE.get(spark.sparkContext.applicationId, [])
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        if path in mine:
            mine.remove(path)
    return len(paths)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores where it comes in fewer pieces than there are, as from a file of one row group."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
