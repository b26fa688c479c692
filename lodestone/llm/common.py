"""What several operators share: written intermediate tables and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.shared import shared_dir, written  # noqa: F401


#: Bytes of Parquet and rows up to which a written table is broadcast: what compresses well has many rows.
SMALL, SMALL_ROWS = 8_000_000, 1_000_000


def stored(df: DataFrame):
    """The Hadoop path and file system of a table of ``written``."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.lodestone_path)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def sized(table: DataFrame) -> DataFrame:
    """A table of ``written`` to join with: broadcast if its files are small and its rows few, else left to a shuffle.

    Rows are counted from the files' footers, and only of files that are small.
    """
    path, files = stored(table)
    return F.broadcast(table) if files.getContentSummary(path).getLength() <= SMALL and table.count() <= SMALL_ROWS else table


def forget(df: DataFrame) -> None:
    """Deletes a table of ``written`` that nothing needs any more."""
    path, files = stored(df)
    files.delete(path, True)


def large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the least of its neighbourhood."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of the links (a, b): one row ``node, component`` for each node that has a link.

    ``component`` is the smallest node that can be reached. Alternating large-star and small-star rounds: each is a
    grouped minimum and an equi-join, so a node with very many neighbours is pre-aggregated and no neighbourhood is
    ever gathered. Each round is written to the shared folder; only a count and a checksum come to the driver. Links
    that are null on a side or join a node with itself are ignored.
    """
    now = written(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct(), "links")
    mark = F.struct(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    seen = now.agg(mark.alias("m")).first()["m"]
    while seen[0]:
        after = written(small_star(large_star(now)), "links")
        then = after.agg(mark.alias("m")).first()["m"]
        forget(now)
        now = after
        if then == seen:
            break
        seen = then
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
