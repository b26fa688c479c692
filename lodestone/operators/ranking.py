"""Top-k, paging, order and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clamp(n: int, low: int, high: int) -> int:
    return max(low, min(n, high))


def top(df: DataFrame, k: int, *order: Column, most: int = 50) -> DataFrame:
    return df.orderBy(*order).limit(clamp(k, 1, most))


def top_by(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of each group with ``rank``; the window limits groups before they are shuffled."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """A page (from 1) of an order, with ``total, has_prev, has_next, first, last``.

    Only the pages up to the one asked for are kept sorted; the total is a count of its own.
    """
    size, number = max(1, size), max(1, number)
    rows = df.orderBy(*order).offset((number - 1) * size).limit(size)
    total = df.agg(F.count("*").alias("total"))
    out = rows.join(F.broadcast(total))
    first = F.lit((number - 1) * size + 1).cast("long")
    return out.select("*", F.lit(number > 1).alias("has_prev"), (F.col("total") > number * size).alias("has_next"), first.alias("first"), F.least(F.lit(number * size).cast("long"), "total").alias("last"))


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key: the first of the order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def last_lines(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """The last ``n`` rows by the keys, in ascending order."""
    return df.orderBy(*[F.desc(k) for k in keys]).limit(n).orderBy(*keys)


def victims(df: DataFrame, keys: list[str], cap: int, *least_first: Column) -> DataFrame:
    """Rows beyond the cap of each group: as many as it has too many, the least valuable."""
    own = Window.partitionBy(*keys)
    out = df.withColumn("_n", F.row_number().over(own.orderBy(*least_first))).withColumn("_total", F.count("*").over(own))
    return out.where(F.col("_n") <= F.col("_total") - cap).drop("_n", "_total")


def reading_order(df: DataFrame, page_keys: list[str], y: str = "y", x: str = "x", gap: float = 0.04) -> DataFrame:
    """``index`` from 1: rows of the page by bands of y, then x. A new band starts where y is over ``gap`` below the last row."""
    down = Window.partitionBy(*page_keys).orderBy(y, x)
    banded = df.withColumn("_new", (F.col(y) - F.lag(y).over(down) > gap).cast("int")).withColumn("_band", F.sum(F.coalesce("_new", F.lit(0))).over(down))
    return banded.withColumn("index", F.row_number().over(Window.partitionBy(*page_keys).orderBy("_band", x, y))).drop("_new", "_band")
