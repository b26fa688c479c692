"""Predicates and projections."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import json_vector

def where_equal(df: DataFrame, **values) -> DataFrame:
    """Conjunctive equality; values that are None or empty add no predicate."""
    for name, value in values.items():
        if value not in (None, ""):
            df = df.where(F.col(name) == F.lit(value))
    return df


def where_contains(df: DataFrame, **values: str) -> DataFrame:
    """Substring facets; empty ones add no predicate."""
    for name, value in values.items():
        if value:
            df = df.where(F.coalesce(F.col(name), F.lit("")).contains(value))
    return df


def where_in(df: DataFrame, name: str, values: Iterable | DataFrame) -> DataFrame:
    """Rows whose value is in a short list, or in the one column of a table, by a semi join."""
    if isinstance(values, DataFrame):
        return df.join(values.select(F.col(values.columns[0]).alias(name)), name, "left_semi")
    return df.where(F.col(name).isin(list(values)))


def after(df: DataFrame, name: str, since) -> DataFrame:
    """Strictly after a cursor; no cursor, no predicate."""
    return df if since in (None, "") else df.where(F.col(name) > F.lit(since))


def without(df: DataFrame, other: DataFrame, *keys: str) -> DataFrame:
    return df.join(other.select(*keys), list(keys), "left_anti")


def public(df: DataFrame) -> DataFrame:
    """Without the columns whose names start with an underscore."""
    return df.select(*[c for c in df.columns if not c.startswith("_")])


def by_key(df: DataFrame, **key) -> DataFrame:
    return where_equal(df, **key).limit(1)


def row_holds(marker: str) -> Column:
    """Whether the row as JSON holds the marker."""
    return F.to_json(F.struct("*")).contains(marker)


def sound_vectors(df: DataFrame, name: str = "embedding") -> DataFrame:
    """Rows with a vector that is given and not empty. Vectors kept as JSON text become arrays; malformed ones go."""
    if dict(df.dtypes)[name] == "string":
        df = df.withColumn(name, json_vector(F.col(name)))
    return df.where(F.col(name).isNotNull() & (F.size(name) > 0))


def kept_frames(df: DataFrame, status: str = "novelty_status") -> DataFrame:
    """Frames that are neither invalid nor duplicates; one without a status is kept."""
    return df.where(~F.coalesce(F.col(status).isin("invalid", "duplicate"), F.lit(False)))


def review_queue(df: DataFrame, now: Column, *, due_only: bool = True, q: str = "", fields: Iterable[str] = ("title", "question_text"), page_size: int = 20) -> DataFrame:
    """The first page of items to review, by status, review state, time and id; ``q`` is looked for in some text columns."""
    if due_only:
        df = df.where(due(F.col("next_review_at"), now))
    if q:
        df = df.where(F.concat_ws("\n", *[F.coalesce(F.col(f), F.lit("")) for f in fields]).contains(q))
    return df.orderBy("status", "review_state", F.col("next_review_at").asc_nulls_first(), "id").limit(page_size)


def due(next_review_at: Column, now: Column) -> Column:
    """Own rule, as the original is not public: due once the time has come, and where no time is set."""
    return next_review_at.isNull() | (next_review_at <= now)
