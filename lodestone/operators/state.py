"""Changes of keyed tables as new tables: upserts, soft deletes, counters, backfills and pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import missing
from lodestone.operators.ranking import victims


def upsert(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``new`` replace rows with the same key, and others are added; ``new`` has one row for a key."""
    there = F.col("_there").isNotNull()
    marked = old.alias("o").join(new.withColumn("_there", F.lit(True)).alias("n"), list(keys), "full")
    rest = [c for c in old.columns if c not in keys]
    return marked.select(*keys, *[F.when(there, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in rest])


def unique(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key, the first of the order: what a unique key keeps."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def set_status(df: DataFrame, ids: DataFrame | list, status: str, id_col: str = "id", now: Column | None = None) -> DataFrame:
    """Soft delete (``superseded``) or restore (``active``) of some ids; no other status is taken."""
    if status not in ("active", "superseded"):
        raise ValueError(status)
    hit = flagged(df, ids, id_col)
    out = hit.withColumn("status", F.when(F.col("_hit"), F.lit(status)).otherwise(F.col("status")))
    if now is not None:
        out = out.withColumn("updated_at", F.when(F.col("_hit"), now).otherwise(F.col("updated_at")))
    return out.drop("_hit")


def flagged(df: DataFrame, ids: DataFrame | list, id_col: str = "id") -> DataFrame:
    """``_hit``: whether a row's id is among some."""
    if not isinstance(ids, DataFrame):
        return df.withColumn("_hit", F.col(id_col).isin(list(ids)))
    some = ids.select(F.col(ids.columns[0]).alias(id_col)).distinct().withColumn("_hit", F.lit(True))
    return df.join(some, id_col, "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))


def mark_seen(deltas: DataFrame, ids: DataFrame | list) -> DataFrame:
    return flagged(deltas, ids).withColumn("seen", F.col("seen") | F.col("_hit")).drop("_hit")


def count_uses(df: DataFrame, ids: DataFrame | list, now: Column, id_col: str = "id") -> DataFrame:
    out = flagged(df, ids, id_col)
    return out.withColumn("use_count", F.col("use_count") + F.col("_hit").cast("long")).withColumn("last_used_at", F.when(F.col("_hit"), now).otherwise(F.col("last_used_at"))).drop("_hit")


def replace_text(df: DataFrame, corrections: DataFrame, now: Column) -> DataFrame:
    """Corrected text and its vector, at once: ``corrections`` has ``id, text, embedding``."""
    c = corrections.select("id", F.col("text").alias("_text"), F.col("embedding").alias("_embedding"))
    hit = F.col("_text").isNotNull()
    out = df.join(c, "id", "left")
    for name in ("text", "embedding"):
        out = out.withColumn(name, F.when(hit, F.col(f"_{name}")).otherwise(F.col(name)))
    return out.withColumn("updated_at", F.when(hit, now).otherwise(F.col("updated_at"))).drop("_text", "_embedding")


def backfill(df: DataFrame, name: str, default: str) -> DataFrame:
    """Null and empty become the default."""
    return df.withColumn(name, F.coalesce(missing(F.col(name)), F.lit(default)))


def settle(df: DataFrame) -> DataFrame:
    """Lifecycle: ``resolved`` is ``mastered``; what is mastered or ignored has no next review."""
    status = F.when(F.col("status") == "resolved", "mastered").otherwise(F.col("status"))
    return df.withColumn("status", status).withColumn("next_review_at", F.when(~F.col("status").isin("mastered", "ignored"), F.col("next_review_at")))


def prune(df: DataFrame, account: str = "account_id", cap: int = 400) -> DataFrame:
    """Beyond the cap the active rows of least importance, then least used, then oldest, become superseded."""
    gone = victims(df.where("status = 'active'"), [account], cap, F.col("importance"), F.col("use_count"), F.col("updated_at"), F.col("id")).select("id")
    return set_status(df, gone, "superseded")


def delete(df: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    return df.join(ids.select(F.col(ids.columns[0]).alias(id_col)), id_col, "left_anti")


def review_event(mistakes: DataFrame, events: DataFrame) -> DataFrame:
    """Actions on mistakes set status and review state: ``events`` has ``id, action``, one for an id."""
    from lodestone.functions.labels import ACTIONS, coded

    e = events.select("id", F.col("action").alias("_action"))
    out = mistakes.join(e, "id", "left")
    status = coded(F.col("_action"), {k: v[0] for k, v in ACTIONS.items()}, F.col("status"))
    state = coded(F.col("_action"), {k: v[1] for k, v in ACTIONS.items()}, F.col("review_state"))
    return out.withColumn("status", status).withColumn("review_state", state).drop("_action")
