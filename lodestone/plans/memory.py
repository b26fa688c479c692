"""Composite queries over stored facts: retrieval, persona, turns, extraction, statistics and the restore guard.

A fact has ``id, account_id, kind, text, embedding, importance, status, use_count, updated_at``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import scoring
from lodestone.functions.text import json_array, kind, number_or, strip
from lodestone.operators.filters import sound_vectors, without
from lodestone.operators.matching import products, semantic_upsert, similar_to_some
from lodestone.operators.ranking import clamp
from lodestone.operators.state import prune

TEXT_LIMIT = 400


def scored(facts: DataFrame, query: Column, now: Column, account: str | None = None) -> DataFrame:
    """Active facts with ``semantic, recency, importance, usage, score``. The query vector is a literal: no join is needed."""
    if account is not None:
        facts = facts.where(F.col("account_id") == account)
    live = sound_vectors(facts.where("status = 'active'"))
    out = live.withColumns(
        {"semantic": scoring.clamp01(scoring.cosine(F.col("embedding"), query)), "recency": scoring.recency(scoring.age_days(F.col("updated_at"), now)), "usage": scoring.usage(F.col("use_count")), "importance": scoring.clamp01(F.coalesce("importance", F.lit(0.0)))}
    )
    return out.withColumn("score", scoring.hybrid(F.col("semantic"), F.col("recency"), F.col("importance"), F.col("usage")))


def retrieve(facts: DataFrame, query: list[float] | Column, now: Column, *, account: str | None = None, k: int = 5, min_score: float = 0.30, exclude: DataFrame | None = None) -> DataFrame:
    """The ``k`` best facts (1 to 50) from ``min_score`` on, ties by id. Exclusion comes after the cut and refills nothing.

    Scores are rounded to four places before they are compared with ``min_score`` and ordered, so what differs later ties.
    """
    vector = query if isinstance(query, Column) else F.array(*[F.lit(float(x)) for x in query])
    rounded = {c: F.round(c, 4) for c in ("score", "semantic", "recency", "importance", "usage")}
    best = scored(facts, vector, now, account).withColumns(rounded).where(F.col("score") >= min_score).orderBy(F.desc("score"), "id").limit(clamp(k, 1, 50))
    best = best if exclude is None else without(best, exclude, "id")
    return best.select("id", "kind", "text", "score", "semantic", "recency", "importance", "usage")


BLOCK_TURNS = 1024


def retrieve_turns(facts: DataFrame, turns: DataFrame, now: Column, *, k: int = 5, min_score: float = 0.30, exclude: DataFrame | None = None) -> DataFrame:
    """``retrieve`` for many turns at once: ``turn_id, rank`` and the columns of ``retrieve``.

    ``turns``: ``turn_id, account_id, query`` (a vector); each meets the active facts of its account, which are at most its
    capacity. ``exclude``: ``turn_id, id``, after the cut. Turns without a sound vector, and those of accounts without facts,
    have no rows; rows that repeat a turn are one turn if they are equal. Vectors of another length have a similarity of 0.

    An account's turns go in blocks of about ``BLOCK_TURNS``, each with the account's facts, so that an account with most turns is many
    tasks; a block's similarities are one product of matrices. Of each turn only facts that can still be among its ``k``
    best after rounding leave the block; ranks are made from those.
    """
    k = clamp(k, 1, 50)
    asked = sound_vectors(turns.select("turn_id", "account_id", F.col("query").cast("array<double>").alias("query")), "query").distinct()
    live = sound_vectors(facts.where("status = 'active'")).select(
        "account_id", "id", F.col("embedding").cast("array<double>").alias("vec"),
        scoring.hybrid(F.lit(0.0), scoring.recency(scoring.age_days(F.col("updated_at"), now)), F.col("importance"), scoring.usage(F.col("use_count"))).alias("rest"),
    )
    sizes = asked.groupBy("account_id").agg(F.ceil(F.count("*") / BLOCK_TURNS).alias("blocks"))
    asked = asked.join(sizes, "account_id").withColumn("block", F.pmod(F.xxhash64("turn_id"), "blocks")).drop("blocks")
    held = live.join(sizes, "account_id").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    kinds = dict([*turns.dtypes, *facts.dtypes])
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("turn_id", "account_id", "id")) + ", sim double"

    def near(q: pa.Table, f: pa.Table) -> pa.Table:
        if not q.num_rows or not f.num_rows:
            return pa.table({"turn_id": q["turn_id"][:0], "account_id": q["account_id"][:0], "id": f["id"][:0], "sim": pa.array([], pa.float64())})
        sim = products(q["query"], f["vec"])
        score = scoring.W_SEMANTIC * np.clip(sim, 0, 1) + f["rest"].to_numpy()
        most = min(k, f.num_rows)
        # Rounding moves a score by half a unit of the fourth place at most.
        i, j = np.nonzero(score >= np.partition(score, f.num_rows - most, axis=1)[:, [f.num_rows - most]] - 2e-4)
        turns = pa.array(i)
        return pa.table({"turn_id": q["turn_id"].take(turns), "account_id": q["account_id"].take(turns), "id": f["id"].take(pa.array(j)), "sim": pa.array(sim[i, j])})

    keys = ["account_id", "block"]
    found = asked.groupBy(keys).cogroup(held.groupBy(keys)).applyInArrow(near, schema)
    full = found.join(facts.where("status = 'active'").select("account_id", "id", "kind", "text", "importance", "use_count", "updated_at"), ["account_id", "id"])
    parts = {"semantic": scoring.clamp01(F.col("sim")), "recency": scoring.recency(scoring.age_days(F.col("updated_at"), now)), "usage": scoring.usage(F.col("use_count")), "importance": scoring.clamp01(F.coalesce("importance", F.lit(0.0)))}
    full = full.withColumns(parts).withColumn("score", scoring.hybrid(F.col("semantic"), F.col("recency"), F.col("importance"), F.col("usage")))
    rounded = full.withColumns({c: F.round(c, 4) for c in ("score", "semantic", "recency", "importance", "usage")}).where(F.col("score") >= min_score)
    best = rounded.withColumn("rank", F.row_number().over(Window.partitionBy("turn_id", "account_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    best = best if exclude is None else without(best, exclude, "turn_id", "id")
    return best.select("turn_id", "rank", "id", "kind", "text", "score", "semantic", "recency", "importance", "usage")


def persona(facts: DataFrame, account: str | None = None, n: int = 5, kinds: tuple[str, ...] = ("preference", "habit", "goal")) -> DataFrame:
    own = facts if account is None else facts.where(F.col("account_id") == account)
    return own.where((F.col("status") == "active") & F.col("kind").isin(*kinds)).orderBy(F.desc("importance"), F.desc("updated_at"), "id").limit(clamp(n, 1, 20))


def for_turn(facts: DataFrame, query, now: Column, *, account: str | None = None, n: int = 3, k: int = 5, min_score: float = 0.30, kinds: tuple[str, ...] = ("preference", "habit", "goal")) -> DataFrame:
    """The persona first, then recalled facts that are not in it: ``slot`` 0 and 1."""
    first = persona(facts, account, n, kinds).select("id", "kind", "text")
    then = without(retrieve(facts, query, now, account=account, k=k, min_score=min_score), first, "id")
    return first.withColumn("slot", F.lit(0)).unionByName(then.select("id", "kind", "text").withColumn("slot", F.lit(1)))


def candidates(replies: DataFrame, reply_col: str = "reply") -> DataFrame:
    """Facts in model replies, one row each with ``seq``: objects with 4 characters of text or more, kind and importance made sound."""
    items = replies.select("*", F.posexplode(json_array(F.col(reply_col), "text string, kind string, importance string")).alias("seq", "_item"))
    text = F.substring(strip(F.coalesce("_item.text", F.lit(""))), 1, TEXT_LIMIT)
    out = items.select("*", text.alias("text"), kind(F.col("_item.kind")).alias("kind"), number_or(F.col("_item.importance")).alias("importance"))
    return out.where(F.length("text") >= 4).drop("_item", reply_col)


def extract_and_store(facts: DataFrame, replies: DataFrame, embed: Callable[[Column], Column], *, now: Column | None = None, least: float = 0.90, cap: int = 400) -> DataFrame:
    """Facts after the replies of ``account_id, event_id, reply`` were read into them; ``embed`` makes vectors of texts.

    Items are taken by event, then by their place in the reply. Only active facts are matched; others stay as they are, with
    ``op`` keep. What is added or updated has ``updated_at`` now (by default the current time).
    """
    now = F.current_timestamp() if now is None else now
    found = candidates(replies).withColumn("id", F.concat_ws("-", "event_id", "seq")).withColumn("vec", embed(F.col("text")).cast("array<double>"))
    found = found.withColumn("seq", F.concat_ws("-", "event_id", F.lpad(F.col("seq").cast("string"), 10, "0")))
    facts = facts.withColumn("vec", F.col("embedding").cast("array<double>"))
    live = facts.where("status = 'active'")
    merged = semantic_upsert(live, found, least=least)
    rest = live.select("id", "use_count", "updated_at")
    out = merged.join(rest, "id", "left").withColumn("use_count", F.coalesce("use_count", F.lit(0).cast("long"))).withColumn("status", F.lit("active"))
    out = out.withColumn("updated_at", F.when(F.col("op") == "keep", F.col("updated_at")).otherwise(now))
    aside = facts.where("status is null or status <> 'active'").withColumn("op", F.lit("keep")).select(*out.columns)
    return prune(out.unionByName(aside), cap=cap)


def stats(facts: DataFrame, account: str | None = None) -> DataFrame:
    own = facts if account is None else facts.where(F.col("account_id") == account)
    return own.where("status = 'active'").rollup("kind").agg(F.count("*").alias("n"))


def restorable(facts: DataFrame, wanted: DataFrame, *, least: float = 0.90, cap: int = 400) -> DataFrame:
    """``id, verdict`` for each wanted id: ``missing``, ``ok`` if already active, ``capacity``, ``duplicate``, else ``ok``; first match.

    A duplicate is an active fact of the same account whose vector is within ``least``.
    """
    live = facts.where("status = 'active'")
    full = live.groupBy("account_id").agg((F.count("*") >= cap).alias("full"))
    asked = wanted.select("id").distinct().join(facts, "id", "left")
    vec = F.col("embedding").alias("vec")
    near = similar_to_some(asked.select("account_id", "id", vec), live.select("account_id", "id", vec), ["account_id"], least).select("id", F.lit(True).alias("near"))
    out = asked.select("id", "account_id", "status").join(full, "account_id", "left").join(near, "id", "left")
    verdict = F.when(F.col("status").isNull(), "missing").when(F.col("status") == "active", "ok").when(F.col("full"), "capacity").when(F.col("near"), "duplicate").otherwise("ok")
    return out.select("id", verdict.alias("verdict"))
