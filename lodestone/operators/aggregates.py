"""Counts, latencies, quotas and merged evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts_with_total(df: DataFrame, key: str) -> DataFrame:
    """``key, n`` and a row with a null key for the total."""
    return df.rollup(key).agg(F.count("*").alias("n"))


def overflow(df: DataFrame, account: str, cap: int = 400) -> DataFrame:
    return df.where("status = 'active'").groupBy(account).agg(F.greatest(F.count("*") - cap, F.lit(0)).alias("overflow"))


def delta_counts(deltas: DataFrame, *keys: str) -> DataFrame:
    """Adds and updates; an unknown operation counts as an add."""
    return deltas.groupBy(*keys).agg(F.count_if(F.coalesce(F.col("op"), F.lit("")) != "update").alias("adds"), F.count_if(F.col("op") == "update").alias("updates"))


def session_counts(items: DataFrame) -> DataFrame:
    """Per session the number of its questions, of the mistakes among them, and of subjects."""
    return items.groupBy("session_id").agg(F.count("*").alias("questions"), F.count_if("mistake").alias("mistakes"), F.count_distinct("subject").alias("subjects"))


def profiles(events: DataFrame, at: str = "created_at") -> DataFrame:
    """What a memory profile is made from: ``account_id, scope, source_count, latest_event_at``."""
    return events.groupBy("account_id", "scope").agg(F.count("*").alias("source_count"), F.max(at).alias("latest_event_at"))


def progress(df: DataFrame, done: Column, ms: Column, *keys: str, order: str | None = None) -> DataFrame:
    """``done, total, avg_ms`` and ``eta_ms``: what is left times the average, halves rounded away from zero.

    A sum of doubles depends on the order of its rows, and a half then falls to either side. So times are added and divided as
    decimals of six places; only a group with times that are no such decimals is added in doubles. With an ``order`` (a column)
    doubles are added one after the other in that order, so the sum is determined too, and is that of a scan of a sorted table.
    """
    left = F.col("total") - F.col("done")
    if order is not None:
        so_far = Window.partitionBy(*keys).orderBy(order)
        rows = df.withColumns({"_ms": F.when(done, ms), "_done": done, "_at": F.row_number().over(so_far)})
        rows = rows.withColumn("_sum", F.sum("_ms").over(so_far.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        out = rows.groupBy(*keys).agg(F.count_if("_done").alias("done"), F.count("*").alias("total"), (F.max_by("_sum", "_at") / F.nullif(F.count("_ms"), F.lit(0))).alias("avg_ms"))
        return out.withColumn("eta_ms", F.round(left * F.col("avg_ms")).try_cast("long"))
    exact = ms.try_cast("decimal(20,6)")
    out = df.groupBy(*keys).agg(
        F.count_if(done).alias("done"), F.count("*").alias("total"), F.avg(F.when(done, ms)).alias("_avg"), F.count(F.when(done, ms)).alias("_n"),
        F.sum(F.when(done, exact)).alias("_sum"), F.bool_and(F.when(done, exact.cast("double").eqNullSafe(ms.cast("double")))).alias("_exact"),
    )
    own = F.col("_exact") & F.col("_sum").isNotNull()
    out = out.withColumn("avg_ms", F.when(own, F.col("_sum").cast("double") / F.col("_n")).otherwise(F.col("_avg"))).withColumn("_left", left)
    # In millionths: (2 * left * sum + n) div (2 * n) is left * sum / n, rounded.
    millionths = F.abs(F.col("_sum") * 1000000).cast("decimal(36,0)")
    halves, whole = millionths * (F.col("_left") * 2) + F.col("_n") * 1000000, F.col("_n") * 2000000
    rounded = F.call_function("div", halves, whole.cast("decimal(38,0)")) * F.signum(F.col("_sum").cast("double")).cast("long")
    eta = F.when(own, rounded).otherwise(F.round(F.col("_left") * F.col("_avg")).try_cast("long"))
    return out.withColumn("eta_ms", eta).select(*keys, "done", "total", "avg_ms", "eta_ms")


def queue_eta(ahead: Column, avg_ms: Column) -> Column:
    """Seconds until a turn: those ahead and the own one, at least 20 s each."""
    return (ahead + 1) * F.greatest(F.lit(20.0), F.coalesce(avg_ms, F.lit(0.0)) / 1000.0)


def daily_quota(df: DataFrame, account: str, at: str, quota: int) -> DataFrame:
    """``account, day, used, left`` per UTC day."""
    return df.groupBy(account, F.to_date(at).alias("day")).agg(F.count("*").alias("used")).withColumn("left", F.greatest(F.lit(quota) - F.col("used"), F.lit(0)))


def status_board(df: DataFrame, kind: str, status: str, values: list[str], wait: Column) -> DataFrame:
    """A column of counts for each status, and the average wait, by kind."""
    return df.groupBy(kind).agg(*[F.count_if(F.col(status) == v).alias(v) for v in values], F.avg(wait).alias("avg_wait"))


def duplicate_rate(df: DataFrame, identity: Column, *keys: str) -> DataFrame:
    """``n, distinct_n, duplicate_rate``."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct(identity).alias("distinct_n")).withColumn("duplicate_rate", 1 - F.col("distinct_n") / F.col("n"))


def merged_evidence(df: DataFrame, keys: list[str], at: str, sequence: str, image: str) -> DataFrame:
    """First and last sight, first and last place in the sequence, count, and the set of images (sorted)."""
    return df.groupBy(*keys).agg(
        F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.min(sequence).alias("first_sequence"), F.max(sequence).alias("last_sequence"), F.count("*").alias("evidence_count"), F.sort_array(F.collect_set(image)).alias("images"),
    )


def text_of(lines: DataFrame, keys: list[str], order: list[str], text: str) -> DataFrame:
    """Lines of a group joined in order."""
    return lines.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_t")))), lambda r: r["_t"]), "\n").alias("text"))


def dwell(events: DataFrame, keys: list[str], at: str, gap_seconds: float) -> DataFrame:
    """Stays: runs of events no further apart than the gap, with start, end, events and seconds."""
    w = Window.partitionBy(*keys).orderBy(at)
    seconds = F.unix_micros(F.col(at).cast("timestamp")) / 1e6
    marked = events.withColumn("_s", seconds).withColumn("_new", (F.col("_s") - F.lag("_s").over(w) > gap_seconds).cast("int"))
    runs = marked.withColumn("stay", F.sum(F.coalesce("_new", F.lit(0))).over(w.rangeBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "stay").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("events"), (F.max("_s") - F.min("_s")).alias("seconds"))


def novel_frames(frames: DataFrame, most: int = 5, least_text: float = 0.5) -> DataFrame:
    """``session_id, image_id, sequence_index, novelty_status, visual_distance, text_distance``: change against the last novel frame.

    ``frames``: ``session_id, image_id, sequence_index, visual_hash, tokens``. Which frame that is depends on all before, so a
    lag cannot say it: a session's frames are folded in order, in one column expression. A frame without a hash is
    ``invalid`` and has no distances; the first sound one is ``novel``, and so is one that differs in more than ``most`` bits or
    whose tokens, as a set, are ``least_text`` or more away (1 - Jaccard; two empty sets are alike); others are ``duplicate``. Null tokens are
    none. The rule and its bounds are our own. A session is gathered in one row of the shuffle's result.
    """
    mine = F.array_sort(F.collect_list(F.struct("sequence_index", "image_id", "visual_hash", F.array_distinct(F.array_compact(F.coalesce("tokens", F.array().cast("array<string>")))).alias("tokens"))))
    none = F.struct(F.lit(None).cast("long").alias("hash"), F.array().cast("array<string>").alias("tokens"), F.array().cast("array<struct<s:string,v:int,t:double>>").alias("out"))

    def step(state, f):
        sound, later = f["visual_hash"].isNotNull(), state["hash"].isNotNull()
        visual = F.when(sound & later, F.bit_count(f["visual_hash"].bitwiseXOR(state["hash"])))
        both = F.size(F.array_union(f["tokens"], state["tokens"]))
        text = F.when(sound & later, F.when(both == 0, F.lit(0.0)).otherwise(1 - F.size(F.array_intersect(f["tokens"], state["tokens"])) / both))
        status = F.when(~sound, "invalid").when((visual <= most) & (text < least_text), "duplicate").otherwise("novel")
        new = status == "novel"
        told = F.struct(status.alias("s"), visual.cast("int").alias("v"), text.alias("t"))
        return F.struct(F.when(new, f["visual_hash"]).otherwise(state["hash"]).alias("hash"), F.when(new, f["tokens"]).otherwise(state["tokens"]).alias("tokens"), F.concat(state["out"], F.array(told)).alias("out"))

    folded = frames.groupBy("session_id").agg(mine.alias("f")).select("session_id", F.explode(F.arrays_zip("f", F.aggregate("f", none, step)["out"].alias("o"))).alias("x"))
    return folded.select("session_id", F.col("x.f.image_id").alias("image_id"), F.col("x.f.sequence_index").alias("sequence_index"), F.col("x.o.s").alias("novelty_status"), F.col("x.o.v").alias("visual_distance"), F.col("x.o.t").alias("text_distance"))


def rounds(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """User turns numbered from 1 with the assistant's reply that follows at once, else null."""
    w = Window.partitionBy(conv).orderBy(turn)
    nexts = turns.withColumn("_role", F.lead("role").over(w)).withColumn("_text", F.lead("text").over(w))
    asked = nexts.where("role = 'user'").withColumn("round", F.row_number().over(w))
    return asked.select(conv, "round", F.col("text").alias("question"), F.when(F.col("_role") == "assistant", F.col("_text")).alias("reply"))
