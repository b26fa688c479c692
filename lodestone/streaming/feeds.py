"""Change feeds and novelty of frames."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.operators.shared import exists, written


def unseen(deltas: DataFrame, since=None, limit: int = 200) -> DataFrame:
    """Unseen changes strictly after a cursor, newest first, 1 to 200 of them."""
    from lodestone.operators.filters import after

    return after(deltas.where(~F.col("seen")), "created_at", since).orderBy(F.desc("created_at"), "id").limit(max(1, min(limit, 200)))


def seen_marks(spark: SparkSession, seen: str) -> DataFrame:
    """``id, query, batch`` of what ``deliver_once`` has marked; none if the folder is not there yet."""
    schema = "id string, query string, batch long"
    return spark.read.schema(schema).parquet(seen) if exists(spark, seen) else spark.createDataFrame([], schema)


def deliver_once(deliver: Callable[[DataFrame, int], None], seen: str, id_col: str = "id", at_col: str = "created_at") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that hands a batch over, newest first, and then marks its ids as seen.

    Marks are a folder for each batch of each query, written whole: a batch that is replayed after it was marked is neither
    handed over nor marked again, and one that was lost in between is handed over again (at least once), as are no rows that
    another batch has marked. Rows that repeat an id within a batch are handed over together.
    """

    def sink(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "none"
        own = f"{seen}/query={query}/batch={n}"
        if exists(spark, f"{own}/_SUCCESS"):
            return
        others = seen_marks(spark, seen).where(~((F.col("query") == query) & (F.col("batch") == n))).select(F.col("id").alias("_seen"))
        fresh = written(batch.join(others, F.col(id_col).cast("string") == F.col("_seen"), "left_anti"), "fresh")
        deliver(fresh.orderBy(F.desc(at_col), id_col), n)
        fresh.select(F.col(id_col).cast("string").alias("id")).distinct().write.mode("overwrite").parquet(own)

    return sink


def delta_feed(spark: SparkSession, path: str, schema: str, deliver: Callable[[DataFrame, int], None], checkpoint: str, *, seen: str | None = None, since=None, every: str = "8 seconds", once: bool = False):
    """Delivers new changes in batches, newest first in each: unseen ones strictly after ``since``.

    The cursor is the stream's own checkpoint. With ``seen``, a folder that all executors share, what was delivered is marked
    there (``deliver_once``), so no change is delivered by two batches and a replayed batch marks nothing twice.
    """
    from lodestone.operators.filters import after

    stream = after(spark.readStream.schema(schema).parquet(path).where(~F.coalesce("seen", F.lit(False))), "created_at", since)
    sink = deliver_once(deliver, seen) if seen else lambda df, n: deliver(df.orderBy(F.desc("created_at"), "id"), n)
    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def live(df: DataFrame, now, expires: str = "expires_at") -> DataFrame:
    """Rows that have not expired; without a time they never do."""
    return df.where(F.col(expires).isNull() | (F.col(expires) > now))


NOVELTY = "session_id string, image_id string, sequence_index long, novelty_status string, visual_distance int, text_distance double"


def novelty(frames: DataFrame, most: int = 5, least_text: float = 0.5) -> DataFrame:
    """Marks frames ``novel``, ``duplicate`` or ``invalid`` against the last novel one of the session, with the distances to it.

    ``frames``: ``session_id, image_id, sequence_index, visual_hash, tokens (array of strings)``. The rule is that of
    ``aggregates.novel_frames``, which does the same for a table. Frames of a trigger go by ``sequence_index`` and ``image_id``; a frame of a later trigger
    follows those of the triggers before. State for each session: the last novel frame.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        out = pd.concat(list(batches)).sort_values(["sequence_index", "image_id"])
        marks, far, apart = [], [], []
        for h, tokens in zip(out["visual_hash"], out["tokens"], strict=True):  # a text: longs with nulls would come as floats and lose bits
            mine = set(x for x in tokens if x is not None) if tokens is not None else set()
            visual = text = None
            if pd.isna(h):
                marks.append("invalid")
            else:
                if last is not None:
                    visual = ((int(h) ^ int(last[0])) & 0xFFFFFFFFFFFFFFFF).bit_count()
                    before = set(last[1])
                    text = 1 - len(mine & before) / len(mine | before) if mine or before else 0.0
                marks.append("duplicate" if visual is not None and visual <= most and text < least_text else "novel")
                if marks[-1] == "novel":
                    last = (str(int(h)), sorted(mine))
            far.append(visual)
            apart.append(text)
        out["novelty_status"], out["visual_distance"], out["text_distance"] = marks, pd.array(far, dtype="Int32"), pd.array(apart, dtype="Float64")
        yield out[["session_id", "image_id", "sequence_index", "novelty_status", "visual_distance", "text_distance"]]
        if last is not None:
            state.update(last)

    texts = frames.select("session_id", "image_id", "sequence_index", F.col("visual_hash").cast("string").alias("visual_hash"), "tokens")
    return texts.groupBy("session_id").applyInPandasWithState(step, NOVELTY, "hash string, tokens array<string>", "append", GroupStateTimeout.NoTimeout)
