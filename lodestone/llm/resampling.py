"""Importance resampling towards a target distribution of hashed word n-grams.

Two passes over Arrow batches. The first counts buckets of features with ``np.bincount``, a vector for each partition, and
adds the vectors up in a tree; the second looks up the buckets' gains, of which there are as many, and sums them by document.
Documents are then drawn by Gumbel noise on their weights.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.bytewords import LETTERS_DIGITS, Words, chunks, cut
from lodestone.llm.common import sized, written

#: Words up to this many bytes go through the table together, longer ones one by one.
SHORT = 48


def crc_table() -> np.ndarray:
    """What the CRC-32 of the usual reflected polynomial adds for each byte."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


TABLE = crc_table()


def crc32(words: Words, at: np.ndarray, state: np.ndarray) -> np.ndarray:
    """The CRC-32 of what ``state`` stands for, followed by the words ``at``; a state of 0 stands for nothing."""
    starts, lengths = words.starts[at], words.ends[at] - words.starts[at]
    crc = ~state
    alive = np.flatnonzero(lengths <= SHORT)
    for k in range(SHORT):
        alive = alive[lengths[alive] > k]
        if not len(alive):
            break
        crc[alive] = TABLE[(crc[alive] ^ words.data[starts[alive] + k]) & 0xFF] ^ (crc[alive] >> 8)
    crc = ~crc
    for i in np.flatnonzero(lengths > SHORT).tolist():
        crc[i] = zlib.crc32(words.data[starts[i] : starts[i] + lengths[i]], int(state[i]))
    return crc


def features(words: Words, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket and the row of each feature: all words, and all pairs of neighbours joined by one space."""
    every = np.arange(len(words.starts))
    one = crc32(words, every, np.zeros(len(every), np.uint32))
    left = np.flatnonzero(words.rows[1:] == words.rows[:-1])
    spaced = ~(TABLE[(~one[left] ^ 0x20) & 0xFF] ^ (~one[left] >> 8))
    two = crc32(words, left + 1, spaced)
    return np.concatenate([one, two]).astype(np.int64) % buckets, np.concatenate([words.rows, words.rows[left]])


def bucket_counts(texts: DataFrame, buckets: int, depth: int = 3) -> np.ndarray:
    """How many features fall in each bucket, over all rows of the only column of ``texts``."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in chunks(batches, "text"):
            total += np.bincount(features(cut(batch.column("text"), LETTERS_DIGITS), buckets)[0], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    vectors = texts.mapInArrow(counts, "v binary").rdd.map(lambda r: np.frombuffer(r[0], np.int64))
    return vectors.treeReduce(np.add, depth) if vectors.getNumPartitions() else np.zeros(buckets, np.int64)


def gains(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of how much likelier a bucket is in the target, with one added to each count."""
    t, s, size = target.astype(float), raw.astype(float), float(len(raw))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + size) / ((s + 1) * (t.sum() + size)))).astype(np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, schema: str) -> DataFrame:
    """``docs`` (with ``text``, which goes) and ``n_words, n_features, weight``: the floored mean gain of the features."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # as many numbers as there are buckets

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in chunks(batches, "text"):
            words = cut(batch.column("text"), LETTERS_DIGITS)
            bucket, row = features(words, len(gain))
            n = np.bincount(row, minlength=words.n_rows)
            # Doubles add whole numbers exactly below 2**53: 10**11 features of one text.
            total = np.bincount(row, weights=gain[bucket], minlength=words.n_rows).astype(np.int64)
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            kept = [x for x in batch.schema.names if x != "text"]
            new = [pa.array(x.astype(np.int64)) for x in (np.bincount(words.rows, minlength=words.n_rows), n, weight)]
            yield pa.RecordBatch.from_arrays([batch.column(x) for x in kept] + new, [*kept, "n_words", "n_features", "weight"])

    return docs.mapInArrow(weigh, schema)


def resample(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = 10_000, share: int = 25, least_words: int = 20, seed: int = 7) -> DataFrame:
    """``id_col, n_features, weight, score, rank`` (long) of every row: its likeness to ``target``, and the draw.

    Features are the words (runs of ASCII letters, digits and all that is not ASCII, A-Z lower-cased) and the pairs of
    neighbours, repeats counted; their bucket is a CRC-32. The weight is the floored mean of the buckets' gains, 0 without
    features. The score adds Gumbel noise that depends on ``seed`` and the id. Of the N rows with at least ``least_words``
    words, ``floor(share * N / 100)`` with the highest scores are drawn, ties to the smaller id; others have a null rank.

    Null and empty texts have no features. A null id is read as an empty text by the noise and comes after others in a tie;
    rows that repeat an id are rows of their own (with equal texts they are equal but for the rank). An empty table gives no
    rows; an empty target is flat. Other columns are ignored.

    Scores are whole numbers in a narrow range: gains are within 1000 * ln of the table's size, and the noise between -3200 and
    23000. So the number drawn with each score is counted first, and ranks are a score's offset and the place within it;
    nothing is sorted as a whole. Vectors have ``buckets`` numbers whatever the input.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias("text")
    raw, wanted = bucket_counts(docs.select(text(text_col)), buckets), bucket_counts(target.select(text(target_col)), buckets)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = weighted(docs.select(F.col(id_col).alias("id"), text(text_col)), gains(wanted, raw), f"id {kind}, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = written(rows.select("id", "n_words", "n_features", "weight", (F.col("weight") + noise).cast("long").alias("score")), "scored")

    per_score = written(scored.where(F.col("n_words") >= least_words).groupBy("score").count(), "scores")
    total = per_score.agg(F.sum("count")).first()[0] or 0
    draw = total * share // 100
    up_to = F.sum("count").over(Window.orderBy(F.desc("score")))
    ahead = sized(written(per_score.withColumn("ahead", up_to - F.col("count")).where(F.col("ahead") < draw).select("score", "ahead"), "ahead"))
    eligible, cols = F.col("n_words") >= least_words, ["id", "n_features", "weight", "score"]
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.col("id").asc_nulls_last(), "n_features")) + F.col("ahead")
    near = scored.where(eligible).join(ahead, "score").withColumn("place", place.cast("long")).select(*cols, F.when(F.col("place") <= draw, F.col("place")).alias("rank"))
    reached = scored.withColumn("_s", F.when(eligible, F.col("score")))
    far = reached.join(ahead.select(F.col("score").alias("_s")), "_s", "left_anti").select(*cols, F.lit(None).cast("long").alias("rank"))
    return near.unionByName(far).withColumnRenamed("id", id_col)
