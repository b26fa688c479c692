"""Mixing sources to target weights by Pfair scheduling.

Each source's documents form blocks. Block j of a source with weight w may not start before slot floor((j - 1) / w) and is
due by slot ceil(j / w); the earliest deadline among released blocks goes first. At every slot each source is then less
than one block away from its target share. Weights are exact fractions, so nothing adds up over long mixes. With whole
shares the schedule repeats after as many slots as the shares add up to, so one period stands for however many blocks there are.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping
from fractions import Fraction
from itertools import islice
from math import gcd, lcm

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def exact(weights: Mapping[str | None, float | Fraction]) -> dict[str | None, int]:
    """The weights as whole numbers in the same proportions; a float counts as the decimal number it is written as."""
    given = {x: w if isinstance(w, Fraction) else Fraction(str(w)) for x, w in weights.items()}
    if any(w <= 0 for w in given.values()):
        raise ValueError("a weight must be positive")
    whole = lcm(*(w.denominator for w in given.values()))
    return {x: int(w * whole) for x, w in given.items()}


def earliest_deadlines(shares: list[int]) -> Iterator[int]:
    """The source of each slot, without end: earliest deadline first among the released blocks, ties to the first source."""
    total, at = sum(shares), 0
    waiting = [(0, i, 1) for i in range(len(shares))]  # release, source, block
    ready: list[tuple[int, int, int]] = []  # deadline, source, block
    while True:
        while waiting and waiting[0][0] <= at:
            _, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-j * total // shares[i]), i, j))
        _, i, j = heapq.heappop(ready)
        yield i
        at += 1
        heapq.heappush(waiting, (j * total // shares[i], i, j + 1))


def pfair_segments(weights: Mapping[str | None, float | Fraction], blocks: Mapping[str | None, int], most: int = 1 << 20) -> list[tuple[list[str | None], int]]:
    """The schedule as (slots, times): which source has each slot of a stretch, and how often the stretch comes.

    A stretch is a period of the shares of all sources that are left; then comes what is scheduled until one of them runs out,
    and the others start anew with their weights among themselves. After a period every source has exactly its share, so
    repeating it is scheduling on. Weights whose period has more than ``most`` slots for each source are an error, whatever
    the number of blocks: whole weights, or ones with a smaller common denominator, will do.
    """
    share = exact({x: w for x, w in weights.items() if blocks.get(x)})
    left = {x: n for x, n in sorted(blocks.items(), key=lambda kv: (kv[0] is not None, kv[0])) if n}
    out: list[tuple[list[str | None], int]] = []
    while left:
        names = list(left)
        unit = gcd(*(share[x] for x in names))
        shares = [share[x] // unit for x in names]
        if sum(shares) * len(names) > most:
            raise ValueError(f"the weights {shares} of {len(names)} sources have too long a period: give whole weights with a smaller sum")
        times = min((left[x] - 1) // a for x, a in zip(names, shares, strict=True))
        if times:
            out.append(([names[i] for i in islice(earliest_deadlines(shares), sum(shares))], times))
            left = {x: left[x] - times * a for x, a in zip(names, shares, strict=True)}
        tail = []
        for i in earliest_deadlines(shares):
            tail.append(names[i])
            left[names[i]] -= 1
            if not left[names[i]]:
                break
        out.append((tail, 1))
        left = {x: n for x, n in left.items() if n}
    return out


def source_counts(docs: DataFrame, source_col: str = "source", most: int = 100_000) -> dict[str | None, int]:
    """Rows of each source; more than ``most`` sources are an error, so what comes to the driver is bounded."""
    rows = docs.groupBy(source_col).count().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} sources")
    return {r[0]: r[1] for r in rows}


def tempered(counts: Mapping[str | None, int], power: float = 0.5, units: int = 4096) -> dict[str | None, Fraction]:
    """Weights that grow as a power of a source's size, as is usual for mixes in which small sources should show.

    They are whole units, about ``units`` in all and one at least, so the schedule repeats after so many slots.
    """
    total = sum(n**power for n in counts.values())
    return {x: Fraction(max(1, round(n**power / total * units))) for x, n in counts.items()}


def mix_sources(docs: DataFrame, weights: Mapping[str | None, float | Fraction] | None = None, *, id_col: str = "doc_id", source_col: str = "source", block_docs: int = 16, bucket_rows: int = 4096) -> DataFrame:
    """``docs`` with ``block``, ``slot`` and ``position`` (all long, from 0): reading by position meets the target weights.

    ``weights`` maps every source to a positive weight (by default about the square root of its number of rows); a null source
    is a source like any other, and a source without a weight is an error rather than a loss. After every slot each source
    is less than one block from its exact share; from where a source has run out, the others are so from there on, by their
    weights among themselves. Blocks have ``block_docs`` rows, however many rows there are; a source's last block may have fewer.

    A source's order is by a hash of the id, then the id, then a hash of the whole row, so it is the same in every run; rows
    that are equal throughout are exchangeable. Null ids and rows that repeat an id are placed like others. Every row has its
    place. Empty input gives empty output. Columns of ``docs`` named as the new ones are replaced.

    Rows are numbered within (source, hash bucket) of about ``bucket_rows`` rows, and bucket totals are added up, so a
    source with a third of all rows is as many buckets as its size asks for. What is broadcast does not grow with the rows: the
    slots of each stretch of the schedule (``pfair_segments``, which bounds them), and for each source the stretches that it is in.
    """
    spark = docs.sparkSession
    counts = source_counts(docs, source_col)
    weights = dict(weights) if weights is not None else tempered(counts)
    if missing := [x for x in counts if x not in weights]:
        raise ValueError(f"sources without a weight: {missing[:5]}")
    docs = docs.drop("block", "slot", "position")
    if not counts:
        zero = F.lit(0).cast("long")
        return docs.select("*", zero.alias("block"), zero.alias("slot"), zero.alias("position"))
    names = list(counts)
    number = {x: i for i, x in enumerate(names)}
    pattern, stretches, used, slot, at = [], [[] for _ in names], dict.fromkeys(names, 0), 0, 0
    for k, (slots, times) in enumerate(pfair_segments({x: weights[x] for x in counts}, {x: -(-n // block_docs) for x, n in counts.items()})):
        seen: dict[str | None, int] = {}
        for place, x in enumerate(slots):
            pattern.append((k, number[x], seen.get(x, 0), place))
            seen[x] = seen.get(x, 0) + 1
        for x, n in seen.items():
            stretches[number[x]].append((used[x], n, k, len(slots), slot, at))
            used[x] += n * times
        slot += len(slots) * times
        # Only the last slot of a stretch can hold a source's last block, which may be short.
        last = slots[-1]
        at += len(slots) * times * block_docs - max(0, used[last] * block_docs - counts[last])
    long = lambda *cols: ", ".join(f"{c} long" for c in cols)
    pattern = F.broadcast(spark.createDataFrame(pattern, long("_k", "_no", "_offset", "_place")))
    stretch = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("first", "each", "k", "slots", "slot", "at")]))
    kind = T.StructType([T.StructField("_source", docs.schema[source_col].dataType), *(T.StructField(c, T.LongType()) for c in ("_no", "_buckets")), T.StructField("_stretches", stretch)])
    sources = F.broadcast(spark.createDataFrame([(x, number[x], -(-n // bucket_rows), stretches[number[x]]) for x, n in counts.items()], kind))

    h = F.xxhash64(F.col(id_col), F.lit(77))
    placed = (
        docs.withColumn("_whole", F.xxhash64(*[F.col(c) if "map" not in t else F.to_json(c) for c, t in docs.dtypes])).withColumn("_h", h)
        .join(sources, F.col(source_col).eqNullSafe(F.col("_source"))).drop("_source")
        .withColumn("_bucket", F.shiftright(F.shiftrightunsigned("_h", 34) * F.col("_buckets"), 30))
    )
    per_bucket = placed.groupBy("_no", "_bucket").count()
    ahead = per_bucket.select("_no", "_bucket", (F.sum("count").over(Window.partitionBy("_no").orderBy("_bucket")) - F.col("count")).alias("_ahead"))
    order = Window.partitionBy("_no", "_bucket").orderBy(F.shiftrightunsigned("_h", 1), F.col("_h").bitwiseAND(1), id_col, "_whole")
    numbered = placed.withColumn("_row", F.row_number().over(order) - 1).join(ahead, ["_no", "_bucket"])
    nth = F.col("_row") + F.col("_ahead")
    numbered = numbered.withColumn("block", F.floor(nth / block_docs)).withColumn("_in_block", nth % block_docs)
    # The last stretch that begins at the block or before it; the block's period there, and its place in the period.
    numbered = numbered.withColumn("_s", F.element_at(F.filter("_stretches", lambda s: s["first"] <= F.col("block")), -1)).drop("_stretches")
    past = F.col("block") - F.col("_s.first")
    numbered = numbered.withColumns({"_k": F.col("_s.k"), "_period": F.floor(past / F.col("_s.each")), "_offset": past % F.col("_s.each")})
    placed = numbered.join(pattern, ["_k", "_no", "_offset"]).withColumn("_into", F.col("_period") * F.col("_s.slots") + F.col("_place"))
    return placed.select(*docs.columns, "block", (F.col("_s.slot") + F.col("_into")).alias("slot"), (F.col("_s.at") + F.col("_into") * block_docs + F.col("_in_block")).alias("position"))
