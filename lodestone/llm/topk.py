"""Exact top-k by inner product through distributed histogram selection.

Everything is scored, block against block. Each pass adds up a histogram of the scores over the whole table for every
query and narrows the interval that holds its k-th score, until that score is known; a last pass filters by it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import written


def usable(vector: Column) -> Column:
    """Not null or empty, and no component null or non-finite."""
    x = vector.cast("array<double>")
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def packed(rows: DataFrame, per_block: int, total: int) -> DataFrame:
    """``id, vec`` (array of doubles) as blocks ``block, n, dim, ids, vecs``, of about ``per_block`` rows of one length."""
    blocks = max(1, -(-total // per_block))

    def pack(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids = table["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        vecs = table["vec"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)[order]
        return pa.table({"block": table["block"][:1], "dim": table["dim"][:1], "n": pa.array([len(ids)], pa.int64()), "ids": pa.array([ids[order].tobytes()], pa.binary()), "vecs": pa.array([np.ascontiguousarray(vecs).tobytes()], pa.binary())})

    keyed = rows.select(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(blocks)).alias("block"), F.size("vec").cast("long").alias("dim"), "id", "vec")
    return keyed.groupBy("block", "dim").applyInArrow(pack, "block long, dim long, n long, ids binary, vecs binary")


def scored(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of a block of queries and of candidates, and the scores; a query's own row has the least possible score.

    Doubles hold the products exactly while they and their sums stay below 2**53, which is checked; beyond that they are
    made of 64-bit whole numbers, which hold all scores that are allowed.
    """
    dim = row["dim"]
    q, c = (np.frombuffer(row[x], "float64").reshape(-1, dim) for x in ("q_vecs", "vecs"))
    qi, ci = (np.frombuffer(row[x], "int64") for x in ("q_ids", "ids"))
    if np.abs(q).max() * np.abs(c).max() * dim < 2**53:
        s = (q @ c.T).astype("int64")
    else:
        s = q.astype("int64") @ c.astype("int64").T
    s[qi[:, None] == ci[None, :]] = np.iinfo("int64").min
    return qi, ci, s


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, *, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256, bins: int = 1024, query_block: int = 512, block: int = 2048) -> DataFrame:
    """For each query the ``k`` rows of ``vectors`` with the highest inner product: ``query_id, rank, vec_id, score``.

    Components become ``floor(scale * x)``, and scores are whole numbers. Fewer candidates than ``k``: all of them. Ties
    go to the smaller id. A query never meets rows with its own id. Vectors that are null or empty or hold null or
    non-finite components take no part; vectors of different lengths do not meet. Rows that repeat id and vector count
    once, and of rows that repeat an id with other vectors each is a candidate and a query of its own. Queries that meet no
    candidate give no row. Other columns are ignored. Scores beyond 62 bits are an error: ``score`` could not hold them.

    A histogram sends no bins below the one with the block's own k-th score, as the k-th of all cannot lie there, and
    the last pass sends at most k ties of a block: no block sends more than k rows a query, whatever is repeated.
    """
    whole = lambda df: df.where(usable(F.col(vec_col))).select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vec_col), lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("vec")).where("id is not null").distinct()
    rows, asked = whole(vectors), whole(queries)
    size = rows.agg(F.count("*").alias("n"), F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)).alias("norm")).first()
    ask = asked.agg(F.count("*").alias("n"), F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)).alias("norm")).first()
    c = written(packed(rows, block, size["n"]), "candidates")
    q = written(packed(asked, query_block, ask["n"]).withColumnsRenamed({"block": "q_block", "ids": "q_ids", "vecs": "q_vecs", "n": "q_n"}), "queries")
    blocks, q_blocks = max(1, -(-size["n"] // block)), max(1, -(-ask["n"] // query_block))
    bound = int(((size["norm"] or 0) * (ask["norm"] or 0)) ** 0.5) + 2
    if bound >= 2**62:
        raise ValueError("scores beyond 64 bits")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    c_side = c.withColumn("q_block", every(q_blocks))

    def against(state: DataFrame | None, f, schema: str) -> DataFrame:
        """``f`` on every block of queries, with their state, and every block of candidates; one such pair at a time."""
        mine = q
        if state is not None:
            per_block = state.groupBy("q_block", "dim").agg(F.array_sort(F.collect_list(F.struct("nth", "low"))).alias("state"))
            mine = q.join(per_block, ["q_block", "dim"])

        def met(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return pa.table({x.split()[0]: pa.array([], pa.int64()) for x in schema.split(", ")})
            return pa.table(f(left.to_pylist()[0] | right.to_pylist()[0]))

        keys = ["block", "q_block", "dim"]
        return c_side.groupBy(keys).cogroup(mine.withColumn("block", every(blocks)).groupBy(keys)).applyInArrow(met, schema)

    width, low, state = 2 * bound + 1, -bound, None
    while width > 1:
        step = -(-width // bins)

        def histogram(row: dict, step: int = step, width: int = width, low: int = low) -> dict:
            _, _, s = scored(row)
            nth = np.arange(len(s))
            lows = np.full(len(s), low)
            if "state" in row:  # a query that met nobody before has no state, and meets nobody now
                nth, lows = (np.array([x[f] for x in row["state"]], "int64") for f in ("nth", "low"))
                s = s[nth]
            bin_of = np.clip((s - lows[:, None]) // step, -1, (width - 1) // step + 1)
            bin_of[s == np.iinfo("int64").min] = -1
            need = min(k, s.shape[1])
            least = np.partition(bin_of, s.shape[1] - need, axis=1)[:, s.shape[1] - need]
            at = np.nonzero((bin_of >= least[:, None]) & (bin_of >= 0))
            keys, n = np.unique(np.stack([at[0], bin_of[at]]), axis=1, return_counts=True)
            m = len(n)
            return {"q_block": pa.array([row["q_block"]] * m, pa.int64()), "dim": pa.array([row["dim"]] * m, pa.int64()), "nth": pa.array(nth[keys[0]], pa.int64()), "bin": pa.array(keys[1], pa.int64()), "n": pa.array(n, pa.int64())}

        counts = against(state, histogram, "q_block long, dim long, nth long, bin long, n long").groupBy("q_block", "dim", "nth", "bin").agg(F.sum("n").alias("n"))
        own = Window.partitionBy("q_block", "dim", "nth")
        down = own.orderBy(F.desc("bin"))
        # Of a query with fewer than k candidates the lowest bin is taken: all are at or above it.
        found = (
            counts.withColumn("up_to", F.sum("n").over(down)).withColumn("last", F.min("bin").over(own))
            .where((F.col("up_to") - F.col("n") < k) & ((F.col("up_to") >= k) | (F.col("bin") == F.col("last"))))
        )
        before = F.lit(low).cast("long") if state is None else F.col("low")
        if state is not None:
            found = found.join(state.select("q_block", "dim", "nth", "low"), ["q_block", "dim", "nth"])
        state = written(found.select("q_block", "dim", "nth", (before + F.col("bin") * step).alias("low")), "kth")
        width = step

    def above(row: dict) -> dict:
        qi, ci, s = scored(row)
        nth = np.array([x["nth"] for x in row["state"]])
        kth = np.array([x["low"] for x in row["state"]])
        qi, s = qi[nth], s[nth]
        at = np.nonzero(s > kth[:, None])
        ties = (s == kth[:, None]) & (kth[:, None] > np.iinfo("int64").min)
        ties &= np.cumsum(ties, axis=1) <= k  # ids ascend within a block
        a = [np.concatenate(x) for x in zip(at, np.nonzero(ties), strict=True)]
        m = len(a[0])
        return {"q_block": pa.array([row["q_block"]] * m, pa.int64()), "dim": pa.array([row["dim"]] * m, pa.int64()), "nth": pa.array(nth[a[0]], pa.int64()), "query_id": pa.array(qi[a[0]]), "vec_id": pa.array(ci[a[1]]), "score": pa.array(s[tuple(a)])}

    best = against(state, above, "q_block long, dim long, nth long, query_id long, vec_id long, score long")
    # Places are counted within a block of one length, so all three name a query.
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("q_block", "dim", "nth").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
