"""Similarity joins: nearest stored vector, near-equal hashes, and folds that depend on order."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.hashes import bands, hamming
from lodestone.functions.scoring import cosine
from lodestone.operators.shared import written


#: Vectors of a side that a task holds at a time: what is shuffled goes with the square of an account over this.
BLOCK = 4096
#: Rows of a block that are multiplied at a time, so that a product stays small.
SLICE = 512


def products(q: pa.ChunkedArray, c: pa.ChunkedArray) -> np.ndarray:
    """Cosines of all rows of two columns of vectors (arrays of floats or doubles), in doubles: 0 for zero vectors and for different lengths."""
    q, c = (x.combine_chunks() for x in (q, c))
    q_len, c_len = (pc.list_value_length(x).to_numpy(zero_copy_only=False) for x in (q, c))
    out = np.zeros((len(q_len), len(c_len)))
    for n in set(q_len.tolist()) & set(c_len.tolist()) - {0}:
        at, there = np.flatnonzero(q_len == n), np.flatnonzero(c_len == n)
        a, b = (x.take(pa.array(k)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, n) for x, k in ((q, at), (c, there)))
        norms = np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))[None, :]
        out[np.ix_(at, there)] = np.nan_to_num(np.divide(a @ b.T, norms, out=np.zeros_like(norms), where=norms > 0))
    return out


def vectors(df: DataFrame, v: str) -> DataFrame:
    """Rows with a vector; floats stay floats, which are half as much to shuffle."""
    sound = df.where(F.col(v).isNotNull())
    return sound if dict(df.dtypes)[v] == "array<float>" else sound.withColumn(v, F.col(v).cast("array<double>"))


def blockwise(left: DataFrame, right: DataFrame, keys: list[str], by: tuple[str, str], f: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``f`` on every block of the left rows of a key and every block of the right rows of the same key, a task for each two.

    Blocks have about ``BLOCK`` rows, dealt by a hash of the columns ``by``, so a key with very many rows on either side is many
    tasks. Rows with a null key meet nobody.
    """
    # Fresh names for the columns: both sides may come from one table.
    left, right = (df.select(*[F.col(c).alias(c) for c in df.columns]) for df in (left, right))

    def dealt(rows: DataFrame, id_col: str, other: DataFrame, mine: str, theirs: str) -> DataFrame:
        sizes = lambda df, name: df.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).alias(name))
        both = rows.join(sizes(rows, "_mine"), keys).join(sizes(other, "_theirs"), keys)
        return both.withColumn(mine, F.pmod(F.xxhash64(id_col), "_mine")).withColumn(theirs, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_theirs") - 1))).drop("_mine", "_theirs")

    def met(x: pa.Table, y: pa.Table) -> pa.Table:
        if x.num_rows and y.num_rows:
            return f(x, y)
        have = {**dict(zip(y.schema.names, y.schema.types, strict=True)), **dict(zip(x.schema.names, x.schema.types, strict=True))}
        return pa.schema([(c, have.get(c, pa.float64())) for c in columns]).empty_table()

    columns = [c.split()[0] for c in schema.split(", ")]
    cell = [*keys, "_l", "_r"]
    l, r = dealt(left, by[0], right, "_l", "_r"), dealt(right, by[1], left, "_r", "_l")
    return l.groupBy(*cell).cogroup(r.groupBy(*cell)).applyInArrow(met, schema)


def by_slices(f: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """``f`` on ``SLICE`` rows of its first table at a time."""
    size = SLICE
    return lambda q, s: pa.concat_tables([f(q.slice(at, size), s) for at in range(0, q.num_rows, size)])


def nearest(candidates: DataFrame, stored: DataFrame, least: float = 0.90, *, keys: list[str] | None = None, most_pairs_broadcast: int = 2_000) -> DataFrame:
    """For each candidate (``cid, cvec``) the best stored vector (``id, vec, seq``): ``cid, id, sim``; no match, nulls.

    The first of equal similarities by ``seq`` wins, and only those over 0 and from ``least`` on count. With ``keys``
    candidates meet stored vectors of the same key (an account), block by block, as products of matrices. Without,
    candidates are a small query set: their number is checked, and beyond the limit keys are required.
    """
    by = [*(keys or []), "cid"]
    if keys:
        kinds = dict([*stored.dtypes, *candidates.dtypes])

        def best_of(q: pa.Table, s: pa.Table) -> pa.Table:
            sim = products(q["cvec"], s["vec"])
            order = np.lexsort((s["seq"].to_numpy(),))
            at = order[np.argmax(sim[:, order], axis=1)]  # the first of the best
            top = sim[np.arange(len(at)), at]
            keep, at = np.flatnonzero(top > 0), at[top > 0]
            return pa.table({**{k: q[k].take(pa.array(keep)) for k in by}, **{k: s[k].take(pa.array(at)) for k in ("id", "seq")}, "sim": pa.array(top[keep])})

        schema = ", ".join(f"{c} {kinds[c]}" for c in (*by, "id", "seq")) + ", sim double"
        scored = blockwise(vectors(candidates.select(*by, "cvec"), "cvec"), vectors(stored.select(*keys, "id", "seq", "vec"), "vec"), keys, ("cid", "id"), by_slices(best_of), schema)
    else:
        if candidates.limit(most_pairs_broadcast + 1).count() > most_pairs_broadcast:
            raise ValueError("too many candidates to meet every stored vector; give keys")
        pairs = stored.join(F.broadcast(candidates))
        scored = pairs.select(*by, "id", "seq", cosine(F.col("cvec"), F.col("vec")).alias("sim")).where(F.col("sim") > 0)
    best = scored.groupBy(*by).agg(F.max_by(F.struct("id", "sim"), F.struct(F.col("sim"), -F.col("seq"))).alias("best"))
    hit = F.col("best.sim") >= least
    return candidates.select(*by).join(best, by, "left").select(*by, F.when(hit, F.col("best.id")).alias("id"), F.when(hit, F.col("best.sim")).alias("sim"))


#: Rows of one key that meet the others of it in one piece; those of crowded keys are dealt over several.
CROWD = 2048
#: Masks that a hash is entered under at most.
MASKS = 24


def covered(most: int) -> int:
    """Slices that a mask covers: as many, up to three, as give no more than ``MASKS`` masks.

    With one, 16 bits of 64 for hashes within 3, pairs that meet grow with the square of the rows long before hashes run out; with
    three, 20 masks of about 32 bits, most that meet are near.
    """
    return max([t for t in (2, 3) if comb(most + t, t) <= MASKS], default=1)


def masks(most: int, together: int) -> list[int]:
    """Masks of a hash of 64 bits: hashes that differ in ``most`` bits or fewer are equal under one of them.

    The hash is cut into ``most + together`` slices, of which ``together`` hold no differing bit; a mask covers so many of them.
    """
    count = most + together
    ends = [64 * i // count for i in range(count + 1)]
    slices = [(1 << b) - (1 << a) for a, b in zip(ends, ends[1:])]  # noqa: B905
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return [signed(sum(some)) for some in combinations(slices, together)]


def meeting(x: DataFrame, y: DataFrame, keys: list[str], most: int, together: int, own: Column) -> DataFrame:
    """Rows of ``x`` (with a hash ``h``) and ``y`` (with a hash ``i``) of the same keys within ``most`` bits, for which ``own`` holds: each two once.

    They meet under masks; of the masks under which two are equal the first counts. Rows of a mask that many rows of ``y`` share meet
    them in pieces of about ``CROWD``, so that no task has all pairs of a crowd.
    """
    every = masks(most, together)
    under = lambda df, h: df.select("*", F.posexplode(F.array(*[F.col(h).bitwiseAND(m) for m in every])).alias("_k", "_m"))
    cell = [*keys, "_k", "_m"]
    crowds = under(y.select(*keys, "i"), "i").groupBy(*cell).count().where(F.col("count") > CROWD).select(*cell, F.ceil(F.col("count") / CROWD).alias("_pieces"))
    crowds = F.broadcast(written(crowds, "crowds"))
    asked = under(x, "h").join(crowds, cell, "left").withColumn("_p", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_pieces", F.lit(1).cast("long")) - 1))).drop("_pieces")
    held = under(y, "i").join(crowds, cell, "left").withColumn("_p", F.coalesce(F.pmod(F.xxhash64("i"), "_pieces"), F.lit(0).cast("long"))).drop("_pieces")
    apart = F.col("h").bitwiseXOR(F.col("i"))
    first = F.lit(None).cast("int")
    for k, m in reversed(list(enumerate(every))):
        first = F.when(apart.bitwiseAND(m) == 0, k).otherwise(first)
    return asked.join(held, [*cell, "_p"]).where((F.bit_count(apart) <= most) & own & (first == F.col("_k"))).drop("_k", "_m", "_p")


def near_hashes(df: DataFrame, id_col: str, hash_col: str, most: int = 3) -> DataFrame:
    """Pairs ``a < b`` of classes of equal hashes, by their least ids, that differ in 1 to ``most`` bits (``distance`` long), and
    for each further member ``b`` of a class a row with its least id ``a`` and distance 0.

    So no pair is lost, and a hash that a third of all rows have gives a row for each of them and not for each two. Classes
    meet under masks (``meeting``); rows without a hash are near nobody.
    """
    if most > 31:
        raise ValueError("more bands than the hash has")
    one = df.where(F.col(hash_col).isNotNull()).select(F.col(id_col).alias("b"), F.col(hash_col).alias("h"))
    classes = written(one.groupBy("h").agg(F.min("b").alias("a")), "classes")
    x, y = classes.toDF("h", "x"), classes.toDF("i", "y")
    close = meeting(x, y, [], most, covered(most), F.col("h") < F.col("i"))
    far = close.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.bit_count(F.col("h").bitwiseXOR(F.col("i"))).cast("long").alias("distance"))
    same = one.join(classes, "h").where("a <> b").select("a", "b", F.lit(0).cast("long").alias("distance"))
    return far.unionByName(same)


def first_wins(conflicts: DataFrame) -> DataFrame:
    """``g, a``: what goes when, within a group and in order, each goes that conflicts with an earlier one that stays.

    ``conflicts``: ``g, a, b`` with a before b in the order of a's and b's own values. In each round those that no undecided one
    precedes stay and those in conflict with them go, until no conflict is left; rounds are as many as the longest chain.
    """
    left = written(conflicts.select("g", "a", "b").distinct(), "conflicts")
    dropped = left.select("g", "a").limit(0)
    while not left.isEmpty():
        later = left.select("g", F.col("b").alias("a")).distinct()
        gone = written(left.join(later, ["g", "a"], "left_anti").select("g", F.col("b").alias("a")).distinct(), "gone")
        left = written(left.join(gone.withColumnRenamed("a", "b"), ["g", "b"], "left_anti").join(gone, ["g", "a"], "left_anti").select("g", "a", "b"), "conflicts")
        dropped = dropped.unionByName(gone)
    return dropped


def near_before(nodes: DataFrame, hash_col: str, most: int, later=None, together: int | None = None) -> DataFrame:
    """``g, a, b``: a before b (``o`` orders), hashes within ``most`` bits; ``later`` is a condition on b.

    ``together``: slices that a mask covers. Fewer are fewer rows to shuffle and more pairs that meet.
    """
    sound = nodes.where(F.col(hash_col).isNotNull())
    x = sound.select("g", F.col("o").alias("a"), F.col(hash_col).alias("h"))
    y = (sound if later is None else sound.where(later)).select("g", F.col("o").alias("b"), F.col(hash_col).alias("i"))
    return meeting(x, y, ["g"], most, together or covered(most), F.col("a") < F.col("b")).select("g", "a", "b")


def alike_in_place(nodes: DataFrame, hash_col: str, most: int, near: float, later) -> DataFrame:
    """``g, a, b``: a before b, hashes within ``most`` bits and centres (``cx, cy``) within ``near`` on both axes.

    Two indexes at once: a row is entered by each band of its hash together with the cell of a grid that its centre lies in, and
    sought in that cell and its eight neighbours. Rows without a hash or a centre meet nobody; ``later`` is a condition on b.
    """
    cell = lambda c: F.floor(F.col(c) / near)
    sound = nodes.where(F.col(hash_col).isNotNull() & F.col("cx").isNotNull() & F.col("cy").isNotNull())
    what = F.struct("o", F.col(hash_col).alias("h"), "cx", "cy")
    entered = sound.select("g", what.alias("x"), cell("cx").alias("column"), cell("cy").alias("row"), F.posexplode(bands(F.col(hash_col), most + 1)).alias("k", "band"))
    around = lambda c: F.explode(F.sequence(cell(c) - 1, cell(c) + 1))
    sought = sound.where(later).withColumn("column", around("cx")).withColumn("row", around("cy"))
    sought = sought.select("g", what.alias("y"), "column", "row", F.posexplode(bands(F.col(hash_col), most + 1)).alias("k", "band"))
    both = entered.join(sought, ["g", "k", "band", "column", "row"]).where((F.col("x.o") < F.col("y.o")) & (hamming(F.col("x.h"), F.col("y.h")) <= most))
    beside = (F.abs(F.col("x.cx") - F.col("y.cx")) <= near) & (F.abs(F.col("x.cy") - F.col("y.cy")) <= near)
    return both.where(beside).select("g", F.col("x.o").alias("a"), F.col("y.o").alias("b")).distinct()


def firsts(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each group, by groups that combine before the shuffle."""
    rest = [c for c in df.columns if c not in by]
    return df.withColumn("_o", F.struct(*order)).groupBy(*by).agg(F.min_by(F.struct(*rest), "_o").alias("_r")).select(*by, "_r.*").select(*df.columns)


def greedy_first(df: DataFrame, keys: list[str], order: list[str], hash_col: str, most: int = 3) -> DataFrame:
    """Rows kept when each is held against those kept before it, in order, within a group: first ones win.

    Not the components of the links: of A ~ B ~ C with A and C apart, A and C stay. Exact copies are dropped beforehand; rows
    without a hash all stay. Conflicts come from a join of bands, and rounds of joins decide them (``first_wins``).
    """
    distinct = written(firsts(df.where(F.col(hash_col).isNotNull()), [*keys, hash_col], order), "distinct")
    nodes = distinct.select("*", F.struct(*keys).alias("g"), F.struct(*order).alias("o"))
    gone = first_wins(near_before(nodes, hash_col, most)).withColumnRenamed("a", "o")
    return nodes.join(gone, ["g", "o"], "left_anti").select(*df.columns).unionByName(df.where(F.col(hash_col).isNull()))


def semantic_upsert(stored: DataFrame, candidates: DataFrame, account: str = "account_id", least: float = 0.90, cap: int = 400, most_new: int = 10_000) -> DataFrame:
    """Per account, in order of ``seq``: a candidate within ``least`` of a stored vector updates it, else it is added.

    ``stored``: ``account_id, id, kind, text, vec, importance``; ``candidates``: ``account_id, seq, id, kind, text, vec,
    importance``. Out: the active rows after the batch with ``op`` (keep, update or add). Added vectors are visible to
    later candidates; updated ones keep matching by their old vector within the batch. Importance never falls.

    The result depends on order, so an account is one task. What it holds is bounded: an account with more than ``cap`` stored
    rows (``state.prune`` keeps accounts within it) or more than ``most_new`` candidates in a batch is refused, not cut.
    """
    schema = f"{account} string, id string, kind string, text string, vec array<double>, importance double, op string"

    def fold(key, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        if len(old) > cap or len(new) > most_new:
            raise ValueError(f"account {key[0]!r} has {len(old)} stored rows of {cap} and {len(new)} new ones of {most_new}: prune it, or split the batch")
        rows = [dict(r, op="keep") for r in old.sort_values("id").to_dict("records")] if len(old) else []
        groups: dict[int, list] = {}  # by length: rows, their vectors as a matrix that doubles, norms

        def hold(at: int, v: np.ndarray) -> None:
            g = groups.setdefault(len(v), [[], np.zeros((16, len(v))), np.zeros(16)])
            if len(g[0]) == len(g[1]):
                g[1], g[2] = np.concatenate([g[1], np.zeros_like(g[1])]), np.concatenate([g[2], np.zeros_like(g[2])])
            g[1][len(g[0])], g[2][len(g[0])] = v, np.linalg.norm(v)
            g[0].append(at)

        for at, r in enumerate(rows):
            hold(at, np.asarray(r["vec"], float))
        for c in new.sort_values("seq").to_dict("records") if len(new) else []:
            v, best, at = np.asarray(c["vec"], float), 0.0, -1
            if (g := groups.get(len(v))) and (norm := np.linalg.norm(v)):
                n = len(g[0])
                norms = g[2][:n] * norm
                sims = np.divide(g[1][:n] @ v, norms, out=np.zeros(n), where=norms > 0)
                k = int(np.argmax(sims))  # the first of the best
                best, at = (float(sims[k]), g[0][k]) if sims[k] > 0 else (0.0, -1)
            if at >= 0 and best >= least:
                rows[at] |= {"text": c["text"], "kind": c["kind"], "vec": c["vec"], "importance": max(rows[at]["importance"], c["importance"]), "op": "add" if rows[at]["op"] == "add" else "update"}
            else:
                hold(len(rows), v)
                rows.append({"id": c["id"], "kind": c["kind"], "text": c["text"], "vec": c["vec"], "importance": c["importance"], "op": "add"})
        out = pd.DataFrame(rows, columns=["id", "kind", "text", "vec", "importance", "op"])
        out.insert(0, account, key[0])
        return out

    old = stored.select(account, "id", "kind", "text", "vec", "importance")
    # Fresh names for the columns: both sides may come from one table.
    new = candidates.select(*[F.col(c).alias(c) for c in (account, "seq", "id", "kind", "text", "vec", "importance")])
    return old.groupBy(account).cogroup(new.groupBy(account)).applyInPandas(fold, schema)


def similar_to_some(asked: DataFrame, stored: DataFrame, keys: list[str], least: float = 0.90) -> DataFrame:
    """The rows of ``asked`` (``id, vec`` and keys) to which a row of ``stored`` with the same key and another id is within ``least``."""
    kinds = dict(asked.dtypes)

    def some(q: pa.Table, s: pa.Table) -> pa.Table:
        ids = {x: k for k, x in enumerate({*q["id"].to_pylist(), *s["id"].to_pylist()})}
        a, b = (np.array([ids[x] for x in t["id"].to_pylist()]) for t in (q, s))
        hit = ((products(q["vec"], s["vec"]) >= least) & (a[:, None] != b[None, :])).any(axis=1)
        return pa.table({c: q[c].filter(pa.array(hit)) for c in (*keys, "id")})

    sound = lambda df: vectors(df.where(F.col("id").isNotNull()).select(*keys, "id", "vec"), "vec")
    found = blockwise(sound(asked), sound(stored), keys, ("id", "id"), by_slices(some), ", ".join(f"{c} {kinds[c]}" for c in (*keys, "id")))
    return asked.join(found.distinct(), [*keys, "id"], "left_semi")


def exists_similar(df: DataFrame, keys: list[str], least: float = 0.90) -> DataFrame:
    """Rows (``id, vec``) with another row of the same key within ``least``: the ids and vectors."""
    return similar_to_some(df.select(*keys, "id", "vec"), df, keys, least)


def best_previous(frames: DataFrame, keys: list[str], order: str, score: str) -> DataFrame:
    """Each row with the best row before it in its group (``best_previous`` its order, ``best_score``): ties to the earliest."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    best = F.max_by(F.struct(order, score), F.struct(F.col(score), -F.col(order))).over(w)
    return frames.withColumn("_b", best).withColumn("best_previous", F.col(f"_b.{order}")).withColumn("best_score", F.col(f"_b.{score}")).drop("_b")


def graded_regions(regions: DataFrame, grades: DataFrame) -> DataFrame:
    """Grades joined to the regions of their page by reading-order index."""
    return regions.join(grades, ["page", "index"], "left")
