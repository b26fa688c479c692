"""Embedding near-duplicates by PCA-ordered tiled comparison.

Vectors are turned to unit length and rotated so that leading dimensions carry most of their length. A tree of median
cuts along the leading dimensions forms cells, cells form tiles, and tiles are compared two at a time: products are
accumulated over leading dimensions first, the rest is bounded by the norms of the suffixes, and pairs that cannot reach
the threshold any more are left. Tiles whose cells are too far apart do not meet at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import ArrayType, FloatType

from lodestone.llm.common import components, forget, written
from lodestone.llm.topk import usable


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component to about one: no digit changes, and squares neither
    overflow nor vanish."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])


def fitted(sample: np.ndarray, cells: int) -> tuple[np.ndarray, list]:
    """The rotation (columns by falling variance) and the median cuts ``(dimension, value, left, right)``, or a cell's number."""
    _, vectors = np.linalg.eigh(sample.T @ sample)
    rotation = np.ascontiguousarray(vectors[:, ::-1])
    lead = (sample @ rotation)[:, :16]
    number = iter(range(cells * 2))

    def cut(x: np.ndarray, n: int):
        if n > 1 and len(x) > 3:
            d = int(np.argmax(x.std(axis=0)))
            at = float(np.median(x[:, d]))
            left = x[:, d] < at
            if left.any():
                return (d, at, cut(x[left], n // 2), cut(x[~left], n - n // 2))
        return next(number)

    return rotation, cut(lead, cells)


def cells_of(tree, x: np.ndarray, out: np.ndarray | None = None, at: np.ndarray | None = None) -> np.ndarray:
    """The cell of each row of ``x``."""
    out = np.zeros(len(x), "int64") if out is None else out
    at = np.arange(len(x)) if at is None else at
    if not isinstance(tree, tuple):
        out[at] = tree
    elif len(at):
        left = x[at, tree[0]] < tree[1]
        cells_of(tree[2], x, out, at[left])
        cells_of(tree[3], x, out, at[~left])
    return out


def boxes(tree, dims: int, low=None, high=None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The box of each cell, in the leading dimensions."""
    low, high = (np.full(dims, -1.0) if low is None else low), (np.full(dims, 1.0) if high is None else high)
    if not isinstance(tree, tuple):
        return {tree: (low, high)}
    d, at, a, b = tree
    high_a, low_b = high.copy(), low.copy()
    high_a[d], low_b[d] = at, at
    return boxes(a, dims, low, high_a) | boxes(b, dims, low_b, high)


def near_cells(tree, dims: int, threshold: float) -> dict[int, list[int]]:
    """For each cell the cells, itself included, that a vector with a cosine of ``threshold`` to one of its own can be in.

    Unit vectors with cosine c are sqrt(2 - 2c) apart.
    """
    box = boxes(tree, dims)
    low, high = (np.array([box[i][n] for i in sorted(box)]) for n in (0, 1))
    far = 2 - 2 * threshold + 1e-9
    return {i: [int(j) for j in np.nonzero((np.clip(np.maximum(low - high[i], low[i] - high), 0, None) ** 2).sum(axis=1) <= far)[0]] for i in sorted(box)}


def turned(v: np.ndarray, rotation: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, their lengths and the rotated unit vectors."""
    v = scaled(v)
    n = np.sqrt((v * v).sum(axis=1))
    return v, n, (v / n[:, None]) @ rotation


def close_pairs(x: tuple[np.ndarray, ...], y: tuple[np.ndarray, ...], threshold: float, steps=(8, 16, 32)) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs of rows of ``x`` and ``y``, as ``turned`` gives them, with a cosine of ``threshold`` or more, in double precision."""
    (a, na, ra), (b, nb, rb) = x, y
    rest = lambda r, d: np.sqrt(np.clip((r[:, d:] ** 2).sum(axis=1), 0, None))
    i = j = product = None
    done, dim = 0, a.shape[1]
    for upto in [*(s for s in steps if s < dim), dim]:
        if i is None:
            more = ra[:, done:upto] @ rb[:, done:upto].T
            product = more if product is None else product + more
            alive = product + rest(ra, upto)[:, None] * rest(rb, upto)[None, :] >= threshold - 1e-9
            if np.count_nonzero(alive) < 0.1 * alive.size or upto == dim:
                i, j = np.nonzero(alive)
                product = product[i, j]
        else:
            product = product + np.einsum("nd,nd->n", ra[i, done:upto], rb[j, done:upto])
            alive = product + rest(ra, upto)[i] * rest(rb, upto)[j] >= threshold - 1e-9
            i, j, product = i[alive], j[alive], product[alive]
        done = upto
    exact = np.concatenate([np.einsum("nd,nd->n", a[i[n : n + 65536]], b[j[n : n + 65536]]) for n in range(0, max(1, len(i)), 65536)]) / (na[i] * nb[j])
    return i[exact >= threshold], j[exact >= threshold]


def joined(i: np.ndarray, j: np.ndarray, nodes: int) -> np.ndarray:
    """For each node the least node of its component under the links (i, j)."""
    label = np.arange(nodes)
    while True:
        before = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        label = label[label]
        if (label == before).all():
            return label


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, *, id_col: str = "vec_id", vec_col: str = "embedding", tile_rows: int = 4096, fit_rows: int = 4096, most_cells: int = 1024, round_bytes: int = 1 << 27) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id`` (long) ``, kept`` (boolean).

    Two vectors link when their cosine, in double precision, is ``threshold`` or more; ``n_links`` counts the vectors
    linked directly, ``component_id`` is the smallest id that links lead to, the own id included, and ``kept`` says that
    it is the own one. Vectors that are null, empty, zero or hold null or non-finite components, and vectors of
    different lengths, link with nothing. Rows that repeat an id count as vectors of their own and link with that id's
    component. Rows with a null id stay, without links. Other columns are ignored.

    Very large and very small vectors are scaled by powers of two first, so their squares neither overflow nor vanish.

    Equal vectors are one class with a count, so a vector that fills a third of the table is compared once. Rotation
    and cuts are fitted on the ``fit_rows`` vectors of smallest hash: any rotation gives the same links, a good one
    gives them sooner. Two tiles send a count for each vector and a forest of their links, never their pairs. The
    near-copies of one vector can fill a cell; it then is as many tiles as its size asks for.

    Tiles are written once, up to four to a block, and blocks meet in rounds: a round sends no more bytes than the table has
    (or ``round_bytes``), and what it sent is deleted before the next. So disk grows with the table, though work has its square.
    """
    kind = vectors.schema[vec_col].dataType
    own = "float" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "double"
    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(F.col(vec_col), lambda x: x.cast(own) + F.lit(0.0).cast(own)).alias("vec"))
    # Two hashes name a vector from its class on, so that vectors are shuffled only once to find equal ones.
    names = [F.xxhash64(F.lit(k), "vec").alias(f"name{k}") for k in (1, 2)]
    sound = F.col("vec_id").isNotNull() & usable(F.col("vec")) & F.exists("vec", lambda x: x != 0)
    classes = given.where(sound).groupBy("vec").agg(F.min("vec_id").alias("id"), F.count("*").alias("size"))
    classes = written(classes.select("id", "size", "vec", F.size("vec").cast("long").alias("dim"), *names), "vectors")
    stats = classes.groupBy("dim").agg(F.count("*").alias("n")).orderBy("dim").collect()  # a row for each length of vectors
    if not stats:
        return given.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    named = written(classes.select("id", "size", "name1", "name2"), "names")
    all_tiles = [tiled(classes.where(F.col("dim") == s["dim"]), s["n"], s["dim"], own, threshold, tile_rows, fit_rows, most_cells) for s in stats]
    forget(classes)
    rounds = [links for tiles, s in zip(all_tiles, stats, strict=True) for links in met(*tiles, s["n"], s["dim"], own, threshold, tile_rows, round_bytes)]
    links = rounds[0]
    for more in rounds[1:]:
        links = links.unionByName(more)
    links = written(links.groupBy("id", "root").agg(F.sum("n").alias("n")), "links")
    for table in rounds:
        forget(table)
    n = links.groupBy("id").agg(F.sum("n").alias("others"))
    member = components(links.where("root is not null"), "id", "root").withColumnRenamed("node", "id")
    found = named.join(n, "id", "left").join(member, "id", "left")
    found = found.select("name1", "name2", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return (
        given.select("vec_id", *[F.when(sound, x).alias(f"name{k}") for k, x in enumerate(names, 1)]).join(found, ["name1", "name2"], "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )


def tiled(classes: DataFrame, count: int, dim: int, own: str, threshold: float, tile_rows: int, fit_rows: int, most_cells: int) -> tuple[DataFrame, dict, dict, np.ndarray]:
    """The written tiles ``cell, tile, ids, sizes, vecs``, the rows of each, the near cells of each cell, and the rotation."""
    sample = np.array([r["vec"] for r in classes.orderBy(F.xxhash64("id", F.lit(3))).select("vec").limit(fit_rows).collect()], "float64")
    sample = scaled(sample)
    sample = np.nan_to_num(sample / np.sqrt((sample * sample).sum(axis=1))[:, None])
    rotation, tree = fitted(sample, max(1, min(most_cells, count // tile_rows)))
    lead = min(16, rotation.shape[1])
    near = near_cells(tree, lead, threshold)

    def cell(batches):
        for b in batches:
            v = b.column("vec").flatten().to_numpy().reshape(b.num_rows, -1).astype("float64") if b.num_rows else np.zeros((0, dim))
            at = cells_of(tree, turned(v, rotation)[2][:, :lead]) if b.num_rows else np.zeros(0, "int64")
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("size"), b.column("vec"), pa.array(at)], names=["id", "size", "vec", "cell"])

    placed = classes.select("id", "size", "vec").mapInArrow(cell, f"id long, size long, vec array<{own}>, cell long")
    cells = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}  # most_cells rows at most
    tiles_in = {c: max(1, -(-n // tile_rows)) for c, n in cells.items()}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A tile as one row."""
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        parts = [table["id"].to_numpy(), table["size"].to_numpy(), table["vec"].combine_chunks().flatten().to_numpy()]
        row = [table["cell"][:1].combine_chunks(), table["tile"][:1].combine_chunks(), *(pa.array([x.tobytes()], pa.binary()) for x in parts)]
        yield pa.RecordBatch.from_arrays(row, names=["cell", "tile", "ids", "sizes", "vecs"])

    subs = F.create_map(*[F.lit(x).cast("long") for kv in tiles_in.items() for x in kv])
    placed = placed.withColumn("tile", F.pmod(F.xxhash64("id", F.lit(9)), subs[F.col("cell")]))
    tiles = written(placed.groupBy("cell", "tile").applyInArrow(pack, "cell long, tile long, ids binary, sizes binary, vecs binary"), "tiles")
    return tiles, {(c, t): cells[c] / k for c, k in sorted(tiles_in.items()) for t in range(k)}, near, rotation


def met(tiles: DataFrame, rows_in: dict, near: dict, rotation: np.ndarray, count: int, dim: int, own: str, threshold: float, tile_rows: int, round_bytes: int) -> list[DataFrame]:
    """Written ``id, n, root`` of each round of blocks that meet: links of the class, weighted by size, or a link of the forest."""
    kind = np.dtype({"float": "float32", "double": "float64"}[own])
    item = kind.itemsize
    block_rows = max(tile_rows, min(4 * tile_rows, count // 24, (1 << 23) // (dim * item)))
    blocks: list[float] = []
    block_of = {}
    for at, n in rows_in.items():
        if not blocks or blocks[-1] + n > block_rows:
            blocks.append(0)
        blocks[-1] += n
        block_of[at] = len(blocks) - 1
    blocks_in: dict[int, set] = {}
    for (c, _), k in block_of.items():
        blocks_in.setdefault(c, set()).add(k)
    meet = sorted({(min(x, y), max(x, y)) for c in blocks_in for d in near[c] for x in blocks_in[c] for y in blocks_in.get(d, ())})
    rounds, sent, most = [], 0, max(count, round_bytes // (dim * item))
    for i, j in meet:
        n = blocks[i] + (blocks[j] if i != j else 0)
        if not rounds or sent + n > most:
            rounds.append([])
            sent = 0
        sent += n
        rounds[-1].append((i, j))
    close = {c: frozenset(x) for c, x in near.items()}

    def compare(table: pa.Table) -> pa.Table:
        """Two blocks, or a block with itself, tile by tile and in strips of rows."""
        rows = sorted(table.to_pylist(), key=lambda r: (r["block"], r["cell"], r["tile"]))
        ids = [np.frombuffer(r["ids"], "int64") for r in rows]
        sizes = [np.frombuffer(r["sizes"], "int64") for r in rows]
        vecs = [turned(np.frombuffer(r["vecs"], kind).reshape(-1, dim).astype("float64"), rotation) for r in rows]
        starts = np.cumsum([0, *map(len, ids)])
        n, forest = np.zeros(starts[-1], "int64"), []
        two = rows[0]["block"] != rows[-1]["block"]
        for p, a in enumerate(rows):
            for q in range(p, len(rows)):
                b = rows[q]
                if (two and a["block"] == b["block"]) or b["cell"] not in close[a["cell"]]:
                    continue
                found = []
                for k in range(0, len(ids[p]), 512):
                    i, j = close_pairs(tuple(x[k : k + 512] for x in vecs[p]), vecs[q], threshold)
                    found.append(np.stack([i + k, j])[:, i + k < j] if p == q else np.stack([i + k, j]))
                i, j = np.concatenate(found, axis=1)
                n[starts[p] : starts[p + 1]] += np.bincount(i, sizes[q][j], len(ids[p])).astype("int64")
                n[starts[q] : starts[q + 1]] += np.bincount(j, sizes[p][i], len(ids[q])).astype("int64")
                if len(i):
                    root = joined(i, j + (0 if p == q else len(ids[p])), len(ids[p]) + (0 if p == q else len(ids[q])))
                    to = lambda x, p=p, q=q: np.where(x < len(ids[p]), x + starts[p], x - len(ids[p]) + starts[q])
                    below = np.nonzero(root != np.arange(len(root)))[0]
                    forest.append(np.stack([to(below), to(root[below])]))
        i, j = np.concatenate([np.zeros((2, 0), "int64"), *forest], axis=1)
        all_ids, root = np.concatenate(ids), joined(i, j, starts[-1])
        some, below = np.nonzero(n)[0], np.nonzero(root != np.arange(len(root)))[0]
        roots = pa.array([None] * len(some) + all_ids[root[below]].tolist(), pa.int64())
        return pa.table({"id": pa.array(np.concatenate([all_ids[some], all_ids[below]])), "n": pa.array(np.concatenate([n[some], np.zeros(len(below), "int64")])), "root": roots})

    spark = tiles.sparkSession
    at = spark.createDataFrame([(*key, k) for key, k in block_of.items()], "cell long, tile long, block long")
    placed, out = tiles.join(F.broadcast(at), ["cell", "tile"]), []
    for pairs in rounds:
        sides = spark.createDataFrame([(k, f"{i}.{j}") for i, j in pairs for k in {i, j}], "block long, pair string")
        moved = placed.join(F.broadcast(sides), "block").groupBy("pair").applyInArrow(compare, "id long, n long, root long")
        out.append(written(moved, "links"))
    forget(tiles)
    return out
