"""N-gram Jaccard join over count vectors.

A document's distinct word n-grams are hashed into groups; the numbers of n-grams in the groups are its point. Two sets
share at most the sum, over groups, of the smaller count, so a pair of points, or of boxes of points, whose summed minima
are too small cannot link. The levels of the tree that are spread over the cluster pin one group each (``blocks``); below them
boxes are packed and joined (``BoxTree``); what survives is verified on the sets themselves, in the task that found it, and
only the links that join something leave the task. Sets are held as 64-bit hashes of their n-grams.

Why the pins lose nothing: sets A and B with Jaccard >= t differ in at most (1 - t) / (1 + t) * (|A| + |B|) n-grams. With
more groups than that, some group holds exactly the same n-grams in both. The number of groups depends on the size class,
and a document is also entered in the class below its own, so both see the same groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import ascii_lower, components, forget, sized, written

#: Coordinates of the points that bound overlaps.
POINT = 64
#: Odd numbers that spread 64-bit hashes; any others would do.
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


@dataclass(frozen=True)
class Rule:
    """Links when ``|A & B| * over >= |A | B| * under``; the threshold is ``under / over``."""

    under: int
    over: int

    def least(self, total):
        """The smallest overlap that links two sets of ``total`` members together."""
        return -(-total * self.under // (self.under + self.over))

    def classes(self, largest: int = 2**31) -> list[tuple[int, int, int, int]]:
        """Size classes as (from, to, groups, spare): a linked pair lies in one class or in two neighbouring ones.

        Linked sets differ in at most r n-grams, so of ``r + 1 + spare`` groups more than ``spare`` are alike. A set with
        no more than ``spare`` empty groups has one that is alike and not empty, and need not enter by its empty ones. With
        r = 0 only equal sets link, and no groups are needed.
        """
        out, low = [], 1
        while low <= largest:
            high = max(low, low * self.over // self.under)
            next_high = max(high + 1, (high + 1) * self.over // self.under)
            pair = high + min(next_high, high * self.over // self.under)  # the largest |A| + |B| with |A| in this class
            r = pair * (self.over - self.under) // (self.under + self.over)
            spare = 2 + r // 16
            out.append((low, high, r + 1 + spare if r else 0, spare))
            low = high + 1
        return out


def words(text: Column, lower: bool = True) -> Column:
    """The words of a text: whatever stands between spaces, tabs, line ends, and form and vertical feeds."""
    text = F.coalesce(text, F.lit(""))
    return F.array_remove(F.split(ascii_lower(text) if lower else text, "[\\x20\\x09-\\x0D]+"), "")


def shingle_sets(docs: DataFrame, n: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, s``: the sorted distinct 64-bit hashes of the n-grams of whole texts; fewer words make one n-gram; none, none."""

    def grams(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))
        few = F.when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, "\n")))).otherwise(F.array().cast("array<bigint>"))
        return F.sort_array(F.array_distinct(F.when(F.size(w) >= n, many).otherwise(few)))

    # Bound as a lambda's variable the words are split once, wherever the optimizer moves the expression.
    return docs.select(F.col(id_col).cast("long").alias("id"), F.transform(F.array(words(F.col(text_col))), grams)[0].alias("s"))


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = x.astype("uint64") + np.uint64(salt * MIX[0] & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[2])
    return x ^ (x >> np.uint64(31))


def point_of(s: np.ndarray, groups: int = POINT) -> np.ndarray:
    """The counts of the groups."""
    return np.bincount((mixed(s, 1) % np.uint64(groups)).astype("int64"), minlength=groups).astype("int32")


def pins(s: np.ndarray, rule: Rule, classes: list[tuple[int, int, int, int]]) -> np.ndarray:
    """The blocks that a set enters: for its class and the one below, each group with the digest of its members."""
    at = next((k for k, c in enumerate(classes) if c[0] <= len(s) <= c[1]), -1)
    out, spread = [], mixed(s, 2)
    for k in (at, at - 1):
        if k < 0 or k < at and Fraction(classes[k][1], len(s)) < Fraction(rule.under, rule.over):
            continue
        _, _, groups, spare = classes[k]
        if not groups:
            continue
        sums = np.zeros(groups, "uint64")
        of = (mixed(s, 3) % np.uint64(groups)).astype("int64")
        np.add.at(sums, of, spread)
        some = np.bincount(of, minlength=groups) > 0
        enter = np.nonzero(some)[0] if groups - some.sum() <= spare else np.arange(groups)
        out.append(mixed(sums[enter] + mixed(enter, 4), k + 5))
    return np.concatenate([np.empty(0, "uint64"), *out])


class BoxTree:
    """Points packed into boxes of boxes; joins itself, leaving pairs of boxes whose summed minima are too small.

    ``labels`` say what is joined already: boxes that lie in one and the same component are left as well.
    """

    FAN = 16

    def __init__(self, points: np.ndarray, sizes: np.ndarray, labels: np.ndarray | None = None):
        labels = np.arange(len(sizes)) if labels is None else labels
        order = np.lexsort((*points.T[np.argsort(points.std(axis=0))][-3:], sizes, labels))
        self.order = order
        self.levels = [(points[order], sizes[order], labels[order], labels[order])]
        while len(self.levels[-1][0]) > 1:
            high, least, x, y = self.levels[-1]
            cut = np.arange(0, len(high), self.FAN)
            self.levels.append((np.maximum.reduceat(high, cut, axis=0), np.minimum.reduceat(least, cut), np.minimum.reduceat(x, cut), np.maximum.reduceat(y, cut)))

    def pairs(self, rule: Rule) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of positions in the points given, whose bound reaches what linking needs, from the root down, strip by strip."""
        if len(self.order) > 1:
            yield from self.below(rule, len(self.levels) - 2, np.zeros((1, 2), "int64"))

    def below(self, rule: Rule, level: int, open_pairs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        high, least, x, y = self.levels[level]
        kids = np.arange(self.FAN)
        for strip in np.array_split(open_pairs, len(open_pairs) // 256 + 1):
            i = ((strip[:, :1] * self.FAN + kids)[:, :, None] + np.zeros((1, 1, self.FAN), "int64")).ravel()
            j = ((strip[:, 1:] * self.FAN + kids)[:, None, :] + np.zeros((1, self.FAN, 1), "int64")).ravel()
            fits = (i < len(least)) & (j < len(least)) & ((i < j) if level == 0 else (i <= j))
            i, j = i[fits], j[fits]
            apart = (x[i] != y[i]) | (x[j] != y[j]) | (x[i] != x[j])
            i, j = i[apart], j[apart]
            near = np.minimum(high[i], high[j]).sum(axis=1) >= rule.least(least[i] + least[j])
            if level == 0:
                yield self.order[i[near]], self.order[j[near]]
            elif near.any():
                yield from self.below(rule, level - 1, np.stack([i[near], j[near]], axis=1))


def jaccard_join(docs: DataFrame, *, n: int = 5, threshold: tuple[int, int] = (8, 10), id_col: str = "doc_id", text_col: str = "text", chunk: int = 2048) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id`` (long) ``, n_copies`` (long: rows with the same set).

    Two documents link when the Jaccard similarity of their sets of distinct word n-grams, A-Z lower-cased, is at least
    ``threshold`` (a fraction of whole numbers, so that ties at the threshold are exact). ``component_id`` is the
    smallest id that links lead to, the own one included. Null and empty texts, and texts without words, have no n-grams
    and link with nothing; a text of fewer than n words is one n-gram. Rows that repeat an id are one document that has
    the set of each. A null id stays, unlinked, with a null component. Other columns are ignored.

    Equal sets are one class with a representative from the start. Blocks send a star of links to their least member, so
    near-copies are found without making their pairs. Blocks whose members are still in different components after that
    are put together with those they share members with, and each such group is joined in full by a tree, across
    components, in pieces of about ``chunk`` members. No pair is capped or dropped.
    """
    rule = Rule(*threshold)
    classes = rule.classes()

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, at = flattened(b.column("s"))
            found = [pins(flat[at[k] : at[k + 1]], rule, classes).view("int64") for k in range(b.num_rows)]
            ends = np.cumsum([0, *map(len, found)])
            blocks = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, "int64"), *found])))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n"), b.column("set"), blocks], names=["id", "n", "set", "blocks"])

    sets = shingle_sets(docs, n, id_col=id_col, text_col=text_col)
    member = sets.select("id", F.size("s").cast("long").alias("n"), F.struct(F.xxhash64("s").alias("x"), F.hash("s").alias("y"), F.size("s").alias("z")).alias("set"), "s")
    member = written(member.mapInArrow(enter, "id long, n long, set struct<x: long, y: int, z: int>, blocks array<long>"), "members")
    reps = member.where("n > 0 and id is not null").groupBy("set").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    reps = written(reps, "classes")

    def sets_of(ids: DataFrame) -> DataFrame:
        """``id, s`` of the ids of a written table: texts are picked first, so that sets are not shuffled."""
        picked = docs.join(sized(ids).select(F.col("id").alias(id_col)), id_col, "left_semi")
        return shingle_sets(picked, n, id_col=id_col, text_col=text_col)

    # Of documents with one and the same set the representative enters. It is found by leaving out the others, which are fewer,
    # so that blocks need not be shuffled by id; an id that repeats can be a representative by another of its sets.
    slim = written(member.drop("blocks"), "members")
    some = slim.where("n > 0 and id is not null")
    again = written(reps.where("copies > 1").select("set", "rep"), "copied")
    others = some.join(sized(again), "set").where("id <> rep").select("id").distinct()
    others = written(others.join(reps.select(F.col("rep").alias("id")), "id", "left_anti"), "others")
    entries = member.where("n > 0 and id is not null").join(sized(others), "id", "left_anti").select(F.explode("blocks").alias("block"), "id")
    keyed = entries.repartition("block").sortWithinPartitions("block", "id")
    runs = written(keyed.mapInArrow(stars, "block long, a long, b long").distinct(), "blocks")
    forget(member)
    starred = runs.where("a <> b").select("a", "b").distinct()
    links = verified(starred, sets_of, rule)
    first = components(links)

    # Members of blocks of three and more, whose star did not join them all.
    inside = runs.where("block is not null").select("block", F.col("b").alias("id")).join(first.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed_blocks = inside.groupBy("block").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.min("id").alias("least")).where("x <> y")
    left = written(inside.join(mixed_blocks.select("block", "least"), "block").select("id", "component", "least").distinct(), "open")
    out = slim.join(reps, "set", "left").join(first.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    if not left.isEmpty():
        joined = components(tree_links(left, sets_of, rule, chunk)).select(F.col("node").alias("component"), F.col("component").alias("joined"))
        out = out.join(joined, "component", "left").withColumn("component", F.coalesce("joined", "component"))
    component = F.when((F.col("n") == 0) | F.col("id").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce("copies", F.lit(1)).alias("n_copies"))


def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over entries sorted by block and id: for each block of several members, rows (block or null, least member, member).

    The block is named by its members, so blocks with the same members become one; it is null for two members, whose
    only pair the star has. Only the block that a batch ends in is carried over.
    """
    keys, ids = np.empty(0, "int64"), np.empty(0, "int64")

    def closed(keys: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        fresh = np.concatenate([[True], (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])]) if len(keys) else np.zeros(0, bool)
        keys, ids = keys[fresh], ids[fresh]
        start = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0] if len(keys) else np.zeros(0, "int64")
        count = np.diff(np.append(start, len(keys)))
        least = np.repeat(ids[start], count)
        name = np.repeat(np.add.reduceat(mixed(ids, 40), start) if len(keys) else np.zeros(0, "uint64"), count).view("int64")
        many = np.repeat(count, count)
        keep = many > 1
        rows = np.unique(np.stack([np.where(many > 2, name, 0), many > 2, least, ids], axis=1)[keep], axis=0)
        rows = rows[(rows[:, 1] == 1) | (rows[:, 2] != rows[:, 3])]
        return pa.RecordBatch.from_arrays([pa.array(rows[:, 0], mask=rows[:, 1] == 0), pa.array(rows[:, 2]), pa.array(rows[:, 3])], names=["block", "a", "b"])

    for b in batches:
        keys, ids = np.concatenate([keys, b.column("block").to_numpy()]), np.concatenate([ids, b.column("id").to_numpy()])
        last = np.searchsorted(keys, keys[-1]) if len(keys) else 0
        if last:
            yield closed(keys[:last], ids[:last])
            keys, ids = keys[last:], ids[last:]
    yield closed(keys, ids)


def verified(pairs: DataFrame, sets_of: Callable[[DataFrame], DataFrame], rule: Rule) -> DataFrame:
    """The pairs (a, b) that link: by their points first, which bound the overlap, then by the sets themselves."""

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = b.column("s")
            flat, at = flattened(s)
            found = [point_of(flat[at[k] : at[k + 1]]).tobytes() for k in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column("id"), s, pa.array(found, pa.binary())], names=["id", "s", "p"])

    asked = written(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "asked")
    some = written(sets_of(asked).mapInArrow(points, "id long, s array<long>, p binary"), "sets")
    a = some.select(F.col("id").alias("a"), F.size("s").alias("n_a"), F.col("p").alias("p_a"))
    b = some.select(F.col("id").alias("b"), F.size("s").alias("n_b"), F.col("p").alias("p_b"))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            p, q = (np.frombuffer(b"".join(x.column(c).to_pylist()), "int32").reshape(-1, POINT) for c in ("p_a", "p_b"))
            total = x.column("n_a").to_numpy().astype("int64") + x.column("n_b").to_numpy()
            near = np.minimum(p, q).sum(axis=1) >= rule.least(total)
            yield pa.RecordBatch.from_arrays([x.column("a").filter(pa.array(near)), x.column("b").filter(pa.array(near))], names=["a", "b"])

    close = pairs.join(a, "a").join(b, "b").select("a", "b", "n_a", "n_b", "p_a", "p_b").mapInArrow(bound, "a long, b long")
    sa, sb = some.select(F.col("id").alias("a"), F.col("s").alias("s_a")), some.select(F.col("id").alias("b"), F.col("s").alias("s_b"))
    both = close.join(sa, "a").join(sb, "b").select("a", "b", "s_a", "s_b", F.size(F.array_intersect("s_a", "s_b")).alias("shared"))
    links = written(both.where(F.col("shared") * rule.over >= (F.size("s_a") + F.size("s_b") - F.col("shared")) * rule.under).select("a", "b"), "verified")
    forget(some)
    return links


def flattened(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists, and where each list begins and ends among them."""
    return column.flatten().to_numpy(), column.offsets.to_numpy() - column.offsets[0].as_py()


def tree_links(left: DataFrame, sets_of: Callable[[DataFrame], DataFrame], rule: Rule, chunk: int) -> DataFrame:
    """Links ``a, b`` between components, by their numbers, that box trees find: with those that are there they give all.

    ``left``: ``id, component, least``, the members of open blocks with the least member of each. Blocks that share members
    are one group, so a set goes to one group only. A group is dealt to pieces: components of more than ``chunk`` members
    to pieces of their own, the others by component. Two pieces meet in one task unless they are of one component. Long
    sets count as several members.
    """
    groups = components(left.select(F.col("least").alias("a"), F.col("id").alias("b")))
    member = left.select("id", "component").distinct()
    ids = written(member.select("id"), "asked")
    sets = sets_of(ids).withColumn("weight", 1 + F.floor(F.size("s") / 1024))
    placed = written(member.join(groups.select(F.col("node").alias("id"), F.col("component").alias("group")), "id").join(sets, "id"), "sets")
    weights = placed.groupBy("group", "component").agg(F.sum("weight").alias("w"))
    own = weights.where(F.col("w") > chunk).select("group", "component", F.ceil(F.col("w") / chunk).alias("own"))
    rest = weights.where(F.col("w") <= chunk).groupBy("group").agg(F.ceil(F.sum("w") / chunk).alias("rest"))
    dealt = placed.join(own, ["group", "component"], "left").join(rest, "group", "left")
    piece = F.when(F.col("own").isNull(), F.struct(F.lit(-1).cast("long").alias("of"), F.pmod(F.xxhash64("component"), F.col("rest")).alias("nth")))
    dealt = dealt.withColumn("piece", piece.otherwise(F.struct(F.col("component").alias("of"), F.pmod(F.xxhash64("id"), F.col("own")).alias("nth"))))
    pieces = written(dealt.select("group", "piece").distinct(), "pieces")
    met = pieces.alias("x").join(pieces.alias("y"), "group").where("x.piece <= y.piece and (x.piece.of <> y.piece.of or x.piece.of = -1)")
    cells = met.select("group", F.col("x.piece").alias("x"), F.col("y.piece").alias("y"))
    cells = written(cells.select("group", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("piece")), "cells")

    def join(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        names, comp = np.unique(table["component"].to_numpy(), return_inverse=True)
        flat, at = flattened(table["s"].combine_chunks())
        rows = [flat[at[k] : at[k + 1]] for k in range(len(comp))]
        out = forest(rows, comp, rule) if comp.max(initial=0) else []
        ends = [sorted((int(names[comp[i]]), int(names[comp[j]]))) for i, j in out]
        return pa.table({"a": pa.array([x for x, _ in ends], pa.int64()), "b": pa.array([y for _, y in ends], pa.int64())})

    grid = dealt.select("group", "piece", "component", "s").join(cells, ["group", "piece"])
    links = written(grid.groupBy("group", "x", "y").applyInArrow(join, "a long, b long"), "tree-links")
    forget(placed)
    return links


def forest(sets: list[np.ndarray], comp: np.ndarray, rule: Rule) -> list[tuple[int, int]]:
    """Links between rows of different components, by a box tree: verified on the sets, fewer than there are components."""
    sizes = np.array([len(s) for s in sets], "int64")
    tree = BoxTree(np.array([point_of(s) for s in sets]), sizes, comp)
    fine: dict[int, np.ndarray] = {}
    label, out = np.arange(comp.max() + 1), []

    def root(x: int) -> int:
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for i, j in tree.pairs(rule):
        for a, b in zip(i.tolist(), j.tolist()):
            if (x := root(comp[a])) == (y := root(comp[b])):
                continue
            for k in (a, b):  # sixteen times as many coordinates leave few pairs that do not link
                if k not in fine:
                    fine[k] = point_of(sets[k], 16 * POINT).astype("uint16" if sizes[k] < 65536 else "int32")
            need = rule.least(sizes[a] + sizes[b])
            if int(np.minimum(fine[a], fine[b]).sum(dtype="int64")) >= need and len(np.intersect1d(sets[a], sets[b], assume_unique=True)) >= need:
                label[max(x, y)] = min(x, y)
                out.append((a, b))
    return out
