"""Audit of how the sources of a language diverge, in whole numbers throughout.

Texts are cut at the byte level; xxhash groups the words of a chunk, and every word's bytes are held against those of its
group. What is counted becomes sparse matrices, terms by sources, in slices of a language's terms; the divergences of a
slice are sums over segments of its entries, and slices add up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.bytewords import LETTERS, Words, chunks, cut, flat
from lodestone.llm.common import written

#: Whole units that probabilities are counted in.
UNIT = 1_000_000_000
#: Cells of a dense piece of a slice.
CELLS = 1 << 18


def grouped(words: Words, digest: Callable[[bytes], int] = xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, np.ndarray]:
    """For each word the number of its group, and a first word of each group: equal bytes, one group.

    Words group by their hash; then each is compared with the first of its group, byte by byte, and those that differ
    from it (hashes that collide) are grouped by their bytes.
    """
    raw, hashes = words.data.tobytes(), np.empty(len(words.starts), np.uint64)
    for at in range(0, len(hashes), 1 << 17):
        part = slice(at, at + (1 << 17))
        hashes[part] = [digest(raw[s:e]) for s, e in zip(words.starts[part].tolist(), words.ends[part].tolist(), strict=True)]
    _, first, group = np.unique(hashes, return_index=True, return_inverse=True)
    lengths = words.ends - words.starts
    like = first[group]
    odd = lengths != lengths[like]
    same = np.flatnonzero(~odd & (like != np.arange(len(like))))
    for at in range(0, len(same), 1 << 17):
        some = same[at : at + (1 << 17)]
        differ = words.data[flat(words.starts[some], lengths[some])] != words.data[flat(words.starts[like[some]], lengths[some])]
        if differ.any():
            odd[some[np.add.reduceat(differ, np.cumsum(lengths[some]) - lengths[some]) > 0]] = True
    apart: dict[tuple[int, bytes], int] = {}
    for i in np.flatnonzero(odd).tolist():
        key = (int(group[i]), raw[words.starts[i] : words.ends[i]])
        if key not in apart:
            apart[key] = len(first)
            first = np.append(first, i)
        group[i] = apart[key]
    return group, first


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, source, text`` to ``lang, source, term, n, docs``: occurrences, and rows that hold the term."""
    for batch in chunks(batches, "text"):
        words = cut(batch.column("text"), LETTERS)
        if not len(words.starts):
            continue
        group, first = grouped(words)
        size = len(first)
        in_row, n = np.unique(words.rows * size + group, return_counts=True)
        kinds = pa.StructArray.from_arrays([batch.column("lang"), batch.column("source")], ["lang", "source"])
        names, kind = np.unique([f"{len(x['lang'])}:{x['lang']}{x['source']}" for x in kinds.to_pylist()], return_inverse=True)
        some = np.zeros(len(names), np.int64)
        some[kind] = np.arange(batch.num_rows)  # a row of each kind
        key = kind[in_row // size] * size + in_row % size
        order = np.argsort(key, kind="stable")
        key = key[order]
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        at, term = some[key[starts] // size], first[key[starts] % size]
        lengths = words.ends[term] - words.starts[term]
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        terms = pa.StringArray.from_buffers(len(term), pa.py_buffer(offsets), pa.py_buffer(words.data[flat(words.starts[term], lengths)]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("lang").take(pa.array(at)), batch.column("source").take(pa.array(at)), terms, pa.array(np.add.reduceat(n[order], starts)), pa.array(np.diff(np.append(starts, len(key))))],
            ["lang", "source", "term", "n", "docs"],
        )


def share(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """``1 + floor(UNIT * (count + 1) / total)``, by long division in steps of 1000 so that 64 bits hold every step."""
    rest, out = np.asarray(count, np.int64) + 1, np.zeros(1, np.int64)
    out, rest = np.divmod(rest, total)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + more
    return out + 1


def excess(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def slice_divergence(terms: pa.Table, groups: pa.Table, block_sources: int, top: int) -> pa.Table:
    """The share of a slice of terms in the divergence of each source of a block from each source of the language.

    ``terms``: ``lang, block, term, n, sources, counts`` (a row of the sparse matrix); ``groups``: ``source, nth, total,
    lang_total`` with ``total`` a source's occurrences plus the number of kept terms. Out: ``lang, source, part, item,
    value``: sums over the slice for pairs, and the ``top`` terms of each source.
    """
    lang, block = terms["lang"][0].as_py(), terms["block"][0].as_py()
    groups = groups.sort_by("nth")
    total = groups["total"].to_numpy()
    names, base = groups["source"].combine_chunks(), share(np.zeros(len(total), np.int64), total)
    mine = np.arange(block * block_sources, min(len(total), (block + 1) * block_sources))
    acc = np.zeros((len(mine), len(total)), np.int64)
    lists = terms["sources"].combine_chunks()
    indptr = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    cols = pc.index_in(lists.flatten(), value_set=names).to_numpy(zero_copy_only=False).astype(np.int64)
    count = terms["counts"].combine_chunks().flatten().to_numpy()
    p = share(count, total[cols])
    of_term = np.repeat(np.arange(len(indptr) - 1), np.diff(indptr))
    step = max(1, CELLS // len(total))
    for low in range(0, terms.num_rows, step):
        high = min(terms.num_rows, low + step)
        at = slice(indptr[low], indptr[high])
        c, t, v = cols[at], of_term[at] - low, p[at]
        q = np.broadcast_to(base, (high - low, len(total))).copy()
        q[t, c] = v
        there = np.zeros(q.shape, bool)
        there[t, c] = True
        order = np.argsort(c, kind="stable")  # entries by source
        c, t, v = c[order], t[order], v[order]
        for piece in range(0, len(c), step):
            ci, ti, vi = (x[piece : piece + step] for x in (c, t, v))
            segments = np.flatnonzero(np.diff(ci, prepend=-1))
            ids = ci[segments]
            # the source of a block has the term: against every source, with the term or without
            own = (ids >= mine[0]) & (ids <= mine[-1])
            if own.any():
                acc[ids[own] - mine[0]] += np.add.reduceat(excess(vi[:, None], q[ti]), segments, axis=0)[own]
            # only the other source has it
            lone = excess(base[mine][None, :], vi[:, None])
            lone[there[ti][:, mine]] = 0
            acc[:, ids] += np.add.reduceat(lone, segments, axis=0).T
        without = (~there).astype(np.float64)  # neither has it: whole numbers far below 2**53
        acc += (without[:, mine].T @ without).astype(np.int64) * excess(base[mine][:, None], base[None, :])
    i, j = (x.ravel() for x in np.meshgrid(mine, np.arange(len(total)), indexing="ij"))
    keep = i != j
    # terms that a source has more of than its language
    own = (cols >= mine[0]) & (cols <= mine[-1])
    q = share(terms["n"].to_numpy(), groups["lang_total"][0].as_py())[of_term]
    more = np.flatnonzero(own & (p > q))
    value = excess(p[more], q[more])
    ranks = np.empty(terms.num_rows, np.int64)
    ranks[pc.sort_indices(terms["term"].combine_chunks()).to_numpy()] = np.arange(terms.num_rows)
    order = np.lexsort((ranks[of_term[more]], -value, cols[more]))
    nth = np.arange(len(order)) - np.searchsorted(cols[more][order], cols[more][order], side="left")
    order = order[nth < top]
    more, value = more[order], value[order]
    both = lambda a, b: pa.concat_arrays([names.take(pa.array(a)), b])
    return pa.table({
        "lang": pa.array([lang] * (int(keep.sum()) + len(more)), pa.string()),
        "source": pa.concat_arrays([names.take(pa.array(i[keep])), names.take(pa.array(cols[more]))]),
        "part": pa.array(["pair"] * int(keep.sum()) + ["term"] * len(more), pa.string()),
        "item": both(j[keep], terms["term"].combine_chunks().take(pa.array(of_term[more]))),
        "value": pa.array(np.concatenate([acc[i[keep] - mine[0], j[keep]], value])),
    })


def divergences(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 3, top: int = 200, slice_entries: int = 1 << 14, block_sources: int = 256) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far each source is from the others of its language, and by which terms.

    Terms are runs of letters and of all that is not ASCII, A-Z lower-cased; a language keeps the V terms that at least
    ``least_docs`` of its rows hold. With N the occurrences of kept terms, a kept term has ``p = 1 + floor(10**9 * (count + 1)
    / (N + V))`` in a source and in the language. Part ``pair``: the sum over all kept terms of ``floor((p - q)**2 / q)``,
    with q the other source's, for every two sources; 0 if V is 0. Part ``term``: that value with q the language's, of terms
    that the source has and of which p > q, the ``top`` of each source. Ranks go by value, then by the item's bytes.

    Null text, lang and source are read as empty; sources without terms (only empty texts, say) take part with counts of 0;
    a language of one source has no pairs; rows that repeat an id are rows like others, and ids are not looked at. An empty
    table gives no rows. Other columns are ignored.

    Counts combine in each chunk and in each task before they are shuffled by term, so neither a hot source nor a hot term
    gathers rows. A term with its counts by source is a row of at most as many entries as the language has sources. Slices
    hold about ``slice_entries`` entries and are compared for ``block_sources`` sources at a time; the rows of a pair are as
    many as its result and one sum for each slice. Sums stay within 64 bits while a language keeps less than 10**9 terms.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(empty(lang_col).alias("lang"), empty(source_col).alias("source"), empty(text_col).alias("text"))
    found = rows.mapInArrow(counted, "lang string, source string, term string, n long, docs long")
    found = found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = found.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("e"))
    kept = written(by_term.where(F.col("docs") >= least_docs).select("lang", "term", "n", F.col("e.source").alias("sources"), F.col("e.n").alias("counts")), "kept-terms")

    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("n_lang"), F.sum(F.size("sources")).alias("entries"))
    sums = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("e")).groupBy("lang", F.col("e.sources").alias("source")).agg(F.sum("e.counts").alias("n"))
    groups = rows.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    numbered = groups.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1).withColumn("of", F.count("*").over(Window.partitionBy("lang")))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    groups = written(numbered.select("lang", "source", "nth", "of", (zero("n") + zero("v")).alias("total"), (zero("n_lang") + zero("v")).alias("lang_total"), F.greatest(F.lit(1), F.ceil(zero("entries") / slice_entries)).alias("slices")), "groups")

    sizes = groups.groupBy("lang").agg(F.first("slices").alias("slices"), F.ceil(F.first("of") / block_sources).alias("blocks"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    left = kept.join(sizes, "lang").withColumn("slice", F.pmod(F.xxhash64("term"), "slices")).withColumn("block", every(F.col("blocks"))).drop("slices", "blocks")
    right = groups.join(sizes.select("lang", "blocks"), "lang").withColumn("slice", every(F.col("slices"))).withColumn("block", every(F.col("blocks"))).select("lang", "slice", "block", "source", "nth", "total", "lang_total")

    schema = "lang string, source string, part string, item string, value long"
    nothing = pa.table({c.split()[0]: pa.array([], pa.int64() if c.endswith("long") else pa.string()) for c in schema.split(", ")})

    def compared(terms: pa.Table, sources: pa.Table) -> pa.Table:
        return slice_divergence(terms, sources, block_sources, top) if terms.num_rows else nothing

    keys = ["lang", "slice", "block"]
    parts = written(left.groupBy(keys).cogroup(right.groupBy(keys)).applyInArrow(compared, schema), "divergences")
    a, b = groups.select("lang", "source"), groups.select("lang", F.col("source").alias("item"))
    sums = parts.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = a.join(b, "lang").where("source <> item").join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    terms = ranked(parts.where("part = 'term'")).where(F.col("rank") <= top)
    return ranked(pairs).unionByName(terms)
