"""Toxicity by compression distance: two small zstandard dictionaries, one of toxic and one of ordinary text.

A window that holds toxic material compresses shorter with the toxic dictionary than with the ordinary one; how many windows
do, for the length of the text, gives a document's score, through a table calibrated on labelled rows that the
dictionaries have not seen.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.bytewords import chunks
from lodestone.llm.common import written

#: Letters only; lower case. Windows and training see the same.
WORD = re.compile(r"[^\W\d_]+")
#: Both dictionaries end with this and every window begins with it, so that each window is a compressed block. Without it
#: zstandard keeps a block raw unless it saves some bytes, and lengths jump.
ANCHOR = bytes(range(1, 25))
#: Shorter prefixes of words say little; zstandard finds matches of 5 bytes here, the space before a word among them.
PREFIXES = range(4, 13)
#: Shortest parts of marks that ordinary words are sought by: what zstandard can match.
PART = 5
#: Rates that the table tells apart, and how many windows in so many bytes make a step; short texts count as so much longer.
RATES, STEP_BYTES, SHORT_BYTES = 64, 5000, 400


def plain(text: str | None) -> str:
    return " ".join(WORD.findall((text or "").lower()))


def windows(text: str, size: int = 60) -> Iterator[bytes]:
    """The whole text as windows of up to ``size`` bytes, cut at words; a word longer than that is cut in pieces that overlap."""
    data = b" " + text.encode() + b" "
    at, end = 0, len(data) - 1
    while at < end:
        if end - at < size:
            yield data[at:]
            return
        cut = data.rfind(b" ", at + 1, at + size)
        if cut > 0:
            yield data[at : cut + 1]
            at = cut
        else:
            yield data[at : at + size]
            at += size - 16


def contexts(text: str) -> Counter:
    """For each prefix of the words of a plain text the number of different words that it stands after: repeats add nothing."""
    seen, before = set(), ""
    for word in text.split():
        word += " "
        seen.update((word[:k], before) for k in PREFIXES if k <= len(word))
        before = word
    return Counter(p for p, _ in seen)


def stems(own: Counter, n_own: int, other: Counter, n_other: int, least: int, ratio: float) -> list[str]:
    """Beginnings of words, ``ratio`` times as frequent in texts of one kind as in the other, grown while four in five
    occurrences agree on the next letter; the most frequent last."""
    marked = [p for p, n in own.items() if n >= least and n / n_own >= ratio * (other[p] + 0.5) / max(n_other, 1)]
    following: dict[str, list[str]] = {}
    for p in own:
        following.setdefault(p[:-1], []).append(p)
    found: set[str] = set()
    for p in sorted(marked, key=lambda p: (len(p), p)):
        if any(s.startswith(p) or p.startswith(s) for s in found):
            continue
        while more := following.get(p):
            longer = max(more, key=lambda q: (own[q], q))
            if own[longer] < 0.8 * own[p]:
                break
            p = longer
        found.add(p)
    return sorted(found, key=lambda p: (own[p], p))


def parts_of(marks: list[str]) -> list[str]:
    """All parts of marks of ``PART`` characters or more, the space before a word among them."""
    return sorted({f" {m}"[i:j] for m in marks for i in range(len(m) + 1) for j in range(i + PART, len(m) + 2)})


def look_alikes(marks: list[str], found: dict[str, str]) -> list[str]:
    """For each place in a mark the ordinary word that holds the longest part from there on; ``found``: a word for each part."""
    words = set()
    for mark in (f" {s}" for s in marks):
        for i in range(len(mark)):
            words |= set([found[mark[i:j]] for j in range(len(mark), i + PART - 1, -1) if mark[i:j] in found][:1])
    return sorted(words)


def dictionaries(toxic_marks: list[str], ordinary_marks: list[str], near: list[str]) -> tuple[bytes, bytes]:
    """The toxic and the ordinary dictionary: the marks of each kind, and at the same places in both the words ``near``.

    So a window's lengths differ by what marks one kind, not by parts of it that ordinary words have as well. zstandard's own
    trainer picks what is frequent in the samples, which both kinds of text share but not to the byte, and that noise drowns
    the difference; so segments are chosen by contrast and loaded as raw dictionaries.
    """
    common = b"\0".join(f" {w} ".encode() for w in near)
    own = [b"\0".join(f" {s}".encode() for s in x) for x in (toxic_marks, ordinary_marks)]
    size = max(map(len, own))
    return tuple(b"\0" + x.rjust(size, b"\0") + b"\0" + common + b"\0" + ANCHOR for x in own)


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    """Exhaustive search, no header: the length is what the window costs."""
    how = zstandard.ZstdCompressionParameters.from_level(
        3, window_log=15, chain_log=14, hash_log=14, search_log=6, min_match=5, target_length=64, strategy=zstandard.STRATEGY_LAZY2,
        write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
    )
    loaded = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    loaded.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=loaded, compression_params=how)


def saved(text: str, toxic: zstandard.ZstdCompressor, ordinary: zstandard.ZstdCompressor) -> tuple[int, int]:
    """The number of windows that the toxic dictionary makes shorter, and the bytes that it saves in them."""
    n = total = 0
    for w in windows(text):
        w = ANCHOR + w
        g = len(ordinary.compress(w)) - len(toxic.compress(w))
        if g > 0:
            n, total = n + 1, total + g
    return n, total


def rate(n: int, text: str) -> int:
    """Windows that save, for the length of the text, in steps from 0 to ``RATES - 1``."""
    return min(RATES - 1, n * STEP_BYTES // (len(text.encode()) + SHORT_BYTES))


@dataclass(frozen=True)
class ToxicityModel:
    """The dictionaries, and the share of toxic rows at each rate."""

    toxic: bytes
    ordinary: bytes
    table: tuple[float, ...]

    def scores(self, texts: list[str | None]) -> Iterator[float]:
        """A probability for each text; the empty text has that of a text without savings."""
        a, b = compressor(self.toxic), compressor(self.ordinary)
        for text in texts:
            text = plain(text)
            n, total = saved(text, a, b)
            total /= len(text) + SHORT_BYTES
            yield 0.999 * self.table[rate(n, text)] + 0.001 * total / (1 + total)


def rising(counts: dict[tuple[int, int], int]) -> tuple[float, ...]:
    """Shares that never fall with the rate (pooled adjacent violators) from counts of (rate, label), with half a row everywhere."""
    rows = [[0.05 + counts.get((r, 1), 0) + 0.02 * r, 0.5 + counts.get((r, 0), 0) + counts.get((r, 1), 0) + 0.02 * r] for r in range(RATES)]
    pools: list[list[float]] = []
    for y, n in rows:
        pools.append([y, n, 1])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            y1, n1, k = pools.pop()
            pools[-1] = [pools[-1][0] + y1, pools[-1][1] + n1, pools[-1][2] + k]
    return tuple(y / n for y, n, k in pools for _ in range(int(k)))


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: tuple[int, int]) -> DataFrame:
    """``text, label, half``: the different plain texts of at most ``rows`` toxic and ordinary labelled ids, those of smallest hash; written."""
    h = F.xxhash64(id_col, F.lit(11))
    some = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(id_col, F.col(label_col).cast("int").alias("_label"))
    some = some.join(docs.select(id_col).distinct(), id_col, "left_semi").distinct()
    picked = [some.where(F.col("_label") == label).orderBy(h, id_col).limit(n) for label, n in ((1, rows[0]), (0, rows[1]))]
    # At most as many rows as ``rows`` says: small enough to be broadcast.
    found = docs.select(id_col, text_col).join(F.broadcast(picked[0].unionByName(picked[1])), id_col).select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col("_label").alias("label"))

    def plainly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(map(plain, b.column("text").to_pylist()), pa.string()), b.column("label")], ["text", "label"])

    texts = found.mapInArrow(plainly, "text string, label int").distinct().withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int"))
    # As many files as a shuffle has parts: a small sample would else be one, and all that is counted in it one task's work.
    return written(texts.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "sample")


def prefix_counts(texts: DataFrame) -> DataFrame:
    """``p, n00, n01, n10, n11``: contexts of each prefix by (half, label), combined in each task; written."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            found: dict[tuple[int, int], Counter] = {}
            for text, label, half in zip(*(b.column(c).to_pylist() for c in ("text", "label", "half")), strict=True):
                found.setdefault((half, label), Counter()).update(contexts(text))
            for (half, label), n in found.items():
                size = len(n)
                yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array([half] * size, pa.int32()), pa.array([label] * size, pa.int32()), pa.array(n.values(), pa.int64())], ["p", "half", "label", "n"])

    each = texts.mapInArrow(counted, "p string, half int, label int, n long")
    of = lambda half, label: F.sum(F.when((F.col("half") == half) & (F.col("label") == label), F.col("n")).otherwise(0)).alias(f"n{half}{label}")
    return written(each.groupBy("p").agg(*[of(h, y) for h in (0, 1) for y in (0, 1)]), "prefixes")


def ordinary_words(texts: DataFrame, marks: list[list[str]]) -> list[dict[str, str]]:
    """For each list of marks an ordinary word (the first by text) for each part of a mark that one without a whole mark holds."""
    parts = sorted({p for m in marks for p in parts_of(m)})
    if not parts:
        return [{} for _ in marks]

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = ahocorasick.Automaton()
        for p in parts:
            known.add_word(p, p)
        known.make_automaton()
        for b in chunks(batches, "text"):
            first: dict[tuple[int, str], str] = {}
            for word in {w for t in b.column("text").to_pylist() for w in t.split()}:
                found = {p for _, p in known.iter(f" {word} ")}
                for k, m in enumerate(marks):
                    if found and not any(f" {s}" in found and f" {word} ".startswith(f" {s}") for s in m):
                        for p in found:
                            first[k, p] = min(word, first.get((k, p), word))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in first], pa.int32()), pa.array([p for _, p in first], pa.string()), pa.array(first.values(), pa.string())], ["k", "p", "word"])

    # A row for each part of a mark at most.
    rows = texts.where("label = 0").select("text").mapInArrow(held, "k int, p string, word string").groupBy("k", "p").agg(F.min("word").alias("word")).collect()
    out: list[dict[str, str]] = [{} for _ in marks]
    for r in rows:
        out[r["k"]][r["p"]] = r["word"]
    return out


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: tuple[int, int] = (1200, 1800), ratio: float = 20.0, marks: int = 400, prefixes: int = 20_000) -> ToxicityModel:
    """Fits a model on a bounded sample: at most ``rows`` labelled toxic and ordinary documents, whole.

    Marks of a kind are beginnings of words (``stems``) that are ``ratio`` times as frequent in its texts; of the ``prefixes`` most
    frequent ones at most ``marks`` become segments of its dictionary. Each half of the sample is scored with dictionaries of the
    other half, and the table is made from that; the model's own dictionaries are made from both.

    The smallest hashes of ids are taken. Null labels do not count, nor labels of ids that ``docs`` does not have. Texts count
    once, however often they repeat; rows that repeat an id are texts of their own. Without labels of both kinds the model
    still works and gives every text one score below 0.5.

    Counts are made where the texts are; what comes to the driver are the ``prefixes`` most frequent candidates, a word for
    each part of a mark, and counts of rates.
    """
    texts = sample(docs, labels, id_col, text_col, label_col, rows)
    counts = prefix_counts(texts)
    number = {(r["half"], r["label"]): r["n"] for r in texts.groupBy("half", "label").agg(F.count("*").alias("n")).collect()}
    total = counts.agg(*[F.sum(c).alias(c) for c in counts.columns[1:]]).first().asDict()
    total = {c: n or 0 for c, n in total.items()}
    chosen = []
    for halves in ((0,), (1,), (0, 1)):
        kinds = []
        for label in (1, 0):
            own, other = (sum((F.col(f"n{h}{y}") for h in halves), F.lit(0)) for y in (label, 1 - label))
            n_own, n_other = (sum(total[f"n{h}{y}"] for h in halves) for y in (label, 1 - label))
            least = max(3, sum(number.get((h, label), 0) for h in halves) // 80)
            # What a mark grows into is four fifths as frequent at least, step by step, so rarer ones are kept as well.
            some = counts.select("p", own.alias("own"), other.alias("other")).where(F.col("own") >= 0.4 * least)
            some = some.where(F.col("own") / max(n_own, 1) >= 0.4 * ratio * (F.col("other") + 0.5) / max(n_other, 1)).orderBy(F.desc("own"), "p").limit(prefixes).collect()
            kinds.append(stems(Counter({r["p"]: r["own"] for r in some}), max(n_own, 1), Counter({r["p"]: r["other"] for r in some}), n_other, least, ratio)[-marks:] if n_other else [])
        chosen.append(kinds)
    words = ordinary_words(texts, [m[0] for m in chosen])
    made = [dictionaries(*m, look_alikes(m[0], w)) for m, w in zip(chosen, words, strict=True)]

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        other = [[compressor(d) for d in made[1 - h]] for h in (0, 1)]
        for b in batches:
            found = [rate(saved(t, *other[h])[0], t) for t, h in zip(b.column("text").to_pylist(), b.column("half").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), b.column("label")], ["rate", "label"])

    found = texts.mapInArrow(rated, "rate int, label int").groupBy("rate", "label").count().collect()
    return ToxicityModel(*made[2], rising({(r["rate"], r["label"]): r["count"] for r in found}))


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (double from 0 to 1) and ``predicted`` (int: 1 from 0.5 on).

    Every whole text is scored, in windows, within the tasks that read it: no shuffle. A null text counts as empty, which
    has the score of a text that saves nothing. Columns named ``score`` or ``predicted`` are replaced.
    """
    docs = docs.drop("score", "predicted")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(model.scores(b.column(b.schema.get_field_index(text_col)).to_pylist()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.float64())], names=[*b.schema.names, "score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(add, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
