"""Fingerprints of texts and images, and distances between them."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of a SimHash here: fifteen hex digits of an md5.
BITS = 60


def normalized(text: Column) -> Column:
    """Lower case, without white space and punctuation."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\s\p{P}]+", "")


def fingerprint(text: Column) -> Column:
    return F.sha1(normalized(text))


#: Characters that a task hashes at a time, and grams that one counter of sixteen bits can count.
PIECE, MOST = 1 << 21, (1 << 16) - 1
#: Up to this many different grams are told apart by a table, more by sorting.
TABLE = 1 << 22


def simhash(text: Column, gram: int = 3) -> Column:
    """A bit is set where more grams of the text have it than not; null for texts shorter than a gram.

    In tasks, over Arrow batches: a gram that occurs is hashed once for many texts, and the bits of all grams of a text are
    added up as arrays, four counters in a word. Time goes with the length of the texts.
    """

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        out = np.zeros(len(texts), np.int64)
        lengths = texts.str.len().fillna(0).to_numpy(np.int64)
        some = np.flatnonzero(lengths >= gram)
        # Pieces of whole texts: a new one begins where the texts up to here fill another multiple of PIECE.
        for piece in np.split(some, np.flatnonzero(np.diff(np.cumsum(lengths[some]) // PIECE)) + 1):
            if len(piece):
                out[piece] = simhashes(texts.iloc[piece].tolist(), lengths[piece], gram)
        return pd.Series(pd.arrays.IntegerArray(out, lengths < gram))

    return of(text)


def simhashes(texts: list[str], lengths: np.ndarray, gram: int) -> np.ndarray:
    """Of texts, all with a gram at least."""
    joined = "".join(texts)
    starts = np.cumsum(lengths) - lengths
    number, first = numbered_grams(joined, starts, lengths, gram)
    bits = np.fromiter((int(hashlib.md5(joined[at : at + gram].encode()).hexdigest()[: BITS // 4], 16) for at in first.tolist()), np.uint64, len(first))
    n = lengths - gram + 1
    parts = -(-n // MOST)  # long texts are counted in parts
    own = np.repeat(np.arange(len(n)), parts)
    heads = np.cumsum(parts) - parts
    at = np.repeat(np.cumsum(n) - n, parts) + (np.arange(len(own)) - heads[own]) * MOST
    out = np.zeros(len(n), np.int64)
    for b in range(0, BITS, 4):
        word = sum(((bits >> np.uint64(b + k)) & np.uint64(1)) << np.uint64(16 * k) for k in range(4))
        sums = np.add.reduceat(word[number], at)
        for k in range(4):
            counts = np.add.reduceat((sums >> np.uint64(16 * k)).astype(np.int64) & MOST, heads)
            out |= (counts * 2 > n).astype(np.int64) << (b + k)
    return out


def numbered_grams(joined: str, starts: np.ndarray, lengths: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The number of each gram within a text, in order, and for each number a place where that gram is."""
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    rank = np.zeros(int(codes.max()) + 1, np.int64)
    rank[codes] = 1
    letters = int(rank.sum())
    rank = (np.cumsum(rank) - 1)[codes]
    within = np.ones(len(codes), bool)
    for k in range(1, gram):
        within[starts + lengths - k] = False
    places = np.flatnonzero(within)
    number, size = rank[places], letters
    for k in range(1, gram):
        if size * letters > 1 << 62:
            seen, number = np.unique(number, return_inverse=True)
            size = len(seen)
        number, size = number * letters + rank[places + k], size * letters
    if size > TABLE:
        _, at, number = np.unique(number, return_index=True, return_inverse=True)
        return number, places[at]
    where = np.full(size, -1, np.int64)
    where[number] = places
    seen = np.flatnonzero(where >= 0)
    dense = np.zeros(size, np.int64)
    dense[seen] = np.arange(len(seen))
    return dense[number], where[seen]


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two numbers; 64 where one is missing."""
    return F.coalesce(F.bit_count(a.bitwiseXOR(b)), F.lit(64))


def hex_hamming(a: Column, b: Column) -> Column:
    """Differing bits of two hex texts; 64 where one is missing or no hex."""

    def number(x: Column) -> Column:
        return F.when(x.rlike("^[0-9A-Fa-f]{1,16}$"), F.conv(x, 16, -10).cast("long"))

    return hamming(number(a), number(b))


def bands(x: Column, count: int = 4) -> Column:
    """Slices that cover all 64 bits: hashes that differ in fewer bits than there are slices have one in common."""
    width = -(-64 // count)
    return F.array(*[F.shiftrightunsigned(x, i * width).bitwiseAND((1 << width) - 1) for i in range(count) if i * width < 64])


def average_hash(values: Column) -> Column:
    """Of a grid of luma values those that reach the mean, as booleans in order."""
    mean = F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(values), F.lit(0))
    return F.transform(F.array(F.struct(values.alias("v"), mean.alias("m"))), lambda p: F.transform(p["v"], lambda x: x >= p["m"]))[0]


def packed(flags: Column) -> Column:
    """Up to 64 booleans as the bits of a long, the first one lowest."""
    bit = lambda x, i: F.when(x, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    return F.aggregate(F.transform(flags, bit), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))


def luma(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b
