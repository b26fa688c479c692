"""Words of many texts at once: a lookup table over the concatenated UTF-8 bytes finds where they begin and end."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are cut at a time; a longer text is cut alone.
CHUNK = 6_000_000


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """True for the bytes of the ranges, and for all bytes of characters beyond ASCII."""
    table = np.zeros(256, bool)
    table[128:] = True
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Letters and all that is not ASCII; with digits as well.
LETTERS = byte_class((0x41, 0x5A), (0x61, 0x7A))
LETTERS_DIGITS = byte_class((0x41, 0x5A), (0x61, 0x7A), (0x30, 0x39))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


@dataclass
class Words:
    """``data``: bytes with A-Z lower-cased; word i is ``data[starts[i]:ends[i]]`` of row ``rows[i]``; rows in order."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    n_rows: int


def cut(texts: pa.Array, table: np.ndarray) -> Words:
    """The words of a column of texts; nulls have none, and no word spans two rows."""
    n = len(texts)
    if not n:
        return Words(np.zeros(0, np.uint8), *(np.zeros(0, np.int64) for _ in range(3)), 0)
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    low, high = int(offsets[0]), int(offsets[-1])
    data = LOWER[np.frombuffer(texts.buffers()[2], np.uint8, high - low, low)] if high > low else np.zeros(0, np.uint8)
    offsets = offsets - low
    inside = table[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges], after[edges - 1] = False, False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return Words(data, starts, ends, np.searchsorted(offsets[:-1], starts, side="right") - 1, n)


def chunks(batches: Iterator[pa.RecordBatch], text_col: str, most: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text, so that memory does not follow the lengths of texts."""
    for batch in batches:
        lengths = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = int(lengths[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(lengths, done + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def flat(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of all bytes of slices, one slice after the other."""
    total = np.cumsum(lengths)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(starts - total + lengths, lengths)
