"""SentencePiece encoding and decoding as a weighted finite-state transducer.

A model file is compiled into a normaliser (spaces become a visible mark, one is put in front), a piece transducer and the
byte fallback. Composed with an input they give a lattice of pieces; its shortest path in the tropical semiring is the
encoding. For unigram models arcs weigh minus the piece's score. For BPE models no weights on single pieces give the
result of merging, but an acceptor over neighbouring pieces does: a segmentation is what merging produces if and only if
merging leaves each two neighbours as they are, so the acceptor weighs such pairs zero and all others infinity, and one
path remains.

Marks begin pieces only, so the lattice falls apart at words. The different words of a slice of texts are composed with the
transducer together, one place at a time, as arrays; long words are composed alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
#: Words whose encodings a worker keeps, at most; slots for pairs of pieces (9 bytes each).
KEPT = 150_000
PAIRS = 1 << 21
#: Characters that are encoded together, and the longest word composed with others.
SLICE = 400_000
LONG = 48


#: Odd numbers that spread keys; any others would do.
SPREAD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def word_hashes(codes: np.ndarray, first: np.ndarray, size: np.ndarray, base: int) -> np.ndarray:
    """A polynomial hash of each word: differences of running sums, moved to the same power."""
    power = np.full(len(codes) + 1, base, "uint64")
    power[0] = 1
    power = np.cumprod(power)
    back = np.full(len(codes) + 1, pow(base, -1, 2**64), "uint64")
    back[0] = 1
    back = np.cumprod(back)
    sums = np.concatenate([np.zeros(1, "uint64"), np.cumsum((codes.astype("uint64") + np.uint64(0x9E3779B9)) * power[:-1])])
    h = (sums[first + size] - sums[first]) * back[first]
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9) ^ size.astype("uint64")


class Transducer:
    """A compiled model; ``encode`` and ``decode`` are each other's inverse for what the normaliser leaves unchanged."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        rule, kinds = proto.normalizer_spec, pb.ModelProto.SentencePiece
        if rule.precompiled_charsmap or rule.remove_extra_whitespaces or not rule.escape_whitespaces:
            raise ValueError("only models whose normaliser marks spaces and changes nothing else are compiled")
        if proto.trainer_spec.model_type not in (1, 2):
            raise ValueError("only unigram and BPE models are compiled")
        if proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("marks must stand before words")
        self.prefix = MARK if rule.add_dummy_prefix else ""
        self.bpe = proto.trainer_spec.model_type == 2
        self.ids, self.scores, self.unknown, self.bytes = {}, {}, 0, {}
        self.out: list[bytes] = []
        for i, p in enumerate(proto.pieces):
            if p.type in (kinds.USER_DEFINED, kinds.UNUSED):
                raise ValueError("models with pieces that are user-defined or unused are not compiled")
            if p.type == kinds.NORMAL:
                self.ids[p.piece], self.scores[p.piece] = i, p.score
                self.out.append(p.piece.replace(MARK, " ").encode())
            elif p.type == kinds.BYTE:
                self.bytes[int(p.piece[3:5], 16)] = i
                self.out.append(bytes([int(p.piece[3:5], 16)]))
            else:
                if p.type == kinds.UNKNOWN:
                    self.unknown = i
                self.out.append(b" \xe2\x81\x87 " if p.type == kinds.UNKNOWN else b"")
        self.longest = max(map(len, self.ids), default=1)
        # The states of the piece transducer: beginnings of pieces, -1, and whole pieces, their ids.
        self.arcs = {p[:k]: -1 for p in self.ids for k in range(1, len(p))} | self.ids
        self.far = min(self.scores.values(), default=0.0) - 10.0
        # Marks stand at the start of pieces only, so no piece crosses from another character to a mark.
        self.split = not any(MARK in p.lstrip(MARK) for p in self.ids)
        self.names = [p.piece for p in proto.pieces]
        self.tables()

    def tables(self) -> None:
        """The piece transducer as arrays: a hash table of arcs (state, character), and the piece that each state ends."""
        states = {"": 0} | {x: k for k, x in enumerate(self.arcs, 1)}
        self.piece_at = np.array([-1, *self.arcs.values()], "int32")
        self.weight = np.array([-self.scores.get(x, 0.0) for x in self.names])
        keys = np.array([states[x[:-1]] << 21 | ord(x[-1]) for x in self.arcs], "uint64")
        size = 1 << max(4, (4 * len(keys)).bit_length())
        self.shift = np.uint64(65 - size.bit_length())
        self.arc_keys, self.arc_to = np.full(size, 2**64 - 1, "uint64"), np.full(size, -1, "int32")
        left, slot = np.arange(len(keys)), self.slots(keys)
        while len(left):  # the first of those that want a slot gets it, the others try the next
            free = self.arc_to[slot] < 0
            won = np.zeros(len(left), bool)
            won[np.unique(np.where(free, slot, size), return_index=True)[1]] = True
            won &= free
            self.arc_keys[slot[won]], self.arc_to[slot[won]] = keys[left[won]], left[won] + 1
            left, slot = left[~won], (slot[~won] + 1) % size
        self.pair_keys, self.pair_ok = np.full(PAIRS, -1, "int64"), np.zeros(PAIRS, bool)
        self.forget()

    def forget(self) -> None:
        self.kept = [np.zeros(0, "uint64"), np.zeros(0, "uint64"), np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0, "int32")]

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(SPREAD[0])) >> self.shift).astype("int64")

    def follow(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The states that arcs lead to, or -1."""
        keys = state.astype("uint64") << np.uint64(21) | char.astype("uint64")
        at, out = self.slots(keys), np.full(len(keys), -1, "int32")
        left = np.arange(len(keys))
        while len(left):
            have = self.arc_keys[at[left]]
            hit = have == keys[left]
            out[left[hit]] = self.arc_to[at[left[hit]]]
            left = left[~hit & (self.arc_to[at[left]] >= 0)]
            at[left] = (at[left] + 1) % len(self.arc_to)
        return out

    def accepted(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``accepts`` for pieces by number; -1 on the left stands for the start."""
        keys = (left.astype("int64") + 1) * len(self.names) + right
        at = ((keys.astype("uint64") * np.uint64(SPREAD[1])) >> np.uint64(65 - PAIRS.bit_length())).astype("int64")
        ok, missing = self.pair_ok[at], self.pair_keys[at] != keys
        if missing.any():
            new, back = np.unique(keys[missing], return_inverse=True)
            pairs = ((int(k) // len(self.names) - 1, int(k) % len(self.names)) for k in new)
            found = np.array([self.accepts(self.names[a] if a >= 0 else "", self.names[b]) for a, b in pairs])
            ok[missing] = found[back]
            self.pair_keys[at[missing]], self.pair_ok[at[missing]] = keys[missing], ok[missing]
        return ok

    def normal(self, text: str) -> str:
        return self.prefix + text.replace(" ", MARK) if text else ""

    def merged(self, text: str) -> list[str]:
        """What merging makes of a short text: the best piece first, of equal ones the leftmost."""
        parts, score = list(text), self.scores.get
        joins = [score(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            best, at = None, -1
            for k, x in enumerate(joins):
                if x is not None and (best is None or x > best):
                    best, at = x, k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del joins[at]
            if at < len(joins):
                joins[at] = score(parts[at] + parts[at + 1])
            if at:
                joins[at - 1] = score(parts[at - 1] + parts[at])

    def accepts(self, left: str, right: str) -> bool:
        """Whether the acceptor lets ``right`` follow ``left``; the empty text stands for the start or a fallback."""
        return self.merged(left + right) == ([left, right] if left else [right])

    def fallback(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode("utf-8", "replace")] if self.bytes else [self.unknown]

    def shortest(self, text: str) -> tuple[int, ...]:
        """The shortest path through the lattice of a chunk."""
        return self.only_path(text) if self.bpe else self.best_path(text)

    def only_path(self, text: str) -> tuple[int, ...]:
        """With the acceptor: each place has one piece that a path with finite weight can end in, whatever follows."""
        arcs, known, size = self.arcs.get, {}, len(text)
        last: list[str | None] = [""] + [None] * size
        for start in range(size):
            before = last[start]
            if before is None:
                continue
            for end in range(start + 1, size + 1):
                piece = text[start:end]
                i = arcs(piece)
                if i is None:
                    break
                if i >= 0 and last[end] is None:
                    if (before, piece) not in known:
                        known[before, piece] = bool(self.accepted(np.array([self.ids[before] if before else -1]), np.array([i]))[0])
                    if known[before, piece]:
                        last[end] = piece
            if last[start + 1] is None and text[start] not in self.ids:
                last[start + 1] = ""
        out, end = [], size
        while end:
            piece = last[end]
            if piece:
                out.append([self.ids[piece]])
                end -= len(piece)
            else:
                out.append(self.fallback(text[end - 1]))
                end -= 1
        return tuple(i for part in reversed(out) for i in part)

    def best_path(self, text: str) -> tuple[int, ...]:
        """Without it: least sum of weights; of equal paths the one with the longer last piece."""
        cost, back = [0.0] + [float("inf")] * len(text), [0] * (len(text) + 1)
        for end in range(1, len(text) + 1):
            for start in range(max(0, end - self.longest), end):
                score = self.scores.get(text[start:end])
                if score is None and start == end - 1:
                    score = self.far
                if score is not None and cost[start] - score < cost[end]:
                    cost[end], back[end] = cost[start] - score, start
        out, end = [], len(text)
        while end:
            piece = text[back[end] : end]
            out.append([self.ids[piece]] if piece in self.ids else self.fallback(piece))
            end = back[end]
        return tuple(i for part in reversed(out) for i in part)

    def together(self, codes: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shortest paths of many words (rows of characters, padded): all ids in turn, and how many each word has."""
        n, width = codes.shape
        cost = np.full((n, width + 1), np.inf)
        cost[:, 0] = 0
        last, long = np.full((n, width + 1), -1, "int32"), np.zeros((n, width + 1), "int8")
        one = self.follow(np.zeros(codes.size, "int32"), codes.ravel())
        single = ((one >= 0) & (self.piece_at[one] >= 0)).reshape(codes.shape)
        far = 0.0 if self.bpe else -self.far
        for start in range(width):
            row = np.nonzero((cost[:, start] < np.inf) & (size > start))[0]
            state = np.zeros(len(row), "int32")
            for end in range(start + 1, min(width, start + self.longest) + 1):
                some = size[row] >= end
                row, state = row[some], self.follow(state[some], codes[row[some], end - 1])
                row, state = row[state >= 0], state[state >= 0]
                if not len(row):
                    break
                piece = self.piece_at[state]
                at, piece = row[piece >= 0], piece[piece >= 0]
                weight = np.where(self.accepted(np.maximum(last[at, start], -1), piece), 0.0, np.inf) if self.bpe else self.weight[piece]
                better = cost[at, start] + weight < cost[at, end]
                at, piece = at[better], piece[better]
                cost[at, end], last[at, end], long[at, end] = cost[at, start] + weight[better], piece, end - start
            row = np.nonzero((cost[:, start] < np.inf) & (size > start))[0]
            row = row[~single[row, start] & (cost[row, start] + far < cost[row, start + 1])]
            cost[row, start + 1], last[row, start + 1], long[row, start + 1] = cost[row, start] + far, -2 - codes[row, start].astype("int32"), 1
        out, count, at, rows = np.zeros((n, width), "int32"), np.zeros(n, "int64"), size.copy(), np.arange(n)
        while (open_ := at > 0).any():
            r = rows[open_]
            out[r, count[r]] = last[r, at[r]]
            at[r] -= long[r, at[r]]
            count[r] += 1
        back = count[:, None] - 1 - np.arange(width)
        flat = np.take_along_axis(out, np.maximum(back, 0), axis=1)[back >= 0]
        if not (flat < 0).any():
            return flat, count
        chars, which = np.unique(flat[flat < 0], return_inverse=True)
        ids = [self.fallback(chr(-2 - int(c))) for c in chars]
        many = np.ones(len(flat), "int64")
        many[flat < 0] = np.array([len(x) for x in ids])[which]
        starts = np.cumsum([0, *map(len, ids)])[:-1]
        of = np.zeros(len(flat), "int64")
        of[flat < 0] = starts[which]
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        wide = np.repeat(flat, many)
        wide[wide < 0] = np.array([i for x in ids for i in x], "int32")[(np.repeat(of, many) + nth)[wide < 0]]
        word = np.repeat(np.arange(n), count)
        return wide, np.bincount(word, many, n).astype("int64")

    def of_words(self, codes: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For words at ``first`` of ``size`` characters: where their ids begin in the third array, how many, and all ids."""
        offset, count, flat, have = np.zeros(len(first), "int64"), np.zeros(len(first), "int64"), [], 0
        low = 0
        for high in (4, 7, 10, 14, 20, 32, LONG):
            word = np.nonzero((size > low) & (size <= high))[0]
            low = high
            for part in np.array_split(word, len(word) // 20_000 + 1):
                at = np.minimum(first[part][:, None] + np.arange(high), len(codes) - 1)
                padded = np.where(np.arange(high) < size[part][:, None], codes[at], 0)
                ids, n = self.together(padded, size[part])
                offset[part], count[part] = have + np.cumsum(n) - n, n
                flat.append(ids)
                have += len(ids)
        for k in np.nonzero(size > LONG)[0]:
            ids = self.shortest(codes[first[k] : first[k] + size[k]].astype("<u4").tobytes().decode("utf-32-le", "replace"))
            offset[k], count[k] = have, len(ids)
            flat.append(np.array(ids, "int32"))
            have += len(ids)
        return offset, count, np.concatenate([np.zeros(0, "int32"), *flat])

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in turn, and how many each has."""
        normal = [self.normal(t) for t in texts]
        ends = np.cumsum([len(x) for x in normal], dtype="int64")
        codes = np.frombuffer("".join(normal).encode("utf-32-le", "replace"), "<u4").astype("uint32")
        if not len(codes):
            return np.zeros(0, "int32"), np.zeros(len(texts), "int64")
        mark = codes == ord(MARK)
        start = mark & ~np.concatenate([[False], mark[:-1]]) if self.split else np.zeros(len(codes), bool)
        start[0] = True
        start[ends[ends < len(codes)]] = True
        first = np.nonzero(start)[0]
        size = np.diff(np.append(first, len(codes)))
        a, b = (word_hashes(codes, first, size, base) for base in SPREAD[:2])
        _, rep, word = np.unique(a, return_index=True, return_inverse=True)
        keys, check = a[rep], b[rep]
        if (check[word] != b).any():  # two words with one hash: none is taken for another
            rep = word = np.arange(len(first))
            keys, check = np.zeros(len(first), "uint64"), np.zeros(len(first), "uint64")
            self.forget()
        kept_a, kept_b, kept_offset, kept_count, kept_ids = self.kept
        at = np.minimum(np.searchsorted(kept_a, keys), max(len(kept_a) - 1, 0))
        known = (kept_a[at] == keys) & (kept_b[at] == check) if len(kept_a) else np.zeros(len(keys), bool)
        new = np.nonzero(~known)[0]
        offset, count, ids = np.zeros(len(keys), "int64"), np.zeros(len(keys), "int64"), kept_ids
        offset[known], count[known] = (x[at[known]] for x in (kept_offset, kept_count)) if len(kept_a) else (0, 0)
        offset[new], count[new], fresh = self.of_words(codes, first[rep[new]], size[rep[new]])
        offset[new] += len(kept_ids)
        ids = np.concatenate([kept_ids, fresh])
        per_word = count[word]
        upto = np.cumsum(per_word)
        out = ids[np.repeat(offset[word] - upto + per_word, per_word) + np.arange(upto[-1])]
        upto_doc = np.concatenate([[0], upto])[np.searchsorted(first, ends)]
        self.keep(keys[new], check[new], offset[new], count[new], ids)
        return out, np.diff(np.concatenate([[0], upto_doc]))

    def keep(self, *new: np.ndarray) -> None:
        """Adds words to those kept; beyond the bounds only those of this slice stay, or none if they are too many."""
        if not len(new[0]) or not new[0].any():
            return
        some = [np.concatenate([x, y]) for x, y in zip(self.kept[:4], new[:4])]
        if len(some[0]) > KEPT or len(new[4]) > 8 * KEPT:
            self.forget()
            return
        order = np.argsort(some[0], kind="stable")
        self.kept = [*(x[order] for x in some), new[4]]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids) -> str:
        """The text of the ids; bytes that are not UTF-8 become U+FFFD."""
        text = b"".join(map(self.out.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def compiled(model: bytes) -> Transducer:
    """Once in each worker."""
    return Transducer(model)


def model_bytes(path: str, most: int = 64_000_000) -> bytes:
    """A model file on the driver; what is sent to the workers is bounded."""
    data = Path(path).read_bytes()
    if len(data) > most:
        raise ValueError(f"a model of {len(data)} bytes; at most {most} are sent to workers")
    return data


def sliced(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in turn, about ``SLICE`` bytes of text at a time; a longer text stands alone."""
    upto = np.cumsum(np.array([x or 0 for x in pc.binary_length(batch.column(at)).to_pylist()], "int64"))
    cuts = np.nonzero(np.diff(upto // SLICE, prepend=0))[0].tolist()
    for i, j in zip([0, *cuts], [*cuts, batch.num_rows]):
        if j > i:
            yield batch.slice(i, j - i)


def encode(docs: DataFrame, model: bytes, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array of int), ``n_tokens`` (int) and ``round_trip`` (whether decoding gives the text again).

    Whole texts are encoded where they are read, without a shuffle. Null texts have null ids, 0 tokens and a null round
    trip, empty ones no ids. Lone surrogates become ``?``. Columns named as the new ones are replaced.
    """
    docs = docs.drop("ids", "n_tokens", "round_trip")
    at = docs.columns.index(text_col)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = compiled(model)
        for batch in batches:
            for b in sliced(batch, at):
                texts = b.column(at).to_pylist()
                null = np.array([x is None for x in texts], bool)
                flat, sizes = fst.encode_all([x or "" for x in texts])
                ends = np.concatenate([[0], np.cumsum(sizes)])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()), mask=pa.array(null))
                same = [None if x is None else fst.decode(flat[i:j].tolist()) == x for x, i, j in zip(texts, ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([*b.columns, ids, pa.array(sizes, pa.int32()), pa.array(same, pa.bool_())], names=[*b.schema.names, "ids", "n_tokens", "round_trip"])

    more = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.IntegerType()), T.StructField("round_trip", T.BooleanType())]
    return docs.mapInArrow(add, T.StructType([*docs.schema.fields, *more]))


def decode(encoded: DataFrame, model: bytes, *, ids_col: str = "ids", into: str = "text") -> DataFrame:
    """``encoded`` with the text of its ids in the column ``into``, which is replaced; null ids give a null text."""
    encoded = encoded.select(*[c for c in encoded.columns if c != into])
    at = encoded.columns.index(ids_col)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = compiled(model)
        for b in batches:
            texts = [None if x is None else fst.decode(x) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, into])

    return encoded.mapInArrow(add, T.StructType([*encoded.schema.fields, T.StructField(into, T.StringType())]))
