"""Byte-level BPE by ranks, on padded numpy matrices.

Pre-tokens (matches of a pattern) that the cache doesn't know are put into matrices, rows of like length together and padded
to the length of the longest. In each round every row looks up the ranks of its adjacent pairs in a hash table (open
addressing, key left * 2**20 + right), merges its leftmost pair of least rank, and the matrix is compacted. Where no pair
that these merges bring forth is of that rank or less, the pairs of that rank further right are the next to be merged; a row
then takes them, from left to right, in the same round. Rows without a pair leave. Pre-tokens of any length go this way.

Defined results: a null text is empty and has no ids; ids decode to the very bytes of the text; other columns pass through and
those named like an output are replaced; repeated rows each get their row; of pairs of one rank the leftmost is merged first; an empty table gives an
empty one; texts of any length are encoded whole.

Scale: no shuffle at all. What is broadcast is the vocabulary's pair table (a few MB, by the vocabulary alone).
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from stoichion.llm.pieces import PieceCache, held, id_lists
from stoichion.llm.textbytes import map_texts, released, small_batches

#: Cells of a matrix, and widths that rows are padded to: one more eighth each.
CELLS = 2_000_000
_NONE = np.int32((1 << 31) - 1)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)

#: Fixed value: unlike the default of the regular expression library, white space is Unicode's property alone.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


def pair_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and merged ids of all pairs of tokens that make up a token, in an open hash table."""
    keys, values = [], []
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                keys.append(left << 20 | right)
                values.append(rank)
    bits = max(4, (4 * len(keys) - 1).bit_length())
    table, merged = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NONE, np.int32)
    key, value = np.array(keys, np.int64), np.array(values, np.int32)
    slot = ((key.astype(np.uint64) * _SPREAD) >> np.uint64(64 - bits)).astype(np.int64)
    while len(key):  # of those that want a free slot, the first gets it
        _, first = np.unique(slot, return_index=True)
        first = first[table[slot[first]] < 0]
        table[slot[first]], merged[slot[first]] = key[first], value[first]
        rest = np.setdiff1d(np.arange(len(key)), first)
        key, value, slot = key[rest], value[rest], (slot[rest] + 1) & ((1 << bits) - 1)
    return table, merged


class MatrixBpe:
    """Ids of pre-tokens given in bytes."""

    def __init__(self, table: np.ndarray, merged: np.ndarray, byte_ids: np.ndarray) -> None:
        self.table, self.merged, self.byte_ids = table, merged, byte_ids
        self.bits = np.uint64(64 - int(len(table) - 1).bit_length())
        self.mask = len(table) - 1

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 20 | right
        slot = ((key.astype(np.uint64) * _SPREAD) >> self.bits).astype(np.int64)
        seen = self.table[slot]
        out = np.where(seen == key, self.merged[slot], _NONE)
        todo = np.nonzero((seen != key) & (seen >= 0))
        while len(todo[0]):
            slot[todo] = at = (slot[todo] + 1) & self.mask
            seen = self.table[at]
            good = seen == key[todo]
            out[tuple(x[good] for x in todo)] = self.merged[at[good]]
            more = ~good & (seen >= 0)
            todo = tuple(x[more] for x in todo)
        return out

    def encode(self, words: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(size, kind="stable")
        ends = size[order]
        at = int(np.searchsorted(ends, 1))
        while at < len(order):
            most = ends[at] + ends[at] // 8 + 1  # rows of one matrix differ in length by so much at most
            to = min(int(np.searchsorted(ends, most, "right")), at + max(1, CELLS // int(most)))
            rows = order[at:to]
            self.matrix(rows, [words[i] for i in rows.tolist()], size[rows], out)
            at = to
        return out

    def matrix(self, rows: np.ndarray, words: list[bytes], size: np.ndarray, out: list[bytes]) -> None:
        ids = np.full((len(rows), int(size.max())), -1, np.int32)
        ids[np.arange(ids.shape[1])[None, :] < size[:, None]] = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        rank = np.full(ids.shape, _NONE)  # of the pair that begins there
        both = ids[:, 1:] >= 0
        rank[:, :-1][both] = self.ranks(ids[:, :-1][both], ids[:, 1:][both])
        while True:
            least = rank.min(axis=1)
            done = least == _NONE
            if done.any():
                data = ids[done]
                for i, row in zip(rows[done].tolist(), data, strict=True):
                    out[i] = row[row >= 0].astype("<u4").tobytes()
                if done.all():
                    return
                rows, ids, rank, least = rows[~done], ids[~done], rank[~done], least[~done]
            merge = self.merges(ids, rank, least)
            ids[merge] = np.broadcast_to(least[:, None], ids.shape)[merge]
            gone = np.zeros_like(merge)
            gone[:, 1:] = merge[:, :-1]
            stay = (ids >= 0) & ~gone
            count = stay.sum(axis=1)
            filled = np.arange(int(count.max()))[None, :] < count[:, None]
            packed = lambda m, none: self.placed(m[stay], filled, none)
            ids, rank, merge = packed(ids, -1), packed(rank, _NONE), packed(merge, False)
            # The pairs that begin and that end with a new id.
            near = merge.copy()
            near[:, :-1] |= merge[:, 1:]
            row, col = np.nonzero(near)
            right = np.where(col + 1 < ids.shape[1], ids[row, np.minimum(col + 1, ids.shape[1] - 1)], -1)
            new, real = np.full(len(row), _NONE), right >= 0
            new[real] = self.ranks(ids[row[real], col[real]], right[real])
            rank[row, col] = new

    @staticmethod
    def placed(values: np.ndarray, filled: np.ndarray, none: int) -> np.ndarray:
        out = np.full(filled.shape, none, values.dtype)
        out[filled] = values
        return out

    def merges(self, ids: np.ndarray, rank: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Where pairs begin that are merged in this round."""
        out = rank == least[:, None]
        if (out[:, 1:] & out[:, :-1]).any():  # of pairs that overlap each other every second one, from the left
            at = np.arange(out.shape[1])[None, :]
            before = np.maximum.accumulate(np.where(out, -1, at), axis=1)
            out &= (at - before) % 2 == 1
        several = np.flatnonzero(out.sum(axis=1) > 1)
        if not len(several):
            return out
        own, part, new = out[several], ids[several], least[several]
        row, col = np.nonzero(own)
        none = np.full(len(row), -1, np.int32)
        left = np.where(col > 0, part[row, np.maximum(col - 1, 0)], none)
        left = np.where((col > 1) & own[row, np.maximum(col - 2, 0)], new[row], left)
        right = np.where(col + 2 < part.shape[1], part[row, np.minimum(col + 2, part.shape[1] - 1)], none)
        early = np.zeros(len(several), bool)
        for a, b in ((left, new[row]), (new[row], right)):
            real = (a >= 0) & (b >= 0)
            early[row[real][self.ranks(a[real], b[real]) <= new[row[real]]]] = True
        single = several[early]
        first = out[single].argmax(axis=1)
        out[single] = False
        out[single, first] = True
        return out


def encode(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", pattern: str = PATTERN, drop_text: bool = True) -> DataFrame:
    """docs with a column of token ids (array<int>) of its text."""
    ranks = load_ranks(vocabulary)
    if max(ranks.values()) >= 1 << 20 or any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("ranks must be below 2**20 and hold every single byte")
    table, merged = pair_table(ranks)
    shared = docs.sparkSession.sparkContext.broadcast((table, merged, np.array([ranks[bytes([b])] for b in range(256)], np.int32)))

    def cache() -> PieceCache:
        bpe, find = MatrixBpe(*shared.value), regex.compile(pattern).findall

        def new(pieces: list[str]) -> list[bytes]:
            parts = [find(x) for x in pieces]
            words = list({w for own in parts for w in own})
            known = dict(zip(words, bpe.encode([w.encode() for w in words]), strict=True))
            return [b"".join(map(known.__getitem__, own)) for own in parts]

        return PieceCache(new)

    def make():
        own = held(("byte_bpe", vocabulary, pattern), cache)
        return lambda texts, _: {ids: id_lists(*own(texts))}

    return map_texts(docs, make, [T.StructField(ids, T.ArrayType(T.IntegerType()))], text, drop_text)


def decode(docs: DataFrame, vocabulary: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """docs with a binary column of the bytes that its ids stand for; null ids give no bytes."""
    ranks = load_ranks(vocabulary)
    size = max(ranks.values()) + 1
    tokens = [b""] * size
    for token, rank in ranks.items():
        tokens[rank] = token
    shared = docs.sparkSession.sparkContext.broadcast(tokens)
    fields = [f for f in docs.schema.fields if f.name != out]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.array(shared.value, object)
        for batch in batches:
            at = batch.schema.names.index(ids)
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                data = [b"" if x.values is None else b"".join(table[x.values.to_numpy(zero_copy_only=False)].tolist()) for x in part.column(at)]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(data, pa.binary())], [*names, out])

    return small_batches(docs).select(*(f"`{n}`" for n in names)).mapInArrow(lambda batches: released(run(batches)), T.StructType([*fields, T.StructField(out, T.BinaryType())]))
