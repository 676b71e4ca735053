"""Vectorised text primitives on raw UTF-8 bytes, and the Arrow plumbing that feeds them.

Arrow hands a batch of texts over as one byte buffer plus offsets, so word boundaries, word hashes and word
n-gram hashes of a whole batch are a handful of numpy passes; no Python string is made for text that does not hit.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Texts are worked off in groups of about so many bytes, which bounds a worker's memory whatever the batch size;
#: one text longer than this forms a group of its own.
GROUP_BYTES = 1_000_000

_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE_CODE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the hash base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def __reduce__(self):
        return _Powers, ()

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, GROUP_BYTES + 65536)
            for name, base in (("up", _BASE), ("down", _BASE_INV)):
                out = np.full(size, base, np.uint64)
                out[0] = 1
                setattr(self, name, np.multiply.accumulate(out))
        return self.up, self.down


_POWERS = _Powers()


def byte_classes(word: Callable[[int], bool], lower: bool = True) -> np.ndarray:
    """Table byte -> byte as it is hashed (A-Z lower-cased when asked), 0 for bytes outside words."""
    return np.array([(b + 32 if lower and 65 <= b <= 90 else b) if word(b) else 0 for b in range(256)], np.uint8)


#: Words are runs of anything but ASCII white space.
SPACED = byte_classes(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D and b != 0)


class Words:
    """Words of a group of texts: byte positions, 64-bit hashes, and for each text the range of its words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> None:
        self.data = classes[data]
        mask = self.data != 0
        edge = np.zeros(len(mask) + 1, bool)
        edge[offsets[offsets < len(mask)]] = True
        first = mask.copy()
        first[1:] &= ~mask[:-1] | edge[1:-1]
        last = mask.copy()
        last[:-1] &= ~mask[1:] | edge[1:-1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, offsets)

    def hashes(self) -> np.ndarray:
        up, down = _POWERS.upto(len(self.data) + 1)
        total = np.cumsum(_BYTE_CODE[self.data] * up[: len(self.data)], dtype=np.uint64)
        before = np.where(self.starts > 0, total[np.maximum(self.starts, 1) - 1], np.uint64(0)) if len(self.starts) else np.zeros(0, np.uint64)
        return mix((total[self.ends - 1] - before) * down[self.starts]) if len(self.starts) else before

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def owners(self) -> np.ndarray:
        """For each word, the number of its text."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive words (by the position of its first), over the boundaries of texts too."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for t in range(1, k):
        out *= _MULT
        out += words[t : t + n]
    return mix(out)


def gram_valid(bounds: np.ndarray, k: int) -> np.ndarray:
    """Which of gram_hashes() lie within one text."""
    n = int(bounds[-1]) - k + 1
    ok = np.zeros(max(n, 0) + 1, np.int32)
    size = np.diff(bounds)
    keep = size >= k
    np.add.at(ok, bounds[:-1][keep], 1)
    np.add.at(ok, bounds[:-1][keep] + size[keep] - k + 1, -1)
    return np.cumsum(ok)[: max(n, 0)].astype(bool)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of an array of strings; null counts as empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, kind, len(texts) + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8, offsets[-1] - offsets[0], offsets[0]) if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def as_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def groups(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about GROUP_BYTES of text each, one row at least."""
    _, offsets = buffers(batch.column(text))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offsets, offsets[at] + GROUP_BYTES, "right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def released(rows: Iterator) -> Iterator:
    """rows, and at their end the memory that the process holds but doesn't use goes back: idle Python workers stay on
    beside an executor's next stages.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        yield from rows
    finally:
        trim()


def trim() -> None:
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def small_batches(df: DataFrame) -> DataFrame:
    """df, its session sending fewer rows to Python at once unless that was set already: texts may be long, and what
    waits in Arrow buffers beside the heap is memory of the executor too.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(name) == "10000":
        df.sparkSession.conf.set(name, "1000")
    return df


def map_texts(
    df: DataFrame, make: Callable[[], Callable[[pa.Array, pa.RecordBatch], dict[str, pa.Array]]], fields: list[T.StructField], text: str = "text", drop_text: bool = True,
    inputs: tuple[str, ...] = (),
) -> DataFrame:
    """df with columns computed from its text column in numpy; other columns pass through, equal names are replaced.

    make() runs once in each task and gives the function for a group of texts and the rows that hold them. Rows keep their order and number.
    inputs names columns that the function reads besides the text.
    """
    new = {f.name for f in fields}
    also = [f for f in df.schema.fields if f.name in inputs]
    kept = [f for f in df.schema.fields if f.name not in new and not (drop_text and f.name == text)]
    df = df.select(*dict.fromkeys(f"`{f.name}`" for f in [*kept, *also, df.schema[text]]))
    schema = T.StructType([*kept, *fields])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for whole in batches:
            for batch in groups(whole, text):
                made = work(batch.column(text), batch)
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *(made[f.name] for f in fields)], [*names, *(f.name for f in fields)])

    return small_batches(df).mapInArrow(lambda batches: released(run(batches)), schema)
