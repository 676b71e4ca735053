"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against every training window.

Words are runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after A-Z are lower-cased. A window is `n` consecutive words of
one benchmark item; an item with fewer words, but not none, is one window of its own length.

Defined results: a null text has no words; a null or wordless benchmark text has no windows; a null item_id counts as
the string "null"; repeated benchmark rows count once by id; repeated documents each get their row; an empty benchmark
marks nothing, and empty documents give an empty table; texts of any length are read whole; null ids are ids like others; of
items that share a window all are named; scan() replaces input columns that share a name with an output column,
decontaminate() keeps all, whatever their names.

Scale: one pass over the documents without a shuffle. The set is broadcast in blocks of at most `max_windows`
windows (about 100 bytes each), so what is broadcast never grows with the data; more blocks mean more passes.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stoichion.llm.keys import field, packed, saved, workspace
from stoichion.llm.textbytes import Words, buffers, byte_classes, gram_hashes, gram_valid, map_texts

WINDOW = 10
#: Bound of one broadcast block, in windows.
MAX_WINDOWS = 200_000

CLASSES = byte_classes(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("item_ids", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
]
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def words_of(text: str | None) -> list[bytes]:
    data = (text or "").encode()
    return _WORD.findall(bytes(data).translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))))


def item_windows(rows: list[tuple[object, str | None]], n: int) -> dict[tuple[bytes, ...], set[str]]:
    """Windows of the benchmark with the ids of their items."""
    found: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
    for item, text in rows:
        words = words_of(text)
        for i in range(max(len(words) - n + 1, 1) if words else 0):
            found[tuple(words[i : i + n])].add("null" if item is None else str(item))
    return found


class Scanner:
    """Finds windows in groups of texts: hash every run of words, look it up, compare the words themselves."""

    def __init__(self, windows: dict[tuple[bytes, ...], set[str]]) -> None:
        self.items = [sorted(x) for x in windows.values()]
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, list[list[tuple[bytes, int]]]]] = {}
        sizes = defaultdict(list)
        for i, w in enumerate(windows):
            sizes[len(w)].append((b" ".join(w), i))
        for k, own in sizes.items():
            data = b"\x00".join(x for x, _ in own)
            offsets = np.cumsum([0, *(len(x) + 1 for x, _ in own)])
            offsets[-1] -= 1
            at = Words(np.frombuffer(data, np.uint8), offsets, CLASSES)
            hashes = gram_hashes(at.hashes(), k)[at.bounds[:-1]]
            keys, inverse = np.unique(hashes, return_inverse=True)
            lists: list[list[tuple[bytes, int]]] = [[] for _ in keys]
            for j, x in zip(inverse, own, strict=True):
                lists[j].append(x)
            sieve = np.zeros(1 << 20, bool)
            sieve[(keys >> np.uint64(44)).astype(np.int64)] = True
            self.by_size[k] = (keys, sieve, hashes, lists)

    def __call__(self, texts: pa.Array, batch: pa.RecordBatch | None = None) -> dict[str, pa.Array]:
        """prior results of other blocks are taken from batch, if it has their columns."""
        data, offsets = buffers(texts)
        words = Words(data, offsets, CLASSES)
        hashes, count = words.hashes(), np.diff(words.bounds)
        covered = np.zeros(len(hashes) + 1, np.int64)
        items: dict[int, set[str]] = defaultdict(set)
        if batch is not None and "spans" in batch.schema.names:
            for doc, (ids, spans) in enumerate(zip(batch.column("item_ids").to_pylist(), batch.column("spans").to_pylist(), strict=True)):
                items[doc].update(ids)
                for x in spans:
                    covered[np.searchsorted(words.starts, x["start"] + offsets[doc])] += 1
                    covered[np.searchsorted(words.ends, x["end"] + offsets[doc]) + 1] -= 1
        for k, (keys, sieve, _, lists) in self.by_size.items():
            grams = gram_hashes(hashes, k)
            maybe = np.flatnonzero(sieve[(grams >> np.uint64(44)).astype(np.int64)])
            slot = np.searchsorted(keys, grams[maybe])
            slot[slot == len(keys)] = 0
            good = keys[slot] == grams[maybe]
            good &= gram_valid(words.bounds, k)[maybe] if len(maybe) else good
            for i, s in zip(maybe[good].tolist(), slot[good].tolist(), strict=True):
                real = b" ".join(words.text(j) for j in range(i, i + k))
                own = [n for x, n in lists[s] if x == real]
                if own:
                    covered[i] += 1
                    covered[i + k] -= 1
                    doc = int(np.searchsorted(words.bounds, i, "right")) - 1
                    for n in own:
                        items[doc].update(self.items[n])
        hit = np.cumsum(covered)[:-1] > 0
        total = np.concatenate([[0], np.cumsum(hit)])
        spans: list[list[dict[str, int]]] = [[] for _ in count]
        if hit.any():
            edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
            for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
                while a < b:  # a run may go on over the end of its text
                    doc = int(np.searchsorted(words.bounds, a, "right")) - 1
                    to = min(b, int(words.bounds[doc + 1]))
                    spans[doc].append({"start": int(words.starts[a] - offsets[doc]), "end": int(words.ends[to - 1] - offsets[doc])})
                    a = to
        return {
            "n_words": pa.array(count, pa.int64()),
            "n_hit": pa.array(total[words.bounds[1:]] - total[words.bounds[:-1]], pa.int64()),
            "item_ids": pa.array([sorted(items.get(i, ())) for i in range(len(count))], pa.list_(pa.string())),
            "spans": pa.array(spans, _SPANS),
        }


def _blocks(benchmark: DataFrame, n: int, max_windows: int):
    """Dicts of windows with at most max_windows windows each (one item more at most); the driver holds one at a time."""
    rows, words = [], 0
    for row in benchmark.select("item_id", "text").where(F.col("text").isNotNull()).toLocalIterator():
        rows.append((row[0], row[1]))
        words += max(1, len(row[1]) // 2)
        if words >= max_windows:
            yield item_windows(rows, n)
            rows, words = [], 0
    if rows:
        yield item_windows(rows, n)


def scan(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, text: str = "text", drop_text: bool = True, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """docs with n_words, n_hit, item_ids (sorted strings) and spans (byte ranges of text) of the words hit."""
    spark, folder = docs.sparkSession, None
    own = {f.name for f in FIELDS}
    docs = docs.select(*(f"`{c}`" for c in docs.columns if c not in own))
    blocks = _blocks(benchmark, n, max_windows)
    now = next(blocks, {})
    while True:
        handle, later = spark.sparkContext.broadcast(now), next(blocks, None)
        docs = map_texts(docs, lambda h=handle: Scanner(h.value), FIELDS, text, drop_text and later is None, ("item_ids", "spans") if folder else ())
        if later is None:
            return docs
        folder = folder or workspace(spark, "decontamination")
        docs, now = saved(docs, folder, uuid.uuid4().hex), later
        handle.unpersist()


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, text: str = "text", remove: str = "documents") -> DataFrame:
    """docs without contamination, with its own columns: remove="documents" drops each document that has a hit,
    remove="spans" keeps it and cuts the bytes from the first to the last word of each run of hit words.
    """
    found = scan(docs.select(packed(docs, text).alias("row"), F.col(f"`{text}`").alias("text")), benchmark, n, "text", drop_text=False)
    columns = lambda own: [(own if c == text else field(c)).alias(c) for c in docs.columns]
    if remove == "documents":
        return found.where("n_hit = 0").select(*columns(F.col("text")))
    data = F.col("text").cast("binary")
    ends = F.concat(F.array(F.lit(0).cast("long")), F.col("spans.end"))
    starts = F.concat(F.col("spans.start"), F.array(F.octet_length(data).cast("long")))
    pieces = F.transform(F.arrays_zip(ends.alias("a"), starts.alias("b")), lambda x: F.substring(data, (x["a"] + 1).cast("int"), (x["b"] - x["a"]).cast("int")).cast("string"))
    return found.select(*columns(F.when(F.col("n_hit") == 0, F.col("text")).otherwise(F.concat_ws("", pieces))))
