"""Token files: independent zstandard frames, a trailing seek table and a checksum for each frame.

Layout of a file: data frames; one skippable frame (magic 0x184D2A50) with the document index of the frames; the seek
table of the public zstandard seekable format (skippable frame 0x184D2A5E: for each data frame its compressed size,
size and the low 32 bits of the XXH64 of its content; then the number of frames, a flag byte 0x80 and the magic
0x8F92EAB1). A data frame holds the number of documents, their ids (0 where null), null flags, token counts and all
token ids, little-endian. Readers take the last bytes of a file, find the frames of the documents asked for, and
decompress and check those only.

Defined results: a null text is empty and has the end id alone; documents are in ascending order of doc_id, nulls
first, then of a hash of the text, so repeated rows are neighbours; an empty table gives no documents; other columns
are dropped; texts of any length form one document of one frame.

Scale: texts are dealt once by ranges of (doc_id, text hash) and each task streams its range into one file in
spark.checkpoint.dir. File names carry a random part and the manifest written by the tasks that count names those that
are valid, so a task that runs again can't mix with its first attempt. Starts are file totals summed over the manifest,
a row for each file, plus sums within a file. Other stores than file: are opened through pyarrow.fs.
"""

from __future__ import annotations

import io
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stoichion.llm.keys import saved
from stoichion.llm.pieces import PieceCache, held
from stoichion.llm.textbytes import groups, released, small_batches

END_ID = 0
#: A frame is closed once it holds so many bytes of token ids.
FRAME_BYTES = 1 << 18
LEVEL = 3

_INDEX, _SEEK, _FOOT = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
_ENTRY, _ENTRY_SIZE = "<qqBBIQ", struct.calcsize("<qqBBIQ")  # first and last doc_id, whether they are null, documents, tokens
MANIFEST = "part int, file string, n_docs long, n_tokens long"


def _open(path: str, mode: str):
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" not in path:
        if mode == "wb":
            os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, mode)  # noqa: SIM115
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    return store.open_output_stream(at) if mode == "wb" else store.open_input_file(at)


class Writer:
    """Streams documents into a file."""

    def __init__(self, out) -> None:
        self.out, self.ids, self.data, self.size = out, [], [], 0
        self.frames: list[tuple[int, int, int]] = []
        self.index: list[bytes] = []
        self.n_docs = self.n_tokens = 0

    def add(self, doc_id: int | None, tokens: bytes) -> None:
        self.ids.append(doc_id)
        self.data.append(tokens)
        self.size += len(tokens)
        if self.size >= FRAME_BYTES:
            self.flush()

    def flush(self) -> None:
        if not self.ids:
            return
        n = len(self.ids)
        ids = np.array([x or 0 for x in self.ids], "<i8")
        null = np.array([x is None for x in self.ids], np.uint8)
        counts = np.array([len(x) // 4 for x in self.data], "<u4")
        raw = b"".join([struct.pack("<I", n), ids.tobytes(), null.tobytes(), counts.tobytes(), *self.data])
        packed = zstandard.ZstdCompressor(level=LEVEL).compress(raw)
        self.out.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.index.append(struct.pack(_ENTRY, int(ids[0]), int(ids[-1]), int(null[0]), int(null[-1]), n, self.size // 4))
        self.n_docs += n
        self.n_tokens += self.size // 4
        self.ids, self.data, self.size = [], [], 0

    def close(self) -> None:
        self.flush()
        index = b"".join(self.index)
        self.out.write(struct.pack("<II", _INDEX, len(index)) + index)
        table = b"".join(struct.pack("<III", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, _FOOT)
        self.out.write(struct.pack("<II", _SEEK, len(table)) + table)
        self.out.close()


class Reader:
    """Random access to the documents of a file."""

    def __init__(self, file) -> None:
        self.file = file
        size = file.seek(0, io.SEEK_END)
        size = file.tell() if size is None else size
        file.seek(size - 9)
        n, flag, magic = struct.unpack("<IBI", file.read(9))
        if magic != _FOOT or flag != 0x80:
            raise ValueError("no seek table with checksums at the end of the file")
        whole = 8 + n * (12 + _ENTRY_SIZE) + 8 + 9
        file.seek(size - whole)
        tail = file.read(whole)
        cut = 8 + n * _ENTRY_SIZE
        self.index = [struct.unpack_from(_ENTRY, tail, 8 + i * _ENTRY_SIZE) for i in range(n)]
        self.frames = [struct.unpack_from("<III", tail, cut + 8 + 12 * i) for i in range(n)]
        self.at = [0, *np.cumsum([x[0] for x in self.frames]).tolist()]

    def frame(self, i: int) -> Iterator[tuple[int | None, bytes]]:
        packed_size, size, check = self.frames[i]
        self.file.seek(self.at[i])
        raw = zstandard.ZstdDecompressor().decompress(self.file.read(packed_size), max_output_size=size)
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {i} doesn't match its checksum")
        n = struct.unpack_from("<I", raw)[0]
        ids, null = np.frombuffer(raw, "<i8", n, 4), np.frombuffer(raw, np.uint8, n, 4 + 8 * n)
        counts = np.frombuffer(raw, "<u4", n, 4 + 9 * n)
        at = 4 + 13 * n
        for doc, none, count in zip(ids.tolist(), null.tolist(), counts.tolist(), strict=True):
            yield None if none else doc, raw[at : at + 4 * count]
            at += 4 * count

    def starts(self) -> list[int]:
        """Tokens before each frame."""
        return [0, *np.cumsum([x[5] for x in self.index]).tolist()]

    def documents(self, wanted: set[int] | None = None) -> Iterator[tuple[int | None, int, bytes]]:
        """(doc_id, tokens before it in the file, its token ids in bytes), of those wanted; other frames stay unread."""
        for i, start in zip(range(len(self.frames)), self.starts(), strict=False):
            low, high, low_null, high_null = self.index[i][:4]
            if wanted is not None and (high_null or not any((low_null or low <= x) and x <= high for x in wanted)):
                continue
            for doc, data in self.frame(i):
                if wanted is None or doc in wanted:
                    yield doc, start, data
                start += len(data) // 4


def _cache(vocabulary: str) -> PieceCache:
    """Token ids by the tokenizers library. Pieces go to it many at once, with line breaks between: next to a piece a line
    break always is a pre-token of its own, so its id parts the ids; pieces that hold line breaks go one by one. Texts that
    hold an added token of the vocabulary are encoded in one piece; where the vocabulary's pre-tokenizer isn't the one that
    the cuts are made for, all texts are.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary)
    ids = lambda texts: [np.array(x.ids, "<u4") for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    made = json.loads(tokenizer.to_str())
    before = made.get("pre_tokenizer") or {}
    known = (made.get("normalizer"), before.get("type"), before.get("add_prefix_space"), before.get("use_regex")) == (None, "ByteLevel", False, True)
    (line,) = ids(["\n"])
    if not known or len(line) != 1:
        return PieceCache(lambda pieces: [x.tobytes() for x in ids(pieces)], uncut=lambda texts: np.ones(len(texts), bool))
    added = re.compile("|".join(re.escape(x["content"]) for x in made.get("added_tokens", ()) if x["content"]) or r"(?!)")

    def uncut(texts: pa.Array) -> np.ndarray:
        return np.asarray(pc.fill_null(pc.match_substring_regex(texts, added.pattern), False)) if added.pattern != r"(?!)" else np.zeros(len(texts), bool)

    def encode(pieces: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(pieces)
        plain = [i for i, x in enumerate(pieces) if x and "\n" not in x and not added.search(x) and not x[-1].isspace() and (len(x) == 1 or not x[1].isspace())]
        for at in range(0, len(plain), 512):
            own = plain[at : at + 512]
            (found,) = ids(["\n".join([pieces[i] for i in own])])
            cut = np.flatnonzero(found == line[0])
            data, ends = found.tobytes(), [*cut.tolist(), len(found)]
            start = 0
            for i, end in zip(own, ends, strict=True):
                out[i] = data[4 * start : 4 * end]
                start = end + 1
        plain_set = set(plain)
        rest = [i for i, x in enumerate(pieces) if x and i not in plain_set]
        for at in range(0, len(rest), 512):
            for i, x in zip(rest[at : at + 512], ids([pieces[i] for i in rest[at : at + 512]]), strict=True):
                out[i] = x.tobytes()
        return out

    return PieceCache(encode, uncut=uncut)


def write_tokens(docs: DataFrame, vocabulary: str, folder: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the files below folder and returns their manifest: part (files in order), file, n_docs, n_tokens."""
    key = F.xxhash64("text")
    dealt = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).repartitionByRange(F.col("doc_id").asc_nulls_first(), key).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), key)
    end = struct.pack("<I", END_ID)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, writer, name, cache = TaskContext.get().partitionId(), None, "", None
        for whole in batches:
            for batch in groups(whole, "text"):
                if writer is None:
                    name, cache = f"part-{part:07d}-{uuid.uuid4().hex}.tokens.zst", held(("tokenizers", vocabulary), lambda: _cache(vocabulary))
                    writer = Writer(_open(f"{folder}/{name}", "wb"))
                ids, bounds = cache(batch.column("text"))
                data, bounds = ids.astype("<u4").tobytes(), (4 * bounds).tolist()
                for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                    writer.add(doc, data[bounds[i] : bounds[i + 1]] + end)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([writer.n_docs]), pa.array([writer.n_tokens])], ["part", "file", "n_docs", "n_tokens"])

    return saved(small_batches(dealt).mapInArrow(lambda batches: released(run(batches)), MANIFEST), folder, "manifest")


def read_tokens(spark: SparkSession, folder: str, wanted: set[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, tokens as bytes, ids_crc32) of all documents, or of those wanted (a small set)."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # A task for each file: the number is given, so that adaptive execution doesn't join them.
    files = manifest.select("part", "file", F.coalesce(before, F.lit(0)).alias("base"))
    files = files.repartitionById((manifest.agg(F.max("part")).first()[0] or 0) + 1, F.col("part")).drop("part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with _open(f"{folder}/{name}", "rb") as file:
                    rows, size = [], 0
                    for doc, start, data in Reader(file).documents(wanted):
                        rows.append((doc, base + start, len(data) // 4, data, zlib.crc32(data)))
                        size += len(data)
                        if size > 4_000_000:
                            yield _rows(rows)
                            rows, size = [], 0
                    if rows:
                        yield _rows(rows)

    return files.mapInArrow(lambda batches: released(run(batches)), "doc_id long, start long, n_tokens long, tokens binary, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "start", "n_tokens", "tokens", "ids_crc32"])
