"""Substring dedup: hashes of sliding sentence spans, joined globally; repeated spans go except their first occurrence.

A sentence ends after a word that ends in `.`, `!` or `?` (a closing quote or bracket may follow), at a line break and at
the end of the text; a sentence of more than 16 words is taken in pieces of 16. From every sentence on, and up to every
sentence, a span is the shortest run of consecutive sentences, three at least, that has 20 words or more; so spans cover a
repeated passage to its last sentence, and any longer run of sentences that repeats is covered by its spans. Words are runs of anything but
ASCII white space, A-Z lower-cased; spans are equal when the 64-bit hashes of their words are. Of equal spans the one
in the least doc_id (then the first in its text) stays; every sentence covered by any other one is removed, with the
white space after it.

Defined results: a null text stays null, an empty one empty; texts too short for a span stay whole; ids are of any type
that has an order; rows of equal doc_id are versions of one document, among which no version counts as the later one,
so repeated rows are treated alike; rows without an id come last, each text of theirs being a document of its own, in the
order of a hash of the text; within one text later repetitions go; an empty table gives an empty one; texts of any length
are taken whole; other columns pass through, whatever their names, and those named like an output are replaced.

Scale: one numpy pass makes about one span of 28 bytes for each sentence; the first occurrence of a span is a
map-side combined minimum, and only spans seen twice join back, where a passage held by a third of all documents is
an ordinary skewed join. Texts move once, to meet what is to be cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stoichion.llm.keys import field, packed, saved, workspace
from stoichion.llm.textbytes import buffers, groups, map_texts, mix, released, small_batches, SPACED, Words, _POWERS

SENTENCES, SPAN_WORDS, PIECE_WORDS = 3, 20, 16

_END = np.isin(np.arange(256), list(b".!?"))
_CLOSE = np.isin(np.arange(256), list(b"\"')]}"))


class Sentences:
    """Sentences of a group of texts: for each the range of its words, and for each text the range of its sentences."""

    def __init__(self, texts: pa.Array, longest: int = PIECE_WORDS) -> None:
        self.raw, self.offsets = buffers(texts)
        self.words = words = Words(self.raw, self.offsets, SPACED)
        n = len(words.starts)
        last = np.zeros(n, bool)
        if n:
            tail = self.raw[words.ends - 1]
            before = self.raw[np.maximum(words.ends - 2, words.starts)]
            last = _END[tail] | (_CLOSE[tail] & _END[before])
            breaks = np.cumsum(self.raw == 10)
            last[:-1] |= breaks[words.starts[1:]] > breaks[words.ends[:-1] - 1]
            last[words.bounds[1:][np.diff(words.bounds) > 0] - 1] = True
            at = np.arange(n)
            first = np.ones(n, bool)
            first[1:] = last[:-1]
            last |= (at - np.maximum.accumulate(np.where(first, at, 0))) % longest == longest - 1
        self.ends = np.flatnonzero(last) + 1
        self.starts = np.concatenate([[0], self.ends[:-1]]) if n else self.ends
        self.bounds = np.searchsorted(self.starts, words.bounds)

    def spans(self, least: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text number, first and last sentence within the text, and hash of each span."""
        n = len(self.starts)
        if not n:
            none = np.zeros(0, np.int64)
            return none, none, none, none.astype(np.uint64)
        doc = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))
        first = np.arange(n)
        end = np.maximum(np.searchsorted(self.ends, self.starts + size), first + least - 1)
        back = np.minimum(np.searchsorted(self.starts, self.ends - size, "right") - 1, first - least + 1)
        on = end < self.bounds[doc + 1]
        up_to = back >= self.bounds[doc]
        up_to[up_to] = end[back[up_to]] != first[up_to]  # the others begin there already
        doc, first, end = np.concatenate([doc[on], doc[up_to]]), np.concatenate([first[on], back[up_to]]), np.concatenate([end[on], first[up_to]])
        hashes = self.words.hashes()
        up, down = _POWERS.upto(len(hashes) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[: len(hashes)], dtype=np.uint64)])
        a, b = self.starts[first], self.ends[end]
        key = mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))
        return doc, first - self.bounds[doc], end - self.bounds[doc], key


def spans(docs: DataFrame, doc_id: str, text: str, least: int = SENTENCES, size: int = SPAN_WORDS) -> DataFrame:
    """(id, text_hash, span, first, last): a row for each span of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in groups(whole, "text"):
                doc, first, last, key = Sentences(batch.column("text")).spans(least, size)
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(take), batch.column("text_hash").take(take), pa.array(key.view(np.int64)), pa.array(first, pa.int32()), pa.array(last, pa.int32())],
                    ["id", "text_hash", "span", "first", "last"],
                )

    kind = T.StructType([T.StructField("id", docs.schema[doc_id].dataType), *T._parse_datatype_string("text_hash long, span long, first int, last int").fields])
    return small_batches(docs).select(F.col(f"`{doc_id}`").alias("id"), F.xxhash64(f"`{text}`").alias("text_hash"), F.col(f"`{text}`").alias("text")).mapInArrow(lambda batches: released(run(batches)), kind)


def covered(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = SENTENCES, size: int = SPAN_WORDS) -> DataFrame:
    """(id, text_hash, cuts): the runs of sentences that later occurrences of spans cover, for each text that has any."""
    all_spans, folder = spans(docs, doc_id, text, least, size), workspace(docs.sparkSession, "sentence-spans")
    none = F.col("id").isNull()
    place = F.struct(none.alias("none"), F.col("id"), F.when(none, F.col("text_hash")).otherwise(F.lit(0)).alias("hash"))
    # Written first, so that the join is between plain exchanges, whose hot partitions can be split.
    again = saved(all_spans.groupBy("span").agg(F.count("*").alias("n"), F.min(place).alias("owner")).where("n > 1").select("span", "owner"), folder, "again")
    met = saved(all_spans.join(again, "span").select("id", "text_hash", "span", "first", "last", (F.col("id").eqNullSafe(F.col("owner.id")) & (~none | (F.col("text_hash") == F.col("owner.hash")))).alias("own")), folder, "met")
    own = met.where("own")
    lead = own.groupBy("span", "text_hash").agg(F.min("first").alias("lead"))
    later = own.join(lead, ["span", "text_hash"]).where("first > lead").select("id", "text_hash", "first", "last")
    gone = met.where("NOT own").select("id", "text_hash", "first", "last").union(later)
    return gone.groupBy("id", "text_hash").agg(F.collect_set(F.struct("first", "last")).alias("cuts"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = SENTENCES, size: int = SPAN_WORDS) -> DataFrame:
    """docs with its text cut, n_sentences and n_removed."""
    names = [c for c in docs.columns if c not in ("n_sentences", "n_removed")]
    cuts = covered(docs, doc_id, text, least, size).select(F.col("id").alias("cut_id"), F.col("text_hash").alias("cut_hash"), "cuts")
    keyed = docs.select(packed(docs.select(*(f"`{c}`" for c in names)), text).alias("row"), F.col(f"`{doc_id}`").alias("id"), F.xxhash64(f"`{text}`").alias("text_hash"), F.col(f"`{text}`").alias("text"))
    at = keyed.join(cuts, F.col("id").eqNullSafe(F.col("cut_id")) & (F.col("text_hash") == F.col("cut_hash")), "left").select("row", "text", "cuts")

    def make():
        def work(texts: pa.Array, batch: pa.RecordBatch) -> dict[str, pa.Array]:
            s = Sentences(texts)
            count, lost, out = np.diff(s.bounds), np.zeros(len(texts), np.int64), texts.to_pylist()
            lists = batch.column("cuts")
            for i in np.flatnonzero(~np.asarray(lists.is_null())):
                gone = np.zeros(count[i] + 1, np.int64)
                for x in lists[int(i)].as_py():
                    gone[x["first"]] += 1
                    gone[x["last"] + 1] -= 1
                gone = np.cumsum(gone)[:-1] > 0
                lost[i] = gone.sum()
                begin = s.words.starts[s.starts[s.bounds[i] : s.bounds[i + 1]]]
                edges = np.concatenate([begin, s.offsets[i + 1 : i + 2]])
                kept = [s.raw[s.offsets[i] : begin[0]], *(s.raw[edges[j] : edges[j + 1]] for j in np.flatnonzero(~gone))]
                out[i] = b"".join(x.tobytes() for x in kept).decode()
            return {"n_sentences": pa.array(count, pa.int64()), "n_removed": pa.array(lost), "text": pa.array(out, pa.string())}

        return work

    fields = [T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("text", T.StringType())]
    cut = map_texts(at, make, fields, "text", inputs=("cuts",))
    return cut.select(*((F.col("text") if c == text else field(c)).alias(c) for c in names), "n_sentences", "n_removed")
