"""Language-model scores: an n-gram model of the corpus as a weighted backoff automaton.

Tokens are words (A-Z lower-cased) and an end for each text. The model smooths each order with the one below:
P(w | h) = (c(h w) + m P(w | h')) / (c(h) + m), h' being h without its first word and m a constant of the order; below one word stands
(c(w) + A) / (N + A (V + 1)), so that all known words and one unknown one sum to 1. As an automaton: contexts that occur are states; an
n-gram that occurs is an arc with log10 P(w | h) to the longest state that it ends in; the failure arc of a state goes to h' and weighs
log10(m / (c(h) + m)), which times P(w | h') is exactly P(w | h) where c(h w) is 0. A text is traversed once from left to
right, its state carried along, weights summed. Traversals run side by side: a state depends on the last words alone, so
pieces of long texts start in the state that the words before them lead to.

Corpus and model are too large for any task, so that neither is ever in one place. A task cuts its texts into blocks. Of
each block the distinct n-grams with their counts in training texts go, as sorted keys, to the part of all keys that they belong to; a part
adds the counts up and answers each block in the block's own order; a block then builds the states and arcs that its own
texts can reach and traverses them.

Defined results: null and empty texts are their end alone; repeated rows count as often as they stand there; without training texts
every score is 0 a token; an empty table has no rows; what is kept of a row is one struct, so that names can't clash.

Scale: texts are tokenised twice and moved once, compressed, to meet their block's counts; keys move as differences of sorted
numbers, counts as bytes. Keys have 24 bits more than the number of bytes of all texts, so that a chance meeting stays rare at any size. A block holds
`BLOCK_BYTES` of text or one longer text, a part about `PART_BYTES` of the texts' n-grams; a word in every text has a row for each block, not for each
text. The same blocks must arise twice: rows are to come from files or another source that gives the same rows again; other input is to be
saved first; what differs is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stoichion.llm.keys import packed, saved
from stoichion.llm.textbytes import GROUP_BYTES, SPACED, Words, buffers, gram_hashes, groups, mix, released, small_batches

#: Order of the model, the constants of the orders from two words on (the best of thirty pairs for a tenth of the texts learnt from, the model being
#: fitted to the others), and what is added to the counts of single words.
ORDER, STRENGTH, ADDED = 3, (300.0, 1.0), 0.1
BLOCK_BYTES, PART_BYTES = 8 << 20, 8 << 20
#: Tokens of a piece that is traversed beside others.
_PIECE = 128

#: Words are runs of anything but ASCII white space; the byte 0 belongs to words, under a number that no UTF-8 text has.
_CLASSES = SPACED.copy()
_CLASSES[0] = 0xFF
_BEGIN, _END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def squeezed(x: np.ndarray) -> bytes:
    """Whole numbers as zstandard of their byte planes."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def widened(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").ravel().astype(np.uint64)


class Tape:
    """The tokens of a block: for each text a beginning, its words, an end."""

    def __init__(self, groups: list[tuple[np.ndarray, np.ndarray]], order: int, bits: int) -> None:
        counts, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for data, offsets in groups:  # one after another, as arrays over bytes are the largest
            words = Words(data, offsets, _CLASSES)
            counts.append(np.diff(words.bounds))
            hashes.append(words.hashes())
        count = np.concatenate(counts)
        self.starts = np.concatenate([[0], np.cumsum(count + 2)])
        self.hashes = np.full(self.starts[-1], _END)
        self.hashes[self.starts[:-1]] = _BEGIN
        self.text = np.repeat(np.arange(len(count)), count + 2)
        self.place = np.arange(len(self.hashes)) - self.starts[self.text]
        inner = (self.place > 0) & (self.place <= count[self.text])
        self.hashes[inner] = np.concatenate(hashes)
        self.order, self.shift = order, np.uint64(64 - bits)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions that end a run of k tokens of one text and are no beginning, and the runs' keys."""
        at = np.flatnonzero(self.place >= max(k - 1, 1))
        hashes = mix(self.hashes + np.uint64(k)) if k == 1 else gram_hashes(self.hashes, k)
        return at, hashes[at - (k - 1)] >> self.shift


def parts_of(keys: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """The part of each key; greater keys are in no smaller part."""
    return ((keys >> np.uint64(bits - 32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[int, pa.Table, list[tuple[np.ndarray, np.ndarray]]]]:
    """Number and rows of each block of a task, and the bytes and offsets of its groups of texts; column 0 is the text."""
    task, at, held, size = TaskContext.get().partitionId(), 0, [], 0
    block = lambda: ((task << 32) | at, pa.Table.from_batches(held), [buffers(x.column(0)) for x in held])
    for batch in batches:
        for group in groups(batch, batch.schema.names[0]):
            held.append(group)
            size += int(buffers(group.column(0))[1][-1])
            if size >= block_bytes:
                yield block()
                at, held, size = at + 1, [], 0
    if held:
        yield block()


def _grouped(data: np.ndarray, sizes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Bytes of texts of these sizes in groups as _blocks() has them."""
    ends, out, at, n = np.cumsum(sizes), [], 0, len(sizes)
    while at < n:
        start = int(ends[at] - sizes[at])
        to = max(at + 1, int(np.searchsorted(ends, start + GROUP_BYTES, "right")))
        out.append((data[start : ends[to - 1]], np.concatenate([[0], np.cumsum(sizes[at:to])])))
        at = to
    return out


def counted(rows: DataFrame, order: int, bits: int, parts: int, block_bytes: int) -> DataFrame:
    """(part, block, keys, counts) of rows (text, train, ...): for each order the sorted keys of a block that belong to the
    part, and how often training texts of the block have them.
    """
    schema = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("keys", pa.list_(pa.binary())), ("counts", pa.list_(pa.binary()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, table, texts in _blocks(batches, block_bytes):
            tape, train = Tape(texts, order, bits), np.asarray(table.column(1).to_numpy(zero_copy_only=False), bool)
            cut: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for k in range(1, order + 1):
                at, keys = tape.grams(k)
                both = np.sort(keys << np.uint64(1) | train[tape.text[at]].astype(np.uint64))
                first = np.flatnonzero(np.concatenate([[True], both[1:] >> np.uint64(1) != both[:-1] >> np.uint64(1)])) if len(both) else np.zeros(0, np.int64)
                own = both[first] >> np.uint64(1)
                count = np.add.reduceat(both & np.uint64(1), first) if len(first) else np.zeros(0, np.uint64)
                cut.append((own, count, np.searchsorted(parts_of(own, bits, parts), np.arange(parts + 1))))
            for part in range(parts):
                own = [slice(edge[part], edge[part + 1]) for _, _, edge in cut]
                if any(s.stop > s.start for s in own):
                    keys = [squeezed(np.diff(x[0][s], prepend=np.uint64(0))) for x, s in zip(cut, own, strict=True)]
                    yield pa.RecordBatch.from_pydict({"part": [part], "block": [number], "keys": [keys], "counts": [[squeezed(x[1][s]) for x, s in zip(cut, own, strict=True)]]}, schema=schema)

    return small_batches(rows).mapInArrow(lambda batches: released(run(batches)), "part int, block long, keys array<binary>, counts array<binary>")


def answered(rows: DataFrame, bits: int) -> DataFrame:
    """(block, part, totals, n_tokens, n_types) of counted(): for each block and part the counts in all training texts, in the order of its keys; one row
    of each part has the tokens and distinct tokens of training texts that belong to the part.
    """
    schema = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("totals", pa.list_(pa.binary())), ("n_tokens", pa.int64()), ("n_types", pa.int64())])

    def merge(table: pa.Table) -> pa.Table:
        n, order = table.num_rows, len(table.column("keys")[0])
        totals: list[list[bytes]] = [[] for _ in range(n)]
        tokens = types = 0
        for k in range(order):
            keys = [np.cumsum(widened(x[k].as_py()), dtype=np.uint64) for x in table.column("keys")]
            counts = np.concatenate([widened(x[k].as_py()) for x in table.column("counts")])
            edge = np.concatenate([[0], np.cumsum([len(x) for x in keys])])
            whole = np.concatenate(keys)
            by = np.argsort(whole, kind="stable")
            new = np.concatenate([[True], whole[by][1:] != whole[by][:-1]]) if len(by) else np.zeros(0, bool)
            total = np.add.reduceat(counts[by], np.flatnonzero(new)) if len(by) else counts
            if k == 0:
                tokens, types = int(total.sum()), int((total > 0).sum())
            each = np.zeros(len(whole), np.uint64)
            each[by] = total[np.cumsum(new) - 1] if len(by) else total
            for i in range(n):
                totals[i].append(squeezed(each[edge[i] : edge[i + 1]]))
        zeros = [0] * (n - 1)
        return pa.table({"block": table.column("block"), "part": table.column("part"), "totals": totals, "n_tokens": [tokens, *zeros], "n_types": [types, *zeros]}, schema=schema)

    return rows.groupBy("part").applyInArrow(merge, "block long, part int, totals array<binary>, n_tokens long, n_types long")


class Automaton:
    """The states and arcs that the tokens of a tape can reach. A state is a run of 0 to order - 1 tokens, known by its length and
    its number among the runs of that length.
    """

    def __init__(self, tape: Tape, totals: list[np.ndarray], tokens: int, types: int, strength: tuple[float, ...], added: float) -> None:
        self.tape, n = tape, len(tape.hashes)
        self.count, self.run, self.weight, self.fail = [], [], [], []
        prob: list[np.ndarray] = []
        # Both stand for the beginning as a context: it occurs as often as the end does.
        texts = 0
        for k in range(1, tape.order + 1):
            at, keys = tape.grams(k)
            own, first, which = np.unique(keys, return_index=True, return_inverse=True)
            if len(own) != len(totals[k - 1]):
                raise ValueError("the texts of a block are not those that were counted; save the rows first")
            run = np.full(n, -1, np.int32)
            run[at] = which
            count = totals[k - 1].astype(float)
            if k == 1:
                end = run[tape.starts[1:] - 1] if len(tape.starts) > 1 else np.zeros(0, np.int64)
                texts = count[end[0]] if len(end) else 0.0
                p = (count + added) / (tokens + added * (types + 1))
            else:
                m, last = strength[k - 2], at[first]
                before = self.run[k - 2][last - 1]
                context = np.where(before >= 0, self.count[k - 2][before], texts)
                p = (count + m * prob[k - 2][self.run[k - 2][last]]) / (context + m)
            prob.append(p)
            self.count.append(count)
            self.run.append(run)
            self.weight.append(np.log10(p))
            self.fail.append(np.log10(strength[k - 1] / (count + strength[k - 1])) if k < tape.order else None)
        self.begin = 1 if texts > 0 and tape.order > 1 else 0
        self.begin_fail = float(np.log10(strength[0] / (texts + strength[0]))) if tape.order > 1 else 0.0

    def _state_after(self, at: np.ndarray) -> np.ndarray:
        """Length of the state that the tokens up to a position lead to."""
        length = np.zeros(len(at), np.int64)
        for k in range(1, self.tape.order):
            run = self.run[k - 1][at]
            length[(run >= 0) & (self.count[k - 1][run] > 0)] = k
        length[self.tape.place[at] == 0] = self.begin
        return length

    def scores(self) -> np.ndarray:
        """log10 probability of each text."""
        tape = self.tape
        sizes = np.diff(tape.starts) - 1
        pieces = -(-sizes // _PIECE)
        text = np.repeat(np.arange(len(sizes)), pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at = tape.starts[text] + 1 + nth * _PIECE
        left = np.minimum(sizes[text] - nth * _PIECE, _PIECE)
        length, total = self._state_after(at - 1), np.zeros(len(text))
        by = np.argsort(-left, kind="stable")
        at, left, length, total = at[by], left[by], length[by], total[by]
        for step in range(int(left[0]) if len(left) else 0):
            on = int(np.searchsorted(-left, -step, "left"))
            here = at[:on] + step
            state = length[:on]
            for k in range(tape.order, 1, -1):
                trying = np.flatnonzero(state == k - 1)
                if not len(trying):
                    continue
                pos = here[trying]
                run = self.run[k - 1][pos]
                found = (run >= 0) & (self.count[k - 1][run] > 0)
                hit, miss = trying[found], trying[~found]
                total[hit] += self.weight[k - 1][run[found]]
                state[hit] = -min(k, tape.order - 1)  # negative: this step is done
                before = self.run[k - 2][pos[~found] - 1]
                total[miss] += np.where(before >= 0, self.fail[k - 2][before], self.begin_fail)
                state[miss] = k - 2
            rest = np.flatnonzero(state == 0)
            run = self.run[0][here[rest]]
            total[rest] += self.weight[0][run]
            state[rest] = -(self.count[0][run] > 0).astype(np.int64) * (tape.order > 1)
            np.negative(state, out=state)
        out = np.zeros(len(text))
        out[by] = total
        return np.bincount(text, out, len(sizes))

    def base(self, tokens: int, types: int, added: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text its tokens, those that training texts have, and its log10 probability by single tokens."""
        tape = self.tape
        at = np.flatnonzero(tape.place > 0)
        count, text, n = self.count[0][self.run[0][at]], tape.text[at], len(tape.starts) - 1
        log = np.log10((count + added) / (tokens + added * (types + 1)))
        return np.bincount(text, minlength=n), np.bincount(text[count > 0], minlength=n), np.bincount(text, log, n)


def score(
    docs: DataFrame, train: Column, folder: str, text: str = "text", order: int = ORDER, strength: tuple[float, ...] = STRENGTH, added: float = ADDED,
    block_bytes: int = BLOCK_BYTES, part_bytes: int = PART_BYTES,
) -> DataFrame:
    """(row, n_tokens, n_known, train_tokens, base_score, score): row is what docs has besides the text; train says which texts
    the model learns from. The answered counts are written below folder.
    """
    rows = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"), packed(docs, text).alias("row"))
    size = int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    bits = min(63, max(40, size.bit_length() + 24))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // part_bytes))
    answers = saved(answered(counted(rows, order, bits, parts, block_bytes), bits), folder, "counts")
    known = answers.agg(F.sum("n_tokens"), F.sum("n_types")).first()
    tokens, types = int(known[0] or 0), int(known[1] or 0)
    row = T.StructField("row", rows.schema["row"].dataType)
    sent = T.StructType([T.StructField("block", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("size", T.LongType()), T.StructField("texts", T.BinaryType()), row])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, table, texts in _blocks(batches, block_bytes):
            n, press = table.num_rows, zstandard.ZstdCompressor(level=1).compressobj()
            whole = pa.array([b"".join([*(press.compress(d.tobytes()) for d, _ in texts), press.flush()]), *[None] * (n - 1)], pa.binary())
            own = table.column("row").combine_chunks()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number)), pa.array(np.arange(n)), pa.array(np.concatenate([np.diff(o) for _, o in texts])), whole, own], ["block", "seq", "size", "texts", "row"])

    def walk(texts: pa.Table, counts: pa.Table) -> pa.Table:
        if not texts.num_rows:
            raise ValueError("a block was counted that isn't there when it is scored; save the rows first")
        texts, counts = texts.sort_by("seq"), counts.sort_by("part")
        data = np.frombuffer(zstandard.ZstdDecompressor().decompressobj().decompress(texts.column("texts")[0].as_py()), np.uint8)
        tape = Tape(_grouped(data, texts.column("size").to_numpy()), order, bits)
        totals = [np.concatenate([np.zeros(0, np.uint64), *(widened(x[k].as_py()) for x in counts.column("totals"))]) for k in range(order)]
        machine = Automaton(tape, totals, tokens, types, strength, added)
        n, hit, base = machine.base(tokens, types, added)
        made = {"row": texts.column("row"), "n_tokens": n, "n_known": hit, "train_tokens": np.full(len(n), tokens), "base_score": base, "score": machine.scores()}
        return pa.table(made)

    out = T.StructType([row, *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")), *(T.StructField(c, T.DoubleType()) for c in ("base_score", "score"))])
    left = small_batches(rows).mapInArrow(lambda batches: released(send(batches)), sent)
    return left.groupBy("block").cogroup(answers.select("block", "part", "totals").groupBy("block")).applyInArrow(walk, out)
