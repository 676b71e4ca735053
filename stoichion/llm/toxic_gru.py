"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A text is its words (runs of letters, digits and non-ASCII characters, A-Z lower-cased), cut into windows of 64 words
that begin every 48, so that each boundary lies inside another window; all windows of a text are scored. A word enters
as its embedding (words seen in two training documents or more; all others share one) joined to its characters: the sum
of the embeddings of its hashed byte n-grams (3 to 5 bytes, edges included) over the root of their number. Two
GRUs read the window in either direction, attention weighs their states, and a logistic unit scores it. All of it is trained from random
values; no statistic of the classes is an input. A text's
score comes from its three highest windows, its mean and its number of windows, through a logistic curve fitted to
documents that the network hadn't seen (two parts of the sample), in which both labels weigh the same.

Training is multiple-instance: in every second epoch each window of the sample is scored, and a document contributes its
highest window, clean documents also one at random; in the first two epochs the window of the highest log-odds stands
in, as nothing is learnt by then; log-odds go nowhere else. Parameters start at random from a fixed seed, a part of the words is
replaced by the unknown one so that characters are learnt too, and gradients go through time by hand.

Defined results: null and empty texts, and texts without a word, have no window and count as one window of the least
margin; with labels of one class only every score is 1 or 0 accordingly, without labels 0.5; repeated rows each get
their row; other columns pass through and those named like an output are replaced.

Scale: fitting takes at most `SAMPLE` labelled documents (a documented bound), half of them of either label where there are so many, to the driver,
which broadcasts them; the three networks are trained in a task each; scoring is one pass without a shuffle, the broadcast model is bounded by the sample.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

from stoichion.llm.decontamination import CLASSES
from stoichion.llm.labelled import known, pick, sample
from stoichion.llm.textbytes import Words, buffers, map_texts, mix

#: The most labelled documents that are used for fitting.
SAMPLE = 3000
WINDOW, STRIDE = 64, 48
WORD_DIM, CHAR_DIM, HIDDEN = 6, 6, 8
CHAR_ROWS, GRAMS = 1 << 16, (3, 4, 5)
EPOCHS, STEPS, BATCH, RATE = 6, 120, 96, 0.015
#: Documents that a word's log-odds are shrunk by, words replaced by the unknown one, and the pull of embeddings to 0.
PRIOR, DROP, DECAY = 8.0, 0.3, 1e-4


@dataclass
class WordTable:
    """Words of a group of texts: for each word its number among the distinct ones; of those, hashes and n-gram rows, the
    n-grams of a word lying between two cuts.
    """

    hashes: np.ndarray
    number: np.ndarray
    bounds: np.ndarray
    grams: np.ndarray
    cut: np.ndarray

    @staticmethod
    def of(texts: pa.Array) -> WordTable:
        data, offsets = buffers(texts)
        words = Words(data, offsets, CLASSES)
        hashes, first, number = np.unique(words.hashes(), return_index=True, return_inverse=True)
        start, size = words.starts[first], (words.ends - words.starts)[first]
        wide = size + 2
        base = np.cumsum(wide) - wide
        padded = np.full(int(wide.sum()), 1, np.uint64)
        inner = np.repeat(base + 1 - np.cumsum(size) + size, size) + np.arange(size.sum())
        padded[inner] = words.data[np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())]
        owner, ends = np.repeat(np.arange(len(first), dtype=np.int32), wide), np.repeat((base + wide).astype(np.int32), wide)
        grams, own = [], []
        for k in GRAMS:
            at = np.flatnonzero(np.arange(len(padded)) + k <= ends)
            value = np.full(len(at), k, np.uint64)
            for t in range(k):
                value = value * np.uint64(0x100000001B3) + padded[at + t]
            grams.append((mix(value) % np.uint64(CHAR_ROWS)).astype(np.int32))
            own.append(owner[at])
        own = np.concatenate(own)
        order = np.argsort(own, kind="stable")
        cut = np.searchsorted(own[order], np.arange(len(first) + 1))
        return WordTable(hashes, number.astype(np.int32), words.bounds, np.concatenate(grams)[order], cut)

    def by_word(self, how: np.ufunc, value: np.ndarray) -> np.ndarray:
        """For each distinct word the greatest or the sum of its n-grams' values, 0 for words without any."""
        out = np.zeros(len(self.hashes), np.float32)
        some = np.flatnonzero(self.cut[1:] > self.cut[:-1])
        if len(some):
            out[some] = how.reduceat(value[self.grams], self.cut[some])
        return out

    def part(self, texts: np.ndarray) -> WordTable:
        """The table of some of the texts; the distinct words stay those of all."""
        size = np.diff(self.bounds)[texts]
        ends = np.cumsum(size)
        at = np.repeat(self.bounds[texts] - ends + size, size) + np.arange(size.sum())
        return WordTable(self.hashes, self.number[at], np.concatenate([[0], ends]), self.grams, self.cut)


def windows(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, first word and number of words of each window; the last one of a text reaches its end."""
    size = np.diff(bounds)
    count = np.where(size == 0, 0, np.maximum(1, -(-(size - WINDOW) // STRIDE) + 1))
    doc = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    first = bounds[doc] + nth * STRIDE
    return doc, first, np.minimum(WINDOW, bounds[doc + 1] - first)


@dataclass
class Gru:
    """Parameters: word and character embeddings, for each direction input and state weights of the update, reset and
    candidate gates, attention and output.
    """

    known: np.ndarray
    p: dict[str, np.ndarray] = field(default_factory=dict)

    def words(self, hashes: np.ndarray) -> np.ndarray:
        """Rows of the word embeddings: 0 for words unknown."""
        if not len(self.known):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, at + 1, 0)

    def inputs(self, table: WordTable) -> np.ndarray:
        """Input vector of each distinct word."""
        size = np.sqrt(np.maximum(np.diff(table.cut), 1))
        chars = [table.by_word(np.add, self.p["char"][:, d]) / size for d in range(CHAR_DIM)]
        return np.column_stack([self.p["word"][self.words(table.hashes)], *chars]).astype(np.float32)

    def run(self, x: np.ndarray, index: np.ndarray, size: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
        """Margins of windows: x has the inputs of distinct words, index their numbers by window and position, size the
        number of words in each window. With keep, what the gradient needs.
        """
        n, steps, h = len(index), index.shape[1], HIDDEN
        states = np.zeros((n, steps, 2 * h), np.float32)
        live = np.arange(steps)[None, :] < size[:, None]
        memo: dict = {"live": live, "index": index}
        for d in (0, 1):
            proj = x @ self.p[f"w{d}"] + self.p[f"b{d}"]
            u, c = self.p[f"u{d}"][:, : 2 * h], self.p[f"u{d}"][:, 2 * h :]
            state, trace = np.zeros((n, h), np.float32), []
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                a = proj[index[:, t]]
                gate = 0.5 * np.tanh(0.5 * (a[:, : 2 * h] + state @ u)) + 0.5
                z, r = gate[:, :h], gate[:, h:]
                new = np.tanh(a[:, 2 * h :] + (r * state) @ c)
                before = state
                state = before + (z * (new - before)) * live[:, t : t + 1]
                states[:, t, d * h : (d + 1) * h] = state
                if keep:
                    trace.append((t, z, r, new, before))
            memo[d] = trace
        key = np.tanh(states @ self.p["wa"] + self.p["ba"])
        score = np.where(live, key @ self.p["va"], -1e9)
        weight = np.exp(score - score.max(axis=1, keepdims=True))
        weight /= weight.sum(axis=1, keepdims=True)
        pooled = (weight[:, :, None] * states).sum(axis=1)
        memo |= {"states": states, "key": key, "weight": weight, "pooled": pooled, "x": x}
        return pooled @ self.p["wo"] + self.p["bo"][0], memo

    def gradient(self, memo: dict, slope: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the parameters but the embeddings, and that of the inputs of the distinct words; slope is the
        loss by margin.
        """
        h, p = HIDDEN, self.p
        states, key, weight, pooled, live, index, x = (memo[k] for k in ("states", "key", "weight", "pooled", "live", "index", "x"))
        g = {"wo": pooled.T @ slope, "bo": np.array([slope.sum()])}
        d_pooled = slope[:, None] * p["wo"]
        d_states = weight[:, :, None] * d_pooled[:, None, :]
        d_weight = states @ d_pooled[:, :, None]
        d_score = weight * (d_weight[:, :, 0] - (weight * d_weight[:, :, 0]).sum(axis=1, keepdims=True))
        g["va"] = d_score.ravel() @ key.reshape(-1, h)
        d_key = d_score[:, :, None] * p["va"] * (1 - key**2)
        g["wa"], g["ba"] = states.reshape(-1, 2 * h).T @ d_key.reshape(-1, h), d_key.sum(axis=(0, 1))
        d_states = d_states + d_key @ p["wa"].T
        d_place = np.zeros((index.size, x.shape[1]), slope.dtype)
        entered = x[index.ravel()]
        for d in (0, 1):
            w, u = p[f"w{d}"], p[f"u{d}"]
            gu, gates_of = np.zeros(u.shape), np.zeros((*index.shape, 3 * h), slope.dtype)
            carry = np.zeros((len(index), h), slope.dtype)
            for t, z, r, new, before in reversed(memo[d]):
                total = carry + d_states[:, t, d * h : (d + 1) * h]
                on = total * live[:, t : t + 1]
                a_new = on * z * (1 - new**2)
                a_z = on * (new - before) * z * (1 - z)
                mixed = a_new @ u[:, 2 * h :].T
                a_r = mixed * before * r * (1 - r)
                gates = np.concatenate([a_z, a_r], axis=1)
                carry = total - on * z + mixed * r + gates @ u[:, : 2 * h].T
                gates_of[:, t, : 2 * h], gates_of[:, t, 2 * h :] = gates, a_new
                gu[:, : 2 * h] += before.T @ gates
                gu[:, 2 * h :] += (r * before).T @ a_new
            every = gates_of.reshape(-1, 3 * h)
            d_place += every @ w.T
            g |= {f"w{d}": entered.T @ every, f"u{d}": gu, f"b{d}": every.sum(axis=0)}
        return g, np.column_stack([np.bincount(index.ravel(), d_place[:, i], len(x)) for i in range(x.shape[1])])

    def margins(self, table: WordTable, most: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """Text number and margin of each window."""
        doc, first, size = windows(table.bounds)
        out = np.zeros(len(doc), np.float32)
        if len(doc):
            x, last = self.inputs(table), len(table.number) - 1
            for a in range(0, len(doc), most):
                index = table.number[np.minimum(first[a : a + most, None] + np.arange(WINDOW)[None, :], last)]
                out[a : a + most] = self.run(x, index, size[a : a + most])[0]
        return doc, out


def odds(bad: np.ndarray, count: np.ndarray, share: float) -> np.ndarray:
    """Log of a word's rate of label 1, over its share among all documents, shrunk by PRIOR documents of that share."""
    return np.log((bad + PRIOR * share) / (count + PRIOR) / share)


def start(table: WordTable, label: np.ndarray) -> tuple[Gru, np.ndarray]:
    """Parameters before training, and for each distinct word the greatest log-odds between the classes of it and its
    n-grams.
    """
    rng, share = np.random.default_rng(5), float(np.clip(label.mean() if len(label) else 0.5, 0.01, 0.99))
    held = np.zeros((2, len(table.hashes)), np.int64)
    grams = np.zeros((2, CHAR_ROWS))
    for i, c in enumerate(label):
        own = np.unique(table.number[table.bounds[i] : table.bounds[i + 1]])
        held[c, own] += 1
        size = table.cut[own + 1] - table.cut[own]
        at = np.repeat(table.cut[own] - np.cumsum(size) + size, size) + np.arange(size.sum())
        grams[c, np.unique(table.grams[at])] += 1
    known = table.hashes[held.sum(axis=0) > 1]
    telling = np.maximum(odds(held[1], held.sum(axis=0), share), table.by_word(np.maximum, odds(grams[1], grams.sum(axis=0), share)))
    draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    p = {"word": (0.1 * rng.standard_normal((len(known) + 1, WORD_DIM))).astype(np.float32), "char": (0.1 * rng.standard_normal((CHAR_ROWS, CHAR_DIM))).astype(np.float32)}
    for d in (0, 1):
        p |= {f"w{d}": draw(WORD_DIM + CHAR_DIM, 3 * HIDDEN), f"u{d}": draw(HIDDEN, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}
    p |= {"wa": draw(2 * HIDDEN, HIDDEN), "ba": np.zeros(HIDDEN, np.float32), "va": draw(HIDDEN), "wo": draw(2 * HIDDEN), "bo": np.zeros(1, np.float32)}
    return Gru(known, p), telling


def top(doc: np.ndarray, margin: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Greatest margin of each text and its window, -1 where a text has none."""
    best = np.full(n, -np.inf)
    np.maximum.at(best, doc, margin)
    at = np.full(n, -1)
    hit = np.flatnonzero(margin == best[doc])
    at[doc[hit]] = hit
    return best, at


def hints(table: WordTable, telling: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number of each window, and the greatest log-odds of a word in it: where to look before training."""
    doc, first, size = windows(table.bounds)
    odd = np.append(telling[table.number], -9)
    return doc, np.maximum.reduceat(odd, np.stack([first, first + size], axis=1).ravel())[::2] if len(doc) else odd[:0]


def train(all_texts: WordTable, label: np.ndarray) -> Gru:
    """Multiple-instance training with Adam, for EPOCHS epochs and about STEPS steps at least."""
    (net, telling), rng = start(all_texts, label), np.random.default_rng(17)
    known, cut = net.words(all_texts.hashes), all_texts.cut
    parts = [(own := all_texts.part(np.flatnonzero(label == y)), windows(own.bounds)) for y in (0, 1)]
    m1 = {k: np.zeros(v.shape, np.float32) for k, v in net.p.items()}
    m2 = {k: np.zeros(v.shape, np.float32) for k, v in net.p.items()}
    epochs = max(EPOCHS, -(-STEPS * BATCH // (2 * max(1, len(label)))))
    step, heavy = 0, min(4.0, max(1.0, (label == 0).sum() / max(1, label.sum()) / 2))
    for epoch in range(epochs):
        if epoch % 2 == 0:
            seen = [top(*(net.margins(table) if epoch else hints(table, telling)), len(table.bounds) - 1)[1] for table, _ in parts]
        chosen = []
        for y, (_, (doc, *_)) in enumerate(parts):
            best = seen[y][seen[y] >= 0]
            if y == 0 and len(doc):
                best = np.concatenate([best, rng.choice(len(doc), len(best))])
            chosen.append(np.stack([np.full(len(best), y), best]))
        chosen = np.concatenate(chosen, axis=1)
        chosen = chosen[:, rng.permutation(chosen.shape[1])]
        for a in range(0, chosen.shape[1], BATCH):
            y, own = chosen[:, a : a + BATCH]
            places, size = [], []
            for c in (0, 1):
                table, (_, first, count) = parts[c]
                mine = own[y == c]
                if len(mine):
                    places.append(table.number[np.minimum(first[mine, None] + np.arange(WINDOW)[None, :], len(table.number) - 1)].ravel())
                    size.append(count[mine])
            at, size = np.concatenate(places), np.concatenate(size)
            rows = np.where(rng.random(len(at)) < DROP, 0, known[at])
            word, back = np.unique(at, return_inverse=True)
            n = cut[word + 1] - cut[word]
            gram_row = all_texts.grams[np.repeat(cut[word] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            gram_at, root = np.repeat(np.arange(len(word)), n), np.sqrt(np.maximum(n, 1))[:, None]
            chars = np.column_stack([np.bincount(gram_at, net.p["char"][gram_row, d], len(word)) for d in range(CHAR_DIM)]) / root
            x = np.concatenate([net.p["word"][rows], chars[back]], axis=1).astype(np.float32)
            margin, memo = net.run(x, np.arange(len(rows)).reshape(-1, WINDOW), size, True)
            target = np.sort(y)
            slope = (1 / (1 + np.exp(-margin.astype(np.float64))) - target) * np.where(target == 1, heavy, 1.0) / len(own)
            g, d_x = net.gradient(memo, slope.astype(np.float32))
            for k, i, d_own in (("word", rows, d_x[:, :WORD_DIM]), ("char", gram_row, None)):
                if d_own is None:
                    per_word = np.column_stack([np.bincount(back, d_x[:, WORD_DIM + d], len(word)) for d in range(CHAR_DIM)]) / root
                    d_own = per_word[gram_at]
                g[k] = DECAY * net.p[k] + np.column_stack([np.bincount(i, d_own[:, d], len(net.p[k])) for d in range(d_own.shape[1])])
            step += 1
            rate = RATE * (1 - 0.8 * epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, v in g.items():
                v = v.astype(np.float32)
                m1[k] += 0.1 * (v - m1[k])
                m2[k] += 0.001 * (v * v - m2[k])
                net.p[k] = net.p[k] - np.float32(rate) * m1[k] / (np.sqrt(m2[k]) + np.float32(1e-8))
    return net


def evidence(doc: np.ndarray, margin: np.ndarray, n: int, least: float) -> np.ndarray:
    """For each text a row of its three greatest margins (the least where it has fewer windows), mean margin, log of
    the number of windows, and 1.
    """
    count = np.bincount(doc, minlength=n)
    order = np.lexsort((-margin, doc))
    cut = np.cumsum(count) - count
    out = np.full((n, 6), least)
    for k in range(3):
        some = count > k
        out[some, k] = margin[order[cut[some] + k]]
    some = count > 0
    out[some, 3] = np.bincount(doc, margin, n)[some] / count[some]
    out[:, 4], out[:, 5] = np.log(np.maximum(count, 1)), 1
    return out


def curve(x: np.ndarray, label: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Coefficients of the logistic curve, both labels weighing the same, by Newton steps; margins never count against label 1, so a column of them
    that would is left out.
    """
    used = np.ones(x.shape[1], bool)
    weight = np.where(label == 1, len(label) / 2 / max(1, label.sum()), len(label) / 2 / max(1, (1 - label).sum()))
    while True:
        theta = np.zeros(x.shape[1])
        own, t, keep = x[:, used], np.zeros(used.sum()), ridge * np.eye(used.sum())
        keep[-1, -1] = 1e-3
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(own @ t, -50, 50)))
            step = np.linalg.solve((own.T * (weight * p * (1 - p))) @ own + keep, own.T @ (weight * (p - label)) + keep @ t)
            t = t - step
            if np.abs(step).max() < 1e-8:
                break
        theta[used] = t
        bad = np.flatnonzero(theta[:4] < 0)
        if not len(bad):
            return theta
        used[bad[np.argmin(theta[bad])]] = False


@dataclass
class Model:
    net: Gru
    theta: np.ndarray
    least: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        if not self.theta[:-1].any():
            return np.full(len(texts), 1 / (1 + np.exp(-self.theta[-1])))
        x = evidence(*self.net.margins(WordTable.of(texts)), len(texts), self.least)
        return 1 / (1 + np.exp(-np.clip(x @ self.theta, -50, 50)))


def _part(table: WordTable, label: np.ndarray, c: int, parts: int) -> tuple:
    """For the last c the known words and parameters of the network trained on all; for each other c the texts of a part, and text number and margin of their
    windows by a network trained without them.
    """
    if c == parts:
        net = train(table, label)
        return net.known, net.p
    part = np.zeros(len(label), np.int64)
    for y in (0, 1):
        own = np.flatnonzero(label == y)
        part[own] = np.random.default_rng(3).permutation(len(own)) % parts
    own, rest = np.flatnonzero(part != c), np.flatnonzero(part == c)
    if len(rest) == 0 or label[own].min() == label[own].max():
        own = rest = np.arange(len(label))
    return rest, *train(table.part(own), label[own]).margins(table.part(rest))


def _on_executors(spark: SparkSession, texts: list[str], label: np.ndarray, parts: int) -> list:
    """_part() for each c, a task each; what comes back is bounded by the sample."""
    shared = spark.sparkContext.broadcast((texts, label))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in batch.column("id").to_pylist():
                own, y = shared.value
                made = _part(WordTable.of(pa.array(own, pa.large_string())), y, c, parts)
                yield pa.RecordBatch.from_pydict({"id": pa.array([c], pa.int64()), "made": pa.array([pickle.dumps(made)], pa.binary())})

    rows = spark.range(0, parts + 1, 1, parts + 1).mapInArrow(run, "id long, made binary").collect()
    shared.unpersist()
    return [pickle.loads(r["made"]) for r in sorted(rows, key=lambda r: r["id"])]


def build(texts: list[str], label: np.ndarray, spark: SparkSession | None = None, parts: int = 2) -> Model:
    """Trains without each part to place the curve, and on all; on executors where a session is given."""
    theta = np.zeros(6)
    if len(label) == 0 or label.min() == label.max():
        theta[-1] = 0.0 if len(label) == 0 else 50.0 * (2 * int(label[0]) - 1)
        return Model(start(WordTable.of(pa.array([], pa.large_string())), label[:0])[0], theta, 0.0)
    if spark is None:
        table = WordTable.of(pa.array(texts, pa.large_string()))
        *seen, net = (_part(table, label, c, parts) for c in range(parts + 1))
    else:
        *seen, net = _on_executors(spark, texts, label, parts)
    margins = np.concatenate([m for *_, m in seen])
    least = float(np.percentile(margins, 5)) if len(margins) else 0.0
    x = np.concatenate([evidence(doc, margin, len(rest), least) for rest, doc, margin in seen])
    return Model(Gru(*net), curve(x, label[np.concatenate([rest for rest, *_ in seen])]), least)


def fit(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, rows: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Model of the labelled documents that are allowed for training."""
    every = known(labels, label, allowed, doc_id)
    picked = pick(every.where("label = 1"), rows // 2).union(pick(every.where("label = 0"), rows // 2))
    found = sorted((x["label"], x["text"]) for x in sample(docs, picked, doc_id, text).select("label", "text").toLocalIterator())
    return build([t for _, t in found], np.array([y for y, _ in found], np.int64), docs.sparkSession)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score", drop_text: bool = True) -> DataFrame:
    """docs with the score of its text."""
    shared = docs.sparkSession.sparkContext.broadcast((model.net.known, model.net.p, model.theta, model.least))

    def make():
        known, p, *rest = shared.value
        own = Model(Gru(known, p), *rest)
        return lambda texts, _: {out: pa.array(own.scores(texts), pa.float64())}

    return map_texts(docs, make, [T.StructField(out, T.DoubleType())], text, drop_text)
