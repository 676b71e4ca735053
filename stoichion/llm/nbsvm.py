"""Quality classifier: Naive Bayes support vectors over n-gram indicators.

Indicators are hashed n-grams of three streams of a text: words (one and two), bytes (four) and word shapes (two and
three; a shape is the class of a word's first and last byte, whether it has only capitals, and whether it equals the
word before or the one before that). Each indicator is scaled by the log-count ratio of the two classes, the rows are brought to unit length,
and a linear hinge-loss model is fitted by dual coordinate descent; its weights are drawn towards their mean magnitude
as the method has it. A logistic curve makes margins into scores from 0 to 1; it is fitted to margins of models that
haven't seen the row (four parts of the sample).

Defined results: null and empty texts have the bias alone and get its score; with labels of one class only, every score
is 1 or 0 accordingly; without labels every score is 0.5; repeated rows each get their row; other columns pass through and those named like
an output are replaced.

Scale: fitting takes at most `SAMPLE` labelled documents (a documented bound) and sends their distinct features, not
texts, to the driver; scoring is one pass without a shuffle, over a broadcast of 2 * 2**19 floats.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from stoichion.llm.labelled import known, pick, sample
from stoichion.llm.textbytes import SPACED, Words, buffers, byte_classes, gram_hashes, gram_valid, groups, map_texts, mix

#: The most labelled documents that are used for fitting.
SAMPLE = 6000
BITS = 19
EPOCHS, COST, BETA = 12, 1.0, 0.5

_AS_IS = byte_classes(lambda b: SPACED[b] != 0, lower=False)
_KIND = np.array([1 if 97 <= b <= 122 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else 4 if b >= 128 else 5 + b % 59 for b in range(256)], np.uint64)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text number and feature number (below 2**BITS; 0 is the bias) of each distinct indicator, sorted."""
    data, offsets = buffers(texts)
    n = len(offsets) - 1
    doc_bits = np.uint64(BITS)
    keys = [np.arange(n, dtype=np.uint64) << doc_bits]

    def add(doc: np.ndarray, hashes: np.ndarray, kind: int) -> None:
        number = mix(hashes + np.uint64(kind)) >> np.uint64(64 - BITS)
        keys.append((doc.astype(np.uint64) << doc_bits) | np.maximum(number, np.uint64(1)))

    words = Words(data, offsets, _AS_IS)
    if len(words.starts):
        hashes, owner = words.hashes(), words.owners()
        low = Words(data, offsets, SPACED).hashes()
        add(owner, low, 1)
        ok = gram_valid(words.bounds, 2)
        add(owner[: len(ok)][ok], gram_hashes(low, 2)[ok], 2)
        capital = np.concatenate([[0], np.cumsum((data >= 97) & (data <= 122))])
        shape = _KIND[data[words.starts]] | _KIND[data[words.ends - 1]] << np.uint64(8)
        shape |= (capital[words.ends] == capital[words.starts]).astype(np.uint64) << np.uint64(16)
        for back in (1, 2):
            same = np.zeros(len(low), np.uint64)
            same[back:] = low[back:] == low[:-back]
            shape |= same << np.uint64(16 + back)
        shape = mix(shape)
        for k in (2, 3):
            ok = gram_valid(words.bounds, k)
            add(owner[: len(ok)][ok], gram_hashes(shape, k)[ok], 10 + k)
    if len(data) >= 4:
        quad = data[:-3].astype(np.uint64) | data[1:-2].astype(np.uint64) << np.uint64(8) | data[2:-1].astype(np.uint64) << np.uint64(16) | data[3:].astype(np.uint64) << np.uint64(24)
        ok = gram_valid(offsets, 4)
        owner = np.repeat(np.arange(n), np.diff(offsets))
        add(owner[: len(ok)][ok], quad[ok], 20)
    key = np.sort(np.concatenate(keys))
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    return (key >> doc_bits).astype(np.int64), (key & np.uint64((1 << BITS) - 1)).astype(np.int64)


@dataclass
class Model:
    """score = 1 / (1 + exp(-(slope * margin + offset))); margin = sum(weight) / sqrt(sum(square)) over a text's features."""

    weight: np.ndarray
    square: np.ndarray
    slope: float
    offset: float

    def margins(self, doc: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(doc, self.weight[feature], n) / np.sqrt(np.bincount(doc, self.square[feature], n) + 1e-12)

    def scores(self, texts: pa.Array) -> np.ndarray:
        margin = self.margins(*features(texts), len(texts))
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -50, 50)))


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int, cost: float, epochs: int) -> np.ndarray:
    """Weights of the linear hinge-loss model: each step solves the dual for one row, alpha staying within 0 and cost."""
    w, alpha = np.zeros(size), np.zeros(len(rows))
    norm = np.array([float(v @ v) for v in values])
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            if norm[i] == 0:
                continue
            gradient = y[i] * float(w[rows[i]] @ values[i]) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost)
            if new != alpha[i]:
                w[rows[i]] += (new - alpha[i]) * y[i] * values[i]
                alpha[i] = new
    return w


def logistic(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through margins, with smoothed targets, by Newton steps."""
    up, down = label.sum(), (1 - label).sum()
    target = np.where(label == 1, (up + 1) / (up + 2), 1 / (down + 2))
    x, theta = np.stack([margin, np.ones(len(margin))]), np.array([1.0, np.log((up + 1) / (down + 1))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(theta @ x, -50, 50)))
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + 1e-3 * np.eye(2), x @ (p - target) + 1e-3 * theta)
        theta = theta - step
        if np.abs(step).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])


def weights(rows: list[np.ndarray], label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-count ratios, and the weights of the rows scaled by them."""
    count = np.ones((2, 1 << BITS))
    for row, y in zip(rows, label, strict=True):
        count[y, row] += 1
    ratio = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
    ratio[0] = 1.0
    scaled = [ratio[r] / np.sqrt(ratio[r] @ ratio[r]) for r in rows]
    w = dual_descent(rows, scaled, 2.0 * label - 1, len(ratio), COST, EPOCHS)
    used = w != 0
    mean = np.abs(w[used]).mean() if used.any() else 0.0
    return ratio, np.where(used, (1 - BETA) * mean + BETA * w, 0.0)


def train(rows: list[np.ndarray], label: np.ndarray, parts: int = 4) -> Model:
    """Fits all rows; the curve goes through margins of models that haven't seen the row."""
    size = 1 << BITS
    if len(rows) == 0 or label.min() == label.max():
        return Model(np.zeros(size, np.float32), np.ones(size, np.float32), 0.0, 0.0 if len(rows) == 0 else 50.0 * (2 * int(label[0]) - 1))
    part = np.zeros(len(rows), np.int64)
    for y in (0, 1):
        own = np.flatnonzero(label == y)
        part[own] = np.random.default_rng(11).permutation(len(own)) % parts
    margin = np.zeros(len(rows))
    for p in range(parts):
        fitted = np.flatnonzero(part != p)
        ratio, w = weights([rows[i] for i in fitted], label[fitted])
        for i in np.flatnonzero(part == p):
            margin[i] = w[rows[i]] @ ratio[rows[i]] / np.sqrt(ratio[rows[i]] @ ratio[rows[i]])
    ratio, w = weights(rows, label)
    slope, offset = logistic(margin, label)
    return Model((ratio * w).astype(np.float32), (ratio**2).astype(np.float32), slope, offset)


def fit(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, rows: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Model of the labelled documents that are allowed for training."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in groups(whole, "text"):
                doc, feature = features(batch.column("text"))
                cuts = np.searchsorted(doc, np.arange(batch.num_rows + 1))
                data = [feature[a:b].astype("<i4").tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(data, pa.binary())], ["label", "features"])

    found = sample(docs, pick(known(labels, label, allowed, doc_id), rows), doc_id, text).mapInArrow(run, "label int, features binary").collect()
    found.sort(key=lambda x: (x[0], bytes(x[1])))
    return train([np.frombuffer(x[1], "<i4").astype(np.int64) for x in found], np.array([x[0] for x in found], np.int64))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score", drop_text: bool = True) -> DataFrame:
    """docs with the score of its text."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weight, model.square, model.slope, model.offset))

    def make():
        own = Model(*shared.value)
        return lambda texts, _: {out: pa.array(own.scores(texts), pa.float64())}

    return map_texts(docs, make, [T.StructField(out, T.DoubleType())], text, drop_text)
