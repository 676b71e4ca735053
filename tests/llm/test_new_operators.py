"""Whitening, Merkle manifest and language-model scores against brute force, exact arithmetic and known answers."""

import hashlib
import math
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from stoichion.llm import eigen, merkle, ngram_lm, whitening
from stoichion.llm.keys import workspace
from stoichion.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", " \n", "a b c a b c a b", "A B\x00 c\x85 d", "é ½ 🙂 é ½", "a b c a b c a b", "x" * 5000, "w " * 3000, *(f"the cat {i} sat on the mat {i % 3}" for i in range(30))]


def spectrum(values, seed):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))[0]
    a = (q * values) @ q.T
    return (a + a.T) / 2


MATRICES = {
    "one": np.array([[3.0]]), "zero": np.zeros((4, 4)), "equal": np.eye(9), "ones": np.ones((7, 7)), "path": np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1),
    "groups": spectrum(np.repeat([1.0, 2.0, 3.0], 8), 1), "close": spectrum(1 + 1e-12 * np.arange(30), 2), "graded": spectrum(10.0 ** -np.arange(40), 3), "signs": spectrum(np.r_[np.ones(10), -np.ones(10)], 4),
    "wilkinson": np.diag(np.abs(np.arange(-10.0, 11))) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1), "random": spectrum(np.random.default_rng(5).normal(size=65), 5),
}


@pytest.mark.parametrize("name", sorted(MATRICES))
def test_eigen(name):
    a = MATRICES[name]
    values, vectors = eigen.eigen(a)
    size = max(np.abs(a).max(), 1e-300)
    assert np.abs(values - np.sort(np.linalg.eigvalsh(a))[::-1]).max() <= 1e-14 * size * len(a)
    assert np.abs(vectors.T @ vectors - np.eye(len(a))).max() < 1e-13 and np.abs(a @ vectors - vectors * values).max() <= 1e-14 * size * len(a)


def exact_covariance(rows):
    n, dims = len(rows), len(rows[0])
    mean = [Fraction(sum(r[i] for r in rows), n) for i in range(dims)]
    return [[sum((r[i] - mean[i]) * (r[j] - mean[j]) for r in rows) / n for j in range(dims)] for i in range(dims)]


def test_covariance_is_exact_to_the_last_bits(spark):
    """Entries about 2**40 apart from a spread of a few units: plain sums of squares would lose all digits."""
    rng = np.random.default_rng(1)
    rows = [[int(x) for x in (1 << 40) + rng.integers(-3, 4, 5)] for _ in range(200)]
    df = spark.createDataFrame([(r,) for r in rows], "x array<long>").repartition(7)
    n, sums = whitening.sums_of(df, 5)
    assert (n, sums) == (200, [sum(r[i] for r in rows) for i in range(5)])
    got = whitening.covariance(df, "x", whitening.mean_of(n, sums), n)
    assert np.abs(got / np.array([[float(x) for x in r] for r in exact_covariance(rows)]) - 1).max() < 1e-14
    big = np.array([[1 << 50, -(1 << 50)]])
    d, square = whitening.deviations(big, 1 << 20, np.array([0, 0], object))
    assert int(square[0]) == 2 * (1 << 140) and d[0, 0] == 1 << 70


def test_whitening_query(spark):
    got = QUERIES["op11_whitening"](spark, SF).toPandas()
    e = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    x = np.floor(1024 * np.stack(e["embedding"]).astype(float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    values, vectors = np.linalg.eigh((x - s / n).T @ (x - s / n) / n)
    want = (x - s / n) @ vectors[:, ::-1][:, :8] / np.sqrt(values[::-1][:8])
    own = got.pivot(index="vec_id", columns="component", values="whitened").loc[e["vec_id"]].to_numpy()
    assert np.abs(own * np.sign((own * want).sum(axis=0)) - want).max() < 1e-9 and len(got) == 8 * n
    first = got[got["component"] == 1].set_index("vec_id").loc[e["vec_id"]]
    assert (first["deviation"].to_numpy() == ((n * x - s) ** 2).sum(axis=1)).all() and (first["n"] == n).all()
    assert np.abs(first["explained"] - values[-1] / values.sum()).max() < 1e-12 and got["identity_error"].max() < 1e-9


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0, -1.0]), (3, None), (4, []), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0, 2.0, 3.0]), (None, [0.5, 0.25]), (9, [1e300, 0.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, n string")
    got = whitening.whiten(df, "embedding", workspace(spark, "w")).collect()
    assert sorted(str(x["row"]["vec_id"]) for x in got) == ["1", "1", "2", "None"] and {x["n"] for x in got} == {4} and {x["row"]["n"] for x in got} == {"x"}
    assert all(len(x["whitened"]) == 2 and x["identity_error"] < 1e-9 for x in got)
    flat = whitening.whiten(df.where("vec_id = 1"), "embedding", workspace(spark, "w")).collect()
    assert [x["whitened"] for x in flat] == [[0.0, 0.0]] * 2 and flat[0]["explained"] == [0.0, 0.0] and flat[0]["deviation"] == 0
    assert whitening.whiten(df.limit(0), "embedding", workspace(spark, "w")).count() == 0


def sha(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def tree(leaves):
    """Root, and for each leaf its siblings with their sides."""
    at, own, proofs = list(leaves), [[i] for i in range(len(leaves))], [[] for _ in leaves]
    while len(at) > 1:
        up, held = [], []
        for i in range(0, len(at), 2):
            pair, members = at[i : i + 2], own[i : i + 2]
            for k, who in enumerate(members):
                for j in who:
                    proofs[j].append(("" if len(pair) == 1 else pair[1 - k], k))
            up.append(sha(*pair))
            held.append([j for who in members for j in who])
        at, own = up, held
    return at[0], proofs


def merkle_rows(rows):
    text = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, more=0: sha(*(text(r[c] + more if c == "n_chars" and r[c] is not None else r[c]) for c in ("doc_id", "source", "lang", "n_chars", "text")))
    langs, out = {}, []
    for r in rows:
        langs.setdefault(r["lang"], []).append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    for own in langs.values():
        own.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    subs = {x: tree([leaf(r) for r in langs[x]]) for x in order}
    root, tops = tree([subs[x][0] for x in order])
    for x, top in zip(order, tops, strict=True):
        for r, proof in zip(langs[x], subs[x][1], strict=True):
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            at = leaf(r, int(tampered))
            for other, k in proof + top:
                at = sha(other, at) if k else sha(at, other)
            out.append((r["doc_id"], leaf(r), subs[x][0], root, sha(*(s for s, _ in proof + top)), at, at == root))
    return sorted(map(str, out))


@pytest.mark.parametrize("few", [50_000, 2])
def test_merkle_manifest(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(merkle, "FEW", few)
    rows = [(i % 17 if i % 9 else None, f"t{i % 23}" if i % 5 else None, [None, "", "de", "en", "é", "-"][min(i % 11, 5)], None if i % 4 == 0 else i % 3, None if i % 8 == 0 else f"s{i % 2}") for i in range(150)]
    df = spark.createDataFrame([*rows, rows[3], rows[3], (7, "long" * 50_000, "one", 5, None)], "doc_id long, text string, lang string, n_chars long, source string").withColumn("g", F.lit("x")).repartition(5)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op12_merkle_manifest"](spark, str(tmp_path)).collect()
    assert sorted(str(tuple(r)) for r in got) == merkle_rows([r.asDict() for r in df.collect()])
    assert any(not r["verified"] for r in got) and any(r["verified"] for r in got)


def test_merkle_sql(spark):
    import duckdb

    from stoichion.llm.oracles import ORACLES

    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted(map(str, db.execute(ORACLES["op12_merkle_manifest"]).fetchall())) == sorted(str(tuple(r)) for r in QUERIES["op12_merkle_manifest"](spark, SF).collect())


class Plain:
    """The model by its definition."""

    def __init__(self, texts, order, strength, added):
        self.c, self.order, self.m, self.a = Counter(), order, strength, added
        for t in texts:
            x = ["<", *self.tokens(t)]
            for k in range(1, order + 1):
                self.c.update((k, tuple(x[i - k + 1 : i + 1])) for i in range(max(k - 1, 1), len(x)))
        self.vocabulary = {g[0] for k, g in self.c if k == 1}
        self.n = sum(v for (k, _), v in self.c.items() if k == 1)
        self.c[1, ("<",)] = len(texts)

    @staticmethod
    def tokens(text):
        return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), ">"]

    def p(self, gram):
        k = len(gram)
        if k == 1:
            count = self.c[1, gram] if gram[0] in self.vocabulary else 0
            return (count + self.a) / (self.n + self.a * (len(self.vocabulary) + 1))
        m = self.m[k - 2]
        return (self.c[k, gram] + m * self.p(gram[1:])) / (self.c[k - 1, gram[:-1]] + m)

    def score(self, text):
        x = ["<", *self.tokens(text)]
        return sum(math.log10(self.p(tuple(x[max(0, i - self.order + 1) : i + 1]))) for i in range(1, len(x)))


@pytest.mark.parametrize(("order", "block"), [(1, 1 << 20), (2, 400), (3, 1 << 20), (3, 100), (4, 3000)])
def test_language_model(spark, tmp_path, order, block):
    """Every text's score against the definition, whatever the blocks."""
    strength = (3.0, 0.5, 0.25)
    texts = [*TEXTS, *TEXTS[3:6], "w " * 200 + "never seen before " * 90]
    spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, score string").repartition(3).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    got = ngram_lm.score(docs, F.col("doc_id") % 4 != 0, workspace(spark, "lm"), order=order, strength=strength, block_bytes=block, part_bytes=2000).collect()
    plain = Plain([t for i, t in enumerate(texts) if i % 4], order, strength, ngram_lm.ADDED)
    assert len(got) == len(texts) and {r["train_tokens"] for r in got} == {plain.n} and {r["row"]["score"] for r in got} == {"x"}
    for r in got:
        x = plain.tokens(texts[r["row"]["doc_id"]])
        assert (r["n_tokens"], r["n_known"]) == (len(x), sum(t in plain.vocabulary for t in x))
        assert r["score"] == pytest.approx(plain.score(texts[r["row"]["doc_id"]]), rel=1e-9)
        assert r["base_score"] == pytest.approx(sum(math.log10(plain.p((t,))) for t in x), rel=1e-9)


def test_language_model_sums_to_one():
    plain = Plain(TEXTS, 3, (3.0, 0.5), 0.1)
    for context in (("<",), ("the", "cat"), ("cat", "7"), ("never", "seen"), ("a", "b")):
        assert sum(plain.p((*context, w)) for w in [*plain.vocabulary, "?"]) == pytest.approx(1)


def test_language_model_without_training_texts(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (None, "c")], "doc_id long, text string")
    got = ngram_lm.score(docs, F.lit(False), workspace(spark, "lm")).collect()
    assert len(got) == 3 and all(r["score"] == 0 and r["base_score"] == 0 and r["n_known"] == 0 and r["train_tokens"] == 0 for r in got)
    assert ngram_lm.score(docs.limit(0), F.lit(True), workspace(spark, "lm")).count() == 0


def test_secrets_of_a_text_with_very_many(spark):
    """100 000 hits of two rules in one text: places and masks are right, and the work grows with the text, not with its square."""
    from stoichion.llm import secret_scan

    hit = lambda i: hashlib.md5(str(i).encode()).hexdigest()[:16] if i % 2 else f"AKIA{i:014d}"
    text, ends, at = [], [], 0
    for i in range(100_000):
        text.append(hit(i) + "é ")
        ends.append((at, at + len(hit(i))))
        at += len(text[-1])
    df = spark.createDataFrame([(1, "".join(text))], "doc_id long, text string")
    spans = secret_scan.scan(df, rules=secret_scan.BASE).first()["spans"]
    assert [(x["start"], x["end"]) for x in spans] == ends and {x["rule"] for x in spans} == {1, 2}
    assert secret_scan.redact(df, rules=secret_scan.BASE).first()["text"] == "[SECRET]é " * 100_000


def _licence_cases():
    """Every template as it is and with a tenth of its words replaced, put in or left out, within prose of several lengths."""
    import random

    from stoichion.llm import license_scan

    rng, out = random.Random(1), []
    for k, (_, text) in enumerate(license_scan.TEMPLATES):
        for size in (0, 30, 300, 1200):
            for changed in (False, True):
                words = text.split()
                for _ in range(len(words) // 10 if changed else 0):
                    j = rng.randrange(len(words))
                    if not any(license_scan.TELLING.search(w) for w in re.findall(r"\w+", words[j].lower())):
                        words[j : j + 1] = rng.choice([["zebra"], [words[j], "zebra"], [words[j]]])
                prose = [f"w{x}" for x in np.random.default_rng(k * size).integers(0, 300, size)]
                out.append(" ".join([*prose[: size // 2], *words, *prose[size // 2 :]]))
    return out


def test_licence_recall_against_every_template(monkeypatch):
    """What the winners of compression find, against confirming every template everywhere: at least 0.95 of it, and nothing else."""
    from stoichion.llm import license_scan

    cases = _licence_cases()
    won = [license_scan.Scanner().spans(x) for x in cases]
    monkeypatch.setattr(license_scan, "WON", -1e9)
    every = [license_scan.Scanner().spans(x) for x in cases]
    assert sum(len(set(a) & set(b)) for a, b in zip(won, every, strict=True)) >= 0.95 * sum(map(len, every)) and sum(map(len, every)) > 0.9 * len(cases)
    assert all(set(a) <= set(b) for a, b in zip(won, every, strict=True))


def test_licence_winners_decide(monkeypatch):
    """Only what wins the ranking by size is confirmed."""
    from stoichion.llm import license_scan

    text = "x y z Released under the MIT License. and so on"
    assert [x[2] for x in license_scan.Scanner().spans(text)] == ["MIT"]
    monkeypatch.setattr(license_scan.Scanner, "ranked", lambda self, window, size=0: [])
    assert license_scan.Scanner().spans(text) == []
    monkeypatch.setattr(license_scan, "WON", 10.0)
    assert license_scan.Scanner().spans(text) == []


def test_licence_without_its_first_words_and_tags():
    from stoichion.llm import license_scan

    scanner = license_scan.Scanner()
    gpl = next(t for n, t in license_scan.TEMPLATES if n == "GPL-3.0" and t.startswith("This program is free"))
    assert [x[2] for x in scanner.spans("one two " + gpl.split(" ", 2)[2] + " three")] == ["GPL-3.0"]
    for text, name in (("// SPDX-License-Identifier: MIT", "MIT"), ("# SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0-only"), ("given under the terms of the MIT license, as is", "MIT"), ("see the BSD 3-Clause License.", "BSD-3-Clause")):
        assert [x[2] for x in scanner.spans(text)] == [name], text
    assert scanner.spans("SPDX-License-Identifier: None") == []
