"""Operators of the training-data pipeline: brute force, round trips, and odd inputs (nulls, empty, long, repeated)."""

import collections
import hashlib
import itertools
import re
import textwrap
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stoichion.llm import bagminhash, byte_bpe, decontamination, license_scan, line_rules, nbsvm, secret_scan, sentence_spans, token_frames, toxic_gru
from stoichion.llm.pieces import PieceCache
from stoichion.llm.queries import QUERIES, _vocabulary
from stoichion.llm.trigram_query import trigram_query

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def docs(spark, *texts, ids=None, sources=None):
    rows = [(i if ids is None else ids[i], t, None, "s" if sources is None else sources[i], None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def words(n, seed=0, size=500):
    rng = np.random.default_rng(seed)
    return [f"w{x}" for x in rng.integers(0, size, n)]


ODD = [None, "", " ", "\n\n", "a", "a", "é b  c\t", "x" * 50_000, "word " * 20_000, "it's 1½ <|endoftext|> \x00 🙂"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Tables of odd documents, with extra columns of clashing names, and empty ones."""
    out = {}
    for name, texts in (("odd", ODD), ("empty", [])):
        d = tmp_path_factory.mktemp(name)
        base = docs(spark, *texts)
        both = base.union(base).union(docs(spark, "no id", ids=[None]) if texts else base)
        for c in ("score", "spans", "ids", "kept", "n_words", "decoded", "label", "node"):
            both = both.withColumn(c, F.lit("x"))
        both.write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, None), (None, "")] if texts else [], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        spark.createDataFrame([(i, i % 2, None) for i in range(5)] if texts else [], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        vectors = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [0.5, -1.0]), (2, None), (3, []), (4, [float("nan"), 1.0])] if texts else []
        spark.createDataFrame([(*v, "x", "x") for v in vectors], "vec_id long, embedding array<float>, n string, row string").write.parquet(f"{d}/embeddings.parquet")
        out[name] = str(d), both.count()
    return out


@pytest.mark.parametrize("kind", ["odd", "empty"])
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_tables(spark, tables, name, kind):
    path, n = tables[kind]
    rows = QUERIES[name](spark, path).collect()
    # Whitening has other rows: two components for each of the three vectors that it keeps.
    assert len(rows) == (n if name != "op11_whitening" else 6 if n else 0)
    if "score" in (rows[0].asDict() if rows else {}) and name != "op13_lm_scores":  # whose scores are logarithms
        assert all(0 <= r["score"] <= 1 for r in rows)


@pytest.mark.parametrize("kind", ["odd", "empty"])
def test_odd_pipeline(spark, tables, kind):
    import corpus_pipeline

    path = tables[kind][0]
    at = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, at, path)
        assert after.columns == at.columns, name
        assert after.count() <= at.count()
    assert corpus_pipeline.run(spark, path).count() <= tables[kind][1]


def test_pipeline_effects(spark, tmp_path):
    """Stage by stage against plain Python over a small corpus."""
    import corpus_pipeline

    clean = [" ".join(words(120, i)) for i in range(4)]
    leak = " ".join(words(60, 99))
    texts = [*clean, clean[0] + " end", "short", clean[1] + " " + leak, clean[2] + " more " + "token=abcdefghijklmnop " + " ".join(words(200, 50))]
    docs(spark, *texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, str(tmp_path))
        seen[name] = {r["doc_id"]: r for r in at.collect()}
        at = spark.createDataFrame(list(seen[name].values()), at.schema)
    assert set(seen["quality_rules"]) == {0, 1, 2, 3, 4, 6, 7}
    assert set(seen["near_duplicates"]) == {0, 1, 2, 3, 6, 7}
    assert set(seen["decontamination"]) == {0, 1, 2, 3, 7}
    text = seen["secret_scan"][7]["text"]
    assert secret_scan.MASK in text and "abcdefghijklmnop" not in text and seen["secret_scan"][7]["n_chars"] == len(text)
    assert seen["byte_bpe"][0]["decoded_sha256"] == hashlib.sha256(clean[0].encode()).hexdigest()
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(seen["byte_bpe"])


def bag(text):
    w = re.findall(r"[^\x00\x20\x09-\x0D]+", text)
    k = min(5, len(w))
    return collections.Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else collections.Counter()


def test_names_that_clash(spark):
    """Columns named like those that the operators make themselves come out as they went in."""
    names = ["_host", "_key", "_gone", "_id", "_node", "_own", "_salt", "_full", "_may", "_text", "_hash", "cuts", "rules", "text_hash", "spans", "n_hit", "item_ids", "row", "host", "node", "gone", "salt",
             "found", "id", "h", "full", "may", "removed_lines", "kept", "class_id", "own_id", "own_node", "n_words", "b0", "a.b"]
    line = " ".join(words(70, 1))
    base = docs(spark, f"{line} token=abcdefghijklmnop", "", None, line, "\n".join([" ".join(words(60, 3)), " ".join(words(60, 4))]))
    d = base.select("*", *(F.concat(F.lit(n), F.col("doc_id")).alias(n) for n in names))
    bench = spark.createDataFrame([(1, " ".join(words(60, 3)))], "item_id long, text string")
    made = {
        "clean": line_rules.clean(d), "deduplicate": bagminhash.deduplicate(d), "redact": secret_scan.redact(d), "decontaminate": decontamination.decontaminate(d, bench),
        "decontaminate spans": decontamination.decontaminate(d, bench, remove="spans"), "remove_repeats": sentence_spans.remove_repeats(d).select(*(f"`{c}`" for c in d.columns)),
    }
    for name, out in made.items():
        assert out.columns == d.columns, name
        rows = out.collect()
        assert rows, name
        for r in rows:
            assert all(r[n] == f"{n}{r['doc_id']}" for n in names), name
    assert {r["doc_id"]: r["text"] for r in made["redact"].collect()}[2] is None
    assert {r["doc_id"] for r in made["decontaminate"].collect()} == {0, 1, 2, 3}


def similar(a, b):
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def test_near_duplicates_against_brute_force(spark):
    rng = np.random.default_rng(2)
    texts = []
    for i in range(12):
        base = words(150, i)
        texts.append(" ".join(base))
        for k in range(6):
            own = list(base)
            for at in rng.integers(0, len(own), k):
                own[at] = f"z{rng.integers(0, 9999)}"
            texts.append(" ".join(own))
    texts += [texts[3], "a b", "a b", "c d", "u v w x y " * 40, "u v w x y " * 44, "u v w x y " * 80]
    bags, parent = [bag(t) for t in texts], list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        if texts[i] == texts[j] or similar(bags[i], bags[j]) >= 0.8:
            parent[max(root(i), root(j))] = min(root(i), root(j))
    found = {r["doc_id"]: r["class_id"] for r in bagminhash.near_duplicate_classes(docs(spark, *texts)).collect()}
    assert found == {i: root(i) for i in range(len(texts))}


def test_signatures_are_unbiased():
    rng, errors = np.random.default_rng(0), []
    for _ in range(30):
        n = 200
        element = np.sort(rng.integers(0, 1 << 44, n).astype(np.uint64))
        a = rng.integers(0, 6, n) * (rng.random(n) < 0.7)
        b = np.where(rng.random(n) < 0.6, a, rng.integers(0, 30, n))
        doc = np.concatenate([np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)])
        s = bagminhash.signatures(doc, np.concatenate([element[a > 0], element[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, 512)
        errors.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.012


def test_blocks_find_all_links():
    texts = [" ".join(words(60, i % 5)) + f" x{i}" for i in range(20)] + ["a " * n for n in (30, 32, 80)]
    a = pa.array(texts)
    got = set(zip(*(x.tolist() for x in bagminhash.block_links(a, a, 5, 0.8)), strict=True))
    assert got == {(i, j) for i in range(len(texts)) for j in range(len(texts)) if similar(bag(texts[i]), bag(texts[j])) >= 0.8}


def test_decontamination_blocks_and_spans(spark):
    items = [(i, " ".join(words(30, i))) for i in range(6)] + [(9, "only three words")]
    texts = [items[0][1], "Pre " + " ".join(items[1][1].upper().split()[5:17]) + " post", "ONLY, three; words", "nothing", items[2][1] + " x " + items[3][1]]
    d, b = docs(spark, *texts), spark.createDataFrame(items, "item_id long, text string")
    key = lambda df: sorted((r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"], [tuple(s) for s in r["spans"]]) for r in df.collect())
    one = key(decontamination.scan(d, b))
    assert [r[2] for r in one] == [30, 12, 3, 0, 60]
    assert one == key(decontamination.scan(d, b, max_windows=40))
    cut = {r["doc_id"]: r["text"] for r in decontamination.decontaminate(d, b, remove="spans").collect()}
    assert cut == {0: "", 1: "Pre  post", 2: "", 3: "nothing", 4: " x "}
    assert [r["doc_id"] for r in decontamination.decontaminate(d, b).collect()] == [3]


def test_spans_keep_first_only(spark):
    shared = "One two three four five six seven. Eight nine ten eleven twelve. A b c d e f g h i j. K l m n o p q r."
    texts = [f"Alpha beta gamma.\n{shared}\nOmega is here now.", f"Delta epsilon.\n{shared}\nTheta.", "Short one.", f"{shared}\n\n{shared}"]
    got = {r["doc_id"]: (r["n_removed"], r["text"]) for r in sentence_spans.remove_repeats(docs(spark, *texts)).collect()}
    assert got[0] == (0, texts[0]) and got[2] == (0, texts[2])
    assert got[1] == (4, "Delta epsilon.\nTheta.") and got[3] == (8, "")


def sentences_of(text):
    """Word lists of sentences, and their pieces of the text."""
    out, now = [], []
    for m in re.finditer(r"\S+", text or ""):
        now.append(m)
        after = re.match(r"\s*", text[m.end() :])[0]
        if re.search(r"[.!?][\"')\]}]?$", m[0]) or "\n" in after or m.end() + len(after) == len(text) or len(now) == sentence_spans.PIECE_WORDS:
            out.append(now)
            now = []
    return out


def test_spans_against_brute_force(spark):
    """Random texts of few sentences and words: what any repeated run covers goes, but for its first place."""
    rng = np.random.default_rng(11)
    pool = [" ".join(rng.choice(list("abcdefghijklmnop"), rng.integers(1, 30))) + rng.choice([".", "!", ".\n", "?)"]) for _ in range(25)]
    texts = [" ".join(rng.choice(pool, rng.integers(0, 14))) for _ in range(60)]
    texts += [" ".join(pool[:9]), "x y. " + " ".join(pool[:9]), " ".join([*pool[:9], "Chi psi."]), "y. " + " ".join([*pool[:9], "Chi psi."]) + " end of it. z."]
    ids = [*range(50), *([None] * (len(texts) - 50))]
    least, size = sentence_spans.SENTENCES, sentence_spans.SPAN_WORDS
    own = [sentences_of(t) for t in texts]
    places = collections.defaultdict(list)
    for d, s in enumerate(own):
        lists = [[m[0].lower() for m in x] for x in s]
        runs = set()
        for i in range(len(s)):
            fits = [j for j in range(i + least, len(s) + 1) if sum(map(len, lists[i:j])) >= size]
            runs |= {(i, fits[0])} if fits else set()
            fits = [k for k in range(i - least + 1, -1, -1) if sum(map(len, lists[k : i + 1])) >= size]
            runs |= {(fits[0], i + 1)} if fits else set()
        for i, j in runs:
            places[tuple(sum(lists[i:j], []))].append((d, i, j))
    hashes = {t: h for t, h in zip(texts, [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(F.xxhash64("t")).collect()], strict=True)}
    key = lambda d: (ids[d] is None, ids[d] or 0, hashes[texts[d]] if ids[d] is None else 0)
    gone = collections.defaultdict(set)
    for at in places.values():
        first = min(key(d) for d, _, _ in at)
        for d, i, j in at:
            if key(d) != first or i > min(k for e, k, _ in at if texts[e] == texts[d] and key(e) == first):
                gone[d] |= set(range(i, j))
    got = sentence_spans.remove_repeats(spark.createDataFrame([(ids[i], t, i) for i, t in enumerate(texts)], "doc_id long, text string, at int")).collect()
    for r in got:
        assert (r["n_sentences"], r["n_removed"]) == (len(own[r["at"]]), len(gone[r["at"]])), (texts[r["at"]], r)
        assert re.findall(r"\S+", r["text"]) == [m[0] for k, x in enumerate(own[r["at"]]) for m in x if k not in gone[r["at"]]]
    assert next(r for r in got if r["at"] == 63)["text"].split()[-4:] == ["end", "of", "it.", "z."] or ids[63] is None
    tail = [" ".join(pool[:6]) + " Chi psi.", "Else. " + " ".join(pool[:6]) + " Chi psi."]
    named = spark.createDataFrame([("b", tail[1]), ("a", tail[0])], "doc_id string, text string")
    assert {r["doc_id"]: r["text"].strip() for r in sentence_spans.remove_repeats(named).collect()} == {"a": tail[0], "b": "Else."}


def test_frequent_lines(spark):
    line, body = "buy now at our shop today", [" ".join(words(80, i)) for i in range(12)]
    texts = [f"{b}\n  BUY now  at our shop today \nend {i}" for i, b in enumerate(body)] + [f"{line} {line}\n" + "\n".join([line] * 12) + f"\nx{i}" for i in range(3)]
    got = {r["doc_id"]: r for r in line_rules.judge(docs(spark, *texts), limit=5).collect()}
    assert all(got[i]["kept"] and got[i]["n_words"] - got[i]["n_words_left"] == 6 for i in range(12))
    assert not any(got[i]["kept"] for i in (12, 13, 14))
    kept = {r["doc_id"]: r["text"] for r in line_rules.clean(docs(spark, *texts), limit=5).collect()}
    assert kept[0] == f"{body[0]}\nend 0" and set(kept) == set(range(12))
    copies = docs(spark, *[texts[0]] * 20)
    assert line_rules.judge(copies, limit=5).where("kept").count() == 20
    assert line_rules.judge(copies, limit=5, distinct="id").where("kept").count() == 0


@pytest.mark.parametrize("rule", secret_scan.RULES, ids=lambda r: r.kind)
def test_trigrams_are_mandatory(rule):
    samples = {
        "assign": ["password = 'abcdefghijklmn'", "API_KEY:abcdefghijklmnop", "apikey=abcdefghijkl", "Token: ABCDEFGHIJKLMNO", "passwd=aaaaaaaaaaaaaa", "secret=0123456789abcd"],
        "access": ["AKIA" + "A1" * 8], "hex": ["0123456789abcdef"], "github": ["ghp_" + "a" * 36, "gho_" + "b" * 40], "slack": ["xoxb-1234567890"], "google": ["AIza" + "x" * 35],
        "stripe": ["sk_live_" + "0" * 16], "jwt": ["eyJ" + ".".join(["a" * 12] * 3)], "private_key": ["-----BEGIN RSA PRIVATE KEY-----"], "url_password": ["http://me:pw@host"],
    }
    query = trigram_query(rule.pattern)
    for text in samples[rule.kind]:
        assert re.search(rule.pattern, text)
        assert query is None or any(all(t in text.lower() for t in own) for own in query)


def test_secrets_against_plain_search(spark):
    texts = ["é password: x secret= 'abcdefghijkl' token: secret: abcdefghijklmno", "AKIA" + "Z" * 16 + "ff" * 9, "none", None, "ghp_" + "a" * 40 + " http://u:p4ss@h -----BEGIN PRIVATE KEY-----"]
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in secret_scan.scan(docs(spark, *texts)).collect()}
    for i, text in enumerate(texts):
        want = []
        for k, rule in enumerate(secret_scan.RULES):
            for m in re.finditer(rule.pattern, text or "", re.ASCII):
                if not rule.least or len(m[rule.least[0]]) >= rule.least[1]:
                    want.append((m.start(), k, m.end()))
        assert got[i] == sorted(want)


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    path = _vocabulary("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    special = ["a <|endoftext|> b", "<|endoftext|>", "x\n<|endoftext|>\n<|endoftext|>end <|endoftext| |>", "a|b <|c|>"]
    texts = [*(t or "" for t in ODD), *(" ".join(words(400, i)) for i in range(40)), *special]
    folder = f"file://{tmp_path}/tokens"
    token_frames.write_tokens(docs(spark, *texts), path, folder)
    want, start = {}, 0
    for i, t in enumerate(texts):
        data = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, token_frames.END_ID], "<u4").tobytes()
        want[i] = (start, len(data) // 4, zlib.crc32(data))
        start += len(data) // 4
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_frames.read_tokens(spark, folder).collect()}
    assert got == want
    some = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_frames.read_tokens(spark, folder, {3, 41}).collect()}
    assert some == {k: want[k] for k in (3, 41)}


def test_token_file_checksum(tmp_path):
    path = str(tmp_path / "x")
    writer = token_frames.Writer(open(path, "wb"))
    for i in range(3000):
        writer.add(i, np.arange(i % 50, dtype="<u4").tobytes())
    writer.close()
    reader = token_frames.Reader(open(path, "rb"))
    assert len(list(reader.documents())) == 3000 and len(reader.frames) >= 1
    data = bytearray(open(path, "rb").read())
    data[30] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(Exception):  # noqa: B017 - zstandard's own error, or that of the checksum
        list(token_frames.Reader(open(path, "rb")).documents())


def test_encoders_against_libraries(spark):
    import public_tokenizers
    import tiktoken

    rng = np.random.default_rng(4)
    parts = ["a", "b", " ", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "é", "中", "1", "½", "!", "'s", " ", "　", "🙂", "word", "ing", ".", "'", "Ä"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 25))) for _ in range(1500)] + [t or "" for t in ODD] + ["a" * 5000, "abc" * 900]
    vocabulary = _vocabulary("byte_bpe_multi_50k.tiktoken")
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(vocabulary), special_tokens={})
    coded = byte_bpe.decode(byte_bpe.encode(docs(spark, *texts), vocabulary), vocabulary).collect()
    for r in coded:
        assert r["ids"] == plain.encode_ordinary(texts[r["doc_id"]]) and bytes(r["decoded"]) == texts[r["doc_id"]].encode()


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_parts_of_one_hash(spark, tmp_path):
    """Two words that polynomial hashes modulo 2**64 can't tell apart."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    t = thue_morse(1024)
    texts = [f"q{t}q", f"q{t.translate(str.maketrans('ab', 'ba'))}q x", f"q{t}q q{t.translate(str.maketrans('ab', 'ba'))}q"]
    d = docs(spark, *texts).coalesce(1)
    vocabulary = _vocabulary("byte_bpe_multi_50k.tiktoken")
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(vocabulary), special_tokens={})
    for r in byte_bpe.decode(byte_bpe.encode(d, vocabulary), vocabulary).collect():
        assert r["ids"] == plain.encode_ordinary(texts[r["doc_id"]]) and bytes(r["decoded"]) == texts[r["doc_id"]].encode()
    path, folder = _vocabulary("byte_bpe_50k.json"), f"file://{tmp_path}/tokens"
    token_frames.write_tokens(d, path, folder)
    for r in token_frames.read_tokens(spark, folder).collect():
        assert np.frombuffer(r["tokens"], "<u4").tolist() == [*Tokenizer.from_file(path).encode(texts[r["doc_id"]], add_special_tokens=False).ids, token_frames.END_ID]


@pytest.mark.parametrize("trained", [True, False])
def test_matrices_against_library(trained):
    """Words of all lengths, equal pairs in rows, and tokens that rank before their parts."""
    import tiktoken

    rng = np.random.default_rng(3)
    tokens = {bytes([b]): b for b in range(256)}
    corpus = [bytes([x]) for x in rng.choice(list(b"abc"), 6000, p=[0.6, 0.3, 0.1])]
    for _ in range(300):  # trained: the most frequent pair each time
        (left, right), _ = collections.Counter(itertools.pairwise(corpus)).most_common(1)[0]
        tokens.setdefault(left + right, len(tokens))
        merged, i = [], 0
        while i < len(corpus):
            both = i + 1 < len(corpus) and (corpus[i], corpus[i + 1]) == (left, right)
            merged.append(left + right if both else corpus[i])
            i += 1 + both
        corpus = merged
    if not trained:
        shuffled = rng.permutation(len(tokens)).tolist()
        tokens = dict(zip(tokens, shuffled, strict=True))
    bpe = byte_bpe.MatrixBpe(*byte_bpe.pair_table(tokens), np.array([tokens[bytes([b])] for b in range(256)], np.int32))
    library = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=tokens, special_tokens={})
    words_ = ["".join(rng.choice(list("abc"), n, p=[0.6, 0.3, 0.1])) for n in [*range(1, 90), 300, 700, 2000] * 3] + ["a" * n for n in range(1, 40)]
    for w, got in zip(words_, bpe.encode([w.encode() for w in words_]), strict=True):
        want = [bytes([b]) for b in w.encode()]
        while pairs := [(tokens[a + b], i) for i, (a, b) in enumerate(itertools.pairwise(want)) if a + b in tokens]:
            _, i = min(pairs)
            want[i : i + 2] = [want[i] + want[i + 1]]
        want = [tokens[x] for x in want]
        assert np.frombuffer(got, "<u4").tolist() == want
        assert not trained or want == library.encode_ordinary(w)


def test_tokens_are_their_own_merges():
    """The library looks whole pre-tokens up before it merges; in this vocabulary that's the same."""
    ranks = byte_bpe.load_ranks(_vocabulary("byte_bpe_multi_50k.tiktoken"))
    bpe = byte_bpe.MatrixBpe(*byte_bpe.pair_table(ranks), np.array([ranks[bytes([b])] for b in range(256)], np.int32))
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.encode(list(ranks))] == [[r] for r in ranks.values()]


def test_piece_table_starts_anew():
    calls = []
    cache = PieceCache(lambda parts: calls.append(len(parts)) or [np.array([len(p)], "<u4").tobytes() for p in parts], slots=64)
    for i in range(20):
        ids, bounds = cache(pa.array([" ".join(words(10, i)), None, ""]))
        assert len(bounds) == 4 and ids.sum() == len(" ".join(words(10, i)))


def test_private_keys_are_masked_whole(spark):
    begin, end, mask = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----", secret_scan.MASK
    body = lambda n: "\n".join(["MIIEow/+" * 8] * n)
    texts = {
        f"a {begin}\n{body(20)}\nQUJD\n{end} b": f"a {mask} b",
        f"{begin}\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00FF\n\n{body(3)}\n{end}\nc": f"{mask}\nc",
        f"{begin}\n{body(2)}\n{end}\nd\n{begin}\n{body(2)}\n{end}": f"{mask}\nd\n{mask}",
        f"{begin}\nProc-Type: 4,ENCRYPTED\n{body(9)}\nQUI=\nThe text goes on.": f"{mask}\nThe text goes on.",
        f"{begin} {body(1)} {body(1)} e": f"{mask} e",
        f"The line {begin} starts a key.": f"The line {mask} starts a key.",
        f"{begin}\n{body(50_000)}\n{end}f": f"{mask}f",
        f"{begin}\n{body(50_000)}\nnot so": f"{mask}\nnot so",
        f"{begin}\n{'a-b ' * 200_000}": f"{mask}\n{'a-b ' * 200_000}",
    }
    rows = secret_scan.redact(docs(spark, *texts)).collect()
    for r, want in zip(sorted(rows, key=lambda r: r["doc_id"]), texts.values(), strict=True):
        assert r["text"] == want, (r["doc_id"], r["text"][:200])


def test_repeated_windows_of_long_texts(spark):
    n = 100_000  # triples, each twice, a word of its own after each: 800 000 windows, of which some share half their hash
    triple = lambda i, k: f"a{i} b{i} c{i} u{k * n + i}"
    text = " ".join(triple(i, k) for k in (0, 1) for i in range(n)).split()
    df = spark.createDataFrame([(text,)], "w array<string>")
    assert line_rules._repeated_words(df, "w").first()["n_repeat_words"] == 6 * n


def test_licences(spark):
    names = [n for n, _ in license_scan.TEMPLATES]
    texts = [f"before\n{t}\nafter" for _, t in license_scan.TEMPLATES] + ["Released under the MIT license by all.", "Licensed under CC BY 4.0 or so", "This is licensed nonsense", "released under the BSD License.", None]
    got = {r["doc_id"]: r["licenses"] for r in license_scan.scan(docs(spark, *texts)).collect()}
    for i, n in enumerate(names):
        assert got[i] == [n], texts[i]
    assert got[len(names)] == ["MIT"] and got[len(names) + 1] == ["CC-BY-4.0"] and got[len(names) + 2] == got[len(names) + 3] == got[len(names) + 4] == []


def test_licences_over_lines():
    scanner = license_scan.Scanner()
    for name, text in license_scan.TEMPLATES:
        for width in (20, 60, 70, 80):
            for lead in ("", " * "):
                note = "\n".join(lead + x for x in textwrap.wrap(text, width))
                got = scanner.spans(f"one two\n{note}\nthree four")
                assert [x[2] for x in got] == [name] and got[0][0] == 8 + len(lead), (note, got)
    hints = " ".join(["license", *["w"] * 20] * 300)
    assert [at for at, _ in scanner.blocks(hints)] == [0] and scanner.blocks(hints)[0][1] == hints
    far = " ".join(["license", *["w"] * 200] * 50)
    assert len(scanner.blocks(far)) == 50


def test_licences_more_than_once():
    scanner = license_scan.Scanner()
    for name, text in license_scan.TEMPLATES:
        for between in (" ", " and then ", " w" * 50 + " ", " w" * 90 + " "):
            line = between.join([text] * 5)
            at = [m.start() for m in re.finditer(re.escape(text), line)]
            got = scanner.spans(line)
            assert [(x[0], x[2]) for x in got] == [(x, name) for x in at], (text, between, got)


def test_licences_in_long_lines():
    scanner, prose = license_scan.Scanner(), " ".join(words(4000, 7))
    for n in (500, 3000, 20000):
        for name, text in license_scan.TEMPLATES:
            got = scanner.spans(f"{prose[:n]} {text} {prose[n : 2 * n]}")
            assert [x[2] for x in got] == [name] and got[0][0] == len(prose[:n]) + 1, (n, text)


def test_gradient_of_the_network():
    rng = np.random.default_rng(0)
    table = toxic_gru.WordTable.of(pa.array([" ".join(rng.choice(list("abcdefgh"), k)) for k in (3, 50, 7, 90)], pa.large_string()))
    net = toxic_gru.start(table, np.array([0, 1, 0, 1]))[0]
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    doc, first, size = toxic_gru.windows(table.bounds)
    index = table.number[np.minimum(first[:, None] + np.arange(toxic_gru.WINDOW)[None, :], len(table.number) - 1)]
    x, c = net.inputs(table).astype(np.float64), rng.standard_normal(len(doc))
    g, d_x = net.gradient(net.run(x, index, size, True)[1], c)
    loss = lambda: float((net.run(x, index, size)[0] * c).sum())
    for name, of, slopes in [*((k, net.p[k], g[k]) for k in g), ("inputs", x, d_x)]:
        flat, own = of.reshape(-1), slopes.reshape(-1)
        for at in {0, len(flat) - 1, *rng.integers(0, len(flat), 4).tolist()}:
            was = flat[at]
            flat[at] = was + 1e-2
            up = loss()
            flat[at] = was - 1e-2
            assert abs((up - loss()) / 2e-2 - own[at]) < 2e-2 + 0.05 * abs(own[at]), (name, at)
            flat[at] = was


def test_toxicity_is_learnt_from_context():
    """Neither word tells the labels apart, only their order does: what log-odds can't say."""
    rng, texts, label = np.random.default_rng(1), [], []
    for i in range(400):
        own = words(12, i, 60)
        at = int(rng.integers(0, 10))
        own[at : at + 2] = ["salt", "sea"] if i % 2 else ["sea", "salt"]
        texts.append(" ".join(own))
        label.append(i % 2)
    model = toxic_gru.build(texts[:300], np.array(label[:300]))
    scores = model.scores(pa.array([*texts[300:], "", None], pa.large_string()))
    assert ((scores[:100] >= 0.5) == np.array(label[300:])).mean() >= 0.85 and np.isfinite(scores).all()


def test_classifier_learns():
    good, bad = [" ".join(words(60, i)) for i in range(60)], [" ".join(w + "###" for w in words(60, i)) for i in range(60, 120)]
    doc, feature = nbsvm.features(pa.array(good + bad))
    cut = np.searchsorted(doc, np.arange(121))
    model = nbsvm.train([feature[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)], np.array([1] * 60 + [0] * 60))
    scores = model.scores(pa.array([" ".join(words(60, 500)), " ".join(w + "###" for w in words(60, 501)), "", None]))
    assert scores[0] > 0.8 > 0.2 > scores[1] and np.isfinite(scores).all() and scores[2] == scores[3]
