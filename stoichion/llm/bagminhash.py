"""Near-duplicate classes by BagMinHash signatures, banding and an exact check of multiset overlap.

A text is the multiset of its shingles (five consecutive words; a text of fewer words is one shingle), words being runs
of anything but ASCII white space with A-Z lower-cased. Two texts are linked when their weighted Jaccard similarity
(sum of minima over sum of maxima of shingle counts) is 0.8 or more; classes are the connected components.

Signature. Weights are cut at 0, 1, 2, 4, 8, ...; each shingle owns one Poisson process on each piece (0, 1],
(2**(k-1), 2**k], of a rate equal to the width of the piece, all drawn from hashes, so equal shingles see equal points
everywhere. A point lands in one slot of the signature and, inside its piece, descends by hash bits to a unit cell; a
text whose weight ends below that cell rejects it. A slot keeps the id of its earliest point, and two texts agree in a
slot with a probability equal to their weighted Jaccard similarity. Only points before a time at which all slots are
expected to be full are made; a text that still has an empty slot is taken again with four times that time.

Search. Signatures of distinct texts are cut into bands; a bucket holds the texts that agree in a band. First each
bucket compares its members with one hub: the member that shares most buckets with others, which in a group of copies is
the one they stem from. So a group of near copies takes about one comparison each, however large. Members in the
component of the hub are done, as they are in one component already. The others are compared with all members of their buckets,
in blocks: either side is dealt into chunks, a pair of chunks is one product of incidence matrices, and only links leave
it. No bucket, group or candidate list is capped, and no link between texts that share a bucket is lost; with
24 bands of 4 a pair at 0.8 shares no bucket with a probability of 4e-6.

Defined results: rows of equal text share a class; a null text is a class of its own row (class_id = doc_id); texts
without words (empty or blank) link only to equal texts; class_id is the least doc_id of the class (null where all are
null); of hubs that are equally dense the greatest key is taken, which changes no class; repeated rows each get their
row; an empty table gives an empty one; texts of any length are taken whole; other columns are dropped, but deduplicate()
keeps them, whatever their names.

Scale: texts move only for documents that share a bucket; counts pre-aggregate before each shuffle; the stages between
are written to spark.checkpoint.dir. Components use alternating large and small stars, with minima joined back rather
than neighbour lists gathered, so a class of a third of all rows stays splittable.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stoichion.llm.keys import field, packed, saved, text_key, workspace
from stoichion.llm.textbytes import as_array, buffers, gram_hashes, gram_valid, map_texts, mix, released, small_batches, SPACED, Words

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 4
#: Texts in a chunk of a bucket.
CHUNK = 256

_ELEMENT_BITS = np.uint64(44)
_ELEMENT = np.uint64((1 << 44) - 1)
_STEP = np.uint64(0xA0761D6478BD642F)


def bags(texts: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, shingle (44-bit hash) and count of each distinct shingle of each text, sorted by the first two."""
    data, offsets = buffers(texts)
    words = Words(data, offsets, SPACED)
    hashes, owner, size = words.hashes(), words.owners(), np.diff(words.bounds)
    grams = gram_hashes(hashes, k)
    ok = gram_valid(words.bounds, k)
    keys = [(owner[: len(grams)][ok].astype(np.uint64) << _ELEMENT_BITS) | (grams[ok] >> np.uint64(20))]
    for few in range(1, k):
        docs = np.flatnonzero(size == few)
        if len(docs):
            at = words.bounds[docs]
            own = mix(reduce(lambda h, t: h * _STEP + hashes[at + t], range(few), np.zeros(len(docs), np.uint64)))
            keys.append((docs.astype(np.uint64) << _ELEMENT_BITS) | (own >> np.uint64(20)))
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    return (key >> _ELEMENT_BITS).astype(np.int64), key & _ELEMENT, count


def signatures(doc: np.ndarray, element: np.ndarray, count: np.ndarray, n_docs: int, slots: int) -> np.ndarray:
    """n_docs x slots point ids; rows of texts without shingles are 0."""
    out = np.zeros((n_docs, slots), np.uint64)
    weight = np.bincount(doc, count, n_docs)
    horizon = slots * (np.log(slots) + 5) / np.maximum(weight, 1)
    seed, rate, above, own, limit = [mix(element)], [np.ones(len(element))], [np.zeros(len(element), np.int64)], [doc], [count]
    k, more = 1, np.flatnonzero(count > 1)
    while len(more):
        seed.append(mix(element[more] + np.uint64(k * int(_STEP) & ((1 << 64) - 1))))
        rate.append(np.full(len(more), float(1 << (k - 1))))
        above.append(np.full(len(more), 1 << (k - 1), np.int64))
        own.append(doc[more])
        limit.append(count[more])
        k, more = k + 1, more[count[more] > 1 << k]
    seed, rate, above, own, limit = map(np.concatenate, (seed, rate, above, own, limit))
    todo = np.arange(len(seed))
    while len(todo):
        best = np.full(n_docs * slots, np.inf)
        ids = np.zeros(n_docs * slots, np.uint64)
        live, t, j = todo, np.zeros(len(todo)), 0
        while len(live):
            block = int(np.clip(np.median(rate[live] * (horizon[own[live]] - t)) + 1, 1, 64))
            live_at, t_at = live, t
            parts_live, parts_t = [], []
            for piece in np.array_split(np.arange(len(live_at)), max(1, len(live_at) * block // 400_000)):
                a = live_at[piece]
                draw = mix(seed[a][:, None] ^ mix((np.arange(j + 1, j + block + 1, dtype=np.uint64) * _STEP))[None, :])
                gap = -np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate[a][:, None]
                times = t_at[piece][:, None] + np.cumsum(gap, axis=1)
                inside = times < horizon[own[a]][:, None]
                row, col = np.nonzero(inside)
                point = mix(draw[row, col] + _STEP)
                cell = ((point & np.uint64(0xFFFFFFFF)) * above[a][row].astype(np.uint64)) >> np.uint64(32)
                taken = above[a][row] + cell.astype(np.int64) < limit[a][row]
                row, point, when = row[taken], point[taken], times[row, col][taken]
                slot = own[a][row] * slots + (((point >> np.uint64(32)) * np.uint64(slots)) >> np.uint64(32)).astype(np.int64)
                np.minimum.at(best, slot, when)
                won = best[slot] == when
                ids[slot[won]] = point[won]
                on = inside[:, -1]
                parts_live.append(a[on])
                parts_t.append(times[on, -1])
            live, t, j = np.concatenate(parts_live), np.concatenate(parts_t), j + block
        full = np.isfinite(best).reshape(n_docs, slots).all(axis=1)
        out[full & (weight > 0)] = ids.reshape(n_docs, slots)[full & (weight > 0)]
        todo = todo[~full[own[todo]]]
        horizon = np.where(full, horizon, horizon * 4)
        if len(todo):  # only what is still open
            keep = np.zeros(n_docs, bool)
            keep[own[todo]] = True
            weight = np.where(keep, weight, 0)
    return out


def band_columns(df: DataFrame, text: str = "text", k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """df without its text, with a bucket key for each band: b0, b1, ... (null for texts without words)."""
    names = [f"b{i}" for i in range(bands)]

    def make():
        def work(texts: pa.Array, _: pa.RecordBatch) -> dict[str, pa.Array]:
            doc, element, count = bags(texts, k)
            sig = signatures(doc, element, count, len(texts), bands * rows).reshape(len(texts), bands, rows)
            key = np.zeros((len(texts), bands), np.uint64) + np.arange(bands, dtype=np.uint64)[None, :]
            for r in range(rows):
                key = mix(key * _STEP + sig[:, :, r])
            none = np.bincount(doc, minlength=len(texts)) == 0
            return {n: pa.array(key[:, i].view(np.int64), mask=none) for i, n in enumerate(names)}

        return work

    return map_texts(df, make, [T.StructField(n, T.LongType()) for n in names], text)


def similarity(a: pa.Array, b: pa.Array, k: int = SHINGLE) -> np.ndarray:
    """Weighted Jaccard similarity of each pair of texts."""
    (da, ea, ca), (db, eb, cb) = bags(a, k), bags(b, k)
    _, i, j = np.intersect1d((da.astype(np.uint64) << _ELEMENT_BITS) | ea, (db.astype(np.uint64) << _ELEMENT_BITS) | eb, True, True)
    both = np.bincount(da[i], np.minimum(ca[i], cb[j]), len(a))
    either = np.bincount(da, ca, len(a)) + np.bincount(db, cb, len(a)) - both
    return both / np.maximum(either, 1)


def _verified(pairs: DataFrame, k: int, least: float) -> DataFrame:
    """Of pairs (node, hub, text_a, text_b) the (node, hub) that are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = buffers(batch.column("text_a"))[1][1:] + buffers(batch.column("text_b"))[1][1:]
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 3_000_000)))
                part = batch.slice(at, to - at)
                good = pa.array(similarity(part.column("text_a"), part.column("text_b"), k) >= least)
                yield part.select(["node", "hub"]).filter(good)
                at = to

    return small_batches(pairs).select("node", "hub", "text_a", "text_b").mapInArrow(lambda batches: released(run(batches)), "node binary, hub binary")


def _elements(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and key of each unit of each text's multiset: a shingle met c times makes c keys."""
    doc, element, count = bags(texts, k)
    at = np.repeat(np.arange(len(doc)), count)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
    return doc[at], mix(element[at] + nth.astype(np.uint64) * _STEP)


def block_links(a: pa.Array, b: pa.Array, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions in a and b of the pairs of texts that are similar enough, by products of incidence matrices."""
    (da, ea), (db, eb) = _elements(a, k), _elements(b, k)
    na, nb = np.bincount(da, minlength=len(a)), np.bincount(db, minlength=len(b))
    common = np.intersect1d(ea, eb)
    both = np.zeros((len(a), len(b)), np.float32)
    ia, ib = np.searchsorted(common, ea), np.searchsorted(common, eb)
    ok_a, ok_b = (np.append(common, np.uint64(0))[i] == e if len(common) else np.zeros(len(e), bool) for i, e in ((ia, ea), (ib, eb)))
    da, ia, db, ib = da[ok_a], ia[ok_a], db[ok_b], ib[ok_b]
    order_a, order_b = np.argsort(ia, kind="stable"), np.argsort(ib, kind="stable")
    da, ia, db, ib = da[order_a], ia[order_a], db[order_b], ib[order_b]
    for at in range(0, len(common), 4096):
        x, y = np.zeros((len(a), 4096), np.float32), np.zeros((len(b), 4096), np.float32)
        for m, d, i in ((x, da, ia), (y, db, ib)):
            lo, hi = np.searchsorted(i, [at, at + 4096])
            m[d[lo:hi], i[lo:hi] - at] = 1
        both += x @ y.T
    return np.nonzero((both > 0) & (both >= least * (na[:, None] + nb[None, :] - both) - 1e-6))


def _blocked(left: DataFrame, members: DataFrame, own: DataFrame, k: int, least: float) -> DataFrame:
    """(node, hub) links between the texts left (bucket, node, n) and all members of their buckets (bucket, node, n).

    Either side of a bucket is dealt into chunks of about CHUNK texts by a hash; each pair of chunks is a group of its own,
    compared in one go, and gives the links of a spanning forest of its similar pairs, never more than its texts.
    """
    size = left.groupBy("bucket").agg(F.count("*").alias("n_left"))
    chunks = lambda n: F.ceil(F.col(n) / CHUNK).cast("int")
    own_chunk = lambda n: F.pmod(F.xxhash64("node"), chunks(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), chunks(n) - 1))
    a = left.join(size, "bucket").join(own, "node").select("bucket", "node", "text", own_chunk("n_left").alias("i"), every("n").alias("j"))
    b = members.join(size, "bucket").join(own, "node").select("bucket", "node", "text", own_chunk("n").alias("j"), every("n_left").alias("i"))

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        nodes_x, nodes_y = x.column("node").to_pylist(), y.column("node").to_pylist()
        parent: dict[bytes, bytes] = {}

        def root(n: bytes) -> bytes:
            while parent.setdefault(n, n) != n:
                n = parent[n]
            return n

        out = []
        if nodes_x and nodes_y:
            for i, j in zip(*(z.tolist() for z in block_links(as_array(x.column("text")), as_array(y.column("text")), k, least)), strict=True):
                p, q = root(nodes_x[i]), root(nodes_y[j])
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    out.append((nodes_x[i], nodes_y[j]))
        return pa.table({"node": pa.array([o[0] for o in out], pa.binary()), "hub": pa.array([o[1] for o in out], pa.binary())})

    keys = ["bucket", "i", "j"]
    b = b.select(*(F.col(c).alias(f"{c}_") for c in b.columns)).select(*(F.col(f"{c}_").alias(c) for c in b.columns))
    return small_batches(a).groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(run, "node binary, hub binary")


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the least node reached."""

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def star(df: DataFrame, large: bool) -> DataFrame:
        both = df.union(df.select("b", "a")) if large else df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        at = both.join(least, "a")
        out = at.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else at.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    edges = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), folder, "edges-0")
    was, i = mark(edges), 0
    while was[0]:
        i += 1
        edges = saved(star(star(edges, True), False), folder, f"edges-{i}")
        now = mark(edges)
        if now == was:
            break
        was = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def near_duplicate_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(node, doc_id, class_id) for each row; node stands for the text, class_id is the least doc_id of its class."""
    folder = workspace(docs.sparkSession, "bagminhash")
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), text_key(text).alias("node"))
    keyed = band_columns(base.where("text IS NOT NULL"), "text", k, bands, rows)
    names = [f"b{i}" for i in range(bands)]
    texts = saved(keyed.groupBy("node").agg(F.min("doc_id").alias("least_id"), *(F.first(n).alias(n) for n in names)), folder, "texts")
    entries = texts.where("b0 IS NOT NULL").select("node", F.explode(F.array(*names)).alias("bucket"))
    members = saved(entries.join(entries.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "bucket"), folder, "members")
    density = members.groupBy("node").agg(F.sum("n").alias("density"))
    # Copies become one row in each task before anything moves.
    one_each = base.where("text IS NOT NULL").groupBy("node").agg(F.first("text").alias("text"))
    own = saved(one_each.join(density.select("node").hint("shuffle_hash"), "node", "left_semi"), folder, "own")
    hubs = saved(members.join(density, "node").groupBy("bucket").agg(F.max(F.struct("density", "node"))["node"].alias("hub")), folder, "hubs")
    pairs = members.join(hubs, "bucket").where("node <> hub").select("node", "hub").distinct()
    full = pairs.join(own.withColumnRenamed("text", "text_a"), "node").join(own.select(F.col("node").alias("hub"), F.col("text").alias("text_b")), "hub")
    stars = saved(_verified(full, k, least), folder, "stars")
    labels = components(stars.select(F.col("node").alias("a"), F.col("hub").alias("b")), f"{folder}/star-components")
    of = lambda name: labels.select(F.col("node").alias(name), F.col("component").alias(f"{name}_in"))
    placed = members.where("n > 2").join(hubs, "bucket").where("node <> hub").join(of("node"), "node", "left").join(of("hub"), "hub", "left")
    left = saved(placed.where("NOT coalesce(node_in, node) <=> coalesce(hub_in, hub)").select("bucket", "node", "n"), folder, "left")
    links = stars.union(saved(_blocked(left, members, own, k, least), folder, "links"))
    labels = components(links.select(F.col("node").alias("a"), F.col("hub").alias("b")), f"{folder}/components")
    least_of = texts.select("node", "least_id").join(labels, "node").groupBy("component").agg(F.min("least_id").alias("class_id"))
    merged = labels.join(least_of, "component").select("node", "class_id")
    classes = texts.select("node", "least_id").join(merged, "node", "left").select("node", F.coalesce("class_id", "least_id").alias("class_id"))
    return base.select("node", "doc_id").join(classes, "node", "left").select("node", "doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options: float) -> DataFrame:
    """docs with one row of each class, the one of the least doc_id; rows of null text all stay.

    Rows of the class that share that doc_id and its text are the same document: one of them stays.
    """
    classes = near_duplicate_classes(docs, doc_id, text, **options)
    best = classes.where("node IS NOT NULL AND doc_id <=> class_id").groupBy("class_id").agg(F.min("node").alias("node"), F.first("doc_id").alias("own_id"))
    keyed = docs.select(packed(docs).alias("row"), text_key(text).alias("node"), F.col(doc_id).alias("id"))
    best = best.select(F.col("node").alias("own_node"), "own_id")
    kept = keyed.join(best, (F.col("node") == F.col("own_node")) & F.col("id").eqNullSafe(F.col("own_id")), "left_semi")
    one = kept.groupBy("node").agg(F.first("row").alias("row"))
    return one.union(keyed.where(field(text).isNull()).select("node", "row")).select(*(field(c).alias(c) for c in docs.columns))
