"""Whitening of embeddings: projection on principal components, scaled to unit variance.

Entries become whole numbers, so sums are exact. The covariance is compensated: vectors are centred in double-double, outer products are taken
with error-free products and summed pairwise as double-double; each task gives the high and low parts of its sums, and these are
merged as double-double, row by row of the matrix, in two rounds. Components come from `eigen`.

Defined results: rows whose vector is null, empty, or has a null, non-finite or huge (2**30 or more) entry are dropped, and so
are those of another length than the most frequent one (of equally frequent ones, the longest). Components without variance (not above rounding error)
give 0. Fewer dimensions give fewer components. Repeated rows count as often as they stand there; equal eigenvalues have any
orthogonal vectors; an empty table has no rows. What is kept of a row is one struct, so that names can't clash.

Scale: the table is read four times without a shuffle of vectors. A task keeps one matrix of the dimensions' square; the driver
gets one such matrix, which depends on the dimensions alone, never on rows. Vectors are worked off in blocks of a bounded number of products.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stoichion.llm.eigen import eigen
from stoichion.llm.keys import packed, saved

SCALE, SHIFT = 1024, 100_000
#: Products that are worked on at once, and rows of a block.
_PRODUCTS, _ROWS = 1 << 18, 64
#: Groups in which the sums of tasks are merged before the last round.
_ROUND = 64

Pair = tuple[np.ndarray, np.ndarray]


def two_sum(a: np.ndarray, b: np.ndarray) -> Pair:
    """a + b rounded, and what rounding lost."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def halves(a: np.ndarray) -> Pair:
    """a as two parts of 26 bits."""
    c = 134217729.0 * a
    high = c - (c - a)
    return high, a - high


def added(a: Pair, b: Pair) -> Pair:
    """Sum of two double-doubles."""
    s, e = two_sum(a[0], b[0])
    e = e + (a[1] + b[1])
    high = s + e
    return high, e - (high - s)


def summed(a: Pair) -> Pair:
    """Sum over the first axis, pairwise."""
    high, low = a
    while len(high) > 1:
        n = len(high) // 2
        h, e = added((high[:n], low[:n]), (high[n : 2 * n], low[n : 2 * n]))
        high, low = (np.concatenate([h, high[2 * n :]]), np.concatenate([e, low[2 * n :]])) if len(high) % 2 else (h, e)
    return high[0], low[0]


def centred(rows: np.ndarray, mean: Pair) -> Pair:
    """rows minus mean, as double-doubles."""
    d, e = two_sum(rows, -mean[0])
    e = e - mean[1]
    high = d + e
    return high, e - (high - d)


def outer_sums(rows: np.ndarray, mean: Pair) -> Pair:
    """Sum of the outer products of the centred rows: upper triangle, in blocks."""
    dims = rows.shape[1]
    total = np.zeros((dims, dims)), np.zeros((dims, dims))
    width = max(1, min(16, _PRODUCTS // (_ROWS * dims)))
    for at in range(0, len(rows), _ROWS):
        d, e = centred(rows[at : at + _ROWS], mean)
        h, l = halves(d)
        for i in range(0, dims, width):
            own, far = slice(i, i + width), slice(i, None)
            x, y = (slice(None), own, None), (slice(None), None, far)
            p = d[x] * d[y]
            low = ((h[x] * h[y] - p) + h[x] * l[y] + l[x] * h[y]) + l[x] * l[y]
            low += d[x] * e[y] + e[x] * d[y]
            total[0][own, far], total[1][own, far] = added((total[0][own, far], total[1][own, far]), summed((p, low)))
    return total


def matrix_of(column: pa.Array, dims: int) -> np.ndarray:
    """A list column, all of whose lists have dims entries, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _merged(rows: DataFrame, *keys: Column) -> DataFrame:
    """(i, high, low) summed within keys; what a group holds grows with the tasks before it, not with rows."""

    def merge(table: pa.Table) -> pa.Table:
        stack = lambda name: np.stack([np.array(x) for x in table.column(name).to_pylist()])
        high, low = summed((stack("high"), stack("low")))
        return pa.table({"i": table.column("i")[:1], "high": pa.array([high.tolist()]), "low": pa.array([low.tolist()])}).cast(_SUMS)

    return rows.groupBy(*keys).applyInArrow(merge, "i int, high array<double>, low array<double>")


_SUMS = pa.schema([("i", pa.int32()), ("high", pa.list_(pa.float64())), ("low", pa.list_(pa.float64()))])


def covariance(rows: DataFrame, column: str, mean: Pair, n: int) -> np.ndarray:
    """Covariance with divisor n of a column of arrays of numbers, all of one length."""
    dims = len(mean[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = outer_sums(matrix_of(batch.column(0), dims).astype(float), mean)
                total = own if total is None else added(total, own)
        if total is not None:
            part = TaskContext.get().partitionId()
            for i in range(dims):
                yield pa.RecordBatch.from_pydict({"i": [i], "part": [part], "high": [total[0][i].tolist()], "low": [total[1][i].tolist()]}, schema=_SUMS.insert(1, pa.field("part", pa.int32())))

    sums = rows.select(column).mapInArrow(run, "i int, part int, high array<double>, low array<double>")
    sums = _merged(_merged(sums, F.col("i"), F.pmod("part", F.lit(_ROUND))), F.col("i"))
    found = sums.collect()
    high, low = np.zeros((dims, dims)), np.zeros((dims, dims))
    for r in found:
        high[r["i"]], low[r["i"]] = r["high"], r["low"]
    whole = high / n + low / n
    return np.triu(whole) + np.triu(whole, 1).T


def whole_numbers(column: str | Column) -> Column:
    """Entries as whole numbers."""
    return F.transform(column, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT)


def usable(column: str | Column) -> Column:
    """Whether a vector is not null or empty and all its entries are finite and below 2**30."""
    fine = F.forall(column, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float(1 << 30)))
    return F.coalesce((F.size(column) > 0) & fine, F.lit(False))


def sums_of(rows: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of rows and exact sums by dimension of the column x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix_of(batch.column(0), dims)
                out = pa.array(np.append(x.sum(axis=0), batch.num_rows))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims + 1, dtype=np.int32)), out], ["i", "s"])

    found = rows.select("x").mapInArrow(run, "i int, s long").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    total = {r["i"]: int(r["s"]) for r in found}
    return total.get(dims, 0), [total.get(i, 0) for i in range(dims)]


def mean_of(n: int, sums: list[int]) -> Pair:
    """Exact means as double-doubles."""
    exact = [Fraction(s, n) for s in sums]
    high = [float(x) for x in exact]
    return np.array(high), np.array([float(x - Fraction(h)) for x, h in zip(exact, high, strict=True)])


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n * x - S, exactly, and the exact sum of its squares for each row."""
    if n * (int(np.abs(x).max()) if x.size else 0) + max((abs(int(s)) for s in sums), default=0) < 1 << 62:
        d = n * x - sums.astype(np.int64)
        top = int(np.abs(d).max()) if d.size else 0
        if top * top * x.shape[1] < 1 << 62:
            return d, (d * d).sum(axis=1).astype(object)
    d = n * x.astype(object) - sums
    return d, (d * d).sum(axis=1)


def whiten(df: DataFrame, column: str, folder: str, components: int = 8) -> DataFrame:
    """(row, n, deviation, whitened, explained, identity_error): row is what df has besides the vector, whitened the row's coordinates
    on the components by falling variance, explained their shares of all variance, deviation the sum of the squares of n * x - S, and
    identity_error the largest difference of the covariance of whitened from the identity. What lies between is written below folder.
    """
    spark = df.sparkSession
    rows = df.where(usable(f"`{column}`")).select(packed(df, column).alias("row"), whole_numbers(f"`{column}`").alias("x"))
    kind = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    common = rows.groupBy(F.size("x").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if common is None:
        empty = spark.createDataFrame([], kind)
        return empty.select("row", F.lit(0).cast("long").alias("n"), "deviation", "whitened", F.col("whitened").alias("explained"), F.lit(0.0).alias("identity_error"))
    dims = common["dims"]
    rows = rows.where(F.size("x") == dims)
    n, sums = sums_of(rows, dims)
    v = covariance(rows, "x", mean_of(n, sums), n)
    values, vectors = eigen(v)
    top, trace = min(components, dims), float(np.trace(v))
    values, vectors = values[:top], vectors[:, :top]
    real = values > dims * np.finfo(float).eps * max(values[0], 0.0)
    scaled = np.where(real, vectors / np.sqrt(np.where(real, values, 1.0)), 0.0)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact = np.array(sums, object)
        for batch in batches:
            x = matrix_of(batch.column("x"), dims)
            d, square = deviations(x, n, exact)
            # A row's sum must not depend on the batch that it is in, as a matrix product's may.
            w = np.einsum("rd,dk->rk", d.astype(float) / n, scaled)
            flat = pa.array(w.ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, top, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([_decimal(s) for s in square], pa.decimal128(38, 0)), lists], ["row", "deviation", "whitened"])

    wide = saved(rows.mapInArrow(project, kind), folder, "whitened")
    means = wide.agg(*(F.avg(F.get("whitened", F.lit(k))).alias(f"m{k}") for k in range(top))).first()
    error = np.abs(covariance(wide, "whitened", (np.array(list(means)), np.zeros(top)), n) - np.eye(top)).max()
    share = F.array(*(F.lit(float(max(e, 0.0) / trace) if trace > 0 else 0.0) for e in values))
    return wide.select("row", F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(float(error)).alias("identity_error"))


def _decimal(x: int):
    """As a decimal of at most 38 digits, null beyond."""
    from decimal import Decimal

    return Decimal(int(x)) if abs(int(x)) < 10**38 else None
