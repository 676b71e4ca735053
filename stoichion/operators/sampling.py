"""Seeded samples, ways to deal rows out, codes of index pairs, keys of matrices that ignore some order.

What is drawn depends on a seed and on the rows themselves, so any rerun draws the same.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def drawn(df: DataFrame, keys: list[str], n: int, seed: int = 0) -> DataFrame:
    """At most n rows of df, by a hash of their keys."""
    return df.orderBy(F.xxhash64(*keys, F.lit(seed)), *keys).limit(n)


def pruned(df: DataFrame, by: list[str], keys: list[str], most: int, seed: int = 0) -> DataFrame:
    """At most `most` rows of each group of by, drawn by a hash of the keys, with is_truncated: whether its group lost any."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.xxhash64(*keys, F.lit(seed)), *keys))
    size = F.count("*").over(Window.partitionBy(*by))
    return df.withColumns({"_place": place, "is_truncated": size > most}).where(F.col("_place") <= most).drop("_place")


def one_of_each(lists: Column, seed: Column) -> Column:
    """An element of each of several lists, by a hash of the seed and the number of the list; null for an empty one."""
    at = lambda x, i: F.pmod(F.xxhash64(seed, i), F.greatest(F.size(x), F.lit(1))).cast("int")
    return F.transform(lists, lambda x, i: F.get(x, at(x, i)))


def injective_share(df: DataFrame, lists: str, samples: int = 1000, seed: int = 0) -> DataFrame:
    """df with injective_share: how many of `samples` draws of one candidate for each node take no candidate twice."""
    drawn_ = lambda i: one_of_each(F.col(lists), F.lit(seed) * samples + i)
    good = F.filter(F.sequence(F.lit(1), F.lit(samples)), lambda i: F.size(F.array_distinct(drawn_(i))) == F.size(lists))
    return df.withColumn("injective_share", F.size(good) / samples)


def log10_assignments(df: DataFrame, lists: str, samples: int = 1000, seed: int = 0) -> DataFrame:
    """df with log10_n: log10 of the product of the lists' lengths, corrected by the share of draws without a repeat (1e-9 at
    least) and not below 0; null where a list is empty.
    """
    sizes = F.transform(lists, lambda x: F.size(x).cast("double"))
    total = F.aggregate(sizes, F.lit(0.0), lambda a, x: a + F.log10(x))
    share = F.greatest(F.col("injective_share"), F.lit(1e-9))
    out = injective_share(df, lists, samples, seed).withColumn("log10_n", F.when(F.forall(lists, lambda x: F.size(x) > 0), F.greatest(F.lit(0.0), total + F.log10(share))))
    return out.drop("injective_share")


def dealt(df: DataFrame, order: list[str], n: int, by: list[str] | None = None) -> DataFrame:
    """df with part, from 0 to n - 1, dealt round robin in an order within each group of by. Without groups the numbering
    goes over all rows in one task, so it is for short lists; rows of any number are dealt by finder.work_units().
    """
    window = Window.partitionBy(*by).orderBy(*order) if by else Window.orderBy(*order)
    return df.withColumn("part", (F.row_number().over(window) - 1) % n)


def repeated(df: DataFrame, n: int, each: bool = True) -> DataFrame:
    """Each row n times, with copy from 0; ordered by copy the table stands n times one after another, else each row does."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))) if n > 0 else df.withColumn("copy", F.lit(0)).where("false")


def linear_index(row: Column, column: Column, columns: Column) -> Column:
    """The number of a cell, row by row."""
    return row * columns + column


def from_linear(index: Column, columns: Column) -> tuple[Column, Column]:
    return F.floor(index / columns).cast("bigint"), F.pmod(index, columns)


def digits(values: Column) -> Column:
    """The elements written one after another: rows are sorted by this text."""
    return F.array_join(values.cast("array<string>"), "")


def not_after(a: Column, b: Column) -> Column:
    """Whether a isn't behind b in the order of their first differing element."""
    return a <= b


def resized(values: Column, n: int) -> Column:
    return F.slice(values, 1, n)


def element_hash(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, hash): a hash of the values of a matrix that no order of rows or cells changes, modulo 2**64."""
    total = F.sum(F.xxhash64(F.col("value").cast("double")).cast("decimal(38,0)"))
    return cells.groupBy(*keys).agg((total % F.lit(1 << 63).cast("decimal(38,0)")).cast("bigint").alias("hash"))


def sign_code(cells: DataFrame, keys: list[str], width: DataFrame) -> DataFrame:
    """(keys, code): for each row 10**0, 10**3, 10**6 and 10**9 for each 0, 1, -1 and other value, rows sorted. cells may leave
    zeros out; width: (keys, row, n_columns).
    """
    one = F.when(F.col("value") == 0, 0).when(F.col("value") == 1, 1000).when(F.col("value") == -1, 1_000_000).otherwise(1_000_000_000)
    rows = cells.groupBy(*keys, "row").agg(F.sum(one).alias("code"), F.count_if(F.col("value") != 0).alias("n"))
    full = width.join(rows, [*keys, "row"], "left").withColumn("code", F.coalesce("code", F.lit(0)) + F.col("n_columns") - F.coalesce("n", F.lit(0)))
    return full.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list("code")).cast("array<string>"), ",").alias("code"))


def ordered_key(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, key): a key of a matrix that depends on the order of rows and columns: its cells by place."""
    own = cells.where("value <> 0").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("row", "col", "value"))).alias("x"))
    return own.select(*keys, F.sha2(F.to_json("x"), 256).alias("key"))


def random_matrix(spark, n: int, rows: int, columns: int, seed: int = 0) -> DataFrame:
    """(id, row, col, value): matrices of uniform numbers from 0 to 1, rows named r0, r1, ... and columns c0, c1, ..."""
    grid = reduce(lambda df, x: df.withColumn(x[0], F.explode(F.sequence(F.lit(0), F.lit(x[1] - 1)))), (("i", rows), ("j", columns)), spark.range(n))
    value = F.pmod(F.xxhash64("id", "i", "j", F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)
    return grid.select("id", F.concat(F.lit("r"), "i").alias("row"), F.concat(F.lit("c"), "j").alias("col"), value.alias("value"))
