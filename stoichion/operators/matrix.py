"""Matrices as cells (row, col, value, ...): the algebra of named matrices as relations.

A matrix is a DataFrame with the columns row, col and value, further key columns naming which matrix a cell belongs to.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def transpose(m: DataFrame) -> DataFrame:
    return m.withColumns({"row": F.col("col"), "col": F.col("row")})


def without_zero_rows(m: DataFrame, keys: list[str], axis: str = "row") -> DataFrame:
    """Cells of rows (or columns) that have a value other than 0."""
    some = m.where("value <> 0").select(*keys, axis).distinct()
    return m.join(some, [*keys, axis], "left_semi")


def select_names(m: DataFrame, rows: list[str] | None = None, cols: list[str] | None = None) -> DataFrame:
    """The cells of some rows and columns with row_no and col_no, their places in the lists; unknown names are an error."""
    for axis, names in (("row", rows), ("col", cols)):
        if names is None:
            continue
        wanted = m.sparkSession.createDataFrame([(n, i) for i, n in enumerate(names)], f"{axis} string, {axis}_no int")
        missing = wanted.join(m.select(axis).distinct(), axis, "left_anti").limit(1).collect()
        if missing:
            raise ValueError(f"no {axis} {missing[0][0]}")
        m = m.join(F.broadcast(wanted), axis)
    return m


def value_at(m: DataFrame, row: str, col: str) -> DataFrame:
    return m.where((F.col("row") == row) & (F.col("col") == col)).select("value")


def index_of(m: DataFrame, axis: str, keys: list[str]) -> DataFrame:
    """(keys, axis, axis_no): the place, from 0, of each row's or column's name in the order of names."""
    no = (F.row_number().over(Window.partitionBy(*keys).orderBy(axis)) - 1).alias(f"{axis}_no")
    return m.select(*keys, axis).distinct().select(*keys, axis, no)


def select_places(m: DataFrame, keys: list[str], rows: list[int], cols: list[int]) -> DataFrame:
    """Cells of the rows and columns at some places, with row_no and col_no: their places in the lists."""
    out = m
    for axis, places in (("row", rows), ("col", cols)):
        wanted = F.array(*map(F.lit, places)) if places else F.array().cast("array<int>")
        own = index_of(m, axis, keys).withColumn(f"{axis}_no", (F.array_position(wanted, F.col(f"{axis}_no")) - 1).cast("int")).where(f"{axis}_no >= 0")
        out = out.join(own, [*keys, axis])
    return out


def relabelled(names: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """values (keys, row_no, col_no, value) under the names of the matrix names (keys, row, col, ...); cells at places that it doesn't
    have are an error.
    """
    at = values
    for axis in ("row", "col"):
        at = at.join(index_of(names, axis, keys), [*keys, f"{axis}_no"], "left")
    name = lambda axis: F.when(F.col(axis).isNotNull(), F.col(axis)).otherwise(F.raise_error(F.lit(f"the shapes differ in {axis}"))).alias(axis)
    return at.select(*keys, name("row"), name("col"), "value")


def vmerge(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Two matrices of different columns side by side, rows matched by name, 0 where one has no such row."""
    cells = a.unionByName(b)
    rows, cols = cells.select(*keys, "row").distinct(), cells.select(*keys, "col").distinct()
    grid = rows.join(cols, keys) if keys else rows.crossJoin(cols)
    return grid.join(cells, [*keys, "row", "col"], "left").select(*keys, "row", "col", F.coalesce("value", F.lit(0)).alias("value"))


def hstack(parts: list[DataFrame]) -> DataFrame:
    """Matrices of equal rows, columns one after another: col becomes `number of the part:col`."""
    _same(parts, "row")
    return reduce(DataFrame.unionByName, [p.withColumn("col", F.concat(F.lit(f"{i}:"), "col")) for i, p in enumerate(parts)])


def vstack(parts: list[DataFrame]) -> DataFrame:
    """Matrices of equal columns, rows one after another: row becomes `number of the part:row`."""
    _same(parts, "col")
    return reduce(DataFrame.unionByName, [p.withColumn("row", F.concat(F.lit(f"{i}:"), "row")) for i, p in enumerate(parts)])


def _same(parts: list[DataFrame], axis: str) -> None:
    first = parts[0].select(axis).distinct()
    for other in parts[1:]:
        names = other.select(axis).distinct()
        if not first.exceptAll(names).isEmpty() or not names.exceptAll(first).isEmpty():
            raise ValueError(f"the matrices differ in {axis}")


def sort_names(m: DataFrame, keys: list[str]) -> DataFrame:
    """m with row_no and col_no from 0, in the order of names."""
    no = lambda axis: (F.dense_rank().over(Window.partitionBy(*keys).orderBy(axis)) - 1).alias(f"{axis}_no")
    return m.select("*", no("row"), no("col"))


def joined_cells(a: DataFrame, b: DataFrame) -> DataFrame:
    """(row, col, a, b) of two matrices, 0 where one has no cell."""
    both = a.select("row", "col", F.col("value").alias("a")).join(b.select("row", "col", F.col("value").alias("b")), ["row", "col"], "full")
    return both.select("row", "col", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))


def equal(a: DataFrame, b: DataFrame) -> bool:
    return joined_cells(a, b).where("a <> b").isEmpty()


def less_equal(a: DataFrame, b: DataFrame) -> bool:
    return joined_cells(a, b).where("a > b").isEmpty()


def randomize(m: DataFrame, keys: list[str], seed: int = 0) -> DataFrame:
    """m with row_no and col_no, a permutation of rows and of columns that depends on names and seed alone."""
    no = lambda axis: (F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64(axis, F.lit(seed)), axis)) - 1).alias(f"{axis}_no")
    rows, cols = (m.select(*keys, axis).distinct().select(*keys, axis, no(axis)) for axis in ("row", "col"))
    return m.join(rows, [*keys, "row"]).join(cols, [*keys, "col"])


def canonical_key(cells: DataFrame, rows: DataFrame, cols: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, key): text that no permutation of rows and columns changes: the sorted non-zero values of each row,
    rows sorted, then the same by columns, with the sizes. rows and cols hold every row and column.
    """

    def side(names: DataFrame, axis: str) -> DataFrame:
        own = cells.where("value <> 0").groupBy(*keys, axis).agg(F.array_join(F.sort_array(F.collect_list("value")).cast("array<string>"), ",").alias("x"))
        full = names.join(own, [*keys, axis], "left").select(*keys, F.coalesce("x", F.lit("")).alias("x"))
        return full.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list("x")), ";").alias(axis), F.count("*").alias(f"n_{axis}"))

    sides = side(rows, "row"), side(cols, "col")
    both = sides[0].join(sides[1], keys) if keys else sides[0].crossJoin(sides[1])
    return both.select(*keys, F.concat_ws("|", F.col("n_row"), F.col("n_col"), "row", "col").alias("key"))
