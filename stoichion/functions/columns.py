"""Column functions: reaction classes, identity projection, comparisons, names, counts in logarithms."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of the four sizes of a reaction side, and the sixteen classes in order.
SIDES = ["null", "uni", "bi", "multi"]
LABELS = [f"{a}-{b}" for a in SIDES for b in SIDES]
STRONG, WEAK = "strong", "weak"


def class_index(reactant: Column, product: Column) -> Column:
    """0 to 15 from the sums of stoichiometry on either side; fractions count as their floor, 3 and more as one."""
    side = lambda x: F.least(F.floor(x), F.lit(3))
    return (4 * side(reactant) + side(product)).cast("int")


def class_code(index: Column) -> Column:
    """100 times the size of the left side plus that of the right one."""
    return (100 * F.floor(index / 4) + index % 4).cast("int")


def class_label(index: Column) -> Column:
    return F.get(F.array(*map(F.lit, LABELS)), index)


def project(reactant: Column, product: Column, identity: str) -> tuple[Column, Column]:
    """The two sides that an identity compares: as they are, or the two signs of the net change."""
    if identity == STRONG:
        return reactant, product
    if identity != WEAK:
        raise ValueError(f"identity must be {STRONG} or {WEAK}, not {identity}")
    net = product - reactant
    return F.greatest(-net, F.lit(0)), F.greatest(net, F.lit(0))


def is_close(a: Column, b: Column) -> Column:
    """Equal within 1e-8 plus 1e-5 of the second."""
    return F.abs(a - b) <= 1e-8 + 1e-5 * F.abs(b)


def log10_permutations(n: Column, k: Column) -> Column:
    """log10 of the number of ways to place k things on n places; null where k > n."""
    places = F.when(k <= 0, F.array().cast("array<bigint>")).otherwise(F.sequence(n - k + 1, n).cast("array<bigint>"))
    return F.when(k <= n, F.aggregate(places, F.lit(0.0), lambda a, x: a + F.log10(x.cast("double"))))


def permutations(n: Column, k: Column) -> Column:
    """n (n-1) ... (n-k+1), as double; 0 where k > n."""
    places = F.when(k <= 0, F.array().cast("array<bigint>")).otherwise(F.sequence(n - k + 1, n).cast("array<bigint>"))
    return F.when(k > n, 0.0).otherwise(F.aggregate(places, F.lit(1.0), lambda a, x: a * x.cast("double")))


def log10_factorial(n: int) -> float:
    return math.lgamma(n + 1) / math.log(10)


def clamped_log10(p: Column, least: float = 1e-5) -> Column:
    """-log10 of a probability, which counts as `least` at least."""
    return F.lit(0.0) - F.log10(F.greatest(p, F.lit(least)))


def is_int(text: Column) -> Column:
    return F.try_cast(text, "int").isNotNull() if hasattr(F, "try_cast") else text.try_cast("int").isNotNull()


def strip_name(name: Column) -> Column:
    """A name without one bracket, square or round, at either end and without commas."""
    return F.regexp_replace(F.regexp_replace(name, r"^[\[(]|[\])]$", ""), ",", "")


def default_names(prefix: str, n: Column) -> Column:
    """prefix0, prefix1, ..."""
    return F.when(n <= 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.lit(prefix), i.cast("string"))))


def inverse_permutation(a: Column) -> Column:
    """Where each index stands in a."""
    return F.transform(a, lambda _, i: (F.array_position(a, i.cast("int")) - 1).cast("int"))


def pick(values: Column, at: Column) -> Column:
    """values at the indices at, in their order."""
    return F.transform(at, lambda i: F.get(values, i))


def array_product(a: Column) -> Column:
    """Product of positive numbers, by logarithms."""
    return F.exp(F.aggregate(F.transform(a, lambda x: F.ln(x.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def digits_key(a: Column) -> Column:
    """Elements joined without a separator: the order in which rows of digits are sorted."""
    return F.array_join(a.cast("array<string>"), "")


def pack_pair(a: Column, b: Column, most: int = 1_000_000) -> Column:
    """a * most + b, an error where either is beyond most."""
    return F.when((a > most) | (b > most), F.raise_error(F.lit(f"values above {most}"))).otherwise(a.cast("bigint") * most + b)


def unpack_pair(x: Column, most: int = 1_000_000) -> tuple[Column, Column]:
    return F.floor(x / most).cast("bigint"), x % most


def model_number(name: Column) -> Column:
    """The number after a prefix of five characters and zeros."""
    return F.regexp_extract(name, r"^.{5}0*(\d+)", 1).cast("int")
