"""Small pieces that several operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Equality of all keys where null equals null."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join in which null keys meet; the keys of ``left`` are kept once."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, match, how).drop(*[f"_r_{k}" for k in keys])


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def share(part: Column, whole: Column, digits: int = 4) -> Column:
    """part / whole, rounded; null where there is nothing to share."""
    return rounded(part / F.nullif(whole, F.lit(0)), digits)


def exact_sum(c: str | Column) -> Column:
    """Sum over six decimal places: the same whatever the order of the rows."""
    return F.sum((F.col(c) if isinstance(c, str) else c).cast("decimal(30,6)")).cast("double")


def mean(c: str | Column, digits: int = 4) -> Column:
    """Mean of an exact sum, rounded."""
    return rounded(exact_sum(c) / F.count(c), digits)


def rounded(x: Column, digits: int = 4) -> Column:
    """A double rounded half away from zero by its decimal digits, not by its binary ones."""
    return F.round(x.cast("decimal(30,8)"), digits).cast("double")


def place(partition: list[str], *order) -> Column:
    """1, 2, ... in the given order within each partition, as bigint."""
    return F.row_number().over(Window.partitionBy(*partition).orderBy(*order)).cast("bigint")


def listed(values: Column, by: Column | None = None, sep: str = ",") -> Column:
    """Values of a group as text, in order of themselves or of ``by``; for groups known to be short."""
    if by is None:
        return F.array_join(F.array_sort(F.collect_list(values.cast("string"))), sep)
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by.alias("o"), values.cast("string").alias("v")))), lambda x: x["v"]), sep)


def distinct_listed(values: Column, sep: str = ",") -> Column:
    """Distinct values as text, in order."""
    return F.array_join(F.array_sort(F.collect_set(values.cast("string"))), sep)
