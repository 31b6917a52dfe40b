"""Places and running sums over a whole table in one order, without one task that sees all rows.

Rows are dealt into ranges of the order and sorted inside of each; the ranges' own totals, a row for each range, give what
stands before a range. Rows that are equal in the order are told apart by where they were read, so that no range has to
hold all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared as S

#: monotonically_increasing_id: the partition's number is above this many bits.
BITS = 33


def ordered(df: DataFrame, by: list[Column], what: str, at: str = "at") -> DataFrame:
    """df as a table, with at: rising along the order, the number of the range above its 33 lower bits, the place in it below."""
    (tie,) = S.apart([*df.columns, at], "tie")
    ranged = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*by, F.col(tie)).sortWithinPartitions(*by, F.col(tie))
    return S.cut(ranged.drop(tie).withColumn(at, F.monotonically_increasing_id()), what)


def _before(table: DataFrame, part: str, totals: dict[str, Column]) -> DataFrame:
    """part and what all smaller ranges have of each total: a row for each range that has rows."""
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    ranges = table.groupBy(part).agg(*(c.alias(n) for n, c in totals.items()))
    return F.broadcast(ranges.select(part, *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) for n in totals)))


def placed(table: DataFrame, out: str, at: str = "at") -> DataFrame:
    """An ordered table with out, the place of each row from 0, in at's stead."""
    kept = S.others(table, at, out)
    part, before = S.apart([*table.columns, out], "part", "before")
    table = table.withColumn(part, F.shiftright(at, BITS))
    met = table.join(_before(table, part, {before: F.count(F.lit(1))}), part)
    return met.select(*map(S.quoted, kept), (F.col(before) + F.col(at).bitwiseAND(F.lit((1 << BITS) - 1))).alias(out))


def summed(table: DataFrame, amounts: dict[str, str], at: str = "at") -> DataFrame:
    """An ordered table with the sums of the amounts (new names by columns) over all rows before each, in at's stead."""
    kept = S.others(table, at, *amounts)
    part, *names = S.apart([*table.columns, *amounts], "part", *(f"{k}_{n}" for n in amounts for k in ("inside", "before")))
    within, before = dict(zip(amounts, names[::2], strict=True)), dict(zip(amounts, names[1::2], strict=True))
    table = table.withColumn(part, F.shiftright(at, BITS))
    earlier = Window.partitionBy(part).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    inside = table.select(part, *map(S.quoted, kept), *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(within[n]) for n, c in amounts.items()))
    met = inside.join(_before(table, part, {before[n]: F.sum(c) for n, c in amounts.items()}), part)
    return met.select(*map(S.quoted, kept), *((F.col(before[n]) + F.col(within[n])).alias(n) for n in amounts))
