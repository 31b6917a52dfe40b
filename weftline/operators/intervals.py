"""Joins of intervals that overlap, by bins: no pair is formed that does not share a bin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The width of a bin: about that of the intervals that are many. Longer ones lie in several bins, much shorter ones meet more of a bin's others.
WIDTH = 1024


def binned(df: DataFrame, start: str, end: str, out: str, width: int = WIDTH) -> DataFrame:
    """df with a row for each bin that an interval lies in; empty intervals lie in none."""
    place = lambda x: F.floor(x / width).cast("long")
    return df.where(F.col(start) < F.col(end)).withColumn(out, F.explode(F.sequence(place(F.col(start)), place(F.col(end) - 1))))


def overlap_join(left: DataFrame, right: DataFrame, key: str, left_span: tuple[str, str], right_span: tuple[str, str], width: int = WIDTH) -> DataFrame:
    """Rows of left and right of one key whose half-open intervals share a place; each pair once.

    Two intervals may share several bins; the pair is kept in the bin where the later of them starts. Columns other than
    the key must have different names on the two sides. Rows whose key or bounds are null meet none.
    """
    (ls, le), (rs, re) = left_span, right_span
    name = "bin"
    while name in left.columns or name in right.columns:
        name += "_"
    later: Column = F.floor(F.greatest(ls, rs) / width).cast("long")
    met = binned(left, ls, le, name, width).join(binned(right, rs, re, name, width), [key, name])
    return met.where((F.col(name) == later) & (F.col(ls) < F.col(re)) & (F.col(rs) < F.col(le))).drop(name)
