"""Interval joins without a quadratic meeting: intervals lie in bins of a hierarchy of widths, and a point asks one bin of each width.

An interval of up to 8 ** k numbers touches at most two bins of that width, so it is two rows at most, whatever its length. A point meets only
intervals whose bins hold it: those that contain it, and at each width those that end or begin beside it in the same bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.sources.shared import wide

#: Bits of the bin widths: 1, 8, 64, .. up to all of an int.
LEVELS = tuple(range(0, 33, 3))


def _level(low: Column, high: Column) -> Column:
    """The narrowest width of which the interval touches at most two bins."""
    out = F.lit(LEVELS[-1])
    for bits in reversed(LEVELS[:-1]):
        out = F.when(high - low < (1 << bits), F.lit(bits)).otherwise(out)
    return out


def _bin(at: Column, level: Column) -> Column:
    # Shifts by a column are an SQL expression.
    return F.call_function("shiftright", at.cast("long"), level)


def binned(intervals: DataFrame, low: str, high: str) -> DataFrame:
    """``intervals`` with _level and _bin, a row a bin; those that are empty or have a null end are left out."""
    rows = intervals.where(F.col(low) <= F.col(high)).withColumn("_level", _level(F.col(low).cast("long"), F.col(high).cast("long")))
    first, last = _bin(F.col(low), F.col("_level")), _bin(F.col(high), F.col("_level"))
    return rows.withColumn("_bin", F.explode(F.array_distinct(F.array(first, last))))


def containing(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, low: str, high: str) -> DataFrame:
    """Pairs of a point and an interval of equal ``keys`` that holds it. Other columns must not clash."""
    asked = points.withColumn("_level", F.explode(F.array(*map(F.lit, LEVELS)))).withColumn("_bin", _bin(F.col(at), F.col("_level")))
    met = asked.join(wide(binned(intervals, low, high)), [*keys, "_level", "_bin"])
    return met.where((F.col(at) >= F.col(low)) & (F.col(at) <= F.col(high))).drop("_level", "_bin")


def overlapping(a: DataFrame, b: DataFrame, keys: list[str], a_ends: tuple[str, str], b_ends: tuple[str, str]) -> DataFrame:
    """Pairs of intervals of equal ``keys`` that share a number, once each: b holds the low end of a, or a holds that of b after its own."""
    a, b = a.where(F.col(a_ends[0]) <= F.col(a_ends[1])), b.where(F.col(b_ends[0]) <= F.col(b_ends[1]))
    one = containing(a, b, keys, a_ends[0], *b_ends)
    other = containing(b, a, keys, b_ends[0], *a_ends).where(F.col(b_ends[0]) > F.col(a_ends[0]))
    return one.unionByName(other)
