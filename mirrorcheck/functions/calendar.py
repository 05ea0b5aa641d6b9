"""Joining days to the intervals of the same key that hold them, by calendar buckets.

An interval stands once in each month that it touches and a day in its own, so only intervals and days of one
key and month meet; a range filter decides. Intervals that are longer than two years stand in years instead, in a
join of their own, so a stay without an end is some thousand rows and a small side that Spark can send to all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Intervals that touch more months than this go by years.
MOST_MONTHS = 24


def _month(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def _by_years(first: Column, last: Column) -> Column:
    return _month(last) - _month(first) >= MOST_MONTHS


def any_long(intervals: DataFrame, start: str, end: str) -> bool:
    """Whether any interval goes by years. It reads the intervals, so they should be stored."""
    return not intervals.where(_by_years(F.col(start).cast("date"), F.col(end).cast("date"))).isEmpty()


def _spread(intervals: DataFrame, keys: Sequence[str], start: str, end: str, by_year: bool) -> DataFrame:
    """The intervals of one kind with ``__bucket``, and with keys and ends renamed; empty intervals give no row."""
    first, last = F.col(start).cast("date"), F.col(end).cast("date")
    long = _by_years(first, last)
    unit = F.year if by_year else _month
    named = intervals.where((first <= last) & (long if by_year else ~long))
    others = [c for c in intervals.columns if c not in (*keys, start, end)]
    return named.select(*[F.col(k).alias(f"__k_{k}") for k in keys], first.alias(f"__f_{start}"), last.alias(f"__l_{end}"), *others,
                        F.explode(F.sequence(unit(first), unit(last))).alias("__bucket"))


def _holds(keys: Sequence[str], day: str, start: str, end: str, by_year: bool) -> Column:
    date = F.col(day).cast("date")
    cond = (F.year(date) if by_year else _month(date)) == F.col("__bucket")
    for k in keys:
        cond &= F.col(k) == F.col(f"__k_{k}")
    return cond & (date >= F.col(f"__f_{start}")) & (date <= F.col(f"__l_{end}"))


def days_in(days: DataFrame, intervals: DataFrame, keys: Sequence[str], day: str, start: str, end: str, long: bool = True) -> DataFrame:
    """Every row of ``days`` with each interval that holds its day: the columns of both, once.

    Without ``long`` no interval goes by years (``any_long``), and the days are not shuffled for a join with none.
    """
    parts = []
    for by_year in (False, True) if long else (False,):
        spread = _spread(intervals, keys, start, end, by_year)
        joined = days.join(spread, _holds(keys, day, start, end, by_year))
        parts.append(joined.withColumnsRenamed({f"__f_{start}": start, f"__l_{end}": end}).drop("__bucket", *[f"__k_{k}" for k in keys]))
    return parts[0].unionByName(parts[1]) if long else parts[0]


def intervals_with(intervals: DataFrame, days: DataFrame, keys: Sequence[str], day: str, start: str, end: str, long: bool = True) -> DataFrame:
    """The columns of ``intervals`` but keys and ends of those that hold any of the days; repeated where several buckets do.

    ``long`` as for ``days_in``.
    """
    parts = []
    for by_year in (False, True) if long else (False,):
        spread = _spread(intervals, keys, start, end, by_year)
        kept = [c for c in spread.columns if c != "__bucket" and not c.startswith(("__f_", "__l_"))]
        parts.append(spread.join(days.select(*keys, day), _holds(keys, day, start, end, by_year), "left_semi").select(*kept).withColumnsRenamed({f"__k_{k}": k for k in keys}))
    return parts[0].unionByName(parts[1]) if long else parts[0]


def attach_only(days: DataFrame, intervals: DataFrame, keys: Sequence[str], day: str, start: str, end: str) -> DataFrame:
    """Left join of days to the interval that holds them, for intervals of which no two of a key share a day."""
    found = [c for c in intervals.columns if c not in keys]
    out = days
    for by_year in (False, True):
        tag = "y" if by_year else "m"
        spread = _spread(intervals, keys, start, end, by_year)
        out = out.join(spread, _holds(keys, day, start, end, by_year), "left").withColumnsRenamed({f"__f_{start}": start, f"__l_{end}": end})
        out = out.drop("__bucket", *[f"__k_{k}" for k in keys]).withColumnsRenamed({c: f"__{tag}_{c}" for c in found})
    return out.select(*days.columns, *[F.coalesce(f"__m_{c}", f"__y_{c}").alias(c) for c in found])
