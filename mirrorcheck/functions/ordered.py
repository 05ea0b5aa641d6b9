"""Running sums, exact quantiles and average ranks that do not put one group into one task.

Rows are first collapsed to one row per (group, value). Spark sorts these by group and value into ranges, as many as
the rows need; a window runs inside every range, and what stands before a range in its group is added.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .columns import null_safe_join, ratio
from .session import stored

#: Rows of a range; ranges follow the number of rows, and no window holds more than one range.
RANGE_ROWS = 200_000


def value_counts(df: DataFrame, by: Sequence[str], value: str, sums: dict) -> DataFrame:
    """One stored row per (group, value) with the wanted sums; the input is read once."""
    return stored(df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(
        *[expr.alias(name) for name, expr in sums.items()]
    ))


def running_sums(counts: DataFrame, by: Sequence[str], value: str, sums: Sequence[str],
                 range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add ``cum_<s>``, the sum over all values up to and including this one, and ``total_<s>`` per group.

    ``counts`` must hold one row per (group, value) and give the same rows each time it is read.
    """
    ranges = counts.count() // range_rows + 1
    ranged = stored(counts.repartitionByRange(ranges, *by, value).withColumn("__range", F.spark_partition_id()))
    totals = ranged.groupBy(*by, "__range").agg(*[F.sum(s).alias(f"__t_{s}") for s in sums])
    ranges_of = Window.partitionBy(*by)
    before = ranges_of.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "__range", *[F.coalesce(F.sum(f"__t_{s}").over(before), F.lit(0)).alias(f"__o_{s}") for s in sums],
                            *[F.sum(f"__t_{s}").over(ranges_of).alias(f"total_{s}") for s in sums])
    inside = Window.partitionBy(*by, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumns({f"cum_{s}": F.sum(s).over(inside) for s in sums})
    return (null_safe_join(local, offsets, [*by, "__range"])
            .withColumns({f"cum_{s}": F.col(f"cum_{s}") + F.col(f"__o_{s}") for s in sums})
            .drop("__range", *[f"__o_{s}" for s in sums]))


def quantile_columns(probs: dict, value: str, cum: str, n: str) -> list:
    """Aggregates giving linearly interpolated quantiles from a running count."""
    out = []
    for name, p in probs.items():
        h = (F.col(n) - 1) * F.lit(float(p))
        lo, hi = F.floor(h), F.ceil(h)
        v_lo = F.min(F.when(F.col(cum) > lo, F.col(value)))
        v_hi = F.min(F.when(F.col(cum) > hi, F.col(value)))
        frac = F.max(h - lo)
        out.append((v_lo + (v_hi - v_lo) * frac).cast("double").alias(name))
    return out


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: dict, **kw) -> DataFrame:
    """Per group: n, min, mean, max and the named quantiles of the non-null values."""
    counts = value_counts(df.withColumn(value, F.col(value).cast("double")), by, value, {"n": F.count("*")})
    run = running_sums(counts, by, value, ["n"], **kw)
    return run.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.min(value).alias("min"),
        ratio(F.sum(F.col(value) * F.col("n")), F.sum("n")).alias("mean"),
        F.max(value).alias("max"),
        *quantile_columns(probs, value, "cum_n", "total_n"),
    )


#: A value that holds more than this share of the rows of its group is hot; a group has at most 1 / share of them.
HOT_SHARE = 1e-3
#: Rows that look for nothing are dealt to so many keys.
SPREAD = 4096


def attach_by_value(rows: DataFrame, facts: DataFrame, by: Sequence[str], value: str, n: str, small: bool = False) -> DataFrame:
    """Left join of rows to the facts of their (group, value); no value shuffles more than a small share of the rows.

    ``facts`` is a stored frame that holds a row per (group, value) with ``n``, the number of rows of that value, and few groups.
    ``small`` facts go to all tasks. Of others only the hot values do; the rows of all other values are shuffled once, and rows
    that are served or have no value are spread meanwhile.
    """
    names = [c for c in facts.columns if c not in (*by, value, n)]

    def renamed(df, mark):
        return df.select(*[F.col(k).alias(f"__{mark}_{k}") for k in (*by, value)], *[F.col(c).alias(f"__{mark}_{c}") for c in names])

    def equal(mark, key):
        return reduce(lambda a, b: a & b, [F.col(k) == F.col(f"__{mark}_{k}") for k in by], F.col(key) == F.col(f"__{mark}_{value}"))

    if small:
        return rows.join(F.broadcast(renamed(facts, "all")), equal("all", value), "left").select(*rows.columns, *[F.col(f"__all_{c}").alias(c) for c in names])
    totals = facts.groupBy(*by).agg(F.sum(n).alias("__total"))
    marked = facts.join(F.broadcast(totals), list(by)) if by else facts.crossJoin(F.broadcast(totals))
    hot = F.col(n) > F.col("__total") * HOT_SHARE
    served = F.col(f"__hot_{value}").isNotNull() | F.col(value).isNull()
    tried = (rows.join(F.broadcast(renamed(marked.where(hot), "hot")), equal("hot", value), "left")
             .withColumn("__salt", F.when(served, F.monotonically_increasing_id() % SPREAD + 1).otherwise(0))
             .withColumn("__key", F.when(~served, F.col(value))))
    others = renamed(marked.where(~hot), "cold").withColumn("__zero", F.lit(0).cast("long"))
    found = tried.join(others, equal("cold", "__key") & (F.col("__salt") == F.col("__zero")), "left")
    return found.select(*rows.columns, *[F.coalesce(f"__hot_{c}", f"__cold_{c}").alias(c) for c in names])
