"""Small column and join helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def require_columns(df: DataFrame, names: Sequence[str], side: str = "data") -> None:
    """Raise when a wanted column is absent."""
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise ValueError(f"columns not in {side}: {', '.join(absent)}")


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner",
                   small: bool = False) -> DataFrame:
    """Join on equal keys where null equals null; the keys appear once in the result.

    ``small`` sends the right side to every task; callers set it after checking its size.
    """
    right = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    right = F.broadcast(right) if small else right
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    out = left.join(right, cond, how)
    if how in ("left_semi", "left_anti"):
        return out
    if how in ("outer", "full", "full_outer", "right"):
        out = out.withColumns({k: F.coalesce(F.col(k), F.col(f"__r_{k}")) for k in keys})
    return out.drop(*[f"__r_{k}" for k in keys])


def stack_sides(orig: DataFrame, new: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Both tables below each other with a flag ``is_new``; grouping this frame treats null as a level."""
    require_columns(orig, columns, "the original data")
    require_columns(new, columns, "the new data")
    return orig.select(*columns, F.lit(0).alias("is_new")).unionByName(
        new.select(*columns, F.lit(1).alias("is_new"))
    )


def long_values(df: DataFrame, variables: Sequence[str], keep: Sequence[str], as_type: str,
                name: str = "variable", value: str = "value") -> DataFrame:
    """One row per (row, variable): all variables pass through one job as values of one type."""
    pairs = F.array(*[
        F.struct(F.lit(v).alias(name), F.col(v).cast(as_type).alias(value)) for v in variables
    ])
    return df.select(*keep, F.inline(pairs))


#: Columns that are unfolded in one pass over a table.
COLUMNS_PER_PASS = 32


def column_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(variable, n_rows, n_null, n_distinct) of each column; nulls are not counted as a value.

    Columns are unfolded to (variable, value) rows, some at a time, and counted in two stages: values first, which Spark
    combines before the shuffle, then values per column. Values are told apart by their type's own equality, as a
    pass takes columns of one type.
    """
    parts = []
    kinds: dict[str, list[str]] = {}
    for c in columns:
        kinds.setdefault(df.schema[c].dataType.simpleString(), []).append(c)
    for names in kinds.values():
        for i in range(0, len(names), COLUMNS_PER_PASS):
            cells = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias("value")) for c in names[i:i + COLUMNS_PER_PASS]])
            values = df.select(F.inline(cells)).groupBy("variable", "value").agg(F.count("*").alias("n"))
            parts.append(values.groupBy("variable").agg(
                F.sum("n").alias("n_rows"), F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("n_null"), F.count("value").alias("n_distinct")))
    counted = union_all(parts)
    # a table without rows still has a row per column
    every = df.sparkSession.createDataFrame([(c,) for c in columns], "variable string")
    return every.join(F.broadcast(counted), "variable", "left").select(
        "variable", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_rows", "n_null", "n_distinct")])


def count_new() -> Column:
    return F.sum(F.col("is_new"))


def count_orig() -> Column:
    return F.sum(1 - F.col("is_new"))


def ratio(num: Column, den: Column) -> Column:
    """num / den, null when the denominator is zero."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column; adding zero turns -0.0 into 0.0."""
    kinds = (T.DoubleType, T.FloatType)
    return df.select(*[
        (F.round(F.col(f.name).cast("double"), digits) + F.lit(0.0)).alias(f.name)
        if isinstance(f.dataType, kinds) else F.col(f.name)
        for f in df.schema.fields
    ])


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def hash_uniform(seed: int | str, *keys: str) -> Column:
    """A number in [0, 1) that depends only on the seed and the keys, not on the partitioning."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
