"""Identity disclosure and exact matches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import count_new, count_orig, ratio, stack_sides


def key_counts(orig: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key combination with its number of original and new rows."""
    return stack_sides(orig, new, keys).groupBy(*keys).agg(
        count_orig().alias("n_orig"), count_new().alias("n_new")
    )


def identity_disclosure(orig: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Percent of original rows whose key is unique in the new data, in the original, in both, and
    unique among the original rows whose key occurs in the new data."""
    one_o, one_n = F.col("n_orig") == 1, F.col("n_new") == 1
    total = F.sum("n_orig")
    return key_counts(orig, new, keys).agg(
        ratio(100 * F.count_if(one_n), total).alias("uis"),
        ratio(100 * F.count_if(one_o), total).alias("uio"),
        ratio(100 * F.count_if(one_o & one_n), total).alias("repu"),
        ratio(100 * F.count_if(one_o & (F.col("n_new") > 0)), total).alias("uiois"),
    )


def exact_match(orig: DataFrame, new: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Percent of new rows whose whole vector occurs in the original."""
    return key_counts(orig, new, variables).agg(
        F.sum(F.when(F.col("n_orig") > 0, F.col("n_new")).otherwise(0)).alias("n_matched"),
        F.sum("n_new").alias("n_new"),
    ).select("n_matched", "n_new", ratio(100 * F.col("n_matched"), F.col("n_new")).alias("exact_match_pct"))
