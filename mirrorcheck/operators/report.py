"""Whole utility reports over many tables, composed of the single measures."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import union_all
from ..sources.registry import variables_of
from . import crosstabs, distances


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def difference_rollup(categorical: DataFrame, continuous: DataFrame, ks: DataFrame) -> DataFrame:
    """One row per variable: p-value with stars, difference of mean and sd, largest share difference."""
    cat = categorical.groupBy("variable").agg(
        F.first("p_value").alias("p_value"), F.max(F.abs(F.col("p_new") - F.col("p_orig"))).alias("max_diff"))
    stat = continuous.groupBy("variable").agg(
        F.max(F.when(F.col("statistic") == "mean", F.col("diff"))).alias("mean_diff"),
        F.max(F.when(F.col("statistic") == "sd", F.col("diff"))).alias("sd_diff"))
    cont = ks.select("variable", "p_value").join(stat, "variable")
    empty = F.lit(None).cast("double")
    return cont.withColumn("max_diff", empty).unionByName(
        cat.withColumns({"mean_diff": empty, "sd_diff": empty})).withColumn("sig", stars(F.col("p_value")))


def utility_report(orig: Mapping[str, DataFrame], new: Mapping[str, DataFrame], registry: DataFrame) -> DataFrame:
    """All single-variable measures of all tables in one long frame (table, variable, measure, value).

    No table is left out for its size; each table is one set of jobs over all its variables.
    """
    frames = []

    def add(table, df, keys, values):
        item = F.concat_ws(" | ", *[F.coalesce(F.col(k).cast("string"), F.lit("<null>")) for k in keys]) if keys else F.lit("")
        cells = F.array(*[F.struct(F.lit(v).alias("measure"), F.col(v).cast("double").alias("value")) for v in values])
        frames.append(df.select(F.lit(table).alias("table_name"), "variable", item.alias("item"), F.inline(cells)))

    for table in [t for t in orig if t in new]:
        a, b = distances.date_features(orig[table]), distances.date_features(new[table])
        cats = variables_of(registry, table, "cat", a, b)
        conts = variables_of(registry, table, "cont", a, b)
        if cats:
            add(table, distances.categorical_distance(a, b, cats), [], ["hd", "w_hd"])
            add(table, distances.top_level_report(a, b, cats), ["level"], ["p_orig", "p_new", "chi_square", "p_value"])
        if conts:
            add(table, distances.continuous_summary(a, b, conts), ["statistic"], ["orig", "new", "diff"])
            add(table, distances.ks_distance(a, b, conts), [], ["ks_distance", "p_value"])
        if cats or conts:
            add(table, distances.validity(a, b, cats, conts).withColumn("valid", F.col("valid").cast("int")), [], ["valid"])
            add(table, distances.missing_rates(a, b, [*cats, *conts]), [],
                ["missing_orig", "missing_new", "distinct_orig", "distinct_new"])
        if len(cats) >= 2:
            tabs = crosstabs.compare_crosstabs(a, b, cats, 2).withColumnRenamed("crosstab", "variable")
            add(table, tabs, ["level_1", "level_2"], ["n_orig", "n_new", "p_orig", "p_new"])
    return union_all(frames)
