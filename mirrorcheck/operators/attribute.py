"""Attribute disclosure of a list of targets and rare target levels, each in one job over all targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import count_new, count_orig, long_values, null_safe_join, ratio, stack_sides

MEASURES = ("dorig", "dsyn", "disdio", "disco", "tcap", "tcap_1", "tcap_0")


def level_counts(orig: DataFrame, new: DataFrame, keys: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """Rows of each side per (target, key, level of the target)."""
    both = stack_sides(orig, new, list(dict.fromkeys([*keys, *targets])))
    if set(keys) & set(targets):
        raise ValueError("a column cannot be key and target")
    return (long_values(both, targets, [*keys, "is_new"], "string", "target", "level")
            .groupBy("target", *keys, "level")
            .agg(count_orig().alias("n_orig"), count_new().alias("n_new")))


def key_summary(levels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per (target, key): all measures are sums over this frame."""
    shared = F.when(F.col("n_new") > 0, F.col("n_orig")).otherwise(0)
    return levels.groupBy("target", *keys).agg(
        F.sum("n_orig").alias("n_orig"),
        F.sum("n_new").alias("n_new"),
        F.count_if(F.col("n_orig") > 0).alias("levels_orig"),
        F.count_if(F.col("n_new") > 0).alias("levels_new"),
        F.sum(shared).alias("n_orig_shared"),
        F.bool_or((F.col("level") == "1") & (F.col("n_new") > 0)).alias("new_has_1"),
        F.bool_or((F.col("level") == "0") & (F.col("n_new") > 0)).alias("new_has_0"),
    )


def attribute_disclosure(orig: DataFrame, new: DataFrame, keys: Sequence[str], targets: Sequence[str],
                         documented: bool = False) -> DataFrame:
    """One row per target with the seven measures in percent.

    The restricted TCAPs use keys that are disclosive in the original and matched, as the published
    numbers do; ``documented=True`` uses keys that are disclosive in the new data instead.
    """
    one_o, one_n = F.col("levels_orig") == 1, F.col("levels_new") == 1
    matched = F.col("n_new") > 0
    base = one_n if documented else one_o & matched

    def rows(cond, what="n_orig"):
        return F.sum(F.when(cond, F.col(what)).otherwise(0))

    n_o, n_s = F.sum("n_orig"), F.sum("n_new")
    n_matched = rows(matched)
    return key_summary(level_counts(orig, new, keys, targets), keys).groupBy("target").agg(
        ratio(100 * rows(one_o), n_o).alias("dorig"),
        ratio(100 * rows(one_n, "n_new"), n_s).alias("dsyn"),
        ratio(100 * rows(one_o & one_n, "n_orig_shared"), n_o).alias("disdio"),
        ratio(100 * rows(one_n, "n_orig_shared"), n_o).alias("disco"),
        ratio(100 * rows(one_n, "n_orig_shared"), n_matched).alias("tcap"),
        ratio(100 * rows(base & F.coalesce("new_has_1", F.lit(False)), "n_orig_shared"), n_matched).alias("tcap_1"),
        ratio(100 * rows(base & F.coalesce("new_has_0", F.lit(False)), "n_orig_shared"), n_matched).alias("tcap_0"),
    )


def attribute_table(orig: DataFrame, new: DataFrame, keys: Sequence[str], targets: Sequence[str],
                    documented: bool = False) -> DataFrame:
    """Measures in rows, targets in columns."""
    per_target = attribute_disclosure(orig, new, keys, targets, documented)
    return (per_target.unpivot(["target"], list(MEASURES), "measure", "percent")
            .groupBy("measure").pivot("target", list(targets)).agg(F.first("percent")))


def rare_levels(orig: DataFrame, new: DataFrame, keys: Sequence[str], targets: Sequence[str],
                threshold: float = 5.0) -> DataFrame:
    """Percent of new rows that hold a rare target level (share below the threshold, among the new
    rows whose key occurs in the original)."""
    n_new = new.agg(F.count("*")).scalar()
    per_key = long_values(new, targets, keys, "string", "target", "level").groupBy("target", *keys, "level").agg(
        F.count("*").alias("n"))
    per_level = (null_safe_join(per_key, orig.select(*keys).distinct(), keys, "left_semi")
                 .groupBy("target", "level").agg(F.sum("n").alias("n")))
    totals = per_level.groupBy("target").agg(F.sum("n").alias("n_target"))
    rare = ratio(100 * F.col("n"), F.col("n_target")) < threshold
    return (per_level.join(totals, "target")
            .groupBy("target").agg(F.sum(F.when(rare, F.col("n")).otherwise(0)).alias("n_rare"))
            .select("target", "n_rare", ratio(100 * F.col("n_rare"), n_new).alias("p_outliers")))
