"""Cross-tabulations of all combinations of k variables in one pass, and scores built on them."""

from __future__ import annotations

import random
from collections.abc import Sequence
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import count_new, count_orig, null_safe_join, ratio, stack_sides, union_all
from ..functions.session import stable

SEPARATOR = " x "


#: Combinations of one aggregation; more take further passes over the rows, so that no row is copied more often.
SETS_PER_PASS = 32


def variable_combinations(variables: Sequence[str], k: int) -> list[tuple[str, ...]]:
    if k < 2:
        raise ValueError(f"combinations need at least 2 variables each, not {k}")
    if k > len(variables):
        raise ValueError(f"{len(variables)} variables have no combination of {k}")
    return list(combinations(variables, k))


def grouped_combinations(df: DataFrame, combos: Sequence[tuple[str, ...]], aggregates: Sequence[Column], also: Sequence[str] = ()) -> DataFrame:
    """One row per combination and cell: crosstab, var_1.., level_1.. (as text; shorter combinations are padded with null), the
    columns ``also``, by which cells are parted, and the aggregates.

    Each pass is one aggregation over grouping sets. Null is a level.
    """
    width = max(len(c) for c in combos)
    parts = []
    for start in range(0, len(combos), SETS_PER_PASS):
        batch = combos[start:start + SETS_PER_PASS]
        names = list(dict.fromkeys(v for c in batch for v in c))
        at = {v: f"__l{i}" for i, v in enumerate(names)}
        cells = (df.withColumns({at[v]: F.col(v).cast("string") for v in names})
                 .groupingSets([[*[F.col(at[v]) for v in c], *[F.col(x) for x in also]] for c in batch], *at.values(), *also)
                 .agg(*aggregates, F.grouping_id().alias("__set")))
        key = [*at, *[None] * len(also)]  # a set's number has a bit for each column that it lacks
        numbers = [sum(1 << (len(key) - 1 - i) for i, v in enumerate(key) if v is not None and v not in c) for c in batch]
        named = F.coalesce(*[F.when(F.col("__set") == number, F.struct(
            F.lit(SEPARATOR.join(c)).alias("crosstab"),
            *[F.lit(c[i] if i < len(c) else None).cast("string").alias(f"var_{i + 1}") for i in range(width)],
            *[(F.col(at[c[i]]) if i < len(c) else F.lit(None).cast("string")).alias(f"level_{i + 1}") for i in range(width)],
        )) for number, c in zip(numbers, batch)])
        parts.append(cells.withColumn("__cell", named).select("__cell.*", *[c for c in cells.columns if c != "__set" and c not in at.values()]))
    return union_all(parts)


def _levels(combos) -> list[str]:
    return [f"level_{i + 1}" for i in range(max(len(c) for c in combos))]


def _variables(combos) -> list[str]:
    return [f"var_{i + 1}" for i in range(max(len(c) for c in combos))]


def compare_combinations(orig: DataFrame, new: DataFrame, combos: Sequence[tuple[str, ...]],
                         weight: str | None = None, new_suffix: str = "") -> DataFrame:
    """Zero-filled cell counts of both sides, plain and (with a weight) weighted."""
    return _cells(orig, new, combos, weight, new_suffix).drop(*_variables(combos))


def _cells(orig: DataFrame, new: DataFrame, combos: Sequence[tuple[str, ...]], weight: str | None = None, new_suffix: str = "") -> DataFrame:
    names = list(dict.fromkeys(v for c in combos for v in c))
    keep = [weight] if weight else []
    renamed = new.select(*keep, *[F.col(f"{v}{new_suffix}" if f"{v}{new_suffix}" in new.columns else v).alias(v) for v in names])
    both = stack_sides(orig, renamed, [*keep, *names])
    aggs = [count_orig().alias("n_orig"), count_new().alias("n_new")]
    if weight:
        w = F.col(weight).cast("double")
        aggs += [F.sum(F.when(F.col("is_new") == 0, w).otherwise(0.0)).alias("w_orig"),
                 F.sum(F.when(F.col("is_new") == 1, w).otherwise(0.0)).alias("w_new")]
    if len(combos) == 1:
        return grouped_combinations(both, combos, aggs)
    # equal rows first become one, so that grouping sets copy each combination of levels and not each row
    tuples = both.groupBy(*[F.col(v).cast("string").alias(v) for v in names]).agg(*aggs)
    return grouped_combinations(tuples, combos, [F.sum(c).alias(c) for c in tuples.columns if c not in names])


def with_totals(cells: DataFrame, orig: str, new: str) -> DataFrame:
    """The cells with ``__o`` and ``__n``, the sums of two columns over their crosstab; cells are stored, so the rows below are read once."""
    cells = stable(cells)
    totals = cells.groupBy("crosstab").agg(F.sum(orig).alias("__o"), F.sum(new).alias("__n"))
    return cells.join(totals, "crosstab")


def compare_crosstabs(orig: DataFrame, new: DataFrame, variables: Sequence[str], k: int = 2) -> DataFrame:
    """Counts and shares of both sides for every combination of k variables."""
    cells = compare_combinations(orig, new, variable_combinations(variables, k))
    return (with_totals(cells, "n_orig", "n_new")
            .withColumn("p_orig", ratio(F.col("n_orig"), F.col("__o")))
            .withColumn("p_new", ratio(F.col("n_new"), F.col("__n"))).drop("__o", "__n"))


def crosstab_report(orig: DataFrame, new: DataFrame, variables: Sequence[str], top: DataFrame, k: int = 2) -> DataFrame:
    """Crosstabs with the levels outside the list of top levels (variable, level) pooled as 'Other'.

    var_1.. name the variables, and other_1.. tell the pool from a level of that name.
    """
    combos = variable_combinations(variables, k)
    cells = _cells(orig, new, combos)
    for i in range(1, k + 1):
        keep = top.select(F.col("variable").alias(f"var_{i}"), F.col("level").alias(f"level_{i}"), F.lit(True).alias("__keep"))
        cells = null_safe_join(cells, keep, [f"var_{i}", f"level_{i}"], "left").withColumn(f"other_{i}", F.col("__keep").isNull()).withColumn(
            f"level_{i}", F.when(F.col("__keep"), F.col(f"level_{i}")).otherwise("Other")).drop("__keep")
    marks = [f"other_{i}" for i in range(1, k + 1)]
    pooled = cells.groupBy("crosstab", *_variables(combos), *_levels(combos), *marks).agg(F.sum("n_orig").alias("n_orig"), F.sum("n_new").alias("n_new"))
    p, q = ratio(F.col("n_orig"), F.col("__o")), ratio(F.col("n_new"), F.col("__n"))
    return (with_totals(pooled, "n_orig", "n_new").withColumns({"p_orig": p, "p_new": q, "diff": q - p, "rel_diff": ratio(q - p, p)})
            .drop("__o", "__n"))


def high_utility_crosstabs(orig: DataFrame, new: DataFrame, variables: Sequence[str], weight: str,
                           new_suffix: str = "", dims: Sequence[int] = (2, 3), forced: Sequence[str] = ()) -> DataFrame:
    """Weighted and plain crosstabs of several dimensions; with ``forced`` only combinations that
    hold at least one forced variable."""
    pool = list(dict.fromkeys([*variables, *forced]))
    combos = [c for d in dims for c in combinations(pool, d) if not forced or set(c) & set(forced)]
    return compare_combinations(orig, new, combos, weight, new_suffix)


def total_variation(cells: DataFrame, orig: str = "w_orig", new: str = "w_new") -> DataFrame:
    """Half the summed absolute share difference per crosstab; categories are aligned, not positions."""
    gap = F.abs(ratio(F.col(orig), F.col("__o")) - ratio(F.col(new), F.col("__n")))
    return with_totals(cells, orig, new).groupBy("crosstab").agg((0.5 * F.sum(gap)).alias("tvn"))


def choose_combinations(variables: Sequence[str], k: int, n: int | None = None, seed: int = 1) -> list[tuple[str, ...]]:
    """All combinations; with ``n``, that many of them chosen by a seeded draw."""
    if n is None or comb(len(variables), k) <= n:
        return list(combinations(variables, k))
    picked = sorted(random.Random(seed).sample(range(comb(len(variables), k)), n))
    wanted = set(picked)
    return [c for i, c in enumerate(combinations(variables, k)) if i in wanted]


def k_marginals(orig: DataFrame, new: DataFrame, variables: Sequence[str], weight: str, new_suffix: str = "",
                k: int = 3, n: int | None = None, seed: int = 1) -> DataFrame:
    """Total variation of every chosen k-way weighted marginal."""
    combos = choose_combinations(variables, k, n, seed)
    return total_variation(compare_combinations(orig, new, combos, weight, new_suffix))


def k_marginal_score(marginals: DataFrame) -> DataFrame:
    """Summary over the marginals (one row per combination, so a few hundred at most)."""
    return marginals.agg(
        F.count("*").alias("n_marginals"), F.min("tvn").alias("min"), F.percentile("tvn", 0.25).alias("q1"),
        F.percentile("tvn", 0.5).alias("median"), F.avg("tvn").alias("mean"), F.percentile("tvn", 0.75).alias("q3"),
        F.max("tvn").alias("max"))
