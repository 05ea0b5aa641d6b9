"""Pairwise association: correlations, rank correlations, Cramér's V, weighted correlations."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio, require_columns, stack_sides, union_all
from ..functions.ordered import attach_by_value, running_sums, value_counts
from ..functions.session import stored
from .crosstabs import grouped_combinations

# Pairs per aggregation; more pairs are computed in further passes so that the generated code stays small.
PAIRS_PER_PASS = 200
#: Ranks of so many values, over all variables, go to all tasks.
MOST_VALUES_SENT = 200_000


def _pairs(variables: Sequence[str]) -> list[tuple[str, str]]:
    if len(variables) < 2:
        raise ValueError("at least two variables are needed")
    return list(combinations(variables, 2))


def _compare(long: DataFrame, value: str = "r") -> DataFrame:
    """Both sides next to each other with difference and relative difference."""
    return (long.groupBy("var_1", "var_2").agg(
        F.max(F.when(F.col("is_new") == 0, F.col(value))).alias("orig_corr"),
        F.max(F.when(F.col("is_new") == 1, F.col(value))).alias("new_corr"))
        .withColumn("diff", F.col("new_corr") - F.col("orig_corr"))
        .withColumn("rel_diff", ratio(F.col("diff"), F.col("orig_corr"))))


def _correlate(rows: DataFrame, pairs, columns) -> DataFrame:
    """``columns(pair)`` names the two columns to correlate; pairs of constant columns are left out."""
    out = []
    for i in range(0, len(pairs), PAIRS_PER_PASS):
        part = pairs[i:i + PAIRS_PER_PASS]
        aggs, cells = [], []
        for j, (a, b) in enumerate(part):
            x, y = columns((a, b))
            # the built-in correlation fails on a constant column, so it is put together from moments
            vx = F.var_pop(F.when(F.col(y).isNotNull(), F.col(x)))
            vy = F.var_pop(F.when(F.col(x).isNotNull(), F.col(y)))
            aggs.append(ratio(F.covar_pop(x, y), F.sqrt(vx) * F.sqrt(vy)).alias(f"r{j}"))
            cells.append(F.struct(F.lit(a).alias("var_1"), F.lit(b).alias("var_2"), F.col(f"r{j}").alias("r")))
        out.append(rows.groupBy("is_new").agg(*aggs).select("is_new", F.inline(F.array(*cells))))
    return union_all(out).where(F.col("r").isNotNull() & ~F.isnan("r"))


def _complete(compared: DataFrame) -> DataFrame:
    return compared.where(F.col("orig_corr").isNotNull() & F.col("new_corr").isNotNull())


def pairwise_correlations(orig: DataFrame, new: DataFrame, variables: Sequence[str], method: str = "pearson") -> DataFrame:
    """Correlation of every pair on both sides over the rows where both values are present."""
    if method == "spearman":
        return rank_correlations(orig, new, variables)
    if method != "pearson":
        raise ValueError("method must be pearson or spearman")
    rows = stack_sides(orig, new, variables)
    rows = rows.select("is_new", *[F.col(v).cast("double").alias(v) for v in variables])
    return _complete(_compare(_correlate(rows, _pairs(variables), lambda p: p)))


def rank_correlations(orig: DataFrame, new: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Spearman correlations. Ranks are taken among the rows where both variables of a pair are present,
    so a variable has one set of ranks, and one more for each partner that has missing values. All sets of a variable come
    from one count of its values, of all rows and of those where each such partner is present."""
    variables = list(variables)
    rows = stack_sides(orig, new, variables).select("is_new", *[F.col(v).cast("double").alias(f"__v{i}") for i, v in enumerate(variables)])
    nulls = rows.agg(*[F.max(F.col(f"__v{i}").isNull()) for i in range(len(variables))]).first()
    holey = [v for v, null in zip(variables, nulls) if null]
    flags = [F.col(f"__v{variables.index(v)}").isNotNull().cast("long").alias(f"p{k}") for k, v in enumerate(holey, 1)]
    counts = value_counts(_unfolded(rows, ["is_new", *flags], len(variables)), ["is_new", "__var"], "value",
                          {"n0": F.count("*"), **{f"n{k}": F.sum(f"p{k}") for k in range(1, len(holey) + 1)}})
    names = [f"n{k}" for k in range(len(holey) + 1)]
    run = running_sums(counts, ["is_new", "__var"], "value", names)
    # ranks less their mean, so that a pair's correlation needs one sum over the rows
    ranks = stored(run.select("is_new", "__var", "value", *names, *[(F.col(f"cum_{n}") - (F.col(n) + F.col(f"total_{n}")) / 2.0).alias(f"r{k}") for k, n in enumerate(names)]))
    spread = ranks.groupBy("is_new", "__var").agg(*[F.sum(F.col(n) * F.col(f"r{k}") * F.col(f"r{k}")).alias(f"q{k}") for k, n in enumerate(names)])
    wide = _ranked(rows, ranks.drop(*names[1:]), len(variables), ["is_new"], "n0")
    pairs = _pairs(variables)
    if len(pairs) > PAIRS_PER_PASS:
        wide = stored(wide)

    def place(x, partner):
        """The number of the set of ranks and of the variable."""
        return holey.index(partner) + 1 if partner in holey else 0, variables.index(x)

    out = []
    for i in range(0, len(pairs), PAIRS_PER_PASS):
        sums, cells = [], []
        for j, (a, b) in enumerate(pairs[i:i + PAIRS_PER_PASS]):
            (k, x), (m, y) = place(a, b), place(b, a)
            sums.append(F.sum(F.col(f"__r{k}_{x}") * F.col(f"__r{m}_{y}")).alias(f"s{j}"))
            cells.append(F.struct(F.lit(a).alias("var_1"), F.lit(b).alias("var_2"), F.lit(k).alias("k"), F.lit(x).alias("x"), F.lit(m).alias("m"), F.lit(y).alias("y"), F.col(f"s{j}").alias("s")))
        out.append(wide.groupBy("is_new").agg(*sums).select("is_new", F.inline(F.array(*cells))))
    q = spread.select("is_new", "__var", F.array(*[f"q{k}" for k in range(len(names))]).alias("q"))
    found = (union_all(out).join(F.broadcast(q.select("is_new", F.col("__var").alias("x"), F.col("q").alias("__qx"))), ["is_new", "x"])
             .join(F.broadcast(q.select("is_new", F.col("__var").alias("y"), F.col("q").alias("__qy"))), ["is_new", "y"]))
    r = ratio(F.col("s"), F.sqrt(F.get("__qx", F.col("k"))) * F.sqrt(F.get("__qy", F.col("m"))))
    return _complete(_compare(found.withColumn("r", r).where(F.col("r").isNotNull() & ~F.isnan("r"))))


def _unfolded(rows: DataFrame, keep: Sequence, places: int) -> DataFrame:
    """A row per row and variable, ``__var`` being the variable's place and ``value`` its ``__v<place>``."""
    cells = F.array(*[F.struct(F.lit(i).alias("__var"), F.col(f"__v{i}").alias("value")) for i in range(places)])
    return rows.select(*keep, F.inline(cells))


def _ranked(rows: DataFrame, ranks: DataFrame, places: int, by: Sequence[str], n: str) -> DataFrame:
    """The rows with ``__<rank>_<place>``, null where the value is null, in place of each ``__v<place>``.

    ``ranks`` is a stored frame (by, __var, value, n, rank columns). Variables of few values are looked up in each task, those of
    many by a shuffle of the rows; these come first, while rows are narrow.
    """
    sizes = dict(ranks.groupBy("__var").count().collect())
    sent = 0
    small = set()
    for i in sorted(range(places), key=lambda i: sizes.get(i, 0)):
        sent += sizes.get(i, 0)
        if sent <= MOST_VALUES_SENT:
            small.add(i)
    names = [c for c in ranks.columns if c not in (*by, "__var", "value", n)]
    for i in sorted(range(places), key=lambda i: i in small):
        of = ranks.where(F.col("__var") == i).select(*by, F.col("value").alias(f"__v{i}"), n, *[F.col(c).alias(f"__{c}_{i}") for c in names])
        rows = attach_by_value(rows, of, by, f"__v{i}", n, i in small).drop(f"__v{i}")
    return rows


def cramers_v(orig: DataFrame, new: DataFrame, variables: Sequence[str], correct: bool = True) -> DataFrame:
    """Cramér's V of every categorical pair on both sides over rows where both are present; pairs with a
    constant variable are left out. ``correct`` applies the continuity correction to 2x2 tables."""
    cells = (grouped_combinations(stack_sides(orig, new, variables), _pairs(variables), [F.count("*").cast("double").alias("n")], ["is_new"])
             .where("level_1 IS NOT NULL AND level_2 IS NOT NULL").drop("crosstab"))
    by = ["is_new", "var_1", "var_2"]
    row_sums = cells.groupBy(*by, "level_1").agg(F.sum("n").alias("row_n"))
    col_sums = cells.groupBy(*by, "level_2").agg(F.sum("n").alias("col_n"))
    shape = row_sums.groupBy(*by).agg(F.count("*").alias("r"), F.sum("row_n").alias("total")).join(
        col_sums.groupBy(*by).agg(F.count("*").alias("c")), by)
    x = cells.join(row_sums, [*by, "level_1"]).join(col_sums, [*by, "level_2"]).join(shape, by)
    expected = F.col("row_n") * F.col("col_n") / F.col("total")
    stat = x.groupBy(*by, "r", "c", "total").agg(
        (F.first("total") * (F.sum(F.col("n") * F.col("n") / (F.col("row_n") * F.col("col_n"))) - 1)).alias("chi"),
        F.max(F.abs(F.col("n") - expected)).alias("gap"))
    shrunk = (F.col("gap") - F.least(F.lit(0.5), F.col("gap"))) / F.col("gap")
    two = (F.col("r") == 2) & (F.col("c") == 2) & (F.col("gap") > 0) & F.lit(correct)
    chi = F.greatest(F.when(two, F.col("chi") * shrunk * shrunk).otherwise(F.col("chi")), F.lit(0.0))
    v = F.sqrt(chi / F.col("total") / (F.least("r", "c") - 1))
    return _complete(_compare(stat.where("r > 1 AND c > 1").withColumn("v", v), "v")).withColumnsRenamed(
        {"orig_corr": "orig_v", "new_corr": "new_v"}).drop("rel_diff")


# ------------------------------------------------------------------ weighted correlations


def weighted_ranks(df: DataFrame, variables: Sequence[str], weight: str) -> DataFrame:
    """Weighted ranks of the variables in place of their values: weight below plus the mean position among ties.

    Each row stands for itself (``__rows`` is 1).
    """
    w = F.col(weight).cast("double")
    rows = df.select(w.alias("__w"), *[F.col(v).cast("double").alias(f"__v{i}") for i, v in enumerate(variables)])
    counts = value_counts(_unfolded(rows, ["__w"], len(variables)), ["__var"], "value", {"n": F.count("*"), "w": F.sum("__w")})
    run = running_sums(counts, ["__var"], "value", ["w"])
    ranks = stored(run.select("__var", "value", "n", (F.col("cum_w") - F.col("w") + (F.col("n") + 1) / 2.0 * F.col("w") / F.col("n")).alias("r")))
    wide = _ranked(rows, ranks, len(variables), [], "n")
    return wide.select(F.lit(1).alias("__rows"), F.col("__w").alias(weight), *[F.col(f"__r_{i}").alias(v) for i, v in enumerate(variables)])


def weighted_pair_moments(df: DataFrame, pairs, weight: str, columns=None, rows: str | None = None) -> DataFrame:
    """Weighted correlation and number of complete rows per pair, from one aggregation of moments.

    ``rows``: the column that says how many rows a row stands for.
    """
    one = F.col(rows) if rows else F.lit(1)
    columns = columns or (lambda p: p)
    out = []
    for i in range(0, len(pairs), PAIRS_PER_PASS // 2):
        part = pairs[i:i + PAIRS_PER_PASS // 2]
        aggs, cells = [], []
        for j, p in enumerate(part):
            a, b = columns(p)
            x, y = F.col(a).cast("double"), F.col(b).cast("double")
            ok = F.when(x.isNotNull() & y.isNotNull(), F.col(weight).cast("double"))
            for name, e in (("w", ok), ("x", ok * x), ("y", ok * y), ("xx", ok * x * x), ("yy", ok * y * y), ("xy", ok * x * y)):
                aggs.append(F.sum(e).alias(f"{name}{j}"))
            aggs.append(F.coalesce(F.sum(F.when(x.isNotNull() & y.isNotNull(), one)), F.lit(0)).cast("long").alias(f"n{j}"))
            c = {k: F.col(f"{k}{j}") for k in ("w", "x", "y", "xx", "yy", "xy")}
            cov = c["xy"] / c["w"] - c["x"] * c["y"] / (c["w"] * c["w"])
            vx = c["xx"] / c["w"] - c["x"] * c["x"] / (c["w"] * c["w"])
            vy = c["yy"] / c["w"] - c["y"] * c["y"] / (c["w"] * c["w"])
            cells.append(F.struct(F.lit(p[0]).alias("var_1"), F.lit(p[1]).alias("var_2"), F.col(f"n{j}").alias("n_pairs"),
                                  ratio(cov, F.sqrt(F.greatest(vx * vy, F.lit(0.0)))).alias("r")))
        out.append(df.agg(*aggs).select(F.inline(F.array(*cells))))
    return union_all(out)


def change_in_correlations(orig: DataFrame, new: DataFrame, variables: Sequence[str], weight: str,
                           new_suffix: str = "", method: str = "pearson") -> DataFrame:
    """Weighted correlations on both sides, absolute and relative change, and the change in units of
    the original's standard error (1-r)^2/sqrt(n)."""
    require_columns(orig, [*variables, weight], "the original data")
    require_columns(new, [*[f"{v}{new_suffix}" for v in variables], weight], "the new data")
    old = orig.select(weight, *variables)
    now = new.select(weight, *[F.col(f"{v}{new_suffix}").alias(v) for v in variables])
    if method == "spearman":
        old, now = weighted_ranks(old, variables, weight), weighted_ranks(now, variables, weight)
    elif method != "pearson":
        raise ValueError("method must be pearson or spearman")
    pairs = _pairs(variables)
    rows = "__rows" if method == "spearman" else None
    a = weighted_pair_moments(old, pairs, weight, rows=rows).withColumnsRenamed({"r": "orig_corr", "n_pairs": "n_orig"})
    b = weighted_pair_moments(now, pairs, weight, rows=rows).withColumnsRenamed({"r": "new_corr", "n_pairs": "n_new"})
    gap = F.abs(F.col("orig_corr") - F.col("new_corr"))
    se = F.pow(1 - F.col("orig_corr"), F.lit(2.0)) / F.sqrt(F.col("n_orig").cast("double"))
    return a.join(b, ["var_1", "var_2"]).withColumn("abs_diff", gap).withColumn(
        "rel_diff", ratio(gap, F.col("orig_corr"))).withColumn("scaled_diff", ratio(gap, se)).drop("n_new")


def global_correlation_score(changes: DataFrame) -> DataFrame:
    """Mean change in standard-error units over all pairs."""
    return changes.agg(F.avg("scaled_diff").alias("global_utility"), F.count("*").alias("n_pairs"))
