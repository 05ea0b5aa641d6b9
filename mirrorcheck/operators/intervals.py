"""Overlap of confidence intervals between original and new data: simple, survey-weighted, in subsets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import null_safe_join, ratio, require_columns, union_all
from ..functions.stats import critical_value

STATISTICS = {"mean": "mean", "prop": "prop", "sum": "sum", "total": "sum"}


def interval_overlap(l1: Column, u1: Column, l2: Column, u2: Column) -> Column:
    """Mean share of each interval that the other one covers; negative when they are apart."""
    shared = F.least(u1, u2) - F.greatest(l1, l2)
    return 0.5 * (ratio(shared, u1 - l1) + ratio(shared, u2 - l2))


def _check(statistic: str) -> str:
    if statistic not in STATISTICS:
        raise ValueError("statistic must be mean, prop or sum (total)")
    return STATISTICS[statistic]


def _long(df: DataFrame, variables: Sequence[str], suffixes: Sequence[str], statistic: str, keep: Sequence[str],
          subsets: Sequence[str], side: str) -> DataFrame:
    """(variable, implicate, subset, value) rows; a row enters a subset where its flag is 1."""
    kind = "string" if statistic == "prop" else "double"
    require_columns(df, [f"{v}{s}" for v in variables for s in suffixes], side)
    cells = []
    for s in suffixes:
        for sub in subsets or [None]:
            flag = F.lit(True) if sub is None else F.coalesce(
                F.col(f"{sub}{s}" if f"{sub}{s}" in df.columns else sub) == 1, F.lit(False))
            for v in variables:
                cells.append(F.struct(
                    F.lit(v).alias("variable"), F.lit("".join(c for c in s if c.isdigit())).alias("implicate"),
                    F.lit(sub or "").alias("subset"), F.col(f"{v}{s}").cast(kind).alias("value"), flag.alias("inside")))
    rows = df.select(*keep, F.inline(F.array(*cells)))
    return (rows.where("inside") if subsets else rows).drop("inside")


KEYS = ["variable", "implicate", "subset"]


def _moments(df: DataFrame, cells) -> DataFrame:
    """(variable, implicate, subset, m, sd, n) of each cell: sums over the same rows, which are not copied per cell."""
    parts, per_pass = [], SUMS_PER_PASS // 4
    for start in range(0, len(cells), per_pass):
        sums, rows = [], []
        for k, (v, i, sub, x, inside) in enumerate(cells[start:start + per_pass]):
            value = F.when(inside, x.cast("double"))
            sums += [F.count_if(inside).alias(f"r{k}"), F.avg(value).alias(f"m{k}"), F.stddev_samp(value).alias(f"s{k}"), F.count(value).alias(f"n{k}")]
            rows.append(F.struct(F.lit(v).alias("variable"), F.lit(i).alias("implicate"), F.lit(sub).alias("subset"), F.col(f"r{k}").alias("rows"),
                                 F.col(f"m{k}").alias("m"), F.col(f"s{k}").alias("sd"), F.col(f"n{k}").alias("n")))
        parts.append(df.agg(*sums).select(F.inline(F.array(*rows))))
    return union_all(parts).where("rows > 0").drop("rows")


def _simple(df: DataFrame, variables: Sequence[str], suffixes: Sequence[str], subsets: Sequence[str], side: str, statistic: str, z: float, plain_sd_for_sum: bool) -> DataFrame:
    """Estimate and normal interval from the sample size and standard deviation."""
    if statistic == "prop":
        rows = _long(df, variables, suffixes, statistic, [], subsets, side)
        cells = rows.groupBy(*KEYS, F.col("value").alias("category")).agg(F.count("*").alias("k"))
        totals = cells.groupBy(*KEYS).agg(F.sum("k").alias("n"))
        p = ratio(F.col("k"), F.col("n"))
        out = cells.join(totals, KEYS).withColumn("est", p).withColumn("se", F.sqrt(p * (1 - p) / F.col("n")))
    else:
        out = _moments(df, _cells_of(df, variables, suffixes, subsets, side)).withColumn("category", F.lit(None).cast("string"))
        root = F.sqrt(F.col("n").cast("double"))
        if statistic == "mean":
            out = out.withColumn("est", F.col("m")).withColumn("se", ratio(F.col("sd"), root))
        else:
            out = out.withColumn("est", F.col("n") * F.col("m")).withColumn(
                "se", F.col("sd") if plain_sd_for_sum else F.col("sd") * root)
    return out.select(*KEYS, "category", "est", (F.col("est") - z * F.col("se")).alias("low"),
                      (F.col("est") + z * F.col("se")).alias("upp"))


#: Sums of one aggregation; more take further passes over the rows, which are never copied per variable.
SUMS_PER_PASS = 400


def _cells_of(df: DataFrame, variables: Sequence[str], suffixes: Sequence[str], subsets: Sequence[str], side: str) -> list[tuple[str, str, str, Column, Column]]:
    """(variable, implicate, subset, value, flag of the rows inside) of each wanted estimate."""
    require_columns(df, [f"{v}{s}" for v in variables for s in suffixes], side)
    out = []
    for s in suffixes:
        for sub in subsets or [None]:
            inside = F.lit(True) if sub is None else F.coalesce(F.col(f"{sub}{s}" if f"{sub}{s}" in df.columns else sub) == 1, F.lit(False))
            out += [(v, "".join(c for c in s if c.isdigit()), sub or "", F.col(f"{v}{s}"), inside) for v in variables]
    return out


def _weighted_sums(df: DataFrame, cells, statistic: str, names: Sequence[str]) -> DataFrame:
    """(variable, implicate, subset, category, a0.., b0..): weighted sums and sums of weights for each weight.

    For means and totals all cells of a pass are sums over the same rows; for proportions each cell is one grouping by its value.
    """
    ws = [F.col(w).cast("double") for w in names]

    def labels(v, i, sub):
        return [F.lit(v).alias("variable"), F.lit(i).alias("implicate"), F.lit(sub).alias("subset")]

    if statistic == "prop":
        parts = [df.where(inside).groupBy(x.cast("string").alias("category")).agg(*[F.sum(w).alias(f"a{j}") for j, w in enumerate(ws)]).select(*labels(v, i, sub), "*")
                 for v, i, sub, x, inside in cells]
        counted = union_all(parts)
        totals = counted.groupBy(*KEYS).agg(*[F.sum(f"a{j}").alias(f"b{j}") for j in range(len(ws))])
        return counted.join(totals, KEYS)
    per_pass, parts = max(1, SUMS_PER_PASS // (2 * len(ws))), []
    for start in range(0, len(cells), per_pass):
        sums, rows = [], []
        for k, (v, i, sub, x, inside) in enumerate(cells[start:start + per_pass]):
            value = x.cast("double")
            sums.append(F.count_if(inside).alias(f"n{k}"))
            for j, w in enumerate(ws):
                sums += [F.sum(F.when(inside, w * value)).alias(f"a{k}_{j}"), F.sum(F.when(inside & value.isNotNull(), w)).alias(f"b{k}_{j}")]
            rows.append(F.struct(*labels(v, i, sub), F.lit(None).cast("string").alias("category"), F.col(f"n{k}").alias("rows"),
                                 *[F.col(f"{c}{k}_{j}").alias(f"{c}{j}") for j in range(len(ws)) for c in "ab"]))
        parts.append(df.agg(*sums).select(F.inline(F.array(*rows))))
    return union_all(parts).where("rows > 0").drop("rows")


def _survey(df: DataFrame, cells, statistic: str, z: float, weight: str, replicates: Sequence[str], scale: float) -> DataFrame:
    """Weighted estimate with replicate-weight variance about the full-sample estimate. Means and
    totals get normal limits, proportions logit limits."""
    names = [weight, *replicates]
    out = _weighted_sums(df, cells, statistic, names)

    def theta(i):
        return F.col(f"a{i}") if statistic == "sum" else ratio(F.col(f"a{i}"), F.col(f"b{i}"))

    var = F.lit(0.0)
    for i in range(1, len(names)):
        var = var + F.pow(theta(i) - theta(0), F.lit(2.0))
    out = out.withColumn("est", theta(0)).withColumn("se", F.sqrt(F.lit(scale) * var))
    low, upp = F.col("est") - z * F.col("se"), F.col("est") + z * F.col("se")
    if statistic == "prop":
        p = F.col("est")
        half = z * F.col("se") / (p * (1 - p))
        logit = F.ln(p / (1 - p))
        inner = (p > 0) & (p < 1)
        low = F.when(inner, 1 / (1 + F.exp(-(logit - half)))).otherwise(p)
        upp = F.when(inner, 1 / (1 + F.exp(-(logit + half)))).otherwise(p)
    return out.select(*KEYS, "category", "est", low.alias("low"), upp.alias("upp"))


def _combine(orig: DataFrame, new: DataFrame, statistic: str, suffixes, subsets) -> DataFrame:
    a = orig.drop("implicate").withColumnsRenamed({"est": "orig", "low": "orig_low", "upp": "orig_upp"})
    b = new.withColumnsRenamed({"est": "new", "low": "new_low", "upp": "new_upp"})
    if statistic == "prop":
        # a category missing on one side keeps its row; every implicate is matched on its own
        parts = [null_safe_join(a, b.where(F.col("implicate") == i).drop("implicate"), ["variable", "subset", "category"], "outer")
                 .withColumn("implicate", F.lit(i)) for i in dict.fromkeys("".join(c for c in s if c.isdigit()) for s in suffixes)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
    else:
        out = a.drop("category").join(b.drop("category"), ["variable", "subset"])
    head = ["variable", *(["implicate"] if any(suffixes) else []), *(["subset"] if subsets else []),
            *(["category"] if statistic == "prop" else [])]
    c = F.col
    return out.select(
        *head, interval_overlap(c("orig_low"), c("orig_upp"), c("new_low"), c("new_upp")).alias("overlap"),
        ((c("new") >= c("orig_low")) & (c("new") <= c("orig_upp"))).alias("new_est_in_orig_ci"),
        "orig", "new", "orig_low", "new_low", "orig_upp", "new_upp")


def ci_overlap(orig: DataFrame, new: DataFrame, variables: Sequence[str], suffixes: Sequence[str] | None = None,
               statistic: str = "mean", level: float = 0.95, plain_sd_for_sum: bool = False,
               subsets: Sequence[str] = ()) -> DataFrame:
    """Interval overlap for means, proportions or sums, per implicate; optionally inside 0/1 subsets.

    ``plain_sd_for_sum`` takes the standard deviation as the standard error of a sum, as some
    published tables do.
    """
    statistic, z = _check(statistic), critical_value(level)
    suffixes = list(suffixes or [""])
    a = _simple(orig, variables, [""], subsets, "the original data", statistic, z, plain_sd_for_sum)
    b = _simple(new, variables, suffixes, subsets, "the new data", statistic, z, plain_sd_for_sum)
    return _combine(a, b, statistic, suffixes, subsets)


def survey_ci_overlap(orig: DataFrame, new: DataFrame, variables: Sequence[str], weight: str, replicates: Sequence[str],
                      suffixes: Sequence[str] | None = None, statistic: str = "mean", level: float = 0.95,
                      scale: float | None = None, subsets: Sequence[str] = ()) -> DataFrame:
    """Interval overlap with replicate weights; the default variance scale is 4 / replicates."""
    statistic, z = _check(statistic), critical_value(level)
    suffixes = list(suffixes or [""])
    scale = 4.0 / len(replicates) if scale is None else scale
    a = _survey(orig, _cells_of(orig, variables, [""], subsets, "the original data"), statistic, z, weight, replicates, scale)
    b = _survey(new, _cells_of(new, variables, suffixes, subsets, "the new data"), statistic, z, weight, replicates, scale)
    return _combine(a, b, statistic, suffixes, subsets)
