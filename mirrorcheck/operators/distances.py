"""How far the distributions of single variables lie apart: categorical, continuous, missing, valid."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (
    column_counts, count_new, count_orig, long_values, null_safe_join, ratio, require_columns, stack_sides, union_all,
)
from ..functions.ordered import exact_quantiles, running_sums, value_counts
from ..functions.session import stable
from ..functions.stats import chi_square_tail, kolmogorov_tail

PERCENTILES = {"q01": 0.01, "q05": 0.05, "q10": 0.10, "q25": 0.25, "median": 0.5, "q75": 0.75, "q90": 0.90,
               "q95": 0.95, "q99": 0.99}
SUMMARY = ["min", *PERCENTILES, "mean", "max", "sd"]


@F.pandas_udf(T.DoubleType())
def chi_square_p(stat: pd.Series, df: pd.Series) -> pd.Series:
    """Upper chi-square tail for the few rows of a result table."""
    return pd.Series([
        None if pd.isna(s) or pd.isna(d) or d <= 0 else chi_square_tail(float(s), float(d)) for s, d in zip(stat, df)
    ], dtype="float64")


# ------------------------------------------------------------------ dates


def date_features(df: DataFrame, pairs: Sequence[tuple[str, str]] = (), birth: str | None = None) -> DataFrame:
    """For every ``*date`` column its year, month, day and days since 2000; day differences of pairs."""
    origin = F.lit("2000-01-01").cast("date")
    out = {}
    for c in [c for c in df.columns if c.endswith("date")]:
        d = F.col(c).cast("date")
        out |= {f"{c}_year": F.year(d), f"{c}_month": F.month(d), f"{c}_day": F.day(d),
                f"{c}_since2000": F.datediff(d, origin)}
    for start, end in pairs:
        out[f"{start}_to_{end}"] = F.datediff(F.col(end).cast("date"), F.col(start).cast("date"))
    if birth:
        out["birth_since2000"] = F.datediff(F.col(birth).cast("date"), origin)
    return df.withColumns(out)


# ------------------------------------------------------------------ categorical


def level_counts(orig: DataFrame, new: DataFrame, variables: Sequence[str], weight: str | None = None,
                 suffixes: Sequence[str] | None = None) -> DataFrame:
    """One row per (variable, implicate, level) with plain and weighted counts of both sides."""
    require_columns(orig, variables, "the original data")
    suffixes = list(suffixes or [""])
    require_columns(new, [f"{v}{s}" for v in variables for s in suffixes], "the new data")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)

    def side(df, columns, tag):
        """Each side is read once; (variable, implicate) is the place in ``columns`` until the levels are counted."""
        cells = F.array(*[F.struct(F.lit(i).alias("__at"), F.col(c).cast("string").alias("level")) for i, (_, _, c) in enumerate(columns)])
        named = F.array(*[F.struct(F.lit(v).alias("variable"), F.array(*[F.lit(s) for s in of]).alias("implicates")) for v, of, _ in columns])
        counted = df.select(w.alias("__w"), F.inline(cells)).groupBy("__at", "level").agg(F.count("*").alias(f"n_{tag}"), F.sum("__w").alias(f"w_{tag}"))
        sums = [F.col(f"{c}_{t}") if t == tag else F.lit(0).cast(kind).alias(f"{c}_{t}") for c, kind in (("n", "long"), ("w", "double")) for t in ("orig", "new")]
        return counted.withColumn("__of", F.get(named, F.col("__at"))).select("__of.variable", F.explode("__of.implicates").alias("implicate"), "level", *sums)

    # the original levels stand once in every implicate
    sides = side(orig, [(v, suffixes, v) for v in variables], "orig").unionByName(
        side(new, [(v, [s], f"{v}{s}") for v in variables for s in suffixes], "new"))
    counted = sides.groupBy("variable", "implicate", "level").agg(*[F.sum(c).alias(c) for c in ("n_orig", "n_new", "w_orig", "w_new")])
    return counted.withColumn("implicate", F.regexp_extract("implicate", r"\d+", 0))


def level_shares(counts: DataFrame, by: Sequence[str] = ("variable", "implicate")) -> DataFrame:
    """Add each level's share of its variable on both sides."""
    names = ["n_orig", "n_new", "w_orig", "w_new"]
    counts = stable(counts)
    totals = counts.groupBy(*by).agg(*[F.sum(n).alias(f"__{n}") for n in names])
    out = counts.join(totals, list(by))
    return out.withColumns({
        ("p_" if n[0] == "n" else "wp_") + n[2:]: ratio(F.col(n), F.col(f"__{n}")) for n in names
    }).drop(*[f"__{n}" for n in names])


def hellinger(p: str, q: str, scaled: bool = True) -> Column:
    """Aggregate: Hellinger distance of two share columns (unscaled drops the 1/sqrt(2))."""
    d = F.sqrt(F.sum(F.pow(F.sqrt(F.col(p)) - F.sqrt(F.col(q)), F.lit(2.0))))
    return d / math.sqrt(2.0) if scaled else d


def categorical_distance(orig: DataFrame, new: DataFrame, variables: Sequence[str], weight: str | None = None,
                         suffixes: Sequence[str] | None = None) -> DataFrame:
    """Hellinger and weighted Hellinger distance per variable (and implicate); both sides are zero-filled."""
    shares = level_shares(level_counts(orig, new, variables, weight, suffixes))
    by = ["variable", "implicate"] if suffixes else ["variable"]
    return shares.groupBy(*by).agg(hellinger("p_orig", "p_new").alias("hd"),
                                   hellinger("wp_orig", "wp_new").alias("w_hd"))


def joint_distance(orig: DataFrame, new: DataFrame, columns: Sequence[str], scaled: bool = False) -> DataFrame:
    """Hellinger distance over the joint levels of several columns."""
    counts = stack_sides(orig, new, columns).groupBy(*columns).agg(count_orig().alias("n_orig"), count_new().alias("n_new"))
    totals = counts.agg(F.sum("n_orig").alias("o"), F.sum("n_new").alias("n"))
    return counts.select(
        ratio(F.col("n_orig"), totals.select("o").scalar()).alias("p"),
        ratio(F.col("n_new"), totals.select("n").scalar()).alias("q"),
    ).agg(hellinger("p", "q", scaled).alias("hd"))


def top_levels(shares: DataFrame, share: float = 0.5) -> DataFrame:
    """Largest levels of a variable on either side until they hold ``share`` of it; of equal ones the first by name.

    How many levels have which count tells at which count the share is reached, and how many levels of that count are still
    needed; only those are put in order. Both sides go through together.
    """
    sides = F.array(*[F.struct(F.lit(i).alias("__side"), F.col(f"n_{side}").alias("__count")) for i, side in enumerate(("orig", "new"))])
    by, n = ["__side", "variable"], F.col("__count")
    rows = shares.select("variable", "level", F.inline(sides))
    sizes = stable(rows.groupBy(*by, (-n).alias("__less")).agg(F.sum(n).alias("mass")))
    room = share * F.col("total_mass") - (F.col("cum_mass") - F.col("mass"))
    last = (running_sums(sizes, by, "__less", ["mass"]).withColumn("__room", room).where("__room >= 0")
            .groupBy(*by).agg(F.max(F.struct("__less", "__room")).alias("c")))
    cut = last.select(F.col("__side").alias("__s"), F.col("variable").alias("__of"), (-F.col("c.__less")).alias("__cross"), F.col("c.__room").alias("__room"))
    # a row per side and variable
    marked = rows.join(F.broadcast(cut), (F.col("__side") == F.col("__s")) & (F.col("variable") == F.col("__of")))
    tied = marked.where(n == F.col("__cross")).select(*by, "level", F.struct(F.col("level").isNull(), "level").alias("__order"), F.lit(1).alias("one"),
                                                      F.when(n > 0, F.floor(F.col("__room") / n) + 1).alias("__need"))
    first = running_sums(stable(tied), by, "__order", ["one"]).where(F.col("__need").isNull() | (F.col("cum_one") <= F.col("__need")))
    return marked.where(n > F.col("__cross")).select("variable", "level").union(first.select("variable", "level")).distinct()


def pooled_levels(shares: DataFrame, top: DataFrame) -> DataFrame:
    """Counts and shares per kept level; all other levels are added up as 'Other'."""
    marked = null_safe_join(shares, top.withColumn("__keep", F.lit(True)), ["variable", "level"], "left")
    kept = F.coalesce("__keep", F.lit(False))
    return (marked.withColumn("pooled", ~kept)
            .withColumn("level", F.when(kept, F.col("level")).otherwise("Other"))
            .groupBy("variable", "level", "pooled")
            .agg(*[F.sum(c).alias(c) for c in ("n_orig", "n_new", "p_orig", "p_new")]))


def chi_square(pooled: DataFrame, correct: bool = True) -> DataFrame:
    """Two-sample chi-square per variable on pooled level counts, with the continuity correction for
    two levels; a single level gives nulls."""
    totals = pooled.groupBy("variable").agg(
        F.sum("n_orig").alias("__o"), F.sum("n_new").alias("__n"), F.count("*").alias("levels"))
    x = pooled.join(totals, "variable")
    row = (F.col("n_orig") + F.col("n_new")).cast("double")
    grand = (F.col("__o") + F.col("__n")).cast("double")
    e_o, e_n = row * F.col("__o") / grand, row * F.col("__n") / grand
    gap = F.abs(F.col("n_orig") - e_o)
    fix = F.when((F.col("levels") == 2) & F.lit(correct), F.least(F.lit(0.5), gap)).otherwise(0.0)
    part = F.try_divide(F.pow(gap - fix, F.lit(2.0)), e_o) + F.try_divide(F.pow(gap - fix, F.lit(2.0)), e_n)
    return x.withColumn("__part", part).groupBy("variable").agg(
        F.when(F.max("levels") > 1, F.sum("__part")).alias("chi_square"),
        F.when(F.max("levels") > 1, F.max("levels") - 1).alias("df"))


def top_level_report(orig: DataFrame, new: DataFrame, variables: Sequence[str], share: float = 0.5,
                     correct: bool = True, p_values: bool = True, top: DataFrame | None = None) -> DataFrame:
    """Top levels and 'Other' with both sides' shares, Hellinger distance and chi-square per variable.

    ``top``: the top levels, where they are known already.
    """
    shares = level_shares(level_counts(orig, new, variables))
    pooled = pooled_levels(shares, top_levels(shares, share) if top is None else top)
    hd = shares.groupBy("variable").agg(hellinger("p_orig", "p_new").alias("hd"))
    test = chi_square(pooled, correct)
    if p_values:
        test = test.withColumn("p_value", chi_square_p(F.col("chi_square"), F.col("df").cast("double")))
    return pooled.drop("pooled").join(hd, "variable").join(test, "variable")


# ------------------------------------------------------------------ continuous


def continuous_summary(orig: DataFrame, new: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Per variable and statistic: the value on both sides and the difference new - original."""
    rows = long_values(stack_sides(orig, new, variables), variables, ["is_new"], "double")
    by = ["variable", "is_new"]
    stats = exact_quantiles(rows, by, "value", PERCENTILES)
    sd = rows.groupBy(*by).agg(F.stddev_samp("value").alias("sd"))
    long = stats.join(sd, by, "left").unpivot(by, SUMMARY, "statistic", "v")
    side = long.groupBy("variable", "statistic").agg(
        F.max(F.when(F.col("is_new") == 0, F.col("v"))).alias("orig"),
        F.max(F.when(F.col("is_new") == 1, F.col("v"))).alias("new"))
    return side.withColumn("diff", F.col("new") - F.col("orig"))


QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def paired_distances(df: DataFrame, variables: Sequence[str], suffixes: Sequence[str], og_suffix: str = "",
                     weight: str | None = None) -> DataFrame:
    """Distribution of |original - new| per variable and implicate; weighted statistics over rows of
    positive weight use linear interpolation of the weighted distribution function."""
    w = F.col(weight).cast("double") if weight else F.lit(None).cast("double")
    cells = F.array(*[F.struct(
        F.lit(v).alias("variable"), F.lit("".join(ch for ch in s if ch.isdigit())).alias("implicate"),
        F.abs(F.col(f"{v}{og_suffix}").cast("double") - F.col(f"{v}{s}").cast("double")).alias("dist"),
    ) for v in variables for s in suffixes])
    rows = df.select(w.alias("__w"), F.inline(cells))
    by = ["variable", "implicate"]
    positive = F.col("__w") > 0
    counts = value_counts(rows, by, "dist", {
        "n": F.count("*"), "w": F.coalesce(F.sum(F.when(positive, F.col("__w"))), F.lit(0.0))})
    run = running_sums(counts, by, "dist", ["n", "w"])
    pick = []
    for name, p in QUARTILES.items():
        h = (F.col("total_n") - 1) * F.lit(p)
        lo = F.min(F.when(F.col("cum_n") > F.floor(h), F.col("dist")))
        hi = F.min(F.when(F.col("cum_n") > F.ceil(h), F.col("dist")))
        pick.append((lo + (hi - lo) * F.max(h - F.floor(h))).alias(name))
    if weight:
        heavy = F.col("w") > 0
        pick += [F.min(F.when(heavy, F.col("dist"))).alias("w_min"),
                 F.max(F.when(heavy, F.col("dist"))).alias("w_max"),
                 ratio(F.sum(F.col("dist") * F.col("w")), F.sum("w")).alias("w_mean")]
        for name, p in QUARTILES.items():
            share = F.try_divide(F.col("cum_w"), F.col("total_w"))
            below = F.max(F.when(heavy & (share <= p), F.struct(F.col("dist").alias("x"), share.alias("s"))))
            above = F.min(F.when(heavy & (share >= p), F.struct(F.col("dist").alias("x"), share.alias("s"))))
            gap = above["s"] - below["s"]
            pick.append(F.when(below.isNull(), above["x"]).when(above.isNull() | (gap <= 0), below["x"]).otherwise(
                below["x"] + (above["x"] - below["x"]) * (F.lit(p) - below["s"]) / gap).alias(f"w_{name}"))
    stats = run.groupBy(*by).agg(
        F.min("dist").alias("min"), ratio(F.sum(F.col("dist") * F.col("n")), F.sum("n")).alias("mean"),
        F.max("dist").alias("max"), *pick)
    missing = rows.groupBy(*by).agg(
        F.count_if(F.col("dist").isNull()).alias("na_count"),
        *([F.count_if(F.col("dist").isNull() & positive).alias("w_na_count")] if weight else []))
    return missing.join(stats, by, "left")


def ks_distance(orig: DataFrame, new: DataFrame, variables: Sequence[str], p_values: bool = True) -> DataFrame:
    """Kolmogorov-Smirnov distance per variable, non-missing rows of both sides, asymptotic p-value."""
    rows = long_values(stack_sides(orig, new, variables), variables, ["is_new"], "double")
    counts = value_counts(rows, ["variable"], "value", {"c_orig": count_orig(), "c_new": count_new()})
    run = running_sums(counts, ["variable"], "value", ["c_orig", "c_new"])
    run = run.withColumnsRenamed({"total_c_orig": "n_orig", "total_c_new": "n_new"})
    gap = F.abs(ratio(F.col("cum_c_new"), F.col("n_new")) - ratio(F.col("cum_c_orig"), F.col("n_orig")))
    out = run.groupBy("variable", "n_orig", "n_new").agg(F.max(gap).alias("ks_distance"))
    if p_values:
        a, b = F.col("n_orig").cast("double"), F.col("n_new").cast("double")
        out = out.withColumn("p_value", kolmogorov_tail(F.col("ks_distance") * F.sqrt(a * b / (a + b))))
    return out


# ------------------------------------------------------------------ missing and valid


def missing_rates(orig: DataFrame, new: DataFrame, variables: Sequence[str] | None = None) -> DataFrame:
    """Missing rate and distinct non-null values of every shared column on both sides."""
    variables = variables or [c for c in orig.columns if c in new.columns]
    frames = []
    for side, df in (("orig", orig), ("new", new)):
        counted = column_counts(df, variables).select("variable", F.try_divide("n_null", "n_rows").alias(f"missing_{side}"), F.col("n_distinct").alias(f"distinct_{side}"))
        frames.append(counted)
    return frames[0].join(frames[1], "variable")


def validity(orig: DataFrame, new: DataFrame, categorical: Sequence[str], continuous: Sequence[str]) -> DataFrame:
    """Valid = no level absent from the original; continuous: new range inside the original range."""
    out = []
    if categorical:
        levels = level_counts(orig, new, categorical)
        out.append(levels.groupBy("variable").agg(
            F.lit("cat").alias("type"),
            (F.count_if((F.col("n_orig") == 0) & (F.col("n_new") > 0)) == 0).alias("valid")))
    if continuous:
        rows = long_values(stack_sides(orig, new, continuous), continuous, ["is_new"], "double")
        old = F.when(F.col("is_new") == 0, F.col("value"))
        now = F.when(F.col("is_new") == 1, F.col("value"))
        out.append(rows.groupBy("variable").agg(
            F.lit("cont").alias("type"),
            ((F.min(now) >= F.min(old)) & (F.max(now) <= F.max(old))).alias("valid")))
    return union_all(out)
