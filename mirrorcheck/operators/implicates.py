"""Measures for perturbed data with several implicates of each variable (``v`` and ``v_1 .. v_5``)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import count_new, count_orig, hash_uniform, ratio, require_columns, stack_sides, union_all
from ..functions.session import stable
from .crosstabs import SEPARATOR, high_utility_crosstabs, with_totals


def _number(suffix: str) -> str:
    return "".join(c for c in suffix if c.isdigit())


def _changed(variable: str, suffix: str, og_suffix: str) -> Column:
    """Null against a value counts as changed, null against null does not."""
    return (~F.col(f"{variable}{suffix}").eqNullSafe(F.col(f"{variable}{og_suffix}"))).cast("int")


def records_changed(df: DataFrame, variables: Sequence[str], suffixes: Sequence[str], og_suffix: str = "") -> DataFrame:
    """Percent of changed records per variable and implicate, from one pass."""
    require_columns(df, [f"{v}{s}" for v in variables for s in [og_suffix, *suffixes]])
    wide = df.agg(*[F.avg(_changed(v, s, og_suffix)).alias(f"{v}{s}__c") for v in variables for s in suffixes])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(v).alias("variable"), F.lit(_number(s)).alias("implicate"),
                 (100 * F.col(f"{v}{s}__c")).alias("pct_changed")) for v in variables for s in suffixes])))


def records_changed_summary(df: DataFrame, variables: Sequence[str], suffixes: Sequence[str], og_suffix: str = "") -> DataFrame:
    """Implicates side by side with their mean and standard deviation."""
    long = records_changed(df, variables, suffixes, og_suffix)
    numbers = [_number(s) for s in suffixes]
    wide = long.groupBy("variable").agg(
        *[F.max(F.when(F.col("implicate") == n, F.col("pct_changed"))).alias(f"pct_changes_{n}") for n in numbers],
        F.avg("pct_changed").alias("mean_pct_changes"), F.stddev_samp("pct_changed").alias("sd_pct_changes"))
    return wide


def change_flags_by_tier(df: DataFrame, variables: Sequence[str], tier: str, suffixes: Sequence[str],
                         og_suffix: str = "") -> DataFrame:
    """Rows by tier and change flag for every variable and implicate."""
    cells = F.array(*[F.struct(F.lit(v).alias("variable"), F.lit(_number(s)).alias("implicate"),
                               _changed(v, s, og_suffix).alias("change_flag")) for v in variables for s in suffixes])
    return (df.select(F.col(tier).alias("tier"), F.inline(cells))
            .groupBy("variable", "implicate", "tier", "change_flag").agg(F.count("*").alias("n")))


def _new_side(new: DataFrame, variables: Sequence[str], suffix: str) -> DataFrame:
    return new.select(*[F.col(f"{v}{suffix}" if f"{v}{suffix}" in new.columns else v).alias(v) for v in variables])


def new_patterns(orig: DataFrame, new: DataFrame, variables: Sequence[str], suffix: str = "") -> DataFrame:
    """Value combinations that occur in the new data but not in the original, with counts."""
    both = stack_sides(orig, _new_side(new, variables, suffix), variables)
    return (both.groupBy(*variables).agg(count_orig().alias("__o"), count_new().alias("n_new"))
            .where((F.col("__o") == 0) & (F.col("n_new") > 0)).drop("__o"))


def missing_skip_patterns(orig: DataFrame, new: DataFrame, variable_lists: Sequence[Sequence[str]],
                          suffixes: Sequence[str]) -> DataFrame:
    """New patterns of several variable lists and implicates in one table; values as one text."""
    out = []
    for s in suffixes:
        for vs in variable_lists:
            found = new_patterns(orig, new, vs, s)
            text = F.concat_ws("|", *[F.coalesce(F.col(v).cast("string"), F.lit("<null>")) for v in vs])
            out.append(found.select(F.lit(_number(s)).alias("implicate"), F.lit(" ".join(vs)).alias("variables"),
                                    text.alias("pattern"), "n_new"))
    return union_all(out)


#: Sampled records up to this many go to all tasks.
MOST_SENT = 10_000


def conjunctions(orig: DataFrame, new: DataFrame, key: str, widths: Mapping[str, float], n_records: int = 100,
                 new_suffix: str = "", seed: int = 1234) -> DataFrame:
    """Higher-order conjunction of a fixed sample of original records.

    For every sampled record: share of rows on each side that equal it on the variables of width 0
    and lie within the width on the others. A sample of at most ``MOST_SENT`` records is sent to the
    data, a larger one is joined by a shuffle. Without a variable of width 0, rows and records meet by bins
    of the first width.
    """
    names = list(widths)
    sample = (orig.select(key, *names).withColumn("__u", hash_uniform(seed, key)).orderBy("__u", key).limit(n_records)
              .select(F.col(key).alias("sample_id"), *[F.col(v).alias(f"__s_{v}") for v in names]))
    both = stack_sides(orig, _new_side(new, names, new_suffix), names)
    cond = F.lit(True)
    asked = sample
    if not any(width == 0 for width in widths.values()):
        v = names[0]
        bin_of = lambda c: F.floor(c / F.lit(float(widths[v])))
        asked = sample.withColumn("__bin", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: bin_of(F.col(f"__s_{v}")) + k)))
        cond = bin_of(F.col(v)) == F.col("__bin")
    for v, width in widths.items():
        here, there = F.col(v), F.col(f"__s_{v}")
        cond = cond & ((here == there) if width == 0 else here.between(there - width, there + width))
    hits = both.join(F.broadcast(asked) if n_records <= MOST_SENT else asked, cond).groupBy("sample_id").agg(count_orig().alias("o"), count_new().alias("n"))
    n_o, n_n = orig.agg(F.count("*")).scalar(), new.agg(F.count("*")).scalar()
    return (sample.select("sample_id").join(hits, "sample_id", "left")
            .select("sample_id", ratio(F.coalesce("o", F.lit(0)), n_o).alias("similarity_orig"),
                    ratio(F.coalesce("n", F.lit(0)), n_n).alias("similarity_new"))
            .withColumn("score", F.abs(F.col("similarity_orig") - F.col("similarity_new"))))


def conjunction_summary(scores: DataFrame) -> DataFrame:
    """Summary of the scores (one row per sampled record)."""
    return scores.agg(F.count("*").alias("n_records"), F.min("score").alias("min"), F.percentile("score", 0.5).alias("median"),
                      F.avg("score").alias("mean"), F.max("score").alias("max"))


def crosstab_differences(orig: DataFrame, new: DataFrame, variables: Sequence[str], weight: str, new_suffix: str = "", dims: Sequence[int] = (2, 3)) -> DataFrame:
    """Per dimension the mean relative difference of the weighted cell shares, over cells that the original has."""
    cells = with_totals(high_utility_crosstabs(orig, new, variables, weight, new_suffix, dims), "w_orig", "w_new")
    p, q = ratio(F.col("w_orig"), F.col("__o")), ratio(F.col("w_new"), F.col("__n"))
    dimension = (F.size(F.split("crosstab", SEPARATOR))).alias("dimension")
    return cells.where("w_orig > 0").groupBy(dimension).agg(F.avg(F.abs(ratio(q - p, p))).alias("rel_diff"))


def agreement_rate(compared: DataFrame) -> DataFrame:
    """Per outcome the share of coefficients that are significant on both sides or on none."""
    return compared.groupBy("outcome").agg(F.avg((F.col("orig_significant") == F.col("new_significant")).cast("double")).alias("agreement"))


def implicate_rollup(measures: Mapping[str, tuple[DataFrame, Sequence[str], str]], n_implicates: int) -> DataFrame:
    """Mean and standard deviation across implicates of many measures in one table.

    ``measures`` maps a measure name to (frame with an ``implicate`` column, key columns, value column).
    The text of a key that does not have every implicate is listed with its own count; if a whole
    measure has the wrong number of implicates, that is an error.
    """
    rows = []
    for name, (df, keys, value) in measures.items():
        label = F.concat_ws(" | ", *[F.coalesce(F.col(k).cast("string"), F.lit("<null>")) for k in keys]) if keys else F.lit("all")
        rows.append(df.select(F.lit(name).alias("measure"), label.alias("item"), "implicate", F.col(value).cast("double").alias("v")))
    long = stable(union_all(rows))  # read twice, by the check and by the result
    seen = {r["measure"]: r["n"] for r in long.groupBy("measure").agg(F.count_distinct("implicate").alias("n")).collect()}
    wrong = [m for m in measures if seen.get(m, 0) != n_implicates]
    if wrong:
        raise ValueError(f"wrong number of implicates for: {', '.join(wrong)}")
    return long.groupBy("measure", "item").agg(
        F.count_distinct("implicate").alias("n_implicates"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"))


# ------------------------------------------------------------------ derived variables


def banded(value: Column, limits: Sequence[tuple[float, int]], other: int = 0) -> Column:
    """Code of the first limit that the value does not exceed; null stays null."""
    expr = F.when(value.isNull(), F.lit(None).cast("int"))
    for limit, code in limits:
        expr = expr.when(value <= limit, code)
    return expr.otherwise(other)


def spells(columns: Sequence[str], code) -> Column:
    """How many of the columns hold the code; null when one of them is missing."""
    out = F.lit(0)
    for c in columns:
        out = out + (F.col(c) == code).cast("int")
    return out


def wave_changes(columns: Sequence[str]) -> Column:
    """Number of changes between consecutive waves; null when one is missing."""
    out = F.lit(0)
    for a, b in zip(columns, columns[1:]):
        out = out + (F.col(a) != F.col(b)).cast("int")
    return out


def in_field(code: Column, reason: Column | None = None) -> Column:
    """1 for codes 1 and 2, 2 for code 3, else 0; with a reason, code 3 gives 2 for 'N' and 3 for 'Y'."""
    base = F.when(code.cast("string").isin("1", "2"), 1)
    three = code.cast("string") == "3"
    if reason is None:
        return base.when(three, 2).otherwise(0)
    return base.when(three & (reason == "N"), 2).when(three & (reason == "Y"), 3).otherwise(0)


def sentinel_to_null(df: DataFrame, columns: Sequence[str], sentinel=9999998) -> DataFrame:
    """Replace the missing-value code by null in the columns and in all their implicates."""
    hit = [c for c in df.columns if any(c == v or c.startswith(f"{v}_") for v in columns)]
    return df.withColumns({c: F.when(F.col(c) != sentinel, F.col(c)) for c in hit})
