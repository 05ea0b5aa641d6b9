"""Model-based comparisons: propensity U statistic and regression coefficients."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import stack_sides
from ..functions.newton import fitted, logistic_fits
from ..functions.session import stable
from ..functions.stats import chi_square_tail, critical_value, normal_two_sided

U_SCHEMA = ("n long, n_new long, n_coefficients int, u double, u_half double, null_mean double, null_se double, "
            "p_value double")


def propensity_u(orig: DataFrame, new: DataFrame, variables: Sequence[str]) -> DataFrame:
    """U statistic of a logistic model for membership in the new data.

    ``u`` is the mean squared distance of the fitted probabilities from the new side's share c,
    ``u_half`` from one half. Under equal distributions u * n / ((1-c)^2 c) is chi-square with
    (coefficients - 1) degrees of freedom. Equal rows collapse to one weighted row before fitting.
    """
    if not variables:
        raise ValueError("at least one variable is needed")
    cells = stack_sides(orig, new, variables)
    for v in variables:
        cells = cells.where(F.col(v).isNotNull())
    cells = stable(cells.groupBy(*variables).agg(F.count("*").alias("__w"), F.sum("is_new").alias("__h")))
    size = cells.agg(F.sum("__w").alias("n"), F.sum("__h").alias("m")).first()
    n, m = size["n"], size["m"]
    if not n:
        return orig.sparkSession.createDataFrame([(0, 0, None, None, None, None, None, None)], U_SCHEMA)
    fits = logistic_fits(cells, variables, [F.col("__w")], [F.col("__h")])
    k, c = len(fits.names), m / n
    sq = fitted(fits).agg(F.sum(F.col("size") * F.pow(F.col("p") - F.lit(c), F.lit(2.0))).alias("u"),
                          F.sum(F.col("size") * F.pow(F.col("p") - 0.5, F.lit(2.0))).alias("h")).first()
    unit = (1 - c) ** 2 * c / n
    u = sq["u"] / n
    row = (int(n), int(m), k, u, sq["h"] / n, (k - 1) * unit, (2 * (k - 1)) ** 0.5 * unit, chi_square_tail(u / unit, k - 1))
    return orig.sparkSession.createDataFrame([row], U_SCHEMA)


#: Sums of one aggregation; more take further passes.
SUMS_PER_PASS = 400
COEF_SCHEMA = "outcome string, predictor string, estimate double, se double, p_value double, ci_lower double, ci_upper double"


def _ols(df: DataFrame, outcome: str, predictors: Sequence[str], weights: Sequence[str]):
    """Coefficients for every weight column from one aggregation of cross products."""
    cols = [F.lit(1.0), *[F.col(p).cast("double") for p in predictors], F.col(outcome).cast("double")]
    d = len(cols)
    complete = df
    for c in [outcome, *predictors]:
        complete = complete.where(F.col(c).isNotNull())
    cells = [(w, i, j) for w in weights for i in range(d) for j in range(i, d)]
    sums, n = {}, 0
    for start in range(0, len(cells), SUMS_PER_PASS):
        part = cells[start:start + SUMS_PER_PASS]
        row = complete.agg(*[F.sum(F.col(w).cast("double") * cols[i] * cols[j]).alias(f"s{k}") for k, (w, i, j) in enumerate(part)], F.count("*").alias("n")).first()
        sums |= {cell: row[f"s{k}"] for k, cell in enumerate(part)}
        n = row["n"]
    out = {}
    for w in weights:
        m = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                m[i, j] = m[j, i] = sums[w, i, j]
        out[w] = (np.linalg.solve(m[:-1, :-1], m[:-1, -1]), m)
    return out, n


def regression_coefficients(df: DataFrame, outcome: str, predictors: Sequence[str], weight: str,
                            replicates: Sequence[str] = (), scale: float | None = None, level: float = 0.95,
                            suffix: str = "") -> DataFrame:
    """Weighted least squares, or logistic regression when the outcome has two values.

    With replicate weights the standard errors come from the replicates; without, from the model.
    """
    spark = df.sparkSession
    names = [f"{c}{suffix}" if f"{c}{suffix}" in df.columns else c for c in (outcome, *predictors)]
    data = df.select(F.col(names[0]).alias(outcome), *[F.col(n).alias(p) for n, p in zip(names[1:], predictors)],
                     weight, *replicates)
    values = [r[0] for r in data.where(F.col(outcome).isNotNull()).select(outcome).distinct().limit(3).collect()]
    z = critical_value(level)
    scale = (4.0 / len(replicates) if replicates else None) if scale is None else scale
    labels = ["(Intercept)", *predictors]
    if len(values) == 2:
        for c in [outcome, *predictors]:
            data = data.where(F.col(c).isNotNull())
        hit = (F.col(outcome) == F.lit(max(values))).cast("double")
        ws = [weight, *replicates]
        sums = [F.sum(F.col(w).cast("double")).alias(f"__s{i}") for i, w in enumerate(ws)]
        hits = [F.sum(F.col(w).cast("double") * hit).alias(f"__h{i}") for i, w in enumerate(ws)]
        cells = stable(data.groupBy(*predictors).agg(*sums, *hits, F.count("*").alias("__n")))
        total = cells.agg(*[F.sum(f"__s{i}").alias(f"s{i}") for i in range(len(ws))], F.sum("__n").alias("n")).first()
        # weights are scaled to add up to the number of rows; all weights are fitted together
        scales = [total["n"] / total[f"s{i}"] for i in range(len(ws))]
        fits = logistic_fits(cells, predictors, [F.col(f"__s{i}") * x for i, x in enumerate(scales)], [F.col(f"__h{i}") * x for i, x in enumerate(scales)])
        labels, beta = fits.names, fits.beta[0]
        se = np.sqrt(scale * ((fits.beta[1:] - beta) ** 2).sum(axis=0)) if replicates else fits.se[0]
    else:
        fits, n = _ols(data, outcome, predictors, [weight, *replicates])
        beta, m = fits[weight]
        if replicates:
            se = np.sqrt(scale * sum((fits[r][0] - beta) ** 2 for r in replicates))
        else:
            rss = m[-1, -1] - 2 * beta @ m[:-1, -1] + beta @ m[:-1, :-1] @ beta
            se = np.sqrt(np.diag(np.linalg.inv(m[:-1, :-1])) * rss / max(n - len(beta), 1))
    rows = [(outcome, name, float(b), float(s), normal_two_sided(b / s) if s > 0 else None, float(b - z * s), float(b + z * s))
            for name, b, s in zip(labels, beta, se)]
    return spark.createDataFrame(rows, COEF_SCHEMA)


def compare_regressions(orig: DataFrame, new: DataFrame, models: Sequence[tuple[str, Sequence[str]]], weight: str,
                        replicates: Sequence[str] = (), suffix: str = "", alpha: float = 0.05) -> DataFrame:
    """Same models on both sides: coefficients, interval overlap and whether significance agrees."""
    from .intervals import interval_overlap

    out = None
    for outcome, predictors in models:
        a = regression_coefficients(orig, outcome, predictors, weight, replicates).select(
            "outcome", "predictor", *[F.col(c).alias(f"orig_{c}") for c in ("estimate", "se", "p_value", "ci_lower", "ci_upper")])
        b = regression_coefficients(new, outcome, predictors, weight, replicates, suffix=suffix).select(
            "outcome", "predictor", *[F.col(c).alias(f"new_{c}") for c in ("estimate", "se", "p_value", "ci_lower", "ci_upper")])
        part = a.join(b, ["outcome", "predictor"]).where(F.col("predictor") != "(Intercept)")
        out = part if out is None else out.unionByName(part)
    c = F.col
    sig_o, sig_n = c("orig_p_value") < alpha, c("new_p_value") < alpha
    return out.withColumn("overlap", interval_overlap(c("orig_ci_lower"), c("orig_ci_upper"), c("new_ci_lower"), c("new_ci_upper"))) \
        .withColumn("orig_significant", sig_o.cast("int")).withColumn("new_significant", sig_n.cast("int"))


def significance_agreement(compared: DataFrame) -> DataFrame:
    """Two-by-two count of significance on both sides."""
    return compared.groupBy("orig_significant", "new_significant").agg(F.count("*").alias("n"))
