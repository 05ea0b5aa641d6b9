"""Test-negative vaccine-effectiveness study on the person-day facts."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import any_long, days_in, intervals_with
from ..functions.newton import Fits, logistic_fits
from ..functions.session import stable, stored
from ..functions.stats import critical_value

START, END, EPISODE = "combined_macrovisit_start_date", "combined_macrovisit_end_date", "combined_macrovisit_id"


@dataclass
class StudyDesign:
    """Which facts mean what, and the windows in days."""

    diagnoses: Sequence[str]
    vaccination: str
    outcome_positive: str = "INFLUENZA_POS"
    outcome_negative: str = "INFLUENZA_NEG"
    other_tests: Sequence[str] = field(default_factory=lambda: ["PCR_AG_Pos", "PCR_AG_Neg"])
    days_before_test: int = 10
    days_after_test: int = 3
    excluded_before: int = 14
    exposure_window: int = 90


def eligible_persons(summary: DataFrame) -> DataFrame:
    """Persons with a known sex and race/ethnicity."""
    return summary.where(F.upper("sex").isin("MALE", "FEMALE") & (F.lower("race_ethnicity") != "unknown"))


def long_episodes(episodes: DataFrame) -> DataFrame:
    """Distinct episodes that last at least one day."""
    return episodes.select("person_id", EPISODE, START, END).distinct().where(F.col(START) < F.col(END))


def study_days(days: DataFrame, design: StudyDesign) -> DataFrame:
    """What the steps of the study read of the fact days: days with a diagnosis, a test or a vaccination, and their columns."""
    used = list(dict.fromkeys([*design.diagnoses, design.vaccination, design.outcome_positive, design.outcome_negative, *design.other_tests]))
    cond = F.lit(False)
    for c in used:
        cond = cond | (F.col(c) == 1)
    return days.select("person_id", "date", *used).where(cond)


def episodes_with_diagnosis(episodes: DataFrame, days: DataFrame, diagnoses: Sequence[str]) -> DataFrame:
    """Episodes with a day of one of the diagnoses inside them."""
    cond = F.lit(False)
    for d in diagnoses:
        cond = cond | (F.col(d) == 1)
    ill = days.where(cond).select("person_id", "date")
    hit = intervals_with(episodes.select("person_id", EPISODE, START, END), ill, ["person_id"], "date", START, END,
                         any_long(episodes, START, END)).distinct()
    return episodes.join(hit, ["person_id", EPISODE], "left_semi")


def _window(episodes: DataFrame, first: Column, last: Column) -> DataFrame:
    """The window around each episode, from ``__from`` to ``__to``."""
    return episodes.select("person_id", EPISODE, first.alias("__from"), last.alias("__to"))


def episode_tests(episodes: DataFrame, days: DataFrame, design: StudyDesign) -> DataFrame:
    """Per episode with any test in its window: outcome test, other test, positive outcome test."""
    any_outcome = (F.col(design.outcome_positive) == 1) | (F.col(design.outcome_negative) == 1)
    any_other = F.lit(False)
    for c in design.other_tests:
        any_other = any_other | (F.col(c) == 1)
    tests = days.where(any_outcome | any_other).select(
        "person_id", "date", F.when(any_outcome, 1).otherwise(0).alias("o"), F.when(any_other, 1).otherwise(0).alias("x"),
        F.when(F.col(design.outcome_positive) == 1, 1).otherwise(0).alias("p"))
    window = _window(episodes, F.date_sub(START, design.days_before_test), F.date_add(END, design.days_after_test))
    return days_in(tests, window, ["person_id"], "date", "__from", "__to", any_long(window, "__from", "__to")).groupBy("person_id", EPISODE).agg(
        F.max("o").alias("has_influenza_test"), F.max("x").alias("has_virus_test"),
        F.max("p").alias("positive_influenza_test"))


def fully_tested(tests: DataFrame) -> DataFrame:
    return tests.where("has_influenza_test = 1 AND has_virus_test = 1")


def vaccinated_in(episodes: DataFrame, days: DataFrame, vaccination: str, first: Column, last: Column) -> DataFrame:
    """Ids of the episodes with a vaccination day in the window."""
    shots = days.where(F.col(vaccination) == 1).select("person_id", "date")
    window = _window(episodes, first, last)
    return intervals_with(window, shots, ["person_id"], "date", "__from", "__to", any_long(window, "__from", "__to")).distinct()


def drop_recently_vaccinated(episodes: DataFrame, days: DataFrame, design: StudyDesign) -> DataFrame:
    """Remove episodes with a vaccination in the days before the start or on it."""
    recent = vaccinated_in(episodes, days, design.vaccination, F.date_sub(START, design.excluded_before), F.col(START))
    return episodes.join(recent, ["person_id", EPISODE], "left_anti")


def vaccination_status(episodes: DataFrame, days: DataFrame, design: StudyDesign) -> DataFrame:
    """vaccinated = any vaccination in the exposure window that ends the day before the start."""
    hit = vaccinated_in(episodes, days, design.vaccination, F.date_sub(START, design.exposure_window), F.date_sub(START, 1))
    return episodes.join(hit.withColumn("__v", F.lit(1)), ["person_id", EPISODE], "left").withColumn(
        "vaccinated", F.coalesce("__v", F.lit(0))).drop("__v")


def analysis_table(days: DataFrame, summary: DataFrame, episodes: DataFrame, design: StudyDesign) -> DataFrame:
    """One row per included episode: dates, outcome, exposure and covariates.

    Each step reads its episodes several times, so they are stored before it.
    """
    persons = eligible_persons(summary).select("person_id", "age", "sex", "race_ethnicity")
    longer = stored(long_episodes(episodes).join(persons.select("person_id"), "person_id", "left_semi"))
    ill = stored(episodes_with_diagnosis(longer, days, design.diagnoses))
    tested = stored(ill.join(fully_tested(episode_tests(ill, days, design)), ["person_id", EPISODE]))
    kept = stored(drop_recently_vaccinated(tested, days, design))
    return (vaccination_status(kept, days, design).join(persons, "person_id", "left")
            .select("person_id", EPISODE, START, END, "positive_influenza_test", "vaccinated", "age", "sex",
                    "race_ethnicity"))


def two_by_two(analysis: DataFrame) -> DataFrame:
    """Included persons and episodes and the exposure by outcome counts."""
    case, shot = F.col("positive_influenza_test") == 1, F.col("vaccinated") == 1
    return analysis.agg(
        F.count_distinct("person_id").alias("included_patients"),
        F.count("*").alias("included_hospitalizations"),
        F.count_if(case & shot).alias("vaccinated_cases"),
        F.count_if(~case & shot).alias("vaccinated_controls"),
        F.count_if(case & ~shot).alias("unvaccinated_cases"),
        F.count_if(~case & ~shot).alias("unvaccinated_controls"),
    )


ESTIMATES = "statistic string, point_estimate double, standard_error double, ci_lower double, ci_upper double"


def unadjusted_estimates(analysis: DataFrame, level: float = 0.95) -> DataFrame:
    """Odds ratio and effectiveness from the 2x2 counts, with Wald limits."""
    z = critical_value(level)
    a, b, c, d = (F.col(x).cast("double") for x in (
        "vaccinated_cases", "vaccinated_controls", "unvaccinated_cases", "unvaccinated_controls"))
    one = F.lit(1.0)
    log_or = F.ln(F.try_divide(a * d, b * c))
    se = F.sqrt(F.try_divide(one, a) + F.try_divide(one, b) + F.try_divide(one, c) + F.try_divide(one, d))
    base = two_by_two(analysis).select(log_or.alias("b"), se.alias("s")).select(
        F.exp("b").alias("orr"), (F.exp("b") * F.col("s")).alias("or_se"),
        F.exp(F.col("b") - z * F.col("s")).alias("lo"), F.exp(F.col("b") + z * F.col("s")).alias("hi"))
    return base.select(F.inline(F.array(
        F.struct(F.lit("Unadjusted Odds Ratio").alias("statistic"), F.col("orr").alias("point_estimate"),
                 F.col("or_se").alias("standard_error"), F.col("lo").alias("ci_lower"), F.col("hi").alias("ci_upper")),
        F.struct(F.lit("Unadjusted Effectiveness").alias("statistic"), (100 * (1 - F.col("orr"))).alias("point_estimate"),
                 (100 * F.col("or_se")).alias("standard_error"), (100 * (1 - F.col("hi"))).alias("ci_lower"),
                 (100 * (1 - F.col("lo"))).alias("ci_upper")))))


def _cells(analysis: DataFrame, covariates: Sequence[str]) -> DataFrame:
    """Rows that are equal in the predictors collapse to one with the share of cases."""
    cols = ["vaccinated", *covariates]
    rows = analysis.where(F.col("positive_influenza_test").isNotNull())
    for c in cols:
        rows = rows.where(F.col(c).isNotNull())
    return stable(rows.groupBy(*cols).agg(F.count("*").alias("__n"), F.sum("positive_influenza_test").alias("__h")))


def fit_logistic(cells: DataFrame, covariates: Sequence[str], exposure: str = "vaccinated", fixed: Sequence[float] | None = None) -> Fits:
    """Logistic regression on collapsed rows; with ``fixed`` one fit for each effect at which the exposure is held."""
    if fixed is None:
        return logistic_fits(cells, [exposure, *covariates], [F.col("__n")], [F.col("__h")])
    return logistic_fits(cells, covariates, [F.col("__n")], [F.col("__h")], F.col(exposure), fixed)


def _profile_limit(cells, covariates, beta, se, deviance, cut, sign, points=12, rounds=6):
    """Where the profile deviance of the exposure exceeds the best one by ``cut``; None if that isn't found.

    Each round fits several values at once and keeps the gap between those that lie inside and outside.
    """
    inside, outside = beta, None
    for reach in (1, 6, 36):
        tried = beta + sign * reach * 4.0 * se * np.arange(1, points + 1) / points
        over = fit_logistic(cells, covariates, fixed=tried.tolist()).deviance - deviance > cut
        if over.any():
            first = int(np.argmax(over))
            inside, outside = (tried[first - 1] if first else inside), tried[first]
            break
        inside = tried[-1]
    if outside is None:
        return None
    for _ in range(rounds):
        tried = np.linspace(inside, outside, points + 2)[1:-1]
        over = fit_logistic(cells, covariates, fixed=tried.tolist()).deviance - deviance > cut
        edges = np.concatenate([[inside], tried, [outside]])
        first = int(np.argmax(over)) if over.any() else points
        inside, outside = edges[first], edges[first + 1]
        if abs(outside - inside) < 1e-6:
            break
    return (inside + outside) / 2


def adjusted_estimates(analysis: DataFrame, covariates: Sequence[str] = ("age", "sex", "race_ethnicity"),
                       level: float = 0.95, profile: bool = False) -> DataFrame:
    """Adjusted odds ratio and vaccine effectiveness; ``profile=True`` gives profile-likelihood limits.

    Without a complete row the figures are null; a limit that the data don't bound is null too.
    """
    def exp(x):
        return None if x is None or x > 700 else math.exp(x)

    def effect(x):
        return None if x is None else 100 * (1 - x)

    cells = _cells(analysis, covariates)
    rows = [("Adjusted Odds Ratio", None, None, None, None), ("Vaccine Effectiveness", None, None, None, None)]
    if not cells.isEmpty():
        fits = fit_logistic(cells, covariates)
        at = fits.names.index("vaccinated")
        beta, se = float(fits.beta[0, at]), float(fits.se[0, at])
        z = critical_value(level)
        if profile:
            lo, hi = (_profile_limit(cells, covariates, beta, se, fits.deviance[0], z * z, s) for s in (-1, 1))
        else:
            lo, hi = beta - z * se, beta + z * se
        odds, lo, hi = exp(beta), exp(lo), exp(hi)
        error = None if odds is None else odds * se
        rows = [("Adjusted Odds Ratio", odds, error, lo, hi),
                ("Vaccine Effectiveness", effect(odds), None if error is None else 100 * error, effect(hi), effect(lo))]
    return analysis.sparkSession.createDataFrame(rows, ESTIMATES)


def study_estimates(analysis: DataFrame, level: float = 0.95, profile: bool = False) -> DataFrame:
    """Unadjusted and adjusted estimates in one table."""
    return unadjusted_estimates(analysis, level).unionByName(adjusted_estimates(analysis, level=level, profile=profile))


def compare_studies(orig: DataFrame, new: DataFrame, **kw) -> DataFrame:
    """The study on both data sets; an empty new side gives the original rows with null figures."""
    first = study_estimates(orig, **kw)
    if new.isEmpty():
        names = first.columns[0]
        second = first.select(names, *[F.lit(None).cast(t).alias(c) for c, t in first.dtypes if c != names])
    else:
        second = study_estimates(new, **kw)
    return first.withColumn("dataset", F.lit("Original")).unionByName(second.withColumn("dataset", F.lit("Synthetic")))
