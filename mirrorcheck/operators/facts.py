"""Person-day facts, measurements, deaths and the person summary."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .concepts import label_by_set, newest_members, resolve_sets, with_codes
from .episodes import attach_episode

# Accepted ranges of adult body measurements, and the obesity limit.
BMI_RANGE = (10, 100)
WEIGHT_RANGE = (5, 300)      # kg
HEIGHT_RANGE = (0.6, 2.43)   # m
OBESITY_FROM = 30
# Fixed value: a result concept that means negative for one influenza test.
EXTRA_NEGATIVE_RESULT = 1261264

MEASUREMENT_SETS = {
    "bmi": "bmi", "height": "height", "weight": "weight", "influenza": "influenza test", "virus": "virus test",
    "antibody": "antibody test", "positive": "result positive", "negative": "result negative",
}
TEST_OF = {"INFLUENZA_POS": "influenza", "INFLUENZA_NEG": "influenza", "PCR_AG_Pos": "virus", "PCR_AG_Neg": "virus",
           "Antibody_Pos": "antibody", "Antibody_Neg": "antibody"}
LAB_FLAGS = ["INFLUENZA_POS", "INFLUENZA_NEG", "PCR_AG_Pos", "PCR_AG_Neg", "Antibody_Pos", "Antibody_Neg"]


def _of_persons(rows: DataFrame, persons: DataFrame) -> DataFrame:
    """The rows of the persons, left lying by person, so that groupings by person and day and their union need no other shuffle."""
    return rows.join(persons.select("person_id").distinct().hint("shuffle_hash"), "person_id", "left_semi")


def domain_facts(events: DataFrame, persons: DataFrame, concepts: DataFrame, id_col: str, date_col: str,
                 indicators: Sequence[str]) -> DataFrame:
    """Person-day 0/1 indicators of one event table, for cohort persons and dated events."""
    dated = events.where(F.col(date_col).isNotNull()).select(
        "person_id", F.col(date_col).cast("date").alias("date"), F.col(id_col).cast("long").alias("concept_id"))
    wanted = concepts.where(F.col("indicator_prefix").isin(list(indicators)))
    flagged = with_codes(dated, wanted, "concept_id").select("person_id", "date", *[
        F.when(F.col("indicator_prefix") == i, 1).otherwise(0).cast("byte").alias(i) for i in indicators])
    return (_of_persons(flagged, persons)
            .groupBy("person_id", "date").agg(*[F.max(i).cast("int").alias(i) for i in indicators]))


def measurement_facts(measurement: DataFrame, members: DataFrame, persons: DataFrame,
                      sets: Mapping[str, str] | None = None, swapped_influenza: bool = False,
                      indicators: Sequence[str] | None = None) -> DataFrame:
    """Person-day BMI, obesity and test-result flags in one grouping.

    ``swapped_influenza`` exchanges the positive and negative influenza results, as the published
    tables have them. With ``indicators`` (some of ``LAB_FLAGS``) only these columns and the days on which one of them is 1.
    """
    s = dict(MEASUREMENT_SETS, **(sets or {}))
    rows = measurement.where(F.col("measurement_date").isNotNull()).select(
        "person_id", F.col("measurement_date").cast("date").alias("date"), "measurement_concept_id",
        "value_as_number", "value_as_concept_id")
    if indicators is not None:  # left out before any join
        kinds = sorted({s[TEST_OF[i]] for i in indicators})
        tests = newest_members(members).where(F.col("concept_set_name").isin(kinds)).select(F.col("concept_id").alias("measurement_concept_id"))
        rows = with_codes(rows, tests, "measurement_concept_id")
    rows = label_by_set(rows, members, "measurement_concept_id", "kinds",
                        [s[k] for k in ("bmi", "height", "weight", "influenza", "virus", "antibody")])
    rows = label_by_set(rows, members, "value_as_concept_id", "results", [s["positive"], s["negative"]])

    def is_kind(k):
        return F.array_contains("kinds", s[k])

    positive = F.array_contains("results", s["positive"])
    negative = F.array_contains("results", s["negative"]) | F.coalesce(
        F.col("value_as_concept_id") == EXTRA_NEGATIVE_RESULT, F.lit(False))
    flu_pos, flu_neg = (negative, positive) if swapped_influenza else (positive, negative)

    v = F.col("value_as_number")
    flags = {
        "INFLUENZA_POS": is_kind("influenza") & flu_pos, "INFLUENZA_NEG": is_kind("influenza") & flu_neg,
        "PCR_AG_Pos": is_kind("virus") & positive, "PCR_AG_Neg": is_kind("virus") & negative,
        "Antibody_Pos": is_kind("antibody") & positive, "Antibody_Neg": is_kind("antibody") & negative,
    }
    values = {"recorded": is_kind("bmi") & v.between(*BMI_RANGE), "height": is_kind("height") & v.between(*HEIGHT_RANGE),
              "weight": is_kind("weight") & v.between(*WEIGHT_RANGE)}

    # a row is shuffled as what it says in one number and its value, not as concepts
    def bits(of):
        return sum((F.when(cond, 1 << i).otherwise(0) for i, cond in enumerate(of.values())), F.lit(0)).cast("short")

    if indicators is not None:
        flags = {i: flags[i] for i in indicators}
        rows = _of_persons(rows.select("person_id", "date", bits(flags).alias("__flags")).where("__flags <> 0"), persons)
        return rows.groupBy("person_id", "date").agg(*[F.max(F.when(F.col("__flags").bitwiseAND(1 << i) != 0, 1).otherwise(0)).alias(c) for i, c in enumerate(flags)])

    rows = _of_persons(rows.select("person_id", "date", bits(flags).alias("__flags"), bits(values).alias("__kinds"), v.alias("__v")), persons)

    def has(c, i):
        return F.col(c).bitwiseAND(1 << i) != 0

    day = rows.groupBy("person_id", "date").agg(
        *[F.max(F.when(has("__flags", i), 1).otherwise(0)).alias(c) for i, c in enumerate(flags)],
        *[F.max(F.when(has("__kinds", i), F.col("__v"))).alias(c) for i, c in enumerate(values)])
    bmi = F.coalesce("recorded", F.try_divide(F.col("weight"), F.col("height") * F.col("height")))
    return (day.withColumn("HAS_INFLUENZA_TEST_RESULT", F.greatest("INFLUENZA_POS", "INFLUENZA_NEG"))
            .withColumn("bmi", bmi)
            .withColumn("BMI_rounded", F.when(F.col("bmi").between(*BMI_RANGE), F.round("bmi")))
            .withColumn("OBESITY", F.when(F.col("BMI_rounded").isNotNull(),
                                          F.when(F.col("BMI_rounded") >= OBESITY_FROM, 1).otherwise(0)))
            .select("person_id", "date", "INFLUENZA_POS", "INFLUENZA_NEG", "HAS_INFLUENZA_TEST_RESULT",
                    "PCR_AG_Pos", "PCR_AG_Neg", "Antibody_Pos", "Antibody_Neg", "BMI_rounded", "OBESITY"))


def patient_deaths(death: DataFrame, members: DataFrame, persons: DataFrame, visits: DataFrame, floor: str,
                   deceased: str = "deceased", hospice: str = "hospice", late_days: int = 730) -> DataFrame:
    """Persons known to have died, with the best date or none.

    The earliest plausible death-table date wins; else the latest plausible date of a visit that
    ended in death. Undated deaths and hospice discharges are kept without a date. All sources go
    through one grouping by person. Persons without the column ``data_extraction_date`` (the
    synthetic form) have dates with a floor only.
    """
    limited = "data_extraction_date" in persons.columns
    extraction = F.col("data_extraction_date").cast("date") if limited else F.lit(None).cast("date")
    who = persons.select("person_id", extraction.alias("data_extraction_date")).distinct()
    kinds = newest_members(members).where(F.col("concept_set_name").isin(deceased, hospice)).select(
        F.col("concept_id").alias("discharge_to_concept_id"), (F.col("concept_set_name") == deceased).alias("is_deceased"))
    from_table = death.select("person_id", F.col("death_date").cast("date").alias("death_date"),
                              F.lit(None).cast("date").alias("vs"), F.lit(None).cast("date").alias("ve"))
    from_visits = with_codes(visits, kinds, "discharge_to_concept_id").select(
        "person_id", F.lit(None).cast("date").alias("death_date"),
        F.when(F.col("is_deceased"), F.col("visit_start_date").cast("date")).alias("vs"),
        F.when(F.col("is_deceased"), F.col("visit_end_date").cast("date")).alias("ve"))
    low = F.lit(floor).cast("date")
    limit = F.col("data_extraction_date")

    def plausible(c):
        return (F.col(c) >= low) & (F.col(c) < F.date_add(limit, late_days)) if limited else F.col(c) >= low

    visit_date = F.when(plausible("ve"), F.col("ve")).when(plausible("vs"), F.col("vs"))
    table_date = F.when((F.col("death_date") >= low) & (F.col("death_date") < limit) if limited else F.col("death_date") >= low, F.col("death_date"))
    return (from_table.unionByName(from_visits).join(who, "person_id")
            .groupBy("person_id", "data_extraction_date")
            .agg(F.coalesce(F.min(table_date), F.max(visit_date)).alias("date"))
            .withColumn("patient_death", F.lit(1))
            .select("person_id", "date", *["data_extraction_date"] * limited, "patient_death"))


def fact_days(visits: DataFrame, facts: Sequence[DataFrame], deaths: DataFrame, floor: str,
              unfilled: Sequence[str] = ("BMI_rounded",), late_days: int = 730) -> DataFrame:
    """One row per person and day over all sources: indicators are zero-filled and maximised.

    Sources are put below each other and grouped once, without a shuffle where each lies by person; a chain of outer
    joins on the shared columns followed by the same maximum gives the same rows at one more shuffle per source.
    """
    usable = F.col("date") >= F.lit(floor).cast("date")
    if "data_extraction_date" in deaths.columns:
        usable &= F.col("date") < F.date_add(F.col("data_extraction_date"), late_days)
    dated = deaths.where(usable).select("person_id", "date", F.col("patient_death").alias("patient_death_at_visit"))
    # facts lie by person (``_of_persons``); with visits and deaths dealt alike, the rows are grouped where they are
    rows = visits.select("person_id", F.col("visit_start_date").cast("date").alias("date")).repartition("person_id")
    for f in [*facts, dated.repartition("person_id")]:
        rows = rows.unionByName(f, allowMissingColumns=True)
    values = [c for c in rows.columns if c not in ("person_id", "date")]
    return rows.groupBy("person_id", "date").agg(*[
        (F.max(c) if c in unfilled else F.coalesce(F.max(c), F.lit(0))).alias(c) for c in values])


def fact_day_table(visits: DataFrame, facts: Sequence[DataFrame], deaths: DataFrame, episodes: DataFrame,
                   floor: str) -> DataFrame:
    """Fact days with the episode that covers each day."""
    return attach_episode(fact_days(visits, facts, deaths, floor), episodes)


def person_summary(days: DataFrame, cohort: DataFrame, deaths: DataFrame, diagnosis: str | None = None,
                   unfilled: Sequence[str] = ("age",)) -> DataFrame:
    """One row per cohort person: the maximum of every indicator, case flags and the death flag."""
    skip = {"person_id", "date", "BMI_rounded", "patient_death_at_visit", "combined_macrovisit_id",
            "combined_macrovisit_start_date", "combined_macrovisit_end_date"}
    indicators = [c for c in days.columns if c not in skip]
    per_person = days.groupBy("person_id").agg(
        F.max("BMI_rounded").alias("BMI_max_observed_or_calculated"),
        *[F.max(c).alias(f"{c}_indicator") for c in indicators])
    confirmed = F.col("PCR_AG_Pos_indicator") == 1
    if diagnosis:
        confirmed = confirmed | (F.col(f"{diagnosis}_indicator") == 1)
    per_person = (per_person
                  .withColumn("confirmed_case", F.when(confirmed, 1).otherwise(0))
                  .withColumn("possible_case", F.when(confirmed, 0).when(F.col("Antibody_Pos_indicator") == 1, 1).otherwise(0)))
    dead = deaths.groupBy("person_id").agg(F.max("patient_death").alias("patient_death_indicator"))
    out = cohort.join(per_person, "person_id", "left").join(dead, "person_id", "left")
    fill = [c for c in out.columns if c not in ("BMI_max_observed_or_calculated", *unfilled)]
    return out.na.fill(0, subset=fill)
