"""The cohort person table: site manifest, birth dates, age, race roll-ups, visit counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Source race names by roll-up group.
RACE_GROUPS = {
    "Hispanic or Latino": ["Hispanic"],
    "Asian": [
        "Asian", "Asian Indian", "Bangladeshi", "Bhutanese", "Burmese", "Cambodian", "Chinese", "Filipino",
        "Hmong", "Indonesian", "Japanese", "Korean", "Laotian", "Malaysian", "Maldivian", "Nepalese", "Okinawan",
        "Pakistani", "Singaporean", "Sri Lankan", "Taiwanese", "Thai", "Vietnamese",
    ],
    "Black or African American": [
        "African", "African American", "Barbadian", "Black", "Black or African American", "Dominica Islander",
        "Haitian", "Jamaican", "Madagascar", "Trinidadian", "West Indian",
    ],
    "White": ["White"],
    "Native Hawaiian or Other Pacific Islander": [
        "Melanesian", "Micronesian", "Native Hawaiian or Other Pacific Islander", "Other Pacific Islander",
        "Polynesian",
    ],
    "American Indian or Alaska Native": ["American Indian or Alaska Native"],
    "Other": ["More than one race", "Multiple race", "Multiple races", "Other", "Other Race"],
}
EARLIEST_BIRTH = "1902-01-01"


def normalise_manifest(manifest: DataFrame, run_date: str = "run_date",
                       contribution_date: str | None = "contribution_date") -> DataFrame:
    """Parse the two dates and make the partner id an integer."""
    cols = {"run_date": F.to_date(F.col(run_date)), "data_partner_id": F.col("data_partner_id").cast("int")}
    if contribution_date:
        cols["contribution_date"] = F.to_date(F.col(contribution_date))
    return manifest.withColumns(cols)


def clean_shift_days(raw: Column) -> Column:
    """Empty text and 'na' become zero, still as text."""
    return F.when(raw == "", F.lit("0")).otherwise(F.regexp_replace(F.lower(raw), "na", "0"))


def attach_manifest(person: DataFrame, manifest: DataFrame) -> DataFrame:
    """Inner join on the partner; the extraction date and the cleaned shift come along."""
    sites = manifest.select(
        "data_partner_id", F.col("run_date").alias("data_extraction_date"), "cdm_name", "cdm_version",
        "shift_date_yn", clean_shift_days(F.col("max_num_shift_days")).alias("max_num_shift_days"))
    return person.join(sites, "data_partner_id")


def largest_shift(manifest: DataFrame) -> DataFrame:
    """One row: the largest shift of any site that has persons, in days."""
    return manifest.agg(F.coalesce(
        F.max(F.expr("try_cast(max_num_shift_days AS int)")), F.lit(0)).alias("max_shift"))


def birth_date(year: Column, month: Column, day: Column) -> Column:
    """Date from parts: no year is year 1, no month is July, no day is the first; null if not a date."""
    y = F.coalesce(year, F.lit(1))
    m = F.when(month.isNull() | (month == 0), 7).otherwise(month)
    d = F.when(day.isNull() | (day == 0), 1).otherwise(day)
    return F.try_to_date(F.format_string("%04d-%02d-%02d", y.cast("int"), m.cast("int"), d.cast("int")))


def with_birth_date(person: DataFrame, as_of: str, shifts: DataFrame) -> DataFrame:
    """Add ``date_of_birth``, null outside [1902-01-01, as_of + largest shift], and that upper limit."""
    limited = person.withColumn(
        "latest_birth", F.date_add(F.lit(as_of).cast("date"), shifts.select("max_shift").scalar()))
    born = birth_date(F.col("year_of_birth"), F.col("month_of_birth"), F.col("day_of_birth"))
    return (limited.withColumn("date_of_birth", born)
            .withColumn("date_of_birth", F.when(
                F.col("date_of_birth").between(F.lit(EARLIEST_BIRTH).cast("date"), F.col("latest_birth")),
                F.col("date_of_birth"))))


def age_at(limit: Column, born: Column) -> Column:
    return F.floor(F.months_between(limit, born, False) / 12)


def race_group(race: Column) -> Column:
    expr = None
    for group, names in RACE_GROUPS.items():
        expr = F.when(race.isin(names), group) if expr is None else expr.when(race.isin(names), group)
    return expr.otherwise("Unknown")


def race_ethnicity_group(race: Column, ethnicity: Column) -> Column:
    group = race_group(race)
    return (F.when(ethnicity == "Hispanic or Latino", "Hispanic or Latino Any Race")
            .when(group == "Hispanic or Latino", "Hispanic or Latino Any Race")
            .when(group == "Unknown", "Unknown")
            .otherwise(F.concat(group, F.lit(" Non-Hispanic"))))


def visit_summary(visits: DataFrame) -> DataFrame:
    """Visits and days between first and last visit of every person, in one pass."""
    return visits.groupBy("person_id").agg(
        F.count("*").alias("total_visits"),
        F.datediff(F.max("visit_start_date"), F.min("visit_start_date")).alias("observation_period"),
    )


def cohort_persons(person: DataFrame, visits: DataFrame, manifest: DataFrame | None, as_of: str) -> DataFrame:
    """The cohort table. Without a manifest the site columns are left out and no shift applies."""
    people = person.select(
        "person_id", "year_of_birth", "month_of_birth", "day_of_birth", "ethnicity_concept_name",
        "race_concept_name", F.col("gender_concept_name").alias("sex"),
        *(["data_partner_id"] if manifest is not None else []),
    ).repartition("person_id").distinct()  # where the visits of the person are joined
    site = []
    if manifest is not None:
        people = attach_manifest(people, manifest)
        present = people.select("max_num_shift_days")
        shifts = largest_shift(present)
        site = ["data_partner_id", "data_extraction_date", "cdm_name", "cdm_version",
                F.lit("Y").alias("shift_date_yn"),
                F.concat(F.col("max_num_shift_days"), F.lit(" + 180")).alias("max_num_shift_days")]
    else:
        shifts = person.sparkSession.range(1).select(F.lit(0).alias("max_shift"))
    race, eth = F.col("race_concept_name"), F.col("ethnicity_concept_name")
    return (with_birth_date(people, as_of, shifts)
            .join(visit_summary(visits), "person_id", "left")
            .select("person_id", "total_visits", "observation_period", "sex",
                    age_at(F.col("latest_birth"), F.col("date_of_birth")).alias("age"),
                    race_group(race).alias("race"),
                    race_ethnicity_group(race, eth).alias("race_ethnicity"), *site))
