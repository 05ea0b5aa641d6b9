"""Person flags, recodes and frequency checks that feed the risk measures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import column_counts, long_values, ratio, union_all
from ..functions.session import stable
from .concepts import with_codes

# Concept ids and names of the recode.
KNOWN_ETHNICITY = (38003563, 38003564)
UNKNOWN_SEX = (8521, 8551, 4214687, 0)
RACE_OTHER = ("Other Race", "Other", "What Race Ethnicity: Race Ethnicity None Of These")
RACE_UNKNOWN = ("No matching concept", "No Information", "Refuse to answer", "Unknown", "Unknown racial group", "Hispanic")
RACE_MULTIPLE = ("More than one race", "Multiple race", "Multiple races")
OLDEST_AGE_CODE = 999


def person_flags(person: DataFrame, events: Mapping[str, tuple[DataFrame, str]], sheet: DataFrame,
                 indicators: Sequence[str], deaths: DataFrame | None = None,
                 obesity: DataFrame | None = None) -> DataFrame:
    """0/1 flag per person and indicator; ``events`` maps a table code to (table, concept column).

    The rows of the sheet that raise a wanted flag go to the events, and Spark combines flags of a person before the
    shuffle, so a frequent concept does not travel row by row.
    """
    wanted = stable(sheet.where(F.col("indicator_suffix").isin(list(indicators)))
                  .select("table_code", F.col("concept_id").cast("long").alias("concept_id"), "indicator_suffix"))
    marks = union_all([
        with_codes(df.select("person_id", F.col(c).cast("long").alias("concept_id")),
                   wanted.where(F.col("table_code") == code).select("concept_id", "indicator_suffix"), "concept_id")
        .select("person_id", "indicator_suffix") for code, (df, c) in events.items()])
    if deaths is not None:
        marks = marks.unionByName(deaths.select("person_id", F.lit("death").alias("indicator_suffix")))
    if obesity is not None:
        marks = marks.unionByName(obesity.where("OBESITY = 1").select("person_id", F.lit("obesity").alias("indicator_suffix")))
    names = [*indicators, *(["death"] if deaths is not None else []), *(["obesity"] if obesity is not None else [])]
    wide = marks.groupBy("person_id").agg(*[
        F.max(F.when(F.col("indicator_suffix") == n, 1).otherwise(0)).alias(n) for n in names])
    return person.select("person_id").join(wide, "person_id", "left").select(
        "person_id", *[F.coalesce(F.col(n), F.lit(0)).alias(f"flag_{n}") for n in names])


def person_obesity(person: DataFrame, measured: DataFrame) -> DataFrame:
    """Maximum obesity flag over all measured days; null when never measured."""
    return person.select("person_id").join(
        measured.groupBy("person_id").agg(F.max("OBESITY").alias("OBESITY")), "person_id", "left")


def recode_person(person: DataFrame, cut_year: int = 2024, age_year: int = 2025) -> DataFrame:
    """Ethnicity, sex, year of birth, age and race as the risk measures use them."""
    race = F.col("race_concept_name")
    year = F.when(F.col("year_of_birth") != 0, F.col("year_of_birth"))
    return (person
            .withColumn("ethnicity", F.when(F.col("ethnicity_concept_id").isin(*KNOWN_ETHNICITY),
                                            F.col("ethnicity_concept_name")).otherwise("Unknown"))
            .withColumn("sex", F.when(F.col("gender_concept_id").isin(*UNKNOWN_SEX), "Unknown")
                        .otherwise(F.col("gender_concept_name")))
            .withColumn("year_of_birth", year)
            .withColumn("age", F.when(F.lit(cut_year) - year > 100, OLDEST_AGE_CODE).otherwise(F.lit(age_year) - year))
            .withColumn("race_r", F.when(race.isin(*RACE_OTHER), "Other")
                        .when(race.isNull() | race.isin(*RACE_UNKNOWN), "Unknown")
                        .when(race.isin(*RACE_MULTIPLE), "Multiple races").otherwise(race)))


def frequencies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count and percent (2 digits) of every combination of the columns."""
    counts = df.groupBy(*columns).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*")).scalar()
    return counts.withColumn("percentage", F.round(ratio(100 * F.col("n"), total), 2))


def flag_check(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Per flag: rows with 0, 1 and null, their total without nulls, and percents of that total."""
    out = long_values(df, flags, [], "int").groupBy("variable").agg(
        F.count_if(F.col("value") == 0).alias("value_0"),
        F.count_if(F.col("value") == 1).alias("value_1"),
        F.count_if(F.col("value").isNull()).alias("value_na"))
    total = F.col("value_0") + F.col("value_1")
    return out.withColumn("total", total).withColumn("pct_0", F.round(ratio(100 * F.col("value_0"), total), 2)) \
        .withColumn("pct_1", F.round(ratio(100 * F.col("value_1"), total), 2))


def id_counts(orig: Mapping[str, DataFrame], new: Mapping[str, DataFrame],
              ids: Mapping[str, Sequence[str]]) -> DataFrame:
    """Distinct values of the id columns of each table on both sides."""
    def side(tables, name):
        return union_all([column_counts(tables[table], cols).select(F.lit(table).alias("table_name"), F.col("variable").alias("id_column"), F.col("n_distinct").alias(name))
                          for table, cols in ids.items()])
    return side(orig, "orig_distinct").join(side(new, "new_distinct"), ["table_name", "id_column"], "outer")
