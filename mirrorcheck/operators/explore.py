"""Exploration: counts per person, prevalence, spans, timelines, features, profiles, visit gaps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import null_safe_join, ratio, union_all
from ..functions.ordered import exact_quantiles
from .concepts import borrowed_lookup

TAIL = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
# Edges of the birth-year classes, left closed.
BIRTH_EDGES = (1900, 1940, 1950, 1960, 1970, 1980, 1990, 2000, 2010, 2030)


def describe(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """n, mean, sd, min, upper percentiles and max of a numeric column per group."""
    sd = rows.groupBy(*by).agg(F.stddev_samp(F.col(value).cast("double")).alias("sd"))
    return null_safe_join(exact_quantiles(rows.select(*by, value), by, value, TAIL), sd, by, "left")


def events_per_person(tables: Mapping[str, DataFrame], person: str = "person_id") -> DataFrame:
    """Distribution of the number of rows per person for several event tables."""
    counts = union_all([
        t.groupBy(person).agg(F.count("*").alias("events")).select(F.lit(n).alias("table_name"), "events")
        for n, t in tables.items()])
    return describe(counts, ["table_name"], "events")


def _persons_by_name(events: DataFrame, name: str) -> DataFrame:
    return events.select("person_id", name).distinct().groupBy(name).agg(F.count("*").alias("n"))


def prevalence(orig: DataFrame, orig_persons: DataFrame, new: DataFrame, new_persons: DataFrame, id_col: str,
               name_col: str, sum_over_ids: bool = False) -> DataFrame:
    """Share of persons with each concept name on both sides.

    The new side has ids only and borrows the most frequent name of each id. ``sum_over_ids`` adds up
    the person counts of ids that share a name, as some published tables do, instead of counting
    every person once per name.
    """
    names = borrowed_lookup(orig, id_col, name_col).select(
        F.col("concept_id").alias(id_col), F.col("concept_name").alias(name_col))
    pairs = new.select("person_id", id_col).distinct()
    if sum_over_ids:
        b = pairs.groupBy(id_col).agg(F.count("*").alias("n")).join(names, id_col).groupBy(name_col).agg(F.sum("n").alias("n"))
    else:
        b = _persons_by_name(pairs.join(names, id_col), name_col)
    a = _persons_by_name(orig, name_col)
    out = null_safe_join(a.withColumnRenamed("n", "n_orig"), b.withColumnRenamed("n", "n_new"), [name_col], "outer")
    n_o, n_n = orig_persons.agg(F.count_distinct("person_id")).scalar(), new_persons.agg(F.count_distinct("person_id")).scalar()
    return out.select(F.col(name_col).alias("concept_name"), "n_orig", "n_new",
                      ratio(F.col("n_orig"), n_o).alias("rate_orig"), ratio(F.col("n_new"), n_n).alias("rate_new"))


def care_span(visits: DataFrame) -> DataFrame:
    """First and last visit, number of visits and days between per person."""
    return visits.groupBy("person_id").agg(
        F.min("visit_start_date").alias("first_visit"), F.max("visit_start_date").alias("last_visit"),
        F.count("visit_occurrence_id").alias("n_visits"),
        F.datediff(F.max("visit_start_date"), F.min("visit_start_date")).alias("span_days"))


def care_span_summary(visits: DataFrame) -> DataFrame:
    return describe(care_span(visits).select(F.lit("care span").alias("measure"), "span_days"), ["measure"], "span_days")


def monthly_timeline(tables: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Events per person and month for several event types. Months run without gaps from the first to
    the last event of each type; a type without events in a listed month has zero."""
    months = union_all([
        t.where(F.col(d).isNotNull()).groupBy("person_id", F.last_day(F.col(d).cast("date")).alias("month"))
        .agg(F.count("*").alias("n")).withColumn("kind", F.lit(k)) for k, (t, d) in tables.items()])
    spans = months.groupBy("person_id", "kind").agg(F.min("month").alias("a"), F.max("month").alias("b"))
    listed = spans.select("person_id", F.explode(F.sequence(
        F.trunc("a", "month"), F.trunc("b", "month"), F.expr("interval 1 month"))).alias("m")).select(
        "person_id", F.last_day("m").alias("month")).distinct()
    counts = months.groupBy("person_id", "month").agg(*[
        F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(k) for k in tables])
    return listed.join(counts, ["person_id", "month"], "left").na.fill(0, subset=list(tables))


def top_ids(df: DataFrame, id_col: str, k: int) -> list:
    """The k most frequent ids, ties by id (k values come to the driver)."""
    rows = (df.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("n"))
            .orderBy(F.desc("n"), id_col).limit(k).collect())
    return [r[id_col] for r in rows]


def feature_matrix(person: DataFrame, domains: Mapping[str, tuple[DataFrame, str]], k: int = 50,
                   genders: Sequence[int] | None = None) -> DataFrame:
    """One row per person: birth-year classes and gender as 0/1, counts of each domain's top-k concepts.

    Without a list of genders, every gender id that stands in the table gives a column.
    """
    year = F.col("year_of_birth")
    cols = [F.col("person_id")]
    for lo, hi in zip(BIRTH_EDGES, BIRTH_EDGES[1:]):
        cols.append(F.coalesce(((year >= lo) & (year < hi)).cast("int"), F.lit(0)).alias(f"yob_{lo}_{hi}"))
    outside = year.isNull() | (year < BIRTH_EDGES[0]) | (year >= BIRTH_EDGES[-1])
    cols.append(outside.cast("int").alias("yob_nan"))
    gender = F.coalesce(F.col("gender_concept_id").cast("int"), F.lit(-1))
    if genders is None:
        genders = sorted(r[0] for r in person.select(gender.alias("g")).distinct().collect())
    cols += [(gender == g).cast("int").alias(f"gender_{g}" if g >= 0 else "gender_none") for g in genders]
    out = person.select(*cols)
    for prefix, (df, id_col) in domains.items():
        ids = top_ids(df, id_col, k)
        if not ids:
            continue
        counts = df.where(F.col(id_col).isin(ids)).groupBy("person_id").pivot(id_col, ids).agg(F.count(F.lit(1)))
        counts = counts.select("person_id", *[F.col(str(i)).alias(f"{prefix}_{i}") for i in ids])
        out = out.join(counts, "person_id", "left").na.fill(0, subset=[f"{prefix}_{i}" for i in ids])
    return out


def patient_profiles(person: DataFrame, visits: DataFrame, domains: Mapping[str, tuple[DataFrame, str, int]],
                     lookup: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row per person: demographics, visit span and the most frequent concepts of each domain as text."""
    def wanted(df):
        return df if ids is None else df.join(ids.select("person_id").distinct(), "person_id", "left_semi")

    out = wanted(person).select("person_id", "year_of_birth", F.col("gender_concept_name").alias("gender"),
                                F.col("race_concept_name").alias("race"), F.col("ethnicity_concept_name").alias("ethnicity"))
    spans = wanted(visits).groupBy("person_id").agg(
        F.count("*").alias("n_visits"), F.min("visit_start_date").alias("first_visit"), F.max("visit_start_date").alias("last_visit"))
    out = out.join(spans, "person_id", "left")
    for name, (df, id_col, k) in domains.items():
        counts = wanted(df).where(F.col(id_col).isNotNull()).groupBy("person_id", F.col(id_col).cast("long").alias("concept_id")) \
            .agg(F.count("*").alias("n"))
        w = Window.partitionBy("person_id").orderBy(F.desc("n"), "concept_id")
        top = counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).join(lookup, "concept_id", "left")
        label = F.coalesce(F.concat(F.col("concept_name"), F.lit(" ("), F.col("concept_id").cast("string"), F.lit(")")),
                           F.col("concept_id").cast("string"))
        text = F.concat(label, F.lit(" x"), F.col("n").cast("string"))
        lists = top.groupBy("person_id").agg(F.concat_ws("; ", F.transform(
            F.sort_array(F.collect_list(F.struct("rank", text.alias("t")))), lambda s: s["t"])).alias(f"top_{name}"))
        out = out.join(lists, "person_id", "left")
    return out


def concept_rates(events: DataFrame, persons: DataFrame, id_col: str) -> DataFrame:
    """Share of persons with each concept."""
    n = persons.agg(F.count_distinct("person_id")).scalar()
    return events.select("person_id", id_col).distinct().groupBy(id_col).agg(F.count("*").alias("n")).withColumn(
        "rate", ratio(F.col("n"), n))


def latest_values(measurement: DataFrame, rates: DataFrame, min_rate: float, max_rate: float | None = None,
                  pick: int | None = None, id_col: str = "measurement_concept_id", seed: int = 123) -> DataFrame:
    """n, min, mean, median and max of each person's latest value, for the concepts in a rate range.

    With ``pick`` a seeded choice of that many concepts is taken from the range.
    """
    from ..functions.columns import hash_uniform

    chosen = rates.where(F.col("rate") > min_rate)
    if max_rate is not None:
        chosen = chosen.where(F.col("rate") < max_rate)
    if pick is not None:
        chosen = chosen.withColumn("__u", hash_uniform(seed, id_col)).orderBy("__u", id_col).limit(pick)
    rows = measurement.where(F.col("value_as_number").isNotNull()).join(chosen.select(id_col), id_col, "left_semi")
    latest = rows.groupBy(id_col, "person_id").agg(
        F.max(F.struct("measurement_date", "value_as_number"))["value_as_number"].alias("v"))
    return exact_quantiles(latest.select(id_col, "v"), [id_col], "v", {"median": 0.5})


def visit_gaps(visits: DataFrame) -> DataFrame:
    """Total visits and days 1 to 2, 2 to 3, 3 to 4, 4 to 5 and 1 to last per person.

    Visits are first counted per person and day, so a window holds days and not visits.
    """
    days = visits.groupBy("person_id", "visit_start_date").agg(F.count("*").alias("n"))
    w = Window.partitionBy("person_id").orderBy("visit_start_date").rowsBetween(Window.unboundedPreceding, 0)
    run = days.withColumn("cum", F.sum("n").over(w))
    nth = {k: F.min(F.when(F.col("cum") >= k, F.col("visit_start_date"))) for k in range(1, 6)}
    total = F.sum("n")
    return run.groupBy("person_id").agg(
        total.alias("total_visits"),
        F.when(total > 1, F.datediff(F.max("visit_start_date"), nth[1])).alias("days_1_last"),
        *[F.datediff(nth[k + 1], nth[k]).alias(f"days_{k}_{k + 1}") for k in range(1, 5)])


def compare_visit_gaps(orig: DataFrame, new: DataFrame) -> DataFrame:
    return visit_gaps(new).withColumn("dataset", F.lit("synthetic")).unionByName(
        visit_gaps(orig).withColumn("dataset", F.lit("original")))
