"""Queries for the cohort, person-day facts and episodes."""

from pyspark.sql import functions as F

from ..functions.session import stored
from ..operators import cohort, concepts, episodes, facts
from .registry import query

AS_OF, FLOOR = "2004-12-31", "1996-01-01"

# ---------------------------------------------------------------- SQL fragments

SITES = """sites AS (SELECT data_partner_id, run_date AS data_extraction_date, cdm_name, cdm_version,
  CASE WHEN max_num_shift_days = '' THEN '0' ELSE replace(lower(max_num_shift_days), 'na', '0') END AS shift_text FROM manifest)"""

BORN = f"""born AS (SELECT person_id, race_concept_name, ethnicity_concept_name, gender_concept_name, p.data_partner_id,
  CAST('{AS_OF}' AS DATE) + CAST((SELECT max(TRY_CAST(shift_text AS INT)) FROM person x JOIN sites y ON x.data_partner_id = y.data_partner_id) AS INT) AS limit_date,
  TRY_CAST(lpad(CAST(coalesce(year_of_birth, 1) AS STRING), 4, '0') || '-' ||
    lpad(CAST(CASE WHEN coalesce(month_of_birth, 0) = 0 THEN 7 ELSE month_of_birth END AS STRING), 2, '0') || '-' ||
    lpad(CAST(CASE WHEN coalesce(day_of_birth, 0) = 0 THEN 1 ELSE day_of_birth END AS STRING), 2, '0') AS DATE) AS raw_birth
  FROM person p JOIN sites s ON p.data_partner_id = s.data_partner_id),
aged AS (SELECT *, CASE WHEN raw_birth BETWEEN DATE '1902-01-01' AND limit_date THEN raw_birth END AS date_of_birth FROM born)"""

AGE = """CAST(date_part('year', limit_date) - date_part('year', date_of_birth)
  - CASE WHEN date_part('month', limit_date) * 100 + date_part('day', limit_date) < date_part('month', date_of_birth) * 100 + date_part('day', date_of_birth) THEN 1 ELSE 0 END AS BIGINT)"""

RACE = """CASE race_concept_name WHEN 'White' THEN 'White' WHEN 'Black' THEN 'Black or African American' WHEN 'Chinese' THEN 'Asian'
  WHEN 'Multiple race' THEN 'Other' ELSE 'Unknown' END"""
RACE_ETH = f"""CASE WHEN ethnicity_concept_name = 'Hispanic or Latino' THEN 'Hispanic or Latino Any Race'
  WHEN {RACE} = 'Unknown' THEN 'Unknown' ELSE {RACE} || ' Non-Hispanic' END"""

VISITS = """visit_sum AS (SELECT person_id, count(*) AS total_visits, max(visit_start_date) - min(visit_start_date) AS observation_period
  FROM visit_occurrence GROUP BY person_id)"""

COHORT = f"""{SITES}, {BORN}, {VISITS},
cohort AS (SELECT a.person_id, total_visits, observation_period, gender_concept_name AS sex, {AGE} AS age, {RACE} AS race,
  {RACE_ETH} AS race_ethnicity, a.data_partner_id, s.data_extraction_date, s.cdm_name, s.cdm_version, 'Y' AS shift_date_yn,
  s.shift_text || ' + 180' AS max_num_shift_days
  FROM aged a JOIN sites s ON a.data_partner_id = s.data_partner_id LEFT JOIN visit_sum v ON a.person_id = v.person_id)"""

DOMAINS = {
    "condition": ("condition_occurrence", "condition_concept_id", "condition_start_date", ["FLU", "ARI", "VACC"]),
    "device": ("device_exposure", "device_concept_id", "device_exposure_start_date", ["ARI"]),
    "drug": ("drug_exposure", "drug_concept_id", "drug_exposure_start_date", ["VACC"]),
    "observation": ("observation", "observation_concept_id", "observation_date", ["FLU"]),
    "procedure": ("procedure_occurrence", "procedure_concept_id", "procedure_date", ["VACC"]),
}
CUSTOM = [(1005, "FLU"), (1006, "VACC")]


def resolved(domain):
    extra = "".join(f" UNION ALL SELECT {i}, '{p}'" for i, p in CUSTOM) if domain == "condition" else ""
    return f"""(SELECT m.concept_id, indicator_prefix FROM concept_set_members m JOIN concept_sheet s ON m.concept_set_name = s.concept_set_name
  WHERE is_most_recent_version AND domain LIKE '%{domain}%'{extra})"""


def domain_sql(domain):
    table, cid, date, indicators = DOMAINS[domain]
    flags = ", ".join(f"max(CASE WHEN indicator_prefix = '{i}' THEN 1 ELSE 0 END) AS {i}" for i in indicators)
    return f"""SELECT e.person_id, e.{date} AS date, {flags} FROM {table} e JOIN {resolved(domain)} c ON e.{cid} = c.concept_id
  WHERE e.{date} IS NOT NULL AND e.person_id IN (SELECT person_id FROM person p JOIN manifest m ON p.data_partner_id = m.data_partner_id)
  GROUP BY e.person_id, e.{date}"""


LABS = """SELECT person_id, measurement_date AS date,
  max(CASE WHEN measurement_concept_id = 4004 AND value_as_concept_id = 45884084 THEN 1 ELSE 0 END) AS INFLUENZA_POS,
  max(CASE WHEN measurement_concept_id = 4004 AND value_as_concept_id = 45878583 THEN 1 ELSE 0 END) AS INFLUENZA_NEG,
  max(CASE WHEN measurement_concept_id = 4004 AND value_as_concept_id IN (45884084, 45878583) THEN 1 ELSE 0 END) AS HAS_INFLUENZA_TEST_RESULT,
  max(CASE WHEN measurement_concept_id = 4005 AND value_as_concept_id = 45884084 THEN 1 ELSE 0 END) AS PCR_AG_Pos,
  max(CASE WHEN measurement_concept_id = 4005 AND value_as_concept_id = 45878583 THEN 1 ELSE 0 END) AS PCR_AG_Neg,
  max(CASE WHEN measurement_concept_id = 4006 AND value_as_concept_id = 45884084 THEN 1 ELSE 0 END) AS Antibody_Pos,
  max(CASE WHEN measurement_concept_id = 4006 AND value_as_concept_id = 45878583 THEN 1 ELSE 0 END) AS Antibody_Neg
  FROM measurement WHERE measurement_date IS NOT NULL GROUP BY person_id, measurement_date"""
BMI = """SELECT person_id, date, round(b) AS BMI_rounded, CASE WHEN round(b) >= 30 THEN 1 ELSE 0 END AS OBESITY FROM (
  SELECT person_id, date, CASE WHEN rec > 0 THEN rec WHEN h > 0 THEN w / (h * h) END AS b FROM (
    SELECT person_id, measurement_date AS date,
      max(CASE WHEN measurement_concept_id = 4001 AND value_as_number BETWEEN 10 AND 100 THEN value_as_number ELSE 0 END) AS rec,
      max(CASE WHEN measurement_concept_id = 4002 AND value_as_number BETWEEN 0.6 AND 2.43 THEN value_as_number ELSE 0 END) AS h,
      max(CASE WHEN measurement_concept_id = 4003 AND value_as_number BETWEEN 5 AND 300 THEN value_as_number ELSE 0 END) AS w
    FROM measurement WHERE value_as_number IS NOT NULL GROUP BY person_id, measurement_date) q) r WHERE b BETWEEN 10 AND 100"""
MEASURES = f"""SELECT l.*, BMI_rounded, OBESITY FROM ({LABS}) l LEFT JOIN ({BMI}) b ON l.person_id = b.person_id AND l.date = b.date"""

DEATHS = f"""
dead_dates AS (SELECT d.person_id, min(death_date) AS d FROM death d JOIN cohort c ON d.person_id = c.person_id
  WHERE death_date >= DATE '{FLOOR}' AND death_date < data_extraction_date GROUP BY d.person_id),
dead_visits AS (SELECT v.person_id, max(CASE WHEN visit_end_date >= DATE '{FLOOR}' AND visit_end_date < data_extraction_date + 730 THEN visit_end_date
    WHEN visit_start_date >= DATE '{FLOOR}' AND visit_start_date < data_extraction_date + 730 THEN visit_start_date END) AS d
  FROM visit_occurrence v JOIN cohort c ON v.person_id = c.person_id WHERE discharge_to_concept_id = 4216643 GROUP BY v.person_id),
dead_ids AS (SELECT person_id FROM death UNION SELECT person_id FROM visit_occurrence WHERE discharge_to_concept_id IN (4216643, 8546)),
deaths AS (SELECT i.person_id, coalesce(a.d, b.d) AS date, c.data_extraction_date, 1 AS patient_death FROM dead_ids i JOIN cohort c ON i.person_id = c.person_id
  LEFT JOIN dead_dates a ON i.person_id = a.person_id LEFT JOIN dead_visits b ON i.person_id = b.person_id)"""

STAYS = """
stay_rows AS (SELECT person_id, visit_occurrence_id, visit_start_date AS s, visit_end_date AS e FROM visit_occurrence
  WHERE visit_concept_id IN (262, 8717, 9201, 581379, 32037) AND visit_end_date >= visit_start_date),
stay_open AS (SELECT *, max(e) OVER (PARTITION BY person_id ORDER BY s, visit_occurrence_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM stay_rows),
stay_no AS (SELECT *, sum(CASE WHEN prev IS NULL OR s - prev >= 1 THEN 1 ELSE 0 END) OVER (PARTITION BY person_id ORDER BY s, visit_occurrence_id ROWS UNBOUNDED PRECEDING) AS n FROM stay_open),
macro AS (SELECT person_id, n, min(s) AS ms, max(e) AS me FROM stay_no GROUP BY person_id, n),
macro_prev AS (SELECT *, lag(ms) OVER (PARTITION BY person_id ORDER BY ms) AS prev FROM macro),
chain AS (SELECT *, sum(CASE WHEN prev IS NULL OR ms - prev > 30 THEN 1 ELSE 0 END) OVER (PARTITION BY person_id ORDER BY ms ROWS UNBOUNDED PRECEDING) AS k FROM macro_prev),
episodes AS (SELECT person_id, CAST(person_id AS STRING) || '_' || CAST(CAST(k AS BIGINT) AS STRING) AS combined_macrovisit_id,
  min(ms) AS combined_macrovisit_start_date, max(me) AS combined_macrovisit_end_date FROM chain GROUP BY person_id, k)"""

FACT_COLS = ["FLU", "ARI", "VACC", *facts.LAB_FLAGS, "HAS_INFLUENZA_TEST_RESULT", "OBESITY", "patient_death_at_visit"]


def _fact_source(sql, cols, name):
    want = ["BMI_rounded", *FACT_COLS]
    return f"SELECT person_id, date, {', '.join((c if c in cols else 'NULL') + ' AS ' + c for c in want)} FROM ({sql}) {name}"


def fact_days_cte():
    parts = [_fact_source("SELECT person_id, visit_start_date AS date FROM visit_occurrence", [], "v")]
    for d in DOMAINS:
        parts.append(_fact_source(domain_sql(d), DOMAINS[d][3], d))
    parts.append(_fact_source(MEASURES, [*facts.LAB_FLAGS, "HAS_INFLUENZA_TEST_RESULT", "BMI_rounded", "OBESITY"], "m"))
    parts.append(_fact_source(f"SELECT person_id, date, patient_death AS patient_death_at_visit FROM deaths WHERE date >= DATE '{FLOOR}' AND date < data_extraction_date + 730",
                              ["patient_death_at_visit"], "x"))
    flags = ", ".join(f"coalesce(max({c}), 0) AS {c}" for c in FACT_COLS)
    return f"""fact_rows AS ({' UNION ALL '.join(parts)}),
fact_days AS (SELECT person_id, date, max(BMI_rounded) AS BMI_rounded, {flags} FROM fact_rows GROUP BY person_id, date)"""


FACTS = f"{COHORT}, {DEATHS}, {fact_days_cte()}, {STAYS}"

# ---------------------------------------------------------------- Spark side


def cohort_of(t):
    return cohort.cohort_persons(t.person, t.visit_occurrence, t.manifest, AS_OF)


def stored_cohort(t):
    """The cohort is read by every fact table, so it is computed and stored once."""
    return stored(cohort_of(t))


def custom_sets(t):
    return t.spark.createDataFrame(CUSTOM, "concept_id long, indicator_prefix string")


def domain_of(t, persons, domain):
    table, cid, date, indicators = DOMAINS[domain]
    sets = concepts.resolve_sets(t.concept_set_members, t.concept_sheet, domain,
                                 custom_sets(t) if domain == "condition" else None)
    return facts.domain_facts(getattr(t, table), persons, sets, cid, date, indicators)


def deaths_of(t, people):
    return facts.patient_deaths(t.death, t.concept_set_members, people, t.visit_occurrence, FLOOR)


def fact_days_of(t, people, lab_flags=None):
    """The sources of the fact days and the deaths; with ``lab_flags`` only these columns and days of the measurements."""
    sources = [domain_of(t, people, d) for d in DOMAINS]
    sources.append(facts.measurement_facts(t.measurement, t.concept_set_members, people, indicators=lab_flags))
    return sources, deaths_of(t, people)


def fact_table_of(t, people):
    sources, deaths = fact_days_of(t, people)
    return facts.fact_day_table(t.visit_occurrence, sources, deaths,
                                episodes.combined_episodes(t.visit_occurrence), FLOOR)


@query("b01_manifest", "SELECT CAST(data_partner_id AS INT) AS data_partner_id, run_date, max_num_shift_days FROM manifest")
def _(t):
    raw = t.manifest.withColumn("run_date", F.col("run_date").cast("string"))
    return cohort.normalise_manifest(raw, contribution_date=None).select("data_partner_id", "run_date", "max_num_shift_days")


@query("b02_merge_concept_sheets", """
WITH req AS (SELECT DISTINCT concept_set_name, is_most_recent_version FROM concept_set_members WHERE is_most_recent_version),
cus AS (SELECT concept_set_name, is_most_recent_version, count(*) AS n_concepts FROM concept_set_members GROUP BY 1, 2)
SELECT coalesce(req.concept_set_name, cus.concept_set_name) AS concept_set_name,
  coalesce(req.is_most_recent_version, cus.is_most_recent_version) AS is_most_recent_version, n_concepts
FROM req FULL JOIN cus ON req.concept_set_name = cus.concept_set_name AND req.is_most_recent_version = cus.is_most_recent_version""")
def _(t):
    m = t.concept_set_members
    required = m.where("is_most_recent_version").select("concept_set_name", "is_most_recent_version").distinct()
    custom = m.groupBy("concept_set_name", "is_most_recent_version").agg(F.count("*").alias("n_concepts"))
    return concepts.merge_sheets(required, custom)


@query("b03_attach_manifest", f"WITH {SITES} SELECT p.person_id, p.data_partner_id, data_extraction_date, shift_text AS max_num_shift_days FROM person p JOIN sites s ON p.data_partner_id = s.data_partner_id")
def _(t):
    return cohort.attach_manifest(t.person, t.manifest).select(
        "person_id", "data_partner_id", "data_extraction_date", "max_num_shift_days")


def _born(t):
    people = cohort.attach_manifest(t.person, t.manifest)
    return cohort.with_birth_date(people, AS_OF, cohort.largest_shift(people))


@query("b04_birth_date", f"WITH {SITES}, {BORN} SELECT person_id, date_of_birth FROM aged")
def _(t):
    return _born(t).select("person_id", "date_of_birth")


@query("b05_age", f"WITH {SITES}, {BORN} SELECT person_id, {AGE} AS age FROM aged")
def _(t):
    return _born(t).select("person_id", cohort.age_at(F.col("latest_birth"), F.col("date_of_birth")).alias("age"))


@query("b06_race_groups", f"SELECT {RACE} AS race, {RACE_ETH} AS race_ethnicity, count(*) AS n FROM person GROUP BY 1, 2")
def _(t):
    race, eth = F.col("race_concept_name"), F.col("ethnicity_concept_name")
    return t.person.groupBy(cohort.race_group(race).alias("race"),
                            cohort.race_ethnicity_group(race, eth).alias("race_ethnicity")).agg(F.count("*").alias("n"))


@query("b07_visit_summary", f"WITH {VISITS} SELECT * FROM visit_sum")
def _(t):
    return cohort.visit_summary(t.visit_occurrence)


@query("b08_cohort", f"WITH {COHORT} SELECT * FROM cohort")
def _(t):
    return cohort_of(t)


@query("b09_resolve_concept_sets", f"SELECT concept_id, indicator_prefix FROM {resolved('condition')} x")
def _(t):
    return concepts.resolve_sets(t.concept_set_members, t.concept_sheet, "condition", custom_sets(t))


def _register_domain(domain):
    @query(f"b10_{domain}_facts", domain_sql(domain))
    def _(t):
        return domain_of(t, cohort.attach_manifest(t.person, t.manifest), domain)


for _d in DOMAINS:
    _register_domain(_d)


@query("b11_label_concept_set", """
SELECT CASE measurement_concept_id WHEN 4001 THEN 'bmi' WHEN 4002 THEN 'height' WHEN 4003 THEN 'weight' WHEN 4004 THEN 'influenza test' ELSE '' END AS concept_set,
  count(*) AS n FROM measurement GROUP BY 1""")
def _(t):
    labelled = concepts.label_by_set(t.measurement, t.concept_set_members, "measurement_concept_id", "sets",
                                     ["bmi", "height", "weight", "influenza test"])
    return labelled.groupBy(F.array_join("sets", ",").alias("concept_set")).agg(F.count("*").alias("n"))


def _measures(t):
    return facts.measurement_facts(t.measurement, t.concept_set_members, t.person)


@query("b12_bmi", BMI)
def _(t):
    return _measures(t).where("BMI_rounded IS NOT NULL").select("person_id", "date", "BMI_rounded", "OBESITY")


@query("b13_virus_results", f"SELECT person_id, date, PCR_AG_Pos, PCR_AG_Neg, Antibody_Pos, Antibody_Neg FROM ({LABS}) x")
def _(t):
    return _measures(t).select("person_id", "date", "PCR_AG_Pos", "PCR_AG_Neg", "Antibody_Pos", "Antibody_Neg")


@query("b14_influenza_results", f"SELECT person_id, date, INFLUENZA_POS, INFLUENZA_NEG, HAS_INFLUENZA_TEST_RESULT FROM ({LABS}) x")
def _(t):
    return _measures(t).select("person_id", "date", "INFLUENZA_POS", "INFLUENZA_NEG", "HAS_INFLUENZA_TEST_RESULT")


@query("b15_measurement_facts", MEASURES)
def _(t):
    return _measures(t)


@query("b16_patient_deaths", f"WITH {COHORT}, {DEATHS} SELECT * FROM deaths")
def _(t):
    return deaths_of(t, stored_cohort(t))


@query("b17_macrovisits", f"""WITH {STAYS} SELECT s.person_id, visit_occurrence_id, CAST(s.person_id AS STRING) || '_' || CAST(CAST(s.n AS BIGINT) AS STRING) AS macrovisit_id,
  ms AS macrovisit_start_date, me AS macrovisit_end_date FROM stay_no s JOIN macro m ON s.person_id = m.person_id AND s.n = m.n""")
def _(t):
    return episodes.visit_macrovisits(t.visit_occurrence).select(
        "person_id", "visit_occurrence_id", "macrovisit_id", "macrovisit_start_date", "macrovisit_end_date")


@query("b18_combined_macrovisits", f"WITH {STAYS} SELECT * FROM episodes")
def _(t):
    return episodes.combined_episodes(t.visit_occurrence)


@query("b19_fact_days", f"WITH {FACTS} SELECT * FROM fact_days")
def _(t):
    people = stored_cohort(t)
    sources, deaths = fact_days_of(t, people)
    return facts.fact_days(t.visit_occurrence, sources, deaths, FLOOR)


@query("b20_fact_day_table", f"""WITH {FACTS} SELECT f.*, combined_macrovisit_id, combined_macrovisit_start_date, combined_macrovisit_end_date
FROM fact_days f LEFT JOIN episodes e ON f.person_id = e.person_id AND f.date BETWEEN combined_macrovisit_start_date AND combined_macrovisit_end_date""")
def _(t):
    return fact_table_of(t, stored_cohort(t))


_IND = [c for c in FACT_COLS if c != "patient_death_at_visit"]


@query("b21_person_summary", f"""WITH {FACTS},
s AS (SELECT person_id, max(BMI_rounded) AS bmi, {', '.join(f'max({c}) AS {c}_indicator' for c in _IND)} FROM fact_days GROUP BY person_id)
SELECT c.* REPLACE (coalesce(total_visits, 0) AS total_visits, coalesce(observation_period, 0) AS observation_period), bmi AS BMI_max_observed_or_calculated, {', '.join(f'coalesce({c}_indicator, 0) AS {c}_indicator' for c in _IND)},
  CASE WHEN FLU_indicator = 1 OR PCR_AG_Pos_indicator = 1 THEN 1 ELSE 0 END AS confirmed_case,
  CASE WHEN FLU_indicator = 1 OR PCR_AG_Pos_indicator = 1 THEN 0 WHEN Antibody_Pos_indicator = 1 THEN 1 ELSE 0 END AS possible_case,
  coalesce(d.patient_death, 0) AS patient_death_indicator
FROM cohort c LEFT JOIN s ON c.person_id = s.person_id LEFT JOIN deaths d ON c.person_id = d.person_id""")
def _(t):
    people = stored_cohort(t)
    sources, deaths = fact_days_of(t, people)
    return facts.person_summary(facts.fact_days(t.visit_occurrence, sources, deaths, FLOOR), people, deaths, diagnosis="FLU")
