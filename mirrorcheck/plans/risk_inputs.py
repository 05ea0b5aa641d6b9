"""Queries for the risk inputs."""

from pyspark.sql import functions as F

from ..operators import concepts, facts, risk_inputs
from .cohort import BMI
from .registry import query

INDICATORS = ["COPD", "DIABETES", "STATIN", "SURGERY", "INPATIENT"]
EVENTS = {"CO": ("condition_occurrence", "condition_concept_id"), "DE": ("drug_exposure", "drug_concept_id"),
          "PO": ("procedure_occurrence", "procedure_concept_id"), "VO": ("visit_occurrence", "visit_concept_id")}
OBESE = f"(SELECT person_id, max(OBESITY) AS OBESITY FROM ({BMI}) b GROUP BY person_id)"
MARKS = " UNION ALL ".join(
    f"SELECT person_id, indicator_suffix AS i FROM {v} e JOIN flag_sheet s ON e.{c} = s.concept_id AND table_code = '{k}'"
    for k, (v, c) in EVENTS.items())
FLAGS_SQL = f"""WITH marks AS ({MARKS} UNION ALL SELECT person_id, 'death' FROM death UNION ALL SELECT person_id, 'obesity' FROM {OBESE} o WHERE OBESITY = 1),
flags AS (SELECT p.person_id, {', '.join(f"max(CASE WHEN i = '{n}' THEN 1 ELSE 0 END) AS flag_{n}" for n in [*INDICATORS, 'death', 'obesity'])}
FROM person p LEFT JOIN marks m ON p.person_id = m.person_id GROUP BY p.person_id)"""


def measured(t):
    return facts.measurement_facts(t.measurement, t.concept_set_members, t.person)


def flags_of(t):
    events = {k: (getattr(t, v), c) for k, (v, c) in EVENTS.items()}
    return risk_inputs.person_flags(t.person, events, t.flag_sheet, INDICATORS, t.death,
                                    risk_inputs.person_obesity(t.person, measured(t)))


@query("d01_person_flags", FLAGS_SQL + " SELECT * FROM flags")
def _(t):
    return flags_of(t)


@query("d02_person_obesity", f"SELECT p.person_id, OBESITY FROM person p LEFT JOIN {OBESE} o ON p.person_id = o.person_id")
def _(t):
    return risk_inputs.person_obesity(t.person, measured(t))


@query("d03_recode_person", """
SELECT person_id, CASE WHEN ethnicity_concept_id IN (38003563, 38003564) THEN ethnicity_concept_name ELSE 'Unknown' END AS ethnicity,
  CASE WHEN gender_concept_id IN (8521, 8551, 4214687, 0) THEN 'Unknown' ELSE gender_concept_name END AS sex, year_of_birth,
  CASE WHEN 2024 - year_of_birth > 100 THEN 999 ELSE 2025 - year_of_birth END AS age,
  CASE WHEN race_concept_name = 'No Information' THEN 'Unknown' WHEN race_concept_name = 'Multiple race' THEN 'Multiple races' ELSE race_concept_name END AS race_r
FROM person_s""")
def _(t):
    return risk_inputs.recode_person(t.person_s).select("person_id", "ethnicity", "sex", "year_of_birth", "age", "race_r")


@query("d04_attach_concept_name", """
WITH lu AS (SELECT CAST(concept_id AS BIGINT) AS concept_id, min(concept_name) AS nm FROM concept GROUP BY concept_id)
SELECT nm AS condition_concept_name, count(*) AS n FROM condition_occurrence LEFT JOIN lu ON condition_concept_id = concept_id GROUP BY nm""")
def _(t):
    named = concepts.attach_name(t.condition_occurrence, "condition_concept_id", "condition_concept_name",
                                 concepts.concept_lookup(t.concept))
    return named.groupBy("condition_concept_name").agg(F.count("*").alias("n"))


@query("d04_borrowed_names", """
WITH c AS (SELECT o_custkey % 50 AS cid, o_orderstatus AS nm, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT cid AS concept_id, nm AS concept_name FROM c QUALIFY row_number() OVER (PARTITION BY cid ORDER BY n DESC, nm) = 1""")
def _(t):
    return concepts.borrowed_lookup(t.orders.withColumn("cid", F.col("o_custkey") % 50), "cid", "o_orderstatus")


@query("d05_frequencies", """
SELECT race_concept_name, ethnicity_concept_name, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS percentage
FROM person_s GROUP BY 1, 2""")
def _(t):
    return risk_inputs.frequencies(t.person_s, ["race_concept_name", "ethnicity_concept_name"])


@query("d06_flag_check", FLAGS_SQL + """, l AS (UNPIVOT (SELECT * EXCLUDE person_id FROM flags) ON * INTO NAME variable VALUE v)
SELECT variable, count(*) FILTER (WHERE v = 0) AS value_0, count(*) FILTER (WHERE v = 1) AS value_1, count(*) FILTER (WHERE v IS NULL) AS value_na,
  count(v) AS total, round(100.0 * count(*) FILTER (WHERE v = 0) / count(v), 2) AS pct_0, round(100.0 * count(*) FILTER (WHERE v = 1) / count(v), 2) AS pct_1
FROM l GROUP BY variable""")
def _(t):
    f = flags_of(t)
    return risk_inputs.flag_check(f, [c for c in f.columns if c != "person_id"])


@query("d07_joint_flags", FLAGS_SQL + """
SELECT flag_COPD, flag_SURGERY, flag_death, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS percentage FROM flags GROUP BY 1, 2, 3""")
def _(t):
    return risk_inputs.frequencies(flags_of(t), ["flag_COPD", "flag_SURGERY", "flag_death"])


@query("d08_top_concepts", """
WITH top AS (SELECT condition_concept_id AS concept_id, count(*) AS n FROM condition_occurrence GROUP BY 1 ORDER BY n DESC, concept_id LIMIT 25)
SELECT top.concept_id, n, (SELECT min(concept_name) FROM concept c WHERE c.concept_id = top.concept_id) AS concept_name FROM top""")
def _(t):
    return concepts.top_concepts(t.condition_occurrence, "condition_concept_id", 25, concepts.concept_lookup(t.concept))


@query("d09_domain_summary", "SELECT domain_id, count(*) AS n_rows, count(DISTINCT concept_id) AS n_ids, count(DISTINCT concept_name) AS n_names FROM concept GROUP BY 1")
def _(t):
    return concepts.domain_summary(t.concept)


@query("d10_id_counts", """
SELECT 'person' AS table_name, 'person_id' AS id_column, (SELECT count(DISTINCT person_id) FROM person) AS orig_distinct, (SELECT count(DISTINCT person_id) FROM person_s) AS new_distinct
UNION ALL SELECT 'visit_occurrence', 'person_id', (SELECT count(DISTINCT person_id) FROM visit_occurrence), (SELECT count(DISTINCT person_id) FROM visit_occurrence_s)
UNION ALL SELECT 'visit_occurrence', 'visit_occurrence_id', (SELECT count(DISTINCT visit_occurrence_id) FROM visit_occurrence), (SELECT count(DISTINCT visit_occurrence_id) FROM visit_occurrence_s)
UNION ALL SELECT 'condition_occurrence', 'condition_concept_id', (SELECT count(DISTINCT condition_concept_id) FROM condition_occurrence), (SELECT count(DISTINCT condition_concept_id) FROM condition_occurrence_s)""")
def _(t):
    ids = {"person": ["person_id"], "visit_occurrence": ["person_id", "visit_occurrence_id"],
           "condition_occurrence": ["condition_concept_id"]}
    return risk_inputs.id_counts({n: getattr(t, n) for n in ids}, {n: getattr(t, n + "_s") for n in ids}, ids)
