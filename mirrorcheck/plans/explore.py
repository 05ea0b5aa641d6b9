"""Queries for exploration."""

from pyspark.sql import functions as F

from ..operators import concepts, tablesets
from ..operators import explore as ex
from .registry import query

PCT = ", ".join(f"round(quantile_cont(x, {p}), 6) AS {n}" for n, p in ex.TAIL.items())
DESCRIBE = f"count(*) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd, CAST(min(x) AS DOUBLE) AS min, {PCT}, CAST(max(x) AS DOUBLE) AS max"
TABLES = {"visits": ("visit_occurrence", "visit_start_date"), "conditions": ("condition_occurrence", "condition_start_date"),
          "drugs": ("drug_exposure", "drug_exposure_start_date"), "procedures": ("procedure_occurrence", "procedure_date")}


@query("h01_events_per_person", f"SELECT table_name, {DESCRIBE} FROM (" + " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, count(*) AS x FROM {v} GROUP BY person_id" for n, (v, _) in TABLES.items()) + ") q GROUP BY table_name")
def _(t):
    return ex.events_per_person({n: getattr(t, v) for n, (v, _) in TABLES.items()})


NAMES = """lu AS (SELECT concept_id AS cid, min(concept_name) AS nm FROM concept GROUP BY 1),
ev AS (SELECT person_id, condition_concept_id AS cid, nm FROM condition_occurrence LEFT JOIN lu ON condition_concept_id = cid)"""


@query("h02_prevalence", f"""WITH {NAMES},
a AS (SELECT nm, count(DISTINCT person_id) AS n FROM ev GROUP BY nm),
b AS (SELECT nm, count(DISTINCT person_id) AS n FROM condition_occurrence_s s JOIN (SELECT DISTINCT cid, nm FROM ev) e ON s.condition_concept_id = e.cid GROUP BY nm)
SELECT coalesce(a.nm, b.nm) AS concept_name, a.n AS n_orig, b.n AS n_new, round(a.n / (SELECT count(DISTINCT person_id) FROM person), 6) AS rate_orig,
  round(b.n / (SELECT count(DISTINCT person_id) FROM person_s), 6) AS rate_new FROM a FULL JOIN b ON a.nm IS NOT DISTINCT FROM b.nm""")
def _(t):
    named = concepts.attach_name(t.condition_occurrence, "condition_concept_id", "condition_concept_name", concepts.concept_lookup(t.concept))
    return ex.prevalence(named, t.person, t.condition_occurrence_s, t.person_s, "condition_concept_id", "condition_concept_name")


@query("h02_prevalence_summed", f"""WITH {NAMES},
a AS (SELECT nm, count(DISTINCT person_id) AS n FROM ev GROUP BY nm),
b AS (SELECT nm, CAST(sum(n) AS BIGINT) AS n FROM (SELECT condition_concept_id AS cid, count(DISTINCT person_id) AS n FROM condition_occurrence_s GROUP BY 1) s JOIN (SELECT DISTINCT cid, nm FROM ev) e ON s.cid = e.cid GROUP BY nm)
SELECT coalesce(a.nm, b.nm) AS concept_name, a.n AS n_orig, b.n AS n_new, round(a.n / (SELECT count(DISTINCT person_id) FROM person), 6) AS rate_orig,
  round(b.n / (SELECT count(DISTINCT person_id) FROM person_s), 6) AS rate_new FROM a FULL JOIN b ON a.nm IS NOT DISTINCT FROM b.nm""")
def _(t):
    named = concepts.attach_name(t.condition_occurrence, "condition_concept_id", "condition_concept_name", concepts.concept_lookup(t.concept))
    return ex.prevalence(named, t.person, t.condition_occurrence_s, t.person_s, "condition_concept_id", "condition_concept_name", sum_over_ids=True)


@query("h03_care_span", """SELECT person_id, min(visit_start_date) AS first_visit, max(visit_start_date) AS last_visit, count(*) AS n_visits,
  max(visit_start_date) - min(visit_start_date) AS span_days FROM visit_occurrence GROUP BY person_id""")
def _(t):
    return ex.care_span(t.visit_occurrence)


@query("h03_care_span_summary", f"SELECT 'care span' AS measure, {DESCRIBE} FROM (SELECT max(visit_start_date) - min(visit_start_date) AS x FROM visit_occurrence GROUP BY person_id) q")
def _(t):
    return ex.care_span_summary(t.visit_occurrence)


def _months():
    parts = " UNION ALL ".join(f"SELECT person_id, '{k}' AS kind, last_day({d}) AS month FROM {v} WHERE {d} IS NOT NULL" for k, (v, d) in TABLES.items())
    cols = ", ".join(f"CAST(count(*) FILTER (WHERE kind = '{k}') AS BIGINT) AS {k}" for k in TABLES)
    zero = ", ".join(f"coalesce(c.{k}, 0) AS {k}" for k in TABLES)
    return f"""WITH e AS ({parts}), s AS (SELECT person_id, kind, date_trunc('month', min(month)) AS a, date_trunc('month', max(month)) AS b FROM e GROUP BY 1, 2),
m AS (SELECT DISTINCT person_id, last_day(CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE)) AS month FROM s),
c AS (SELECT person_id, month, {cols} FROM e GROUP BY 1, 2)
SELECT m.person_id, m.month, {zero} FROM m LEFT JOIN c ON m.person_id = c.person_id AND m.month = c.month"""


@query("h04_monthly_timeline", _months())
def _(t):
    return ex.monthly_timeline({k: (getattr(t, v), d) for k, (v, d) in TABLES.items()})


GENDERS = [0, 8507, 8532]
DOMS = {"cond": ("condition_occurrence", "condition_concept_id"), "drug": ("drug_exposure", "drug_concept_id"), "proc": ("procedure_occurrence", "procedure_concept_id")}


def _features():
    years = list(zip(ex.BIRTH_EDGES, ex.BIRTH_EDGES[1:]))
    parts = [f"SELECT 'yob_{a}_{b}' AS feature, CAST(count(*) FILTER (WHERE year_of_birth >= {a} AND year_of_birth < {b}) AS BIGINT) AS total, count(*) FILTER (WHERE year_of_birth >= {a} AND year_of_birth < {b}) AS n_nonzero FROM person" for a, b in years]
    parts.append("SELECT 'yob_nan', count(*) FILTER (WHERE year_of_birth IS NULL OR year_of_birth < 1900 OR year_of_birth >= 2030), count(*) FILTER (WHERE year_of_birth IS NULL OR year_of_birth < 1900 OR year_of_birth >= 2030) FROM person")
    parts += [f"SELECT 'gender_{g}', count(*) FILTER (WHERE gender_concept_id = {g}), count(*) FILTER (WHERE gender_concept_id = {g}) FROM person" for g in GENDERS]
    parts += [f"SELECT * FROM (SELECT '{p}_' || CAST({c} AS STRING), count(*) AS n, count(DISTINCT person_id) FROM {v} GROUP BY {c} ORDER BY n DESC, {c} LIMIT 50)" for p, (v, c) in DOMS.items()]
    return " UNION ALL ".join(parts)


@query("h05_feature_matrix", _features())
def _(t):
    m = ex.feature_matrix(t.person, {p: (getattr(t, v), c) for p, (v, c) in DOMS.items()}, 50, GENDERS)
    names = [c for c in m.columns if c != "person_id"]
    long = m.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("long").alias("v")) for c in names])))
    return long.groupBy("feature").agg(F.sum("v").alias("total"), F.count_if(F.col("v") != 0).alias("n_nonzero"))


def _top_text(view, col, k):
    return f"""(SELECT person_id, string_agg(coalesce(nm || ' (' || CAST(c AS STRING) || ')', CAST(c AS STRING)) || ' x' || CAST(n AS STRING), '; ' ORDER BY r) AS txt FROM (
    SELECT person_id, {col} AS c, count(*) AS n, row_number() OVER (PARTITION BY person_id ORDER BY count(*) DESC, {col}) AS r FROM {view} GROUP BY 1, 2) q LEFT JOIN lu ON q.c = lu.cid WHERE r <= {k} GROUP BY person_id)"""


PROFILE = {"visits": ("visit_occurrence", "visit_concept_id", 5), "conditions": ("condition_occurrence", "condition_concept_id", 8),
           "drugs": ("drug_exposure", "drug_concept_id", 8), "procedures": ("procedure_occurrence", "procedure_concept_id", 8)}


@query("h07_patient_profiles", "WITH lu AS (SELECT concept_id AS cid, min(concept_name) AS nm FROM concept GROUP BY 1), " + ", ".join(
    f"t_{n} AS {_top_text(v, c, k)}" for n, (v, c, k) in PROFILE.items()) + """
SELECT p.person_id, year_of_birth, gender_concept_name AS gender, race_concept_name AS race, ethnicity_concept_name AS ethnicity, n_visits, first_visit, last_visit, """
       + ", ".join(f"t_{n}.txt AS top_{n}" for n in PROFILE) + """ FROM person p LEFT JOIN (SELECT person_id, count(*) AS n_visits, min(visit_start_date) AS first_visit, max(visit_start_date) AS last_visit FROM visit_occurrence GROUP BY 1) v ON p.person_id = v.person_id """
       + " ".join(f"LEFT JOIN t_{n} ON p.person_id = t_{n}.person_id" for n in PROFILE))
def _(t):
    return ex.patient_profiles(t.person, t.visit_occurrence, {n: (getattr(t, v), c, k) for n, (v, c, k) in PROFILE.items()},
                               concepts.concept_lookup(t.concept))


@query("h08_latest_values", """
WITH r AS (SELECT measurement_concept_id AS c, count(DISTINCT person_id) / (SELECT count(DISTINCT person_id) FROM person) AS rate FROM measurement GROUP BY 1),
l AS (SELECT measurement_concept_id AS c, person_id, value_as_number AS v FROM measurement WHERE value_as_number IS NOT NULL AND measurement_concept_id IN (SELECT c FROM r WHERE rate > 0.25)
  QUALIFY row_number() OVER (PARTITION BY measurement_concept_id, person_id ORDER BY measurement_date DESC, value_as_number DESC) = 1)
SELECT c AS measurement_concept_id, count(*) AS n, round(min(v), 5) AS min, round(avg(v), 5) AS mean, round(max(v), 5) AS max, round(median(v), 5) AS median FROM l GROUP BY c""", digits=5)
def _(t):
    rates = ex.concept_rates(t.measurement, t.person, "measurement_concept_id")
    return ex.latest_values(t.measurement, rates, 0.25)


def _gaps(view, name):
    return f"""SELECT person_id, count(*) AS total_visits, CASE WHEN count(*) > 1 THEN max(d) - min(d) END AS days_1_last,
  {', '.join(f'max(CASE WHEN rn = {k + 1} THEN d END) - max(CASE WHEN rn = {k} THEN d END) AS days_{k}_{k + 1}' for k in range(1, 5))}, '{name}' AS dataset
  FROM (SELECT person_id, visit_start_date AS d, row_number() OVER (PARTITION BY person_id ORDER BY visit_start_date) AS rn FROM {view}) q GROUP BY person_id"""


@query("h09_visit_gaps", f"{_gaps('visit_occurrence', 'original')} UNION ALL {_gaps('visit_occurrence_s', 'synthetic')}")
def _(t):
    return ex.compare_visit_gaps(t.visit_occurrence, t.visit_occurrence_s)


@query("h10_dashboard_counts", " UNION ALL ".join(f"SELECT '{v}' AS table_name, count(*) AS n_rows, count(DISTINCT person_id) AS n_persons FROM {v}" for v in ("person", *[v for v, _ in TABLES.values()])))
def _(t):
    return tablesets.table_counts({v: getattr(t, v) for v in ("person", *[v for v, _ in TABLES.values()])})
