"""Queries for the vaccine-effectiveness study."""

from pyspark.sql import functions as F

from ..functions.session import stable, stored
from ..functions.stats import normal_quantile
from ..operators import episodes, facts
from ..operators import vaccine_study as vs
from .cohort import FACTS, FLOOR, cohort_of, fact_days_of, stored_cohort
from .registry import query

Z = normal_quantile(0.975)
DESIGN = vs.StudyDesign(diagnoses=["FLU", "ARI"], vaccination="VACC")

PERSONS = """elig AS (SELECT person_id, age, sex, race_ethnicity FROM cohort WHERE upper(sex) IN ('MALE', 'FEMALE') AND lower(race_ethnicity) <> 'unknown')"""
LONG = """longer AS (SELECT * FROM episodes WHERE combined_macrovisit_start_date < combined_macrovisit_end_date)"""
ILL = """ill AS (SELECT * FROM longer l WHERE person_id IN (SELECT person_id FROM elig) AND EXISTS (SELECT 1 FROM fact_days f WHERE f.person_id = l.person_id
  AND (FLU = 1 OR ARI = 1) AND f.date BETWEEN combined_macrovisit_start_date AND combined_macrovisit_end_date))"""
TESTS = """tests AS (SELECT i.person_id, i.combined_macrovisit_id, max(greatest(INFLUENZA_POS, INFLUENZA_NEG)) AS has_influenza_test,
  max(greatest(PCR_AG_Pos, PCR_AG_Neg)) AS has_virus_test, max(INFLUENZA_POS) AS positive_influenza_test
  FROM ill i JOIN fact_days f ON f.person_id = i.person_id AND f.date BETWEEN combined_macrovisit_start_date - 10 AND combined_macrovisit_end_date + 3
  WHERE INFLUENZA_POS = 1 OR INFLUENZA_NEG = 1 OR PCR_AG_Pos = 1 OR PCR_AG_Neg = 1 GROUP BY 1, 2),
tested AS (SELECT i.*, t.positive_influenza_test FROM ill i JOIN tests t ON i.combined_macrovisit_id = t.combined_macrovisit_id
  WHERE has_influenza_test = 1 AND has_virus_test = 1)"""
KEPT = """kept AS (SELECT * FROM tested t WHERE NOT EXISTS (SELECT 1 FROM fact_days f WHERE f.person_id = t.person_id AND VACC = 1
  AND f.date BETWEEN combined_macrovisit_start_date - 14 AND combined_macrovisit_start_date))"""
STATUS = """status AS (SELECT k.*, CASE WHEN EXISTS (SELECT 1 FROM fact_days f WHERE f.person_id = k.person_id AND VACC = 1
  AND f.date >= combined_macrovisit_start_date - 90 AND f.date < combined_macrovisit_start_date) THEN 1 ELSE 0 END AS vaccinated FROM kept k)"""
ANALYSIS = """analysis AS (SELECT s.person_id, combined_macrovisit_id, combined_macrovisit_start_date, combined_macrovisit_end_date,
  positive_influenza_test, vaccinated, age, sex, race_ethnicity FROM status s LEFT JOIN elig e ON s.person_id = e.person_id)"""
TABLE = """counts AS (SELECT count(DISTINCT person_id) AS included_patients, count(*) AS included_hospitalizations,
  count(*) FILTER (WHERE positive_influenza_test = 1 AND vaccinated = 1) AS vaccinated_cases,
  count(*) FILTER (WHERE positive_influenza_test = 0 AND vaccinated = 1) AS vaccinated_controls,
  count(*) FILTER (WHERE positive_influenza_test = 1 AND vaccinated = 0) AS unvaccinated_cases,
  count(*) FILTER (WHERE positive_influenza_test = 0 AND vaccinated = 0) AS unvaccinated_controls FROM analysis)"""
CHAIN = [PERSONS, LONG, ILL, TESTS, KEPT, STATUS, ANALYSIS, TABLE]


def upto(n, tail):
    return f"WITH {FACTS}, {', '.join(CHAIN[:n])} {tail}"


def inputs(t):
    """What the study reads of the fact days (stored once, several steps read it), cohort and episodes."""
    people = stored_cohort(t)
    sources, deaths = fact_days_of(t, people, [DESIGN.outcome_positive, DESIGN.outcome_negative, *DESIGN.other_tests])
    days = stored(vs.study_days(facts.fact_days(t.visit_occurrence, sources, deaths, FLOOR), DESIGN))
    return days, people, episodes.combined_episodes(t.visit_occurrence)


def ill_of(t):
    """Each step reads its episodes several times, so they are stored before it."""
    days, people, eps = inputs(t)
    elig = vs.eligible_persons(people).select("person_id")
    longer = stored(vs.long_episodes(eps).join(elig, "person_id", "left_semi"))
    return days, vs.episodes_with_diagnosis(longer, days, DESIGN.diagnoses)


def stored_ill_of(t):
    days, ill = ill_of(t)
    return days, stored(ill)


@query("c01_eligible_persons", upto(1, "SELECT * FROM elig"))
def _(t):
    return vs.eligible_persons(cohort_of(t)).select("person_id", "age", "sex", "race_ethnicity")


@query("c02_long_episodes", upto(2, "SELECT * FROM longer"))
def _(t):
    return vs.long_episodes(episodes.combined_episodes(t.visit_occurrence))


@query("c03_diagnosed_episodes", upto(3, "SELECT * FROM ill"))
def _(t):
    return ill_of(t)[1]


@query("c04_episode_tests", upto(4, "SELECT * FROM tests"))
def _(t):
    days, ill = stored_ill_of(t)
    return vs.episode_tests(ill, days, DESIGN)


@query("c05_fully_tested", upto(4, "SELECT * FROM tests WHERE has_influenza_test = 1 AND has_virus_test = 1"))
def _(t):
    days, ill = stored_ill_of(t)
    return vs.fully_tested(vs.episode_tests(ill, days, DESIGN))


def tested_of(t):
    days, ill = stored_ill_of(t)
    tests = vs.fully_tested(vs.episode_tests(ill, days, DESIGN)).select("person_id", vs.EPISODE, "positive_influenza_test")
    return days, stored(ill.join(tests, ["person_id", vs.EPISODE]))


@query("c06_drop_recently_vaccinated", upto(5, "SELECT * FROM kept"))
def _(t):
    days, tested = tested_of(t)
    return vs.drop_recently_vaccinated(tested, days, DESIGN)


@query("c07_vaccination_status", upto(6, "SELECT * FROM status"))
def _(t):
    days, tested = tested_of(t)
    return vs.vaccination_status(stored(vs.drop_recently_vaccinated(tested, days, DESIGN)), days, DESIGN)


def analysis_of(t):
    days, people, eps = inputs(t)
    return vs.analysis_table(days, people, eps, DESIGN)


@query("c08_analysis_counts", upto(8, "SELECT * FROM counts"))
def _(t):
    return vs.two_by_two(analysis_of(t))


@query("c08_analysis_table", upto(7, "SELECT * FROM analysis"))
def _(t):
    return analysis_of(t)


@query("c09_unadjusted_estimates", upto(8, f""", w AS (SELECT ln(vaccinated_cases * unvaccinated_controls / (1.0 * vaccinated_controls * unvaccinated_cases)) AS b,
  sqrt(1.0 / vaccinated_cases + 1.0 / vaccinated_controls + 1.0 / unvaccinated_cases + 1.0 / unvaccinated_controls) AS s FROM counts)
SELECT 'Unadjusted Odds Ratio' AS statistic, round(exp(b), 6) AS point_estimate, round(exp(b) * s, 6) AS standard_error,
  round(exp(b - {Z} * s), 6) AS ci_lower, round(exp(b + {Z} * s), 6) AS ci_upper FROM w
UNION ALL SELECT 'Unadjusted Effectiveness', round(100 * (1 - exp(b)), 6), round(100 * exp(b) * s, 6),
  round(100 * (1 - exp(b + {Z} * s)), 6), round(100 * (1 - exp(b - {Z} * s)), 6) FROM w"""))
def _(t):
    return vs.unadjusted_estimates(analysis_of(t))


@query("c10_adjusted_estimates", digits=5)
def _(t):
    return vs.adjusted_estimates(stable(analysis_of(t)))


class _Twin:
    """The same tables with the synthetic visits and measurements in place of the original ones."""

    def __init__(self, t):
        self._t = t

    def __getattr__(self, name):
        swapped = {"visit_occurrence": "visit_occurrence_s", "condition_occurrence": "condition_occurrence_s",
                   "measurement": "measurement_s", "person": "person_s"}
        df = getattr(self._t, swapped.get(name, name))
        if name == "visit_occurrence":
            df = df.withColumnRenamed("discharged_to_concept_id", "discharge_to_concept_id")
        return df


@query("c11_compare_studies", digits=5)
def _(t):
    return vs.compare_studies(stable(analysis_of(t)), stable(analysis_of(_Twin(t))))
