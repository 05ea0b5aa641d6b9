"""Queries for sequences and date shifting."""

from pyspark.sql import functions as F

from ..functions.session import scratch_folder
from ..operators import episodes
from ..operators import sequences as sq
from .registry import query

LINK = """linked AS (SELECT m.person_id, m.measurement_date, m.measurement_concept_id, (SELECT min(visit_occurrence_id) FROM visit_occurrence v WHERE v.person_id = m.person_id
  AND m.measurement_date BETWEEN visit_start_date AND coalesce(visit_end_date, visit_start_date)) AS visit_occurrence_id FROM measurement m)"""


@query("i01_link_to_visit", f"WITH {LINK} SELECT person_id, measurement_date, measurement_concept_id, visit_occurrence_id, count(*) AS n FROM linked GROUP BY 1, 2, 3, 4")
def _(t):
    out = episodes.link_to_visit(t.measurement, t.visit_occurrence, "measurement_date")
    return out.groupBy("person_id", "measurement_date", "measurement_concept_id", "visit_occurrence_id").agg(F.count("*").alias("n"))


@query("i01_match_rate", f"WITH {LINK} SELECT count(*) AS n_rows, count(visit_occurrence_id) AS n_matched, round(100.0 * count(visit_occurrence_id) / count(*), 6) AS match_pct FROM linked")
def _(t):
    return sq.match_rate(episodes.link_to_visit(t.measurement, t.visit_occurrence, "measurement_date"))


@query("i02_qualified_concepts", """SELECT concept_id, count(DISTINCT person_id) AS n_persons FROM (SELECT person_id, CAST(condition_concept_id AS BIGINT) AS concept_id FROM condition_occurrence
  UNION ALL SELECT person_id, drug_concept_id FROM drug_exposure UNION ALL SELECT person_id, procedure_concept_id FROM procedure_occurrence) x GROUP BY 1 HAVING count(DISTINCT person_id) >= 100""")
def _(t):
    return sq.qualified_concepts([(t.condition_occurrence, "condition_concept_id"), (t.drug_exposure, "drug_concept_id"),
                                  (t.procedure_occurrence, "procedure_concept_id")], 100)


EVENTS = """SELECT person_id, l_orderkey AS visit_occurrence_id, 1000 + l_partkey % 203 AS concept_id, CASE WHEN l_linenumber % 2 = 1 THEN l_quantity END AS number_value,
  CASE WHEN l_linenumber = 4 THEN l_returnflag END AS concept_value FROM sequence_tokens"""

TOKENS = f"""ev AS ({EVENTS}),
vis AS (SELECT *, lag(visit_start_date) OVER (PARTITION BY person_id ORDER BY visit_start_date, visit_occurrence_id) AS bef FROM visit_occurrence),
fst AS (SELECT v.person_id, min(visit_start_date) AS d FROM visit_occurrence v GROUP BY 1),
tok AS (
  SELECT f.person_id, d AS day, CAST(-1 AS BIGINT) AS visit, 0 AS part, '' AS sort, 'year:' || CAST(year(d) AS STRING) AS token, CAST(NULL AS DOUBLE) AS number, CAST(NULL AS STRING) AS txt FROM fst f
  UNION ALL SELECT f.person_id, d, -1, 1, '', 'age:' || CAST(year(d) - year_of_birth AS STRING), NULL, NULL FROM fst f JOIN person p ON f.person_id = p.person_id WHERE year_of_birth IS NOT NULL
  UNION ALL SELECT f.person_id, d, -1, 2, '', CAST(gender_concept_id AS STRING), NULL, NULL FROM fst f JOIN person p ON f.person_id = p.person_id
  UNION ALL SELECT person_id, visit_start_date, visit_occurrence_id, 3, '', 'i-D' || CAST(visit_start_date - bef AS STRING), NULL, NULL FROM vis WHERE bef IS NOT NULL
  UNION ALL SELECT person_id, visit_start_date, visit_occurrence_id, 4, '', '[VS]', NULL, NULL FROM vis
  UNION ALL SELECT person_id, visit_start_date, visit_occurrence_id, 5, '', CAST(visit_concept_id AS STRING), NULL, NULL FROM vis
  UNION ALL SELECT person_id, visit_start_date, visit_occurrence_id, 7, '', '[VE]', NULL, NULL FROM vis
  UNION ALL SELECT v.person_id, visit_start_date, v.visit_occurrence_id, 6, lpad(CAST(concept_id AS STRING), 20, '0'), CAST(concept_id AS STRING), number_value, concept_value
    FROM vis v JOIN ev ON v.person_id = ev.person_id AND v.visit_occurrence_id = ev.visit_occurrence_id)"""


def seqs_of(t, max_tokens=None):
    events = t.sequence_tokens.select(
        "person_id", F.col("l_orderkey").alias("visit_occurrence_id"), (1000 + F.col("l_partkey") % 203).alias("concept_id"),
        F.when(F.col("l_linenumber") % 2 == 1, F.col("l_quantity")).alias("number_value"),
        F.when(F.col("l_linenumber") == 4, F.col("l_returnflag")).alias("concept_value"))
    return sq.build_sequences(t.person, t.visit_occurrence, events, max_tokens)


@query("i03_clean_sequences", f"""WITH {TOKENS}, s AS (SELECT tok.person_id, count(*) AS num_of_concepts, CAST(sum(coalesce(year(day) - year_of_birth, 0)) AS BIGINT) AS age_sum,
  CAST(sum(date_diff('day', DATE '1970-01-01', day) // 7) AS BIGINT) AS date_sum FROM tok JOIN person p ON tok.person_id = p.person_id GROUP BY 1)
SELECT * FROM s WHERE num_of_concepts <= 120""")
def _(t):
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return sq.clean_sequences(seqs_of(t), 120).select(
        "person_id", F.col("num_of_concepts").cast("long").alias("num_of_concepts"), total("ages").alias("age_sum"), total("dates").alias("date_sum"))


@query("i03_kept_share", f"""WITH {TOKENS}, s AS (SELECT person_id, count(*) AS k FROM tok GROUP BY 1)
SELECT count(*) AS n_sequences, count(*) FILTER (WHERE k <= 120) AS n_kept, round(100.0 * count(*) FILTER (WHERE k <= 120) / count(*), 6) AS kept_pct FROM s""")
def _(t):
    return sq.kept_share(seqs_of(t), 120)


GAP = "CASE l_linenumber % 5 WHEN 0 THEN 'i-D' || CAST(l_quantity AS INT) WHEN 1 THEN 'i-D-' || CAST(l_quantity AS INT) WHEN 2 THEN 'D' || CAST(l_quantity AS INT) WHEN 3 THEN 'broken' ELSE '[VS]' END"


@query("i04_gap_days", f"""SELECT token, CASE l_linenumber % 5 WHEN 0 THEN q WHEN 2 THEN q ELSE 0 END AS days, count(*) AS n FROM (
  SELECT {GAP} AS token, l_linenumber, CAST(l_quantity AS INT) AS q FROM lineitem) x GROUP BY 1, 2""")
def _(t):
    tokens = t.lineitem.select(F.expr(GAP).alias("token"))
    return tokens.groupBy("token", sq.gap_days(F.col("token")).alias("days")).agg(F.count("*").alias("n"))


U = "(CAST('0x' || substr(md5('{s}:' || CAST({k} AS STRING)), 1, 8) AS BIGINT) / 4294967296.0)"
SHIFT = f"""sh AS (SELECT f.person_id, CAST(lo + CAST(floor({U.format(s=7, k='f.person_id')} * (greatest(make_date(year(f), 12, 31) - lo, 0) + 1)) AS INT) - f AS INT) AS shift_days FROM (
  SELECT v.person_id, f, make_date(greatest(year(f), coalesce(year_of_birth, year(f))), 1, 1) AS lo FROM (SELECT person_id, min(visit_start_date) AS f FROM visit_occurrence GROUP BY 1) v JOIN person p ON v.person_id = p.person_id) f)"""


@query("i05_person_shifts", f"WITH {SHIFT} SELECT * FROM sh")
def _(t):
    return sq.person_shifts(t.person, t.visit_occurrence)


@query("i05_shifted_visits", f"""WITH {SHIFT} SELECT v.visit_occurrence_id, visit_start_date + coalesce(shift_days, 0) AS visit_start_date, visit_end_date + coalesce(shift_days, 0) AS visit_end_date
FROM visit_occurrence v LEFT JOIN sh ON v.person_id = sh.person_id""")
def _(t):
    shifts = sq.person_shifts(t.person, t.visit_occurrence)
    return sq.shift_events({"v": t.visit_occurrence}, shifts)["v"].select("visit_occurrence_id", "visit_start_date", "visit_end_date")


@query("i06_build_sequences", f"""WITH {TOKENS} SELECT person_id, string_agg(token, ' ' ORDER BY day, visit, part, sort, number NULLS FIRST, txt NULLS FIRST) AS tokens, count(*) AS num_of_concepts,
  count(*) FILTER (WHERE number IS NOT NULL OR txt IS NOT NULL) AS n_values FROM tok GROUP BY person_id""")
def _(t):
    return seqs_of(t).select(
        "person_id", F.array_join("concept_ids", " ").alias("tokens"), F.col("num_of_concepts").cast("long").alias("num_of_concepts"),
        F.aggregate("concept_value_masks", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_values"))


@query("i07_sequence_events", f"""WITH ev AS ({EVENTS}), f AS (SELECT person_id, min(visit_start_date) AS d FROM visit_occurrence GROUP BY 1)
SELECT v.person_id, CAST(ev.concept_id AS BIGINT) AS concept_id, c.domain_id, make_date(year(d), 1, 1) + CAST(visit_start_date - d AS INT) AS event_date, number_value AS value_as_number, count(*) AS n
FROM visit_occurrence v JOIN f ON v.person_id = f.person_id JOIN ev ON v.person_id = ev.person_id AND v.visit_occurrence_id = ev.visit_occurrence_id
JOIN (SELECT concept_id, min(domain_id) AS domain_id FROM concept GROUP BY 1) c ON ev.concept_id = c.concept_id GROUP BY 1, 2, 3, 4, 5""")
def _(t):
    return sq.sequence_events(seqs_of(t), t.concept).groupBy("person_id", "concept_id", "domain_id", "event_date", "value_as_number").agg(
        F.count("*").alias("n"))


ROUTES = {"condition_occurrence": "Condition", "drug_exposure": "Drug", "procedure_occurrence": "Procedure", "measurement": "Measurement"}


@query("i07_routed_events", f"""WITH ev AS ({EVENTS})
SELECT CASE c.domain_id {' '.join(f"WHEN '{d}' THEN '{n}'" for n, d in ROUTES.items())} END AS table_name, count(*) AS n_events, count(DISTINCT v.person_id) AS n_persons, count(number_value) AS n_numbers
FROM visit_occurrence v JOIN ev ON v.person_id = ev.person_id AND v.visit_occurrence_id = ev.visit_occurrence_id
JOIN (SELECT concept_id, min(domain_id) AS domain_id FROM concept GROUP BY 1) c ON ev.concept_id = c.concept_id WHERE c.domain_id IN ({', '.join(f"'{d}'" for d in ROUTES.values())}) GROUP BY 1""")
def _(t):
    """The event tables as written by domain, counted when read back."""
    path = scratch_folder(t.spark)
    sq.write_routed(sq.sequence_events(seqs_of(t), t.concept), ROUTES, path)
    return t.spark.read.parquet(path).groupBy("table_name").agg(
        F.count("*").alias("n_events"), F.count_distinct("person_id").alias("n_persons"), F.count("value_as_number").alias("n_numbers"))


@query("i08_random_birthdays", f"""SELECT person_id, month_of_birth, CAST(1 + floor({U.format(s='7d', k='person_id')} * day(last_day(make_date(year_of_birth, month_of_birth, 1)))) AS INT) AS day_of_birth FROM (
  SELECT person_id, year_of_birth, CAST(1 + floor({U.format(s='7m', k='person_id')} * 12) AS INT) AS month_of_birth FROM person) x""")
def _(t):
    return sq.random_birthdays(t.person).select("person_id", "month_of_birth", "day_of_birth")


@query("i09_value_audit", f"""WITH {TOKENS}, s AS (SELECT person_id, count(*) FILTER (WHERE number IS NOT NULL OR txt IS NOT NULL) AS m, count(*) FILTER (WHERE number <> 0) AS nn,
  count(*) FILTER (WHERE txt <> '') AS tt, count(*) FILTER (WHERE token IN ('4306655', '4304866', '4267568', '443768')) AS dd FROM tok GROUP BY 1)
SELECT count(*) AS n_sequences, count(*) FILTER (WHERE m > 0) AS with_values, CAST(sum(nn) AS BIGINT) AS total_values, count(*) FILTER (WHERE tt > 0) AS with_categories,
  count(*) FILTER (WHERE dd > 0) AS with_death, round(100.0 * count(*) FILTER (WHERE m > 0) / count(*), 6) AS with_values_pct FROM s""")
def _(t):
    return sq.value_audit(seqs_of(t))


KNOWN = "(SELECT DISTINCT CAST(concept_id AS STRING) AS c FROM concept)"


@query("h06_token_shares", f"""WITH {TOKENS} SELECT {', '.join(f"round(count(*) FILTER (WHERE {c}) / count(*), 6) AS {n}" for c, n in [("token = '[VS]'", 'visit_start_share'), ("token = '[VE]'", 'visit_end_share'), ("token LIKE 'year:%'", 'year_share'), ("token LIKE 'age:%'", 'age_share'), ("part IN (2, 5, 6)", 'numeric_share')])},
  round(count(*) FILTER (WHERE part IN (2, 5, 6) AND token IN (SELECT c FROM {KNOWN} k)) / count(*) FILTER (WHERE part IN (2, 5, 6)), 6) AS known_share FROM tok""")
def _(t):
    return sq.token_shares(seqs_of(t), t.concept)


@query("h06_unknown_tokens", f"""WITH {TOKENS} SELECT token, count(*) AS n FROM tok WHERE part IN (2, 5, 6) AND token NOT IN (SELECT c FROM {KNOWN} k) GROUP BY token ORDER BY n DESC, token LIMIT 25""")
def _(t):
    return sq.unknown_tokens(seqs_of(t), t.concept)


@query("h06_sequence_lengths", f"""WITH {TOKENS}, s AS (SELECT count(*) AS x FROM tok GROUP BY person_id) SELECT 'tokens' AS measure, count(*) AS n, CAST(min(x) AS DOUBLE) AS min, round(avg(x), 6) AS mean, CAST(max(x) AS DOUBLE) AS max,
  {', '.join(f'round(quantile_cont(x, {p}), 6) AS p{int(p * 100)}' for p in (0.5, 0.75, 0.9, 0.95, 0.99))} FROM s""")
def _(t):
    return sq.sequence_lengths(seqs_of(t))
