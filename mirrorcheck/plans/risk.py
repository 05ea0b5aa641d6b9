"""Queries for identity and attribute disclosure."""

from ..operators import attribute, identity
from .registry import query

KEYS = ["gender_concept_name", "year_of_birth", "race_concept_name"]
TARGETS = ["flag_high", "flag_debt", "ethnicity_concept_name"]
K = ", ".join(KEYS)

COUNTS = f"""
WITH k AS (SELECT {K}, count(*) FILTER (WHERE s = 0) AS n_o, count(*) FILTER (WHERE s = 1) AS n_s FROM (
  SELECT {K}, 0 AS s FROM person UNION ALL SELECT {K}, 1 FROM person_s) u GROUP BY {K})"""


@query("e01_identity_disclosure", COUNTS + """
SELECT round(100.0 * count(*) FILTER (WHERE n_s = 1) / sum(n_o), 6) AS uis,
  round(100.0 * count(*) FILTER (WHERE n_o = 1) / sum(n_o), 6) AS uio,
  round(100.0 * count(*) FILTER (WHERE n_o = 1 AND n_s = 1) / sum(n_o), 6) AS repu,
  round(100.0 * count(*) FILTER (WHERE n_o = 1 AND n_s > 0) / sum(n_o), 6) AS uiois FROM k""")
def _(t):
    return identity.identity_disclosure(t.person, t.person_s, KEYS)


def _same(a, b, cols):
    return " AND ".join(f"{a}.{c} IS NOT DISTINCT FROM {b}.{c}" for c in cols)


def _measures(target, pick):
    """Row-level SQL, written from the definitions with semi joins."""
    kt = [*KEYS, "tgt"]
    return f"""
  SELECT '{target}' AS target, {pick} FROM (
    WITH o AS (SELECT {K}, CAST({target} AS STRING) AS tgt FROM person), s AS (SELECT {K}, CAST({target} AS STRING) AS tgt FROM person_s),
    dis_o AS (SELECT {K} FROM o GROUP BY {K} HAVING count(DISTINCT coalesce(tgt, '<null>')) = 1),
    dis_s AS (SELECT {K} FROM s GROUP BY {K} HAVING count(DISTINCT coalesce(tgt, '<null>')) = 1),
    syn AS (SELECT s.* FROM s SEMI JOIN dis_s d ON {_same('s', 'd', KEYS)}),
    dis_om AS (SELECT d.* FROM dis_o d SEMI JOIN s ON {_same('d', 's', KEYS)}),
    alt_1 AS (SELECT d.* FROM dis_om d SEMI JOIN (SELECT * FROM s WHERE tgt = '1') x ON {_same('d', 'x', KEYS)}),
    alt_0 AS (SELECT d.* FROM dis_om d SEMI JOIN (SELECT * FROM s WHERE tgt = '0') x ON {_same('d', 'x', KEYS)}),
    syn_1 AS (SELECT s.* FROM s SEMI JOIN alt_1 d ON {_same('s', 'd', KEYS)}),
    syn_0 AS (SELECT s.* FROM s SEMI JOIN alt_0 d ON {_same('s', 'd', KEYS)})
    SELECT (SELECT count(*) FROM o) AS n_o, (SELECT count(*) FROM s) AS n_s,
      (SELECT count(*) FROM o SEMI JOIN dis_o d ON {_same('o', 'd', KEYS)}) AS dorig,
      (SELECT count(*) FROM syn) AS dsyn,
      (SELECT count(*) FROM (SELECT o.* FROM o SEMI JOIN dis_om d ON {_same('o', 'd', KEYS)}) o SEMI JOIN syn ON {_same('o', 'syn', kt)}) AS disdio,
      (SELECT count(*) FROM o SEMI JOIN syn ON {_same('o', 'syn', kt)}) AS disco,
      (SELECT count(*) FROM o SEMI JOIN s ON {_same('o', 's', KEYS)}) AS m,
      (SELECT count(*) FROM o SEMI JOIN syn_1 x ON {_same('o', 'x', kt)}) AS t1,
      (SELECT count(*) FROM o SEMI JOIN syn_0 x ON {_same('o', 'x', kt)}) AS t0) z"""


def _per_target(pick):
    return " UNION ALL ".join(_measures(x, pick) for x in TARGETS)


@query("e02_disclosive_share", _per_target("round(100.0 * dorig / n_o, 6) AS dorig, round(100.0 * dsyn / n_s, 6) AS dsyn"))
def _(t):
    return attribute.attribute_disclosure(t.person, t.person_s, KEYS, TARGETS).select("target", "dorig", "dsyn")


@query("e03_disclosive_in_both", _per_target("round(100.0 * disdio / n_o, 6) AS disdio"))
def _(t):
    return attribute.attribute_disclosure(t.person, t.person_s, KEYS, TARGETS).select("target", "disdio")


@query("e04_correct_attribution", _per_target("round(100.0 * disco / n_o, 6) AS disco, round(100.0 * disco / m, 6) AS tcap"))
def _(t):
    return attribute.attribute_disclosure(t.person, t.person_s, KEYS, TARGETS).select("target", "disco", "tcap")


@query("e05_targeted_attribution", _per_target("round(100.0 * t1 / m, 6) AS tcap_1, round(100.0 * t0 / m, 6) AS tcap_0"))
def _(t):
    return attribute.attribute_disclosure(t.person, t.person_s, KEYS, TARGETS).select("target", "tcap_1", "tcap_0")


E06_PICK = """round(100.0 * dorig / n_o, 6) AS dorig, round(100.0 * dsyn / n_s, 6) AS dsyn, round(100.0 * disdio / n_o, 6) AS disdio,
  round(100.0 * disco / n_o, 6) AS disco, round(100.0 * disco / m, 6) AS tcap, round(100.0 * t1 / m, 6) AS tcap_1, round(100.0 * t0 / m, 6) AS tcap_0"""


@query("e06_attribute_table", f"""
WITH w AS ({_per_target(E06_PICK)}), l AS (UNPIVOT w ON {', '.join(attribute.MEASURES)} INTO NAME measure VALUE percent)
SELECT measure, {', '.join(f"max(percent) FILTER (WHERE target = '{x}') AS {x}" for x in TARGETS)} FROM l GROUP BY measure""")
def _(t):
    return attribute.attribute_table(t.person, t.person_s, KEYS, TARGETS)


VARS = [*KEYS, "ethnicity_concept_name", "flag_high"]


@query("e07_exact_match", f"""
SELECT n_matched, n_new, round(100.0 * n_matched / n_new, 6) AS exact_match_pct FROM (
SELECT count(*) FILTER (WHERE EXISTS (SELECT 1 FROM person o WHERE {_same('o', 's', VARS)})) AS n_matched, count(*) AS n_new FROM person_s s) x""")
def _(t):
    return identity.exact_match(t.person, t.person_s, VARS)


def _rare(target):
    return f"""SELECT '{target}' AS target, CAST(sum(CASE WHEN 100.0 * n / tot < 20 THEN n ELSE 0 END) AS BIGINT) AS n_rare,
  round(100.0 * sum(CASE WHEN 100.0 * n / tot < 20 THEN n ELSE 0 END) / (SELECT count(*) FROM person_s), 6) AS p_outliers FROM (
  SELECT {target}, count(*) AS n, sum(count(*)) OVER () AS tot FROM person_s s SEMI JOIN person o ON {_same('o', 's', KEYS)} GROUP BY {target}) x"""


@query("e08_rare_levels", " UNION ALL ".join(_rare(x) for x in TARGETS))
def _(t):
    return attribute.rare_levels(t.person, t.person_s, KEYS, TARGETS, threshold=20.0)
