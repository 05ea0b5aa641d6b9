"""Queries for proximity-based attribution."""

from pyspark.sql import functions as F

from ..operators import attribution as at
from .registry import query

KEYS, KEY_R = ["gender_concept_name", "race_concept_name", "partner"], {"year_of_birth": 2.0}
TARGETS, TARGET_R = ["ethnicity_concept_name"], {"income": 487.0}
CATS, RADII = [*KEYS, *TARGETS], {**KEY_R, **TARGET_R}


def rows_of(df):
    return df.withColumn("partner", F.col("data_partner_id").cast("string"))


def _same(a, b, cols):
    return " AND ".join(f"{a}.{c} IS NOT DISTINCT FROM {b}.{c}" for c in cols)


def _k(a, b, c, r):
    return f"(CASE WHEN {a}.{c} IS NULL OR {b}.{c} IS NULL THEN 1.0 ELSE greatest(0.0, 1.0 - abs({a}.{c} - {b}.{c}) / {r}) END)"


COLS = "person_id, gender_concept_name, race_concept_name, CAST(data_partner_id AS STRING) AS partner, ethnicity_concept_name, CAST(year_of_birth AS DOUBLE) AS year_of_birth, income"
UNIQUE = f"""o AS (SELECT {COLS} FROM person), s AS (SELECT {COLS} FROM person_s),
uq AS (SELECT * FROM o a WHERE NOT EXISTS (SELECT 1 FROM o b WHERE b.person_id <> a.person_id AND {_same('a', 'b', CATS)})
  OR NOT EXISTS (SELECT 1 FROM o b WHERE b.person_id <> a.person_id AND {_same('a', 'b', CATS)} AND ({' OR '.join(f'abs(a.{c} - b.{c}) < {r}' for c, r in RADII.items())})))"""
BASE = f"""base AS (SELECT q.person_id, sum({_k('q', 'd', 'income', 487.0)}) / (SELECT count(*) FROM o) AS baseline FROM uq q JOIN o d ON {_same('q', 'd', TARGETS)} GROUP BY q.person_id)"""


def cap(name, data):
    return f"""{name} AS (SELECT q.person_id, CASE WHEN coalesce(sum({_k('q', 'd', 'year_of_birth', 2.0)}), 0) = 0 THEN 0 ELSE
  sum(CASE WHEN {_same('q', 'd', TARGETS)} THEN {_k('q', 'd', 'year_of_birth', 2.0)} * {_k('q', 'd', 'income', 487.0)} ELSE 0 END) / sum({_k('q', 'd', 'year_of_birth', 2.0)}) END AS cap
  FROM uq q LEFT JOIN {data} d ON {_same('q', 'd', KEYS)} WHERE d.person_id IS NOT NULL GROUP BY q.person_id)"""


ROWS = f"""{UNIQUE}, {BASE}, {cap('co', 'o')}, {cap('cs', 's')},
res AS (SELECT q.person_id, coalesce(baseline, 0) AS baseline, coalesce(co.cap, 0) AS cap_orig, coalesce(cs.cap, 0) AS cap_new FROM uq q LEFT JOIN base ON q.person_id = base.person_id
  LEFT JOIN co ON q.person_id = co.person_id LEFT JOIN cs ON q.person_id = cs.person_id)"""


def queries_of(t):
    o = rows_of(t.person)
    return o, o.join(at.unique_rows(o, "person_id", CATS, RADII), "person_id")


@query("e09_unique_rows", f"WITH {UNIQUE} SELECT person_id, 1 AS times FROM uq")
def _(t):
    return at.unique_rows(rows_of(t.person), "person_id", CATS, RADII)


PROX = "CASE WHEN " + _same("a", "b", ["gender_concept_name", "race_concept_name"]) + f" THEN ({_k('a', 'b', 'year_of_birth', 3.0)} + {_k('a', 'b', 'income', 997.0)}) / 2 ELSE 0 END"


@query("e10_proximity", f"SELECT a.person_id, round({PROX}, 6) AS proximity FROM person a JOIN person_s b ON a.person_id = b.person_id")
def _(t):
    names = ["gender_concept_name", "race_concept_name", "year_of_birth", "income"]
    twin = t.person_s.select("person_id", *[F.col(c).alias(f"s_{c}") for c in names])
    pair = {c: (F.col(c), F.col(f"s_{c}")) for c in names}
    return t.person.select("person_id", *names).join(twin, "person_id").select("person_id", at.proximity(
        [pair[names[0]], pair[names[1]]], [(*pair[names[2]], 3.0), (*pair[names[3]], 997.0)]).alias("proximity"))


@query("e11_attribution_baseline", f"WITH {UNIQUE}, {BASE} SELECT person_id, round(baseline, 6) AS baseline FROM base")
def _(t):
    o, q = queries_of(t)
    return at.attribution_baseline(q, o, "person_id", TARGETS, TARGET_R)


@query("e12_correct_attribution", f"WITH {ROWS} SELECT person_id, round(cap_new, 6) AS cap FROM res")
def _(t):
    _, q = queries_of(t)
    return at.correct_attribution(q, rows_of(t.person_s), "person_id", KEYS, KEY_R, TARGETS, TARGET_R)


def _rows(t):
    return at.attribution_rows(rows_of(t.person), rows_of(t.person_s), "person_id", KEYS, KEY_R, TARGETS, TARGET_R)


@query("e13_attribution_rows", f"""WITH {ROWS} SELECT person_id, 1 AS times, round(baseline, 6) AS baseline, round(cap_orig, 6) AS cap_orig, round(cap_new, 6) AS cap_new,
  round(CASE WHEN abs(cap_orig - baseline) <= 1e-12 THEN NULL WHEN baseline - cap_new > 1e-12 OR baseline > cap_orig THEN 0 WHEN cap_new - cap_orig > 1e-12 THEN 1 ELSE (cap_new - baseline) / (cap_orig - baseline) END, 6) AS value FROM res""")
def _(t):
    return _rows(t)


@query("e13_attribution_score", f"""WITH {ROWS} SELECT count(*) AS n_unique, round(avg(baseline), 6) AS mean_baseline, round(avg(cap_orig), 6) AS mean_orig, round(avg(cap_new), 6) AS mean_new,
  round((avg(cap_new) - avg(baseline)) / (avg(cap_orig) - avg(baseline)), 6) AS gtcap FROM res""")
def _(t):
    return at.attribution_score(_rows(t))
