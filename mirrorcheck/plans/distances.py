"""Queries for single-variable utility measures."""

from pyspark.sql import functions as F

from ..operators import distances as di
from .registry import query

CATS = ["returnflag", "linestatus", "line_no", "supplier_group"]
NUMS = ["quantity", "price", "discount", "tax"]


def long_sql(view, names, kind, extra=""):
    return " UNION ALL ".join(f"SELECT '{v}' AS variable, CAST({v} AS {kind}) AS x{extra} FROM {view}" for v in names)


LEVELS = f"""u AS (SELECT variable, x, 0 AS s FROM ({long_sql('lines', CATS, 'STRING')}) a UNION ALL SELECT variable, x, 1 FROM ({long_sql('lines_s', CATS, 'STRING')}) b),
lev AS (SELECT variable, x AS level, count(*) FILTER (WHERE s = 0) AS n_orig, count(*) FILTER (WHERE s = 1) AS n_new FROM u GROUP BY 1, 2),
sh AS (SELECT *, n_orig / sum(n_orig) OVER (PARTITION BY variable) AS p_orig, n_new / sum(n_new) OVER (PARTITION BY variable) AS p_new FROM lev)"""
HD = "sqrt(sum(pow(sqrt(p_orig) - sqrt(p_new), 2))) / sqrt(2)"


@query("f00_date_features", """
SELECT ship_date_year, ship_date_month, count(*) AS n, CAST(sum(ship_date_day) AS BIGINT) AS days, CAST(sum(ship_date_since2000) AS BIGINT) AS since,
  CAST(sum(gap) AS BIGINT) AS gap FROM (
SELECT year(ship_date) AS ship_date_year, month(ship_date) AS ship_date_month, day(ship_date) AS ship_date_day,
  ship_date - DATE '2000-01-01' AS ship_date_since2000, end_date - ship_date AS gap FROM lines_s) x GROUP BY 1, 2""")
def _(t):
    f = di.date_features(t.lines_s, [("ship_date", "end_date")])
    return f.groupBy("ship_date_year", "ship_date_month").agg(
        F.count("*").alias("n"), F.sum("ship_date_day").alias("days"), F.sum("ship_date_since2000").alias("since"),
        F.sum("ship_date_to_end_date").alias("gap"))


@query("f01_categorical_distance", f"""
WITH {LEVELS}, w AS (SELECT variable, x, sum(CASE WHEN s = 0 THEN wt END) AS wo, sum(CASE WHEN s = 1 THEN wt END) AS wn FROM (
  SELECT variable, x, wt, 0 AS s FROM ({long_sql('lines', CATS, 'STRING', ', price AS wt')}) a UNION ALL SELECT variable, x, wt, 1 FROM ({long_sql('lines_s', CATS, 'STRING', ', price AS wt')}) b) q GROUP BY 1, 2),
ws AS (SELECT variable, coalesce(wo, 0) / sum(wo) OVER (PARTITION BY variable) AS p_orig, coalesce(wn, 0) / sum(wn) OVER (PARTITION BY variable) AS p_new FROM w)
SELECT a.variable, round(a.hd, 6) AS hd, round(b.hd, 6) AS w_hd FROM (SELECT variable, {HD} AS hd FROM sh GROUP BY variable) a
JOIN (SELECT variable, {HD} AS hd FROM ws GROUP BY variable) b ON a.variable = b.variable""")
def _(t):
    return di.categorical_distance(t.lines, t.lines_s, CATS, weight="price")


@query("f02_joint_distance", """
WITH c AS (SELECT returnflag, linestatus, line_no, count(*) FILTER (WHERE s = 0) AS o, count(*) FILTER (WHERE s = 1) AS n FROM (
  SELECT returnflag, linestatus, line_no, 0 AS s FROM lines UNION ALL SELECT returnflag, linestatus, line_no, 1 FROM lines_s) u GROUP BY 1, 2, 3)
SELECT round(sqrt(sum(pow(sqrt(o / (SELECT sum(o) FROM c)) - sqrt(n / (SELECT sum(n) FROM c)), 2))), 6) AS hd FROM c""")
def _(t):
    return di.joint_distance(t.lines, t.lines_s, ["returnflag", "linestatus", "line_no"])


def chi_square_p(x, df):
    """Upper tail of the chi-square law by its series; 0 where it is beyond all digits."""
    return f"""CASE WHEN {df} < 1 OR {x} IS NULL THEN NULL WHEN {x} <= 0 THEN 1.0 WHEN {x} / 2 > 600 THEN 0.0 ELSE greatest(0.0, 1 - list_sum(list_transform(range(3000),
  lambda n: exp(-({x}) / 2 + ({df} / 2.0 + n) * ln(({x}) / 2) - lgamma({df} / 2.0 + n + 1))))) END"""


def kolmogorov_p(lam):
    """Two-sided tail of the Kolmogorov law: its alternating series, or the other one for small values."""
    return f"""CASE WHEN {lam} <= 0 THEN 1.0 WHEN {lam} < 0.5 THEN 1 - sqrt(2 * pi()) / ({lam}) * list_sum(list_transform(range(1, 6), lambda k: exp(-pow(2 * k - 1, 2) * pow(pi(), 2) / 8 / pow({lam}, 2))))
  ELSE list_sum(list_transform(range(1, 61), lambda k: CASE WHEN k % 2 = 1 THEN 2 ELSE -2 END * exp(-2.0 * k * k * pow({lam}, 2)))) END"""


F03_RAW = f"""WITH {LEVELS},
k AS (SELECT *, sum(n_orig) OVER (PARTITION BY variable ORDER BY n_orig DESC, level NULLS LAST ROWS UNBOUNDED PRECEDING) - n_orig AS bo,
  sum(n_new) OVER (PARTITION BY variable ORDER BY n_new DESC, level NULLS LAST ROWS UNBOUNDED PRECEDING) - n_new AS bn,
  sum(n_orig) OVER (PARTITION BY variable) AS o_all, sum(n_new) OVER (PARTITION BY variable) AS n_all FROM sh),
pool AS (SELECT variable, CASE WHEN bo <= 0.5 * o_all OR bn <= 0.5 * n_all THEN level ELSE 'Other' END AS level,
  sum(n_orig) AS n_orig, sum(n_new) AS n_new, sum(p_orig) AS p_orig, sum(p_new) AS p_new FROM k
  GROUP BY variable, CASE WHEN bo <= 0.5 * o_all OR bn <= 0.5 * n_all THEN level ELSE 'Other' END),
e AS (SELECT *, sum(n_orig) OVER (PARTITION BY variable) AS so, sum(n_new) OVER (PARTITION BY variable) AS sn, count(*) OVER (PARTITION BY variable) AS lv FROM pool),
g AS (SELECT *, (n_orig + n_new) * so / (so + sn) AS eo, (n_orig + n_new) * sn / (so + sn) AS en FROM e),
chi AS (SELECT variable, max(lv) - 1 AS df, sum(pow(abs(n_orig - eo) - CASE WHEN lv = 2 THEN least(0.5, abs(n_orig - eo)) ELSE 0 END, 2) * (1 / eo + 1 / en)) AS chi_square FROM g GROUP BY variable)
SELECT p.variable, p.level, CAST(n_orig AS BIGINT) AS n_orig, CAST(n_new AS BIGINT) AS n_new, p_orig, p_new,
  h.hd, chi_square, df, {chi_square_p('chi_square', 'df')} AS p_value FROM pool p JOIN chi ON p.variable = chi.variable
  JOIN (SELECT variable, {HD} AS hd FROM sh GROUP BY variable) h ON p.variable = h.variable"""
F03 = f"SELECT * REPLACE (round(p_orig, 6) AS p_orig, round(p_new, 6) AS p_new, round(hd, 6) AS hd, round(chi_square, 4) AS chi_square, round(p_value, 6) AS p_value) FROM ({F03_RAW}) z"


@query("f03_top_levels", F03)
def _(t):
    return di.top_level_report(t.lines, t.lines_s, CATS).withColumn("chi_square", F.round("chi_square", 4))


def _summary_sql():
    stats = ", ".join(f"quantile_cont(x, {p}) AS {n}" for n, p in di.PERCENTILES.items())
    names = ", ".join(di.SUMMARY)
    return f"""WITH u AS (SELECT variable, x, 0 AS s FROM ({long_sql('lines', NUMS, 'DOUBLE')}) a UNION ALL SELECT variable, x, 1 FROM ({long_sql('lines_s', NUMS, 'DOUBLE')}) b),
q AS (SELECT variable, s, min(x) AS min, {stats}, avg(x) AS mean, max(x) AS max, stddev_samp(x) AS sd FROM u WHERE x IS NOT NULL GROUP BY 1, 2),
l AS (UNPIVOT q ON {names} INTO NAME statistic VALUE v)
SELECT a.variable, a.statistic, round(a.v, 5) AS orig, round(b.v, 5) AS new, round(b.v - a.v, 5) AS diff FROM l a JOIN l b ON a.variable = b.variable AND a.statistic = b.statistic AND a.s = 0 AND b.s = 1"""


@query("f04_continuous_summary", _summary_sql(), digits=5)
def _(t):
    return di.continuous_summary(t.lines, t.lines_s, NUMS)


PAIRED = ["quantity", "tax", "discount"]


def _paired_sql():
    rows = " UNION ALL ".join(
        f"SELECT '{v}' AS variable, '{i}' AS implicate, abs(CAST({v} AS DOUBLE) - {v}_{i}) AS d, weight AS w FROM implicates"
        for v in PAIRED for i in (1, 2, 3))
    wq = ", ".join(f"""CASE WHEN max(CASE WHEN sh <= {p} THEN d END) IS NULL THEN min(CASE WHEN sh >= {p} THEN d END)
    WHEN min(CASE WHEN sh >= {p} THEN d END) IS NULL OR min(CASE WHEN sh >= {p} THEN sh END) - max(CASE WHEN sh <= {p} THEN sh END) <= 0 THEN max(CASE WHEN sh <= {p} THEN d END)
    ELSE max(CASE WHEN sh <= {p} THEN d END) + (min(CASE WHEN sh >= {p} THEN d END) - max(CASE WHEN sh <= {p} THEN d END)) *
      ({p} - max(CASE WHEN sh <= {p} THEN sh END)) / (min(CASE WHEN sh >= {p} THEN sh END) - max(CASE WHEN sh <= {p} THEN sh END)) END AS w_{n}"""
                   for n, p in di.QUARTILES.items())
    return f"""WITH r AS ({rows}),
s AS (SELECT variable, implicate, min(d) AS min, avg(d) AS mean, max(d) AS max, quantile_cont(d, 0.25) AS q1, quantile_cont(d, 0.5) AS median, quantile_cont(d, 0.75) AS q3,
  sum(d * w) / sum(w) FILTER (WHERE d IS NOT NULL) AS w_mean, count(*) FILTER (WHERE d IS NULL) AS na_count FROM r GROUP BY 1, 2),
c AS (SELECT variable, implicate, d, sum(w) AS w FROM r WHERE d IS NOT NULL GROUP BY 1, 2, 3),
k AS (SELECT *, sum(w) OVER (PARTITION BY variable, implicate ORDER BY d ROWS UNBOUNDED PRECEDING) / sum(w) OVER (PARTITION BY variable, implicate) AS sh FROM c),
z AS (SELECT variable, implicate, {wq} FROM k GROUP BY 1, 2)
SELECT s.variable, s.implicate, round(min, 8) AS min, round(q1, 8) AS q1, round(median, 8) AS median, round(mean, 8) AS mean, round(q3, 8) AS q3, round(max, 8) AS max,
  na_count, round(min, 8) AS w_min, round(w_q1, 8) AS w_q1, round(w_median, 8) AS w_median, round(w_mean, 8) AS w_mean, round(w_q3, 8) AS w_q3, round(max, 8) AS w_max, na_count AS w_na_count
FROM s JOIN z ON s.variable = z.variable AND s.implicate = z.implicate"""


@query("f05_paired_distances", _paired_sql(), digits=8)
def _(t):
    return di.paired_distances(t.implicates, PAIRED, ["_1", "_2", "_3"], weight="weight")


F06_RAW = f"""
WITH u AS (SELECT variable, x, 0 AS s FROM ({long_sql('lines', NUMS, 'DOUBLE')}) a UNION ALL SELECT variable, x, 1 FROM ({long_sql('lines_s', NUMS, 'DOUBLE')}) b),
c AS (SELECT variable, x, count(*) FILTER (WHERE s = 0) AS o, count(*) FILTER (WHERE s = 1) AS n FROM u WHERE x IS NOT NULL GROUP BY 1, 2),
k AS (SELECT variable, sum(o) OVER w / sum(o) OVER p AS eo, sum(n) OVER w / sum(n) OVER p AS en, sum(o) OVER p AS so, sum(n) OVER p AS sn FROM c
  WINDOW w AS (PARTITION BY variable ORDER BY x ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY variable))
SELECT *, {kolmogorov_p('(ks_distance * sqrt(1.0 * n_orig * n_new / (n_orig + n_new)))')} AS p_value FROM (
  SELECT variable, CAST(max(so) AS BIGINT) AS n_orig, CAST(max(sn) AS BIGINT) AS n_new, max(abs(eo - en)) AS ks_distance FROM k GROUP BY variable) x"""


@query("f06_ks_distance", f"SELECT * REPLACE (round(ks_distance, 6) AS ks_distance, round(p_value, 6) AS p_value) FROM ({F06_RAW}) z")
def _(t):
    return di.ks_distance(t.lines, t.lines_s, NUMS)


ALL = ["quantity", "price", "returnflag", "linestatus", "line_no", "supplier_group", "ship_date"]


def _missing_sql():
    def side(view):
        return " UNION ALL ".join(f"SELECT '{v}' AS variable, avg(CASE WHEN {v} IS NULL THEN 1.0 ELSE 0 END) AS m, count(DISTINCT {v}) AS d FROM {view}" for v in ALL)
    return f"""WITH a AS ({side('lines')}), b AS ({side('lines_s')})
SELECT a.variable, round(a.m, 6) AS missing_orig, a.d AS distinct_orig, round(b.m, 6) AS missing_new, b.d AS distinct_new FROM a JOIN b ON a.variable = b.variable"""


@query("f07_missing_rates", _missing_sql())
def _(t):
    return di.missing_rates(t.lines, t.lines_s, ALL)


def _validity_sql():
    cats = " UNION ALL ".join(f"SELECT '{v}' AS variable, 'cat' AS type, NOT EXISTS (SELECT 1 FROM lines_s s WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT {v} FROM lines) o WHERE o.{v} IS NOT DISTINCT FROM s.{v})) AS valid" for v in CATS)
    nums = " UNION ALL ".join(f"SELECT '{v}', 'cont', (SELECT min({v}) FROM lines_s) >= (SELECT min({v}) FROM lines) AND (SELECT max({v}) FROM lines_s) <= (SELECT max({v}) FROM lines)" for v in NUMS)
    return f"{cats} UNION ALL {nums}"


@query("f08_validity", _validity_sql())
def _(t):
    return di.validity(t.lines, t.lines_s, CATS, NUMS)
