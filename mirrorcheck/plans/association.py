"""Queries for pairwise association and crosstabs."""

from itertools import combinations

from pyspark.sql import functions as F

from ..operators import association as ac
from ..operators import crosstabs as ct
from ..operators import distances as di
from .distances import CATS, F03_RAW, NUMS
from .registry import query


def _corr_sql(fn):
    def side(view):
        return " UNION ALL ".join(f"SELECT '{a}' AS var_1, '{b}' AS var_2, {fn(a, b, view)} AS r" for a, b in combinations(NUMS, 2))
    return f"""WITH a AS ({side('lines')}), b AS ({side('lines_s')})
SELECT a.var_1, a.var_2, round(a.r, 6) AS orig_corr, round(b.r, 6) AS new_corr, round(b.r - a.r, 6) AS diff, round((b.r - a.r) / a.r, 3) AS rel_diff
FROM a JOIN b ON a.var_1 = b.var_1 AND a.var_2 = b.var_2"""


def _pearson(a, b, view):
    return f"(SELECT corr({a}, {b}) FROM {view})"


def _spearman(a, b, view):
    return f"""(SELECT corr(ra, rb) FROM (SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS ra,
      rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS rb FROM {view} WHERE {a} IS NOT NULL AND {b} IS NOT NULL) z)"""


@query("f09_pairwise_correlations", _corr_sql(_pearson))
def _(t):
    return ac.pairwise_correlations(t.lines, t.lines_s, NUMS).withColumn("rel_diff", F.round("rel_diff", 3))


@query("f10_rank_correlations", _corr_sql(_spearman))
def _(t):
    return ac.pairwise_correlations(t.lines, t.lines_s, NUMS, "spearman").withColumn("rel_diff", F.round("rel_diff", 3))


def _cramer_sql():
    def side(view):
        return " UNION ALL ".join(f"""SELECT '{a}' AS var_1, '{b}' AS var_2, (WITH o AS (SELECT {a} AS x, {b} AS y, count(*) AS n FROM {view} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2),
  xs AS (SELECT x, sum(n) AS nx FROM o GROUP BY x), ys AS (SELECT y, sum(n) AS ny FROM o GROUP BY y), g AS (
    SELECT coalesce(n, 0) AS n, nx * ny / (SELECT sum(n) FROM o) AS e FROM (SELECT xs.x, nx, ys.y, ny FROM xs, ys) f LEFT JOIN o ON o.x = f.x AND o.y = f.y),
  d AS (SELECT least((SELECT count(*) FROM xs), (SELECT count(*) FROM ys)) - 1 AS m, (SELECT count(*) FROM xs) = 2 AND (SELECT count(*) FROM ys) = 2 AS two)
  SELECT sqrt(sum(pow(abs(g.n - e) - CASE WHEN two THEN least(0.5, abs(g.n - e)) ELSE 0 END, 2) / e) / sum(g.n) / max(m)) FROM g, d) AS v"""
                                 for a, b in combinations(CATS, 2))
    return f"""WITH a AS ({side('lines')}), b AS ({side('lines_s')})
SELECT a.var_1, a.var_2, round(a.v, 6) AS orig_v, round(b.v, 6) AS new_v, round(b.v - a.v, 6) AS diff FROM a JOIN b ON a.var_1 = b.var_1 AND a.var_2 = b.var_2"""


@query("f11_cramers_v", _cramer_sql())
def _(t):
    return ac.cramers_v(t.lines, t.lines_s, CATS)


def cells_sql(vars_, k, orig="lines", new="lines_s", name="cells"):
    def side(view, s, c):
        levels = ", ".join(f"CAST({v} AS STRING) AS level_{i + 1}" for i, v in enumerate(c))
        return f"SELECT '{ct.SEPARATOR.join(c)}' AS crosstab, {levels}, {s} AS s FROM {view}"
    parts = " UNION ALL ".join(side(v, s, c) for c in combinations(vars_, k) for v, s in ((orig, 0), (new, 1)))
    lv = ", ".join(f"level_{i + 1}" for i in range(k))
    return f"{name} AS (SELECT crosstab, {lv}, count(*) FILTER (WHERE s = 0) AS n_orig, count(*) FILTER (WHERE s = 1) AS n_new FROM ({parts}) u GROUP BY crosstab, {lv})"


@query("f12_crosstabs", f"""WITH {cells_sql(CATS, 2)} SELECT *, round(n_orig / sum(n_orig) OVER (PARTITION BY crosstab), 6) AS p_orig,
  round(n_new / sum(n_new) OVER (PARTITION BY crosstab), 6) AS p_new FROM cells""")
def _(t):
    return ct.compare_crosstabs(t.lines, t.lines_s, CATS, 2)


@query("f12_crosstabs_3way", f"""WITH {cells_sql(CATS[:3], 3)} SELECT *, round(n_orig / sum(n_orig) OVER (PARTITION BY crosstab), 6) AS p_orig,
  round(n_new / sum(n_new) OVER (PARTITION BY crosstab), 6) AS p_new FROM cells""")
def _(t):
    return ct.compare_crosstabs(t.lines, t.lines_s, CATS[:3], 3)


@query("f13_crosstab_report", F03_RAW.split("pool AS", 1)[0] + f"""top AS (SELECT variable, level FROM k WHERE bo <= 0.5 * o_all OR bn <= 0.5 * n_all), {cells_sql(CATS, 2)},
p AS (SELECT crosstab, CASE WHEN a.variable IS NULL THEN 'Other' ELSE level_1 END AS level_1, CASE WHEN b.variable IS NULL THEN 'Other' ELSE level_2 END AS level_2,
  CAST(sum(n_orig) AS BIGINT) AS n_orig, CAST(sum(n_new) AS BIGINT) AS n_new FROM cells
  LEFT JOIN top a ON a.variable = split_part(crosstab, ' x ', 1) AND a.level IS NOT DISTINCT FROM level_1
  LEFT JOIN top b ON b.variable = split_part(crosstab, ' x ', 2) AND b.level IS NOT DISTINCT FROM level_2 GROUP BY 1, 2, 3),
q AS (SELECT *, n_orig / sum(n_orig) OVER (PARTITION BY crosstab) AS po, n_new / sum(n_new) OVER (PARTITION BY crosstab) AS pn FROM p)
SELECT crosstab, level_1, level_2, n_orig, n_new, round(po, 6) AS p_orig, round(pn, 6) AS p_new, round(pn - po, 6) AS diff, round((pn - po) / nullif(po, 0), 6) AS rel_diff FROM q""")
def _(t):
    shares = di.level_shares(di.level_counts(t.lines, t.lines_s, CATS))
    return ct.crosstab_report(t.lines, t.lines_s, CATS, di.top_levels(shares)).drop("var_1", "var_2", "other_1", "other_2")
