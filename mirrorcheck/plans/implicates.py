"""Queries for interval overlap, models, perturbed data and reports."""

from itertools import combinations

from pyspark.sql import functions as F

from ..functions.columns import union_all
from ..functions.stats import normal_quantile
from ..operators import association as ac
from ..operators import crosstabs as ct
from ..operators import distances as di
from ..operators import implicates as im
from ..operators import intervals as iv
from ..operators import models as mo
from ..operators import report as rp
from .distances import CATS, F03_RAW, F06_RAW, NUMS, chi_square_p
from .registry import query
from .tablesets import registry as variable_types

Z = normal_quantile(0.975)
SUFFIXES = ["_1", "_2", "_3"]
REPS = [f"rep_{r}" for r in range(1, 9)]
VARS = ["quantity", "tax", "discount"]
CAT = ["flag", "status", "line_no"]
MODELS = [("quantity", ["discount", "tax"]), ("cheap", ["quantity", "tax"])]
U_VARS = ["flag", "status", "discount"]

IO = "0.5 * ((least({u1}, {u2}) - greatest({l1}, {l2})) / ({u1} - {l1}) + (least({u1}, {u2}) - greatest({l1}, {l2})) / ({u2} - {l2}))"


def io(l1, u1, l2, u2):
    return IO.format(l1=l1, u1=u1, l2=l2, u2=u2)


def overlap_select(keys, digits=5):
    return f"""SELECT {keys}, round({io('a.low', 'a.upp', 'b.low', 'b.upp')}, 4) AS overlap, b.est >= a.low AND b.est <= a.upp AS new_est_in_orig_ci,
  round(a.est, {digits}) AS orig, round(b.est, {digits}) AS new, round(a.low, {digits}) AS orig_low, round(b.low, {digits}) AS new_low, round(a.upp, {digits}) AS orig_upp, round(b.upp, {digits}) AS new_upp"""


def short(df):
    return df.withColumn("overlap", F.round("overlap", 4))


@query("f14_propensity", """
WITH u AS (SELECT supplier_group AS g, 0 AS s FROM lines WHERE supplier_group IS NOT NULL UNION ALL SELECT supplier_group, 1 FROM lines_s WHERE supplier_group IS NOT NULL),
t AS (SELECT count(*) AS n, sum(s) AS m, count(DISTINCT g) AS k FROM u),
c AS (SELECT count(*) AS w, avg(s) AS p FROM u GROUP BY g),
r AS (SELECT n, m, k, sum(w * pow(p - m / n, 2)) / n AS u, sum(w * pow(p - 0.5, 2)) / n AS h, pow(1 - m / n, 2) * (m / n) / n AS unit FROM c, t GROUP BY n, m, k)
SELECT n, CAST(m AS BIGINT) AS n_new, CAST(k AS INT) AS n_coefficients, round(u, 6) AS u, round(h, 6) AS u_half, round((k - 1) * unit, 6) AS null_mean, round(sqrt(2 * (k - 1)) * unit, 6) AS null_se,
  round(""" + chi_square_p("(u / unit)", "(k - 1)") + """, 6) AS p_value FROM r""")
def _(t):
    return mo.propensity_u(t.lines, t.lines_s, ["supplier_group"])


@query("f14_propensity_model")
def _(t):
    return mo.propensity_u(t.person, t.person_s, ["flag_high", "flag_debt", "ethnicity_concept_name", "income"])


@query("f15_interval_overlap", f"""
WITH x AS (SELECT o_custkey, count(*) AS n, avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders GROUP BY 1 HAVING count(*) > 1 AND stddev_samp(o_totalprice) > 1)
SELECT o_custkey, round({io('(m - s)', '(m + s)', '(m - s / 2)', '(m + 2 * s)')}, 6) AS overlap FROM x""")
def _(t):
    x = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("m"), F.stddev_samp("o_totalprice").alias("s"))
    m, s = F.col("m"), F.col("s")
    return x.where("n > 1 AND s > 1").select("o_custkey", iv.interval_overlap(m - s, m + s, m - s / 2, m + 2 * s).alias("overlap"))


def _imp_rows(kind="DOUBLE", names=VARS, extra="", where=""):
    o = " UNION ALL ".join(f"SELECT '{v}' AS variable, CAST({v} AS {kind}) AS x{extra} FROM implicates{where}" for v in names)
    n = " UNION ALL ".join(f"SELECT '{v}' AS variable, '{i}' AS implicate, CAST({v}_{i} AS {kind}) AS x{extra} FROM implicates{where}" for v in names for i in (1, 2, 3))
    return o, n


def _simple_ci(stat, extra_keys=""):
    est, se = {"mean": ("avg(x)", "stddev_samp(x) / sqrt(count(x))"), "sum": ("avg(x) * count(x)", "stddev_samp(x) * sqrt(count(x))")}[stat]
    o, n = _imp_rows()
    def side(rows, keys):
        return f"SELECT *, est - {Z} * se AS low, est + {Z} * se AS upp FROM (SELECT {keys}, {est} AS est, {se} AS se FROM ({rows}) r GROUP BY {keys}) q"
    return f"""WITH a AS ({side(o, 'variable')}), b AS ({side(n, 'variable, implicate')})
{overlap_select('a.variable, b.implicate', 2 if stat == 'sum' else 5)} FROM a JOIN b ON a.variable = b.variable"""


@query("f16_ci_overlap_mean", _simple_ci("mean"), digits=5)
def _(t):
    return short(iv.ci_overlap(t.implicates, t.implicates, VARS, SUFFIXES, "mean"))


@query("f16_ci_overlap_sum", _simple_ci("sum"), digits=2)
def _(t):
    return iv.ci_overlap(t.implicates, t.implicates, VARS, SUFFIXES, "total").drop("overlap")


import mirrorcheck.plans.registry as _reg  # noqa: E402

_reg.ORACLES["f16_ci_overlap_sum"] = f"SELECT * EXCLUDE overlap FROM ({_reg.ORACLES['f16_ci_overlap_sum']}) z"


def _prop_ci():
    o, n = _imp_rows("STRING", CAT)
    def side(rows, keys):
        return f"SELECT *, est - {Z} * sqrt(est * (1 - est) / tot) AS low, est + {Z} * sqrt(est * (1 - est) / tot) AS upp FROM (SELECT {keys}, x, count(*) / sum(count(*)) OVER (PARTITION BY {keys}) AS est, sum(count(*)) OVER (PARTITION BY {keys}) AS tot FROM ({rows}) r GROUP BY {keys}, x) q"
    return f"""WITH a AS (SELECT * FROM ({side(o, 'variable')}) s, (VALUES ('1'), ('2'), ('3')) i(implicate)), b AS ({side(n, 'variable, implicate')})
{overlap_select('coalesce(a.variable, b.variable) AS variable, coalesce(a.implicate, b.implicate) AS implicate, coalesce(a.x, b.x) AS category')}
FROM a FULL JOIN b ON a.variable = b.variable AND a.implicate = b.implicate AND a.x IS NOT DISTINCT FROM b.x"""


@query("f16_ci_overlap_prop", _prop_ci(), digits=5)
def _(t):
    return short(iv.ci_overlap(t.implicates, t.implicates, CAT, SUFFIXES, "prop"))


def _svy_ci():
    o, n = _imp_rows(extra=", weight, " + ", ".join(REPS))
    theta = ", ".join(f"sum({w} * x) / sum(CASE WHEN x IS NOT NULL THEN {w} END) AS t{i}" for i, w in enumerate(["weight", *REPS]))
    var = " + ".join(f"pow(t{i} - t0, 2)" for i in range(1, 9))
    def side(rows, keys):
        return f"SELECT *, t0 AS est, t0 - {Z} * sqrt(0.5 * ({var})) AS low, t0 + {Z} * sqrt(0.5 * ({var})) AS upp FROM (SELECT {keys}, {theta} FROM ({rows}) r GROUP BY {keys}) q"
    return f"""WITH a AS ({side(o, 'variable')}), b AS ({side(n, 'variable, implicate')})
{overlap_select('a.variable, b.implicate')} FROM a JOIN b ON a.variable = b.variable"""


@query("f17_survey_ci_overlap", _svy_ci(), digits=5)
def _(t):
    return short(iv.survey_ci_overlap(t.implicates, t.implicates, VARS, "weight", REPS, SUFFIXES))


LIMITS = ("orig", "new", "orig_low", "new_low", "orig_upp", "new_upp")


def _svy(total=False, subsets=()):
    """Estimates with replicate weights: means or totals, of all rows or of those with a flag."""
    extra = ", weight, " + ", ".join(REPS)
    theta = ", ".join(f"sum({w} * x)" + ("" if total else f" / sum(CASE WHEN x IS NOT NULL THEN {w} END)") + f" AS t{i}" for i, w in enumerate(["weight", *REPS]))
    var = " + ".join(f"pow(t{i} - t0, 2)" for i in range(1, 9))

    def side(new):
        rows = " UNION ALL ".join(_imp_rows(extra=f", '{sub}' AS subset" + extra, where=f" WHERE {sub} = 1" if sub else "")[new] for sub in subsets or ("",))
        keys = "variable, subset" + (", implicate" if new else "")
        return f"SELECT *, t0 AS est, t0 - {Z} * sqrt(0.5 * ({var})) AS low, t0 + {Z} * sqrt(0.5 * ({var})) AS upp FROM (SELECT {keys}, {theta} FROM ({rows}) r GROUP BY {keys}) q"

    return f"""WITH a AS ({side(0)}), b AS ({side(1)})
{overlap_select('a.variable, b.implicate' + (', a.subset' if subsets else ''))} FROM a JOIN b ON a.variable = b.variable AND a.subset = b.subset"""


@query("f17_survey_totals", f"SELECT * REPLACE ({', '.join(f'round({c} / 1e6, 3) AS {c}' for c in LIMITS)}) FROM ({_svy(total=True)}) z", digits=5)
def _(t):
    out = short(iv.survey_ci_overlap(t.implicates, t.implicates, VARS, "weight", REPS, SUFFIXES, "total"))
    return out.withColumns({c: F.round(F.col(c) / 1e6, 3) for c in LIMITS})


@query("g04_survey_subsets", _svy(subsets=("early", "cheap")), digits=5)
def _(t):
    return short(iv.survey_ci_overlap(t.implicates, t.implicates, VARS, "weight", REPS, SUFFIXES, subsets=["early", "cheap"]))


def _svy_prop():
    extra = ", weight, " + ", ".join(REPS)
    o, n = _imp_rows("STRING", ["flag"], extra)
    sums = ", ".join(f"sum({w}) AS a{i}" for i, w in enumerate(["weight", *REPS]))
    def side(rows, keys):
        theta = ", ".join(f"a{i} / sum(a{i}) OVER (PARTITION BY {keys}) AS t{i}" for i in range(9))
        var = " + ".join(f"pow(t{i} - t0, 2)" for i in range(1, 9))
        half = f"{Z} * sqrt(0.5 * ({var})) / (t0 * (1 - t0))"
        return f"""SELECT *, t0 AS est, 1 / (1 + exp(-(ln(t0 / (1 - t0)) - {half}))) AS low, 1 / (1 + exp(-(ln(t0 / (1 - t0)) + {half}))) AS upp
FROM (SELECT {keys}, x, {theta} FROM (SELECT {keys}, x, {sums} FROM ({rows}) r GROUP BY {keys}, x) p) q"""
    return f"""WITH a AS (SELECT * FROM ({side(o, 'variable')}) s, (VALUES ('1'), ('2'), ('3')) i(implicate)), b AS ({side(n, 'variable, implicate')})
{overlap_select('coalesce(a.variable, b.variable) AS variable, coalesce(a.implicate, b.implicate) AS implicate, coalesce(a.x, b.x) AS category')}
FROM a FULL JOIN b ON a.variable = b.variable AND a.implicate = b.implicate AND a.x IS NOT DISTINCT FROM b.x"""


@query("f17_survey_ci_overlap_prop", _svy_prop(), digits=5)
def _(t):
    return short(iv.survey_ci_overlap(t.implicates, t.implicates, ["flag"], "weight", REPS, SUFFIXES, "prop"))


@query("f18_difference_rollup", f"""
WITH top AS ({F03_RAW}), ks AS ({F06_RAW}),
m AS ({" UNION ALL ".join(f"SELECT '{v}' AS variable, (SELECT avg({v}) FROM lines_s) - (SELECT avg({v}) FROM lines) AS mean_diff, (SELECT stddev_samp({v}) FROM lines_s) - (SELECT stddev_samp({v}) FROM lines) AS sd_diff" for v in NUMS)}),
r AS (SELECT variable, max(p_value) AS p_value, max(abs(p_new - p_orig)) AS max_diff, NULL::DOUBLE AS mean_diff, NULL::DOUBLE AS sd_diff FROM top GROUP BY variable
  UNION ALL SELECT ks.variable, p_value, NULL, mean_diff, sd_diff FROM ks JOIN m ON ks.variable = m.variable)
SELECT variable, round(p_value, 6) AS p_value, round(max_diff, 6) AS max_diff, round(mean_diff, 4) AS mean_diff, round(sd_diff, 4) AS sd_diff,
  CASE WHEN p_value < 0.001 THEN '***' WHEN p_value < 0.01 THEN '**' WHEN p_value < 0.05 THEN '*' ELSE '' END AS sig FROM r""")
def _(t):
    out = rp.difference_rollup(di.top_level_report(t.lines, t.lines_s, CATS), di.continuous_summary(t.lines, t.lines_s, NUMS), di.ks_distance(t.lines, t.lines_s, NUMS))
    return out.withColumns({"mean_diff": F.round("mean_diff", 4), "sd_diff": F.round("sd_diff", 4)})


@query("f18_difference_rollup_values", f"""
WITH c AS (SELECT '{NUMS[0]}' AS variable, (SELECT avg({NUMS[0]}) FROM lines_s) - (SELECT avg({NUMS[0]}) FROM lines) AS m, (SELECT stddev_samp({NUMS[0]}) FROM lines_s) - (SELECT stddev_samp({NUMS[0]}) FROM lines) AS s
  UNION ALL SELECT '{NUMS[2]}', (SELECT avg({NUMS[2]}) FROM lines_s) - (SELECT avg({NUMS[2]}) FROM lines), (SELECT stddev_samp({NUMS[2]}) FROM lines_s) - (SELECT stddev_samp({NUMS[2]}) FROM lines))
SELECT variable, round(m, 6) AS mean_diff, round(s, 6) AS sd_diff FROM c""")
def _(t):
    vs = [NUMS[0], NUMS[2]]
    return rp.difference_rollup(di.top_level_report(t.lines, t.lines_s, CATS[:1]), di.continuous_summary(t.lines, t.lines_s, vs),
                                di.ks_distance(t.lines, t.lines_s, vs)).where("max_diff IS NULL").select("variable", "mean_diff", "sd_diff")


@query("f19_utility_report")
def _(t):
    return rp.utility_report({"person": t.person, "visit_occurrence": t.visit_occurrence},
                             {"person": t.person_s, "visit_occurrence": t.visit_occurrence_s}, variable_types(t.spark))


# ------------------------------------------------------------------ G


def _changed_sql(v, i):
    return f"round(100.0 * avg(CASE WHEN {v}_{i} IS DISTINCT FROM {v} THEN 1 ELSE 0 END), 6)"


@query("g01_records_changed", " UNION ALL ".join(f"""
SELECT '{v}' AS variable, a AS pct_changes_1, b AS pct_changes_2, c AS pct_changes_3, round((a + b + c) / 3, 5) AS mean_pct_changes, round((SELECT stddev_samp(z) FROM (VALUES (a), (b), (c)) q(z)), 5) AS sd_pct_changes
FROM (SELECT {_changed_sql(v, 1)} AS a, {_changed_sql(v, 2)} AS b, {_changed_sql(v, 3)} AS c FROM implicates) x""" for v in [*VARS, "flag"]))
def _(t):
    out = im.records_changed_summary(t.implicates, [*VARS, "flag"], SUFFIXES)
    return out.withColumns({c: F.round(c, 5) for c in ("mean_pct_changes", "sd_pct_changes")})


@query("g02_change_flags_by_tier", "SELECT variable, implicate, tier, change_flag, count(*) AS n FROM (" + " UNION ALL ".join(
    f"SELECT '{v}' AS variable, '{i}' AS implicate, tier, CASE WHEN {v}_{i} IS DISTINCT FROM {v} THEN 1 ELSE 0 END AS change_flag FROM implicates"
    for v in ["quantity", "flag"] for i in (1, 2, 3)) + ") x GROUP BY 1, 2, 3, 4")
def _(t):
    return im.change_flags_by_tier(t.implicates, ["quantity", "flag"], "tier", SUFFIXES)


@query("g03_new_patterns", " UNION ALL ".join(f"""
SELECT '{i}' AS implicate, 'flag line_no' AS variables, coalesce(flag_{i}, '<null>') || '|' || coalesce(line_no_{i}, '<null>') AS pattern, count(*) AS n_new FROM implicates n
WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT flag, line_no FROM implicates) o WHERE o.flag IS NOT DISTINCT FROM n.flag_{i} AND o.line_no IS NOT DISTINCT FROM n.line_no_{i}) GROUP BY 3""" for i in (1, 2, 3)))
def _(t):
    return im.missing_skip_patterns(t.implicates, t.implicates, [["flag", "line_no"]], SUFFIXES)


def _subset_ci():
    parts = []
    for s in ("early", "cheap"):
        o, n = _imp_rows(where=f" WHERE {s} = 1")
        parts.append((s, o, n))
    def side(which, keys):
        rows = " UNION ALL ".join(f"SELECT '{s}' AS subset, * FROM ({(o, n)[which]}) r{s}" for s, o, n in parts)
        return f"SELECT *, est - {Z} * se AS low, est + {Z} * se AS upp FROM (SELECT subset, {keys}, avg(x) AS est, stddev_samp(x) / sqrt(count(x)) AS se FROM ({rows}) r GROUP BY subset, {keys}) q"
    return f"""WITH a AS ({side(0, 'variable')}), b AS ({side(1, 'variable, implicate')})
{overlap_select('a.variable, b.implicate, a.subset')} FROM a JOIN b ON a.variable = b.variable AND a.subset = b.subset"""


@query("g04_subset_ci_overlap", _subset_ci(), digits=5)
def _(t):
    return short(iv.ci_overlap(t.implicates, t.implicates, VARS, SUFFIXES, "mean", subsets=["early", "cheap"]))


def wcells_sql(combos, width, new="_1"):
    def part(c, side):
        cols = [f"CAST({v}{new if side else ''} AS STRING)" for v in c] + ["NULL"] * (width - len(c))
        return f"SELECT '{ct.SEPARATOR.join(c)}' AS crosstab, {', '.join(f'{x} AS level_{i + 1}' for i, x in enumerate(cols))}, weight AS w, {side} AS s FROM implicates"
    lv = ", ".join(f"level_{i + 1}" for i in range(width))
    parts = " UNION ALL ".join(part(c, s) for c in combos for s in (0, 1))
    return f"""SELECT crosstab, {lv}, count(*) FILTER (WHERE s = 0) AS n_orig, count(*) FILTER (WHERE s = 1) AS n_new,
  coalesce(sum(w) FILTER (WHERE s = 0), 0) AS w_orig, coalesce(sum(w) FILTER (WHERE s = 1), 0) AS w_new FROM ({parts}) u GROUP BY crosstab, {lv}"""


_DIMS = [*combinations(CAT, 2), *combinations(CAT, 3)]


@query("g05_high_utility_crosstabs", f"SELECT * REPLACE (round(w_orig, 2) AS w_orig, round(w_new, 2) AS w_new) FROM ({wcells_sql(_DIMS, 3)}) x", digits=2)
def _(t):
    return ct.high_utility_crosstabs(t.implicates, t.implicates, CAT, "weight", "_1")


@query("g06_forced_crosstabs", f"SELECT * REPLACE (round(w_orig, 2) AS w_orig, round(w_new, 2) AS w_new) FROM ({wcells_sql([c for c in _DIMS if 'line_no' in c], 3)}) x", digits=2)
def _(t):
    return ct.high_utility_crosstabs(t.implicates, t.implicates, CAT[:2], "weight", "_1", forced=["line_no"])


def _tvn(k):
    return f"""c AS ({wcells_sql(list(combinations(CAT, k)), k)}),
tv AS (SELECT crosstab, 0.5 * sum(abs(po - pn)) AS tvn FROM (SELECT crosstab, w_orig / sum(w_orig) OVER (PARTITION BY crosstab) AS po, w_new / sum(w_new) OVER (PARTITION BY crosstab) AS pn FROM c) q GROUP BY crosstab)"""


@query("g07_total_variation", f"WITH {_tvn(2)} SELECT crosstab, round(tvn, 6) AS tvn FROM tv")
def _(t):
    return ct.k_marginals(t.implicates, t.implicates, CAT, "weight", "_1", k=2)


@query("g08_k_marginal_score", f"""WITH {_tvn(2)} SELECT count(*) AS n_marginals, round(min(tvn), 6) AS min, round(quantile_cont(tvn, 0.25), 6) AS q1, round(quantile_cont(tvn, 0.5), 6) AS median,
  round(avg(tvn), 6) AS mean, round(quantile_cont(tvn, 0.75), 6) AS q3, round(max(tvn), 6) AS max FROM tv""")
def _(t):
    return ct.k_marginal_score(ct.k_marginals(t.implicates, t.implicates, CAT, "weight", "_1", k=2))


@query("g09_conjunctions", """
WITH s AS (SELECT visit_occurrence_id AS id, visit_concept_id AS c, discharge_to_concept_id AS d, total_charge AS x FROM visit_occurrence
  ORDER BY CAST('0x' || substr(md5('1234:' || CAST(visit_occurrence_id AS STRING)), 1, 8) AS BIGINT), visit_occurrence_id LIMIT 100),
o AS (SELECT id, count(*) AS n FROM s JOIN visit_occurrence v ON c = visit_concept_id AND d = discharge_to_concept_id AND total_charge BETWEEN x - 20000 AND x + 20000 GROUP BY id),
n AS (SELECT id, count(*) AS n FROM s JOIN visit_occurrence_s v ON c = visit_concept_id AND d = discharged_to_concept_id AND total_charge BETWEEN x - 20000 AND x + 20000 GROUP BY id)
SELECT s.id AS sample_id, round(coalesce(o.n, 0) / (SELECT count(*) FROM visit_occurrence), 6) AS similarity_orig, round(coalesce(n.n, 0) / (SELECT count(*) FROM visit_occurrence_s), 6) AS similarity_new,
  round(abs(coalesce(o.n, 0) / (SELECT count(*) FROM visit_occurrence) - coalesce(n.n, 0) / (SELECT count(*) FROM visit_occurrence_s)), 6) AS score
FROM s LEFT JOIN o ON s.id = o.id LEFT JOIN n ON s.id = n.id""")
def _(t):
    new = t.visit_occurrence_s.withColumnRenamed("discharged_to_concept_id", "discharge_to_concept_id")
    return im.conjunctions(t.visit_occurrence, new, "visit_occurrence_id",
                           {"visit_concept_id": 0, "discharge_to_concept_id": 0, "total_charge": 20000.0})


def _wcorr(a, b, table="implicates"):
    ok = f"{a} IS NOT NULL AND {b} IS NOT NULL"
    return f"""(SELECT (sum(w * x * y) / sum(w) - sum(w * x) * sum(w * y) / pow(sum(w), 2)) / sqrt((sum(w * x * x) / sum(w) - pow(sum(w * x) / sum(w), 2)) * (sum(w * y * y) / sum(w) - pow(sum(w * y) / sum(w), 2)))
  FROM (SELECT CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y, weight AS w FROM {table} WHERE {ok}) q)"""


def _changes(table="implicates"):
    pairs = " UNION ALL ".join(f"SELECT '{a}' AS var_1, '{b}' AS var_2, (SELECT count(*) FROM implicates WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n_orig, {_wcorr(a, b, table)} AS o, {_wcorr(a + '_1', b + '_1', table)} AS n"
                               for a, b in combinations(VARS, 2))
    return f"SELECT *, abs(o - n) / (pow(1 - o, 2) / sqrt(n_orig)) AS scaled FROM ({pairs}) x"


_ROUNDED = ("SELECT var_1, var_2, n_orig, round(o, 6) AS orig_corr, round(n, 6) AS new_corr, round(abs(o - n), 6) AS abs_diff, round(abs(o - n) / o, 3) AS rel_diff, "
            "round(scaled, 5) AS scaled_diff FROM ({}) y")
_RANKED = [*VARS, *[f"{v}_1" for v in VARS]]
RANKS = ", ".join(f"""rk_{v} AS (SELECT x, sum(w) OVER (ORDER BY x ROWS UNBOUNDED PRECEDING) - w + (n + 1) / 2.0 * w / n AS r
  FROM (SELECT CAST({v} AS DOUBLE) AS x, sum(weight) AS w, count(*) AS n FROM implicates WHERE {v} IS NOT NULL GROUP BY 1) q)""" for v in _RANKED) + (
    ", ranked AS (SELECT weight, " + ", ".join(f"rk_{v}.r AS {v}" for v in _RANKED) + " FROM implicates i " + " ".join(f"LEFT JOIN rk_{v} ON CAST(i.{v} AS DOUBLE) = rk_{v}.x" for v in _RANKED) + ")")


@query("g10_weighted_correlations", _ROUNDED.format(_changes()))
def _(t):
    out = ac.change_in_correlations(t.implicates, t.implicates, VARS, "weight", "_1")
    return out.withColumns({"rel_diff": F.round("rel_diff", 3), "scaled_diff": F.round("scaled_diff", 5)})


@query("g10_weighted_rank_correlations", f"WITH {RANKS} " + _ROUNDED.format(_changes("ranked")))
def _(t):
    out = ac.change_in_correlations(t.implicates, t.implicates, VARS, "weight", "_1", method="spearman")
    return out.withColumns({"rel_diff": F.round("rel_diff", 3), "scaled_diff": F.round("scaled_diff", 5)})


@query("g10_global_score", f"SELECT round(avg(scaled), 5) AS global_utility, count(*) AS n_pairs FROM ({_changes()}) y", digits=5)
def _(t):
    return ac.global_correlation_score(ac.change_in_correlations(t.implicates, t.implicates, VARS, "weight", "_1"))


def _slope(y, x):
    return f"""(SELECT (sum(w) * sum(w * x * y) - sum(w * x) * sum(w * y)) / (sum(w) * sum(w * x * x) - pow(sum(w * x), 2)) FROM (SELECT CAST({y} AS DOUBLE) AS y, CAST({x} AS DOUBLE) AS x, weight AS w FROM implicates WHERE {y} IS NOT NULL AND {x} IS NOT NULL) q)"""


@query("g11_regression_slopes", f"SELECT 'quantity' AS outcome, 'discount' AS predictor, round({_slope('quantity', 'discount')}, 5) AS orig_estimate, round({_slope('quantity_1', 'discount_1')}, 5) AS new_estimate", digits=5)
def _(t):
    return mo.compare_regressions(t.implicates, t.implicates, [("quantity", ["discount"])], "weight", REPS, "_1").select(
        "outcome", "predictor", "orig_estimate", "new_estimate")


@query("g11_regression_comparison", digits=5)
def _(t):
    return mo.compare_regressions(t.implicates, t.implicates, [("quantity", ["discount", "tax"]), ("cheap", ["quantity", "tax"])],
                                  "weight", suffix="_1")


@query("g11_significance_agreement")
def _(t):
    return mo.significance_agreement(mo.compare_regressions(t.implicates, t.implicates, [("quantity", ["discount", "tax"]), ("cheap", ["quantity", "tax"])], "weight", REPS, suffix="_1"))


@query("g12_implicate_rollup", f"""
WITH c AS ({' UNION ALL '.join(f"SELECT 'records changed' AS measure, '{v}' AS item, 100.0 * avg(CASE WHEN {v}_{i} IS DISTINCT FROM {v} THEN 1 ELSE 0 END) AS x FROM implicates" for v in VARS for i in (1, 2, 3))}),
d AS ({' UNION ALL '.join(f"SELECT 'mean distance' AS measure, '{v}' AS item, avg(abs(CAST({v} AS DOUBLE) - {v}_{i})) AS x FROM implicates" for v in VARS for i in (1, 2, 3))})
SELECT measure, item, count(*) AS n_implicates, round(avg(x), 5) AS mean, round(stddev_samp(x), 5) AS sd FROM (SELECT * FROM c UNION ALL SELECT * FROM d) z GROUP BY 1, 2""", digits=5)
def _(t):
    return im.implicate_rollup({
        "records changed": (im.records_changed(t.implicates, VARS, SUFFIXES), ["variable"], "pct_changed"),
        "mean distance": (di.paired_distances(t.implicates, VARS, SUFFIXES), ["variable"], "mean"),
    }, 3)


@query("g12_implicate_rollup_all")
def _(t):
    x = t.implicates
    stack = {s: s.strip("_") for s in SUFFIXES}
    marg = [ct.k_marginals(x, x, CAT, "weight", s, k=2).withColumn("implicate", F.lit(i)) for s, i in stack.items()]
    corr = [ac.change_in_correlations(x, x, VARS, "weight", s).withColumn("implicate", F.lit(i)) for s, i in stack.items()]
    return im.implicate_rollup({
        "records changed": (im.records_changed(x, VARS, SUFFIXES), ["variable"], "pct_changed"),
        "mean distance": (di.paired_distances(x, VARS, SUFFIXES), ["variable"], "mean"),
        "hellinger": (di.categorical_distance(x, x, CAT, "weight", SUFFIXES), ["variable"], "hd"),
        "ci overlap": (iv.ci_overlap(x, x, VARS, SUFFIXES), ["variable"], "overlap"),
        "k-marginal": (marg[0].unionByName(marg[1]).unionByName(marg[2]), ["crosstab"], "tvn"),
        "correlation": (corr[0].unionByName(corr[1]).unionByName(corr[2]), ["var_1", "var_2"], "abs_diff"),
        "crosstab difference": (union_all([im.crosstab_differences(x, x, CAT, "weight", s).withColumn("implicate", F.lit(i)) for s, i in stack.items()]), ["dimension"], "rel_diff"),
        "significance": (union_all([im.agreement_rate(mo.compare_regressions(x, x, MODELS, "weight", suffix=s)).withColumn("implicate", F.lit(i)) for s, i in stack.items()]), ["outcome"], "agreement"),
        "propensity": (union_all([mo.propensity_u(x.select(*U_VARS), x.select(*[F.col(v + s).alias(v) for v in U_VARS]), U_VARS).withColumn("implicate", F.lit(i)) for s, i in stack.items()]), [], "u"),
    }, 3)


@query("g13_derived_variables", """
SELECT band, spell, changes, field_1, field_2, count(*) AS n, count(money) AS n_money FROM (
SELECT CASE WHEN 2019 - yr <= 10 THEN 1 WHEN 2019 - yr <= 20 THEN 2 WHEN 2019 - yr <= 30 THEN 3 WHEN 2019 - yr <= 100 THEN 4 ELSE 0 END AS band,
  CASE WHEN a = 2 THEN 1 ELSE 0 END + CASE WHEN b = 2 THEN 1 ELSE 0 END + CASE WHEN c = 2 THEN 1 ELSE 0 END AS spell,
  CASE WHEN a <> b THEN 1 ELSE 0 END + CASE WHEN b <> c THEN 1 ELSE 0 END AS changes,
  CASE WHEN a IN (1, 2) THEN 1 WHEN a = 3 THEN 2 ELSE 0 END AS field_1,
  CASE WHEN a IN (1, 2) THEN 1 WHEN a = 3 AND r = 'N' THEN 2 WHEN a = 3 AND r = 'Y' THEN 3 ELSE 0 END AS field_2,
  CASE WHEN money = 9999998 THEN NULL ELSE money END AS money FROM (
SELECT 1960 + l_partkey % 55 AS yr, l_linenumber AS a, l_suppkey % 7 + 1 AS b, l_partkey % 7 + 1 AS c,
  CASE l_returnflag WHEN 'A' THEN 'Y' ELSE 'N' END AS r, CASE WHEN l_orderkey % 10 = 0 THEN 9999998 ELSE l_orderkey END AS money FROM lineitem) x) y GROUP BY 1, 2, 3, 4, 5""")
def _(t):
    x = t.lineitem.select(
        (1960 + F.col("l_partkey") % 55).alias("yr"), F.col("l_linenumber").alias("a"), (F.col("l_suppkey") % 7 + 1).alias("b"),
        (F.col("l_partkey") % 7 + 1).alias("c"), F.when(F.col("l_returnflag") == "A", "Y").otherwise("N").alias("r"),
        F.when(F.col("l_orderkey") % 10 == 0, 9999998).otherwise(F.col("l_orderkey")).alias("money"))
    x = im.sentinel_to_null(x, ["money"])
    return x.select(
        im.banded(2019 - F.col("yr"), [(10, 1), (20, 2), (30, 3), (100, 4)]).alias("band"), im.spells(["a", "b", "c"], 2).alias("spell"),
        im.wave_changes(["a", "b", "c"]).alias("changes"), im.in_field(F.col("a")).alias("field_1"),
        im.in_field(F.col("a"), F.col("r")).alias("field_2"), "money",
    ).groupBy("band", "spell", "changes", "field_1", "field_2").agg(F.count("*").alias("n"), F.count("money").alias("n_money"))
