"""Known values, edge cases, invariants and both forms of each documented choice."""
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from mirrorcheck.functions import ordered, stats
from mirrorcheck.functions.columns import null_safe_join, stack_sides
from mirrorcheck.operators import association, attribute, attribution, crosstabs, distances, episodes, facts, identity
from mirrorcheck.operators import implicates, intervals, models, sequences, tablesets, vaccine_study
from mirrorcheck.sources import registry, tables


def rows(df):
    return [tuple(r) for r in df.collect()]


# ---------------------------------------------------------------- distributions


def pair(spark, a, b, name="x", kind="string"):
    return (spark.createDataFrame([(v,) for v in a], f"{name} {kind}"), spark.createDataFrame([(v,) for v in b], f"{name} {kind}"))


@pytest.mark.parametrize("a, b, expected", [("AAABBB", "AAABB", 0.07116), ("aaabbb", "cabab", 0.32492)])
def test_hellinger_known_values(spark, a, b, expected):
    o, n = pair(spark, a, b)
    assert round(distances.categorical_distance(o, n, ["x"]).first()["hd"], 5) == expected


def test_identical_data_have_distance_zero(spark):
    o, n = pair(spark, [1.0, 2.0, 2.0, None], [1.0, 2.0, 2.0, None], kind="double")
    assert distances.ks_distance(o, n, ["x"]).select("ks_distance", "p_value").first() == (0.0, 1.0)
    assert distances.categorical_distance(o, n, ["x"]).first()["hd"] == pytest.approx(0, abs=1e-9)


def test_ks_against_definition(spark):
    rng = random.Random(3)
    a = [round(rng.gauss(0, 1), 1) for _ in range(200)]
    b = [round(rng.gauss(0.3, 1), 1) for _ in range(150)]
    o, n = pair(spark, a, b, kind="double")
    got = distances.ks_distance(o, n, ["x"]).first()
    d = max(abs(sum(v <= x for v in a) / 200 - sum(v <= x for v in b) / 150) for x in a + b)
    z = d * math.sqrt(200 * 150 / 350)
    p = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * z * z) for k in range(1, 100))
    assert got["ks_distance"] == pytest.approx(d) and got["p_value"] == pytest.approx(p, abs=1e-9)


def test_missing_columns_raise(spark):
    o, n = pair(spark, "ab", "ab")
    with pytest.raises(ValueError):
        distances.ks_distance(o, n, ["nope"])
    with pytest.raises(ValueError):
        distances.categorical_distance(o, n, ["x"], suffixes=["_1"])


def test_top_levels_keep_a_single_large_first_level(spark):
    o, n = pair(spark, "aaaaaaabbc", "aaaaaaabbc")
    shares = distances.level_shares(distances.level_counts(o, n, ["x"]))
    assert rows(distances.top_levels(shares).select("level")) == [("a",)]
    out = {r["level"]: r["n_orig"] for r in distances.top_level_report(o, n, ["x"]).collect()}
    assert out == {"a": 7, "Other": 3}


def test_single_level_gives_null_p(spark):
    o, n = pair(spark, "aaa", "aa")
    r = distances.top_level_report(o, n, ["x"]).first()
    assert r["chi_square"] is None and r["p_value"] is None


def test_chi_square_with_and_without_correction(spark):
    o, n = pair(spark, "a" * 30 + "b" * 20, "a" * 20 + "b" * 30)
    shares = distances.level_shares(distances.level_counts(o, n, ["x"]))
    pooled = distances.pooled_levels(shares, shares.select("variable", "level"))
    assert distances.chi_square(pooled, correct=False).first()["chi_square"] == pytest.approx(4.0)
    assert distances.chi_square(pooled).first()["chi_square"] == pytest.approx(3.24)


def test_tails():
    assert stats.chi_square_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert stats.chi_square_tail(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-9)
    assert stats.critical_value(0.95) == pytest.approx(1.959963985)
    for bad in (0.4, 1.0, float("nan")):
        with pytest.raises(ValueError):
            stats.critical_value(bad)


@pytest.mark.parametrize("ranges", [5, 40])
def test_running_sums_in_ranges_equal_single_window(spark, ranges):
    rng = random.Random(1)
    data = [(g, float(v) if g else rng.random() * 10 ** rng.randint(-3, 6)) for g in (0, 1) for v in range(400) for _ in range(1 + v % 3)]
    df = spark.createDataFrame(data, "g int, v double")
    c = ordered.value_counts(df, ["g"], "v", {"n": F.count("*")})
    one = sorted(rows(ordered.running_sums(c, ["g"], "v", ["n"]).select("g", "v", "n", "cum_n", "total_n")))
    many = sorted(rows(ordered.running_sums(c, ["g"], "v", ["n"], range_rows=800 // ranges).select("g", "v", "n", "cum_n", "total_n")))
    assert one == many
    sums = {0: 0, 1: 0}
    for g, _, n, cum, _ in one:
        sums[g] += n
        assert cum == sums[g]


def test_quantiles_of_one_hot_group_in_ranges(spark):
    values = [i % 97 + 0.5 for i in range(3000)]
    df = spark.createDataFrame([("hot", v) for v in values] + [("cold", 1.0), ("cold", 2.0)], "g string, v double")
    got = {r["g"]: r for r in ordered.exact_quantiles(df, ["g"], "v", {"m": 0.5, "q": 0.99}, range_rows=12).collect()}
    want = {r["g"]: r for r in df.groupBy("g").agg(F.percentile("v", 0.5).alias("m"), F.percentile("v", 0.99).alias("q")).collect()}
    for g in want:
        assert got[g]["m"] == pytest.approx(want[g]["m"]) and got[g]["q"] == pytest.approx(want[g]["q"])


# ---------------------------------------------------------------- association


def test_spearman_with_missing_values(spark):
    data = [(1.0, 2.0, 5.0), (2.0, None, 4.0), (2.0, 1.0, 4.0), (4.0, 7.0, None), (5.0, 6.0, 1.0), (0.0, 6.0, 2.0)]
    df = spark.createDataFrame(data, "a double, b double, c double")
    got = {(r["var_1"], r["var_2"]): r["orig_corr"] for r in association.pairwise_correlations(df, df, ["a", "b", "c"], "spearman").collect()}

    def rank(v):
        return [sum(x < y for x in v) + (sum(x == y for x in v) + 1) / 2 for y in v]

    for i, j in itertools.combinations(range(3), 2):
        both = [(r[i], r[j]) for r in data if r[i] is not None and r[j] is not None]
        x, y = rank([p[0] for p in both]), rank([p[1] for p in both])
        mx, my = sum(x) / len(x), sum(y) / len(y)
        r = sum((p - mx) * (q - my) for p, q in zip(x, y)) / math.sqrt(sum((p - mx) ** 2 for p in x) * sum((q - my) ** 2 for q in y))
        assert got[("abc"[i], "abc"[j])] == pytest.approx(r)


def test_constant_columns_are_left_out(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (2.0, 2.0, 1.0), (3.0, 2.0, 5.0)], "a double, k double, c double")
    assert [(r["var_1"], r["var_2"]) for r in association.pairwise_correlations(df, df, ["a", "k", "c"]).collect()] == [("a", "c")]


def test_crosstab_structure(spark):
    df = spark.createDataFrame([("a", "x", "1"), ("b", "y", None)], "p string, q string, r string")
    assert {r["crosstab"] for r in crosstabs.compare_crosstabs(df, df, ["p", "q", "r"]).collect()} == {"p x q", "p x r", "q x r"}
    for k in (1, 4):
        with pytest.raises(ValueError):
            crosstabs.compare_crosstabs(df, df, ["p", "q", "r"], k)


def test_total_variation_aligns_categories(spark):
    o, n = pair(spark, "aab", "bcc")
    cells = crosstabs.compare_combinations(o.withColumn("w", F.lit(1.0)), n.withColumn("w", F.lit(1.0)), [("x",)], "w")
    assert crosstabs.total_variation(cells).first()["tvn"] == pytest.approx(2 / 3)


# ---------------------------------------------------------------- risk


def test_identity_of_equal_data(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 1), (None, None)], "k string, y int")
    r = identity.identity_disclosure(df, df, ["k", "y"]).first()
    assert r["uis"] == r["uio"] == r["repu"] == r["uiois"] == 50.0
    assert identity.exact_match(df, df, ["k", "y"]).first()["exact_match_pct"] == 100.0


def test_null_target_counts_as_a_level_and_disco_bounds(spark):
    o = spark.createDataFrame([("a", None), ("a", "1"), ("b", "1"), ("b", "1"), ("c", "0")], "k string, t string")
    s = spark.createDataFrame([("a", "1"), ("b", "1"), ("b", "0"), ("c", "0")], "k string, t string")
    r = attribute.attribute_disclosure(o, s, ["k"], ["t"]).first()
    assert r["dorig"] == pytest.approx(60.0) and r["dsyn"] == pytest.approx(50.0)
    assert r["disco"] == pytest.approx(40.0) and r["disdio"] == pytest.approx(20.0)
    assert r["disdio"] <= r["disco"] <= r["tcap"]
    assert r["tcap_1"] == pytest.approx(40.0)  # key b, disclosive in the original
    d = attribute.attribute_disclosure(o, s, ["k"], ["t"], documented=True).first()
    assert d["tcap_1"] == pytest.approx(20.0)  # key a, disclosive in the new data


def _prox(a, b, r):
    return 1.0 if a is None or b is None else max(0.0, 1 - abs(a - b) / r)


@pytest.mark.parametrize("seed", [1, 2])
def test_attribution_against_brute_force(spark, seed):
    rng = random.Random(seed)
    def make(n):
        return [(i, rng.choice("AB"), rng.choice([None, 1.5, 2.0, 3.25, 7.0, 9.5, 12.0]), rng.choice("XY"), rng.choice([None, *[round(rng.random() * 30, 2) for _ in range(3)]])) for i in range(n)]
    od, sd = make(14), make(25)
    schema = "id long, k string, n double, t string, m double"
    o, s = spark.createDataFrame(od, schema), spark.createDataFrame(sd, schema)
    got = {r["id"]: r for r in attribution.attribution_rows(o, s, "id", ["k"], {"n": 2.0}, ["t"], {"m": 5.0}).collect()}

    def unique(a):
        peers = [b for b in od if b[0] != a[0] and (b[1], b[3]) == (a[1], a[3])]
        near = any((a[c] is not None and b[c] is not None and abs(a[c] - b[c]) < r) for b in peers for c, r in ((2, 2.0), (4, 5.0)))
        return not peers or not near

    def cap(a, data):
        k = [(b[1] == a[1]) * _prox(a[2], b[2], 2.0) for b in data]
        t = [(b[3] == a[3]) * _prox(a[4], b[4], 5.0) for b in data]
        return sum(x * y for x, y in zip(k, t)) / sum(k) if sum(k) else 0.0

    assert set(got) == {a[0] for a in od if unique(a)}
    for a in od:
        if unique(a):
            base = sum((b[3] == a[3]) * _prox(a[4], b[4], 5.0) for b in od) / len(od)
            assert got[a[0]]["baseline"] == pytest.approx(base)
            assert got[a[0]]["cap_orig"] == pytest.approx(cap(a, od))
            assert got[a[0]]["cap_new"] == pytest.approx(cap(a, sd))


def test_unique_rows_forms(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 9.0), (3, "b", 1.2), (4, "c", 20.0)], "id long, c string, v double")
    assert {r["id"] for r in attribution.unique_rows(df, "id", ["c"], {"v": 2.0}).collect()} == {1, 2, 3, 4}
    assert {r["id"]: r["times"] for r in attribution.unique_rows(df, "id", ["c"], {"v": 2.0}, published=True).collect()} == {3: 2, 4: 2}
    with pytest.raises(ValueError):
        attribution.unique_rows(df, "id", ["c"], {"v": 0.0})


# ---------------------------------------------------------------- episodes and facts


def test_stays_touching_and_apart(spark):
    v = spark.createDataFrame([
        (1, 1, 9201, "2020-01-01", "2020-01-05"), (2, 1, 9201, "2020-01-05", "2020-01-06"),   # touching: same stay
        (3, 1, 9201, "2020-01-07", "2020-01-08"),                                            # one day later: new stay
        (4, 1, 9201, "2020-01-02", "2020-01-03"), (5, 1, 9202, "2020-01-09", "2020-01-20"),   # inside; not a stay type
        (6, 1, 9201, "2020-02-06", "2020-02-06"), (7, 1, 9201, "2020-03-08", "2020-03-09"),   # 30 days on; 31 days on
        (8, 1, 9201, "2020-05-02", "2020-05-01"), (9, 2, 262, "2020-01-01", None)],           # reversed; open
        "visit_occurrence_id long, person_id long, visit_concept_id int, s string, e string").select(
        "visit_occurrence_id", "person_id", "visit_concept_id", F.to_date("s").alias("visit_start_date"), F.to_date("e").alias("visit_end_date"))
    got = {r["visit_occurrence_id"]: (r["macrovisit_id"], r["combined_macrovisit_id"]) for r in episodes.visit_macrovisits(v).collect()}
    assert got == {1: ("1_1", "1_1"), 2: ("1_1", "1_1"), 4: ("1_1", "1_1"), 3: ("1_2", "1_1"), 6: ("1_3", "1_1"), 7: ("1_4", "1_2")}
    days = spark.createDataFrame([(1, "2020-01-20"), (1, "2020-02-10"), (1, "2020-03-09")], "person_id long, d string").select("person_id", F.to_date("d").alias("date"))
    hit = {str(r["date"]): r["combined_macrovisit_id"] for r in episodes.attach_episode(days, episodes.combined_episodes(v)).collect()}
    assert hit == {"2020-01-20": "1_1", "2020-02-10": None, "2020-03-09": "1_2"}


def test_days_in_long_and_short_intervals(spark):
    from mirrorcheck.functions import calendar

    spans = spark.createDataFrame([(1, "a", "2020-01-15", "2020-03-02"), (1, "b", "2020-02-29", "2020-02-29"), (1, "c", "2019-12-31", "9999-12-31"), (2, "d", "2020-01-01", "2023-06-30"),
                                   (1, "e", "2020-03-05", "2020-03-01"), (None, "f", "2020-01-01", "2020-12-31")], "person_id long, name string, s string, e string").select(
        "person_id", "name", F.to_date("s").alias("s"), F.to_date("e").alias("e"))
    days = spark.createDataFrame([(p, d) for p in (1, 2, None) for d in ("2019-12-30", "2020-01-14", "2020-01-15", "2020-02-29", "2020-03-02", "2020-03-03", "2023-06-30", "2023-07-01", "9999-12-31", None)],
                                 "person_id long, d string").select("person_id", F.to_date("d").alias("day"))
    plain = [(d["person_id"], d["day"], s["name"]) for d in days.collect() for s in spans.collect()
             if d["day"] is not None and d["person_id"] is not None and d["person_id"] == s["person_id"] and s["s"] <= d["day"] <= s["e"]]
    joined = calendar.days_in(days, spans, ["person_id"], "day", "s", "e")
    assert sorted((r["person_id"], r["day"], r["name"]) for r in joined.collect()) == sorted(plain)
    held = calendar.intervals_with(spans, days, ["person_id"], "day", "s", "e").distinct().collect()
    assert sorted((r["person_id"], r["name"]) for r in held) == sorted({(p, n) for p, _, n in plain})
    assert calendar._spread(spans, ["person_id"], "s", "e", True).count() == 7981 + 4  # a stay without an end: one row a year
    alone = calendar.attach_only(days, spans.where("name in ('a', 'd')"), ["person_id"], "day", "s", "e")
    assert alone.count() == days.count()
    assert {(r["person_id"], r["day"], r["name"]) for r in alone.collect() if r["name"]} == {x for x in plain if x[2] in "ad"}


def test_windows_around_episodes_have_sharp_edges(spark):
    from mirrorcheck.operators import vaccine_study as vs

    def day(text):
        return F.to_date(F.lit(text))

    e = spark.createDataFrame([(1, "1_1")], f"person_id long, {vs.EPISODE} string").withColumn(vs.START, day("2020-03-20")).withColumn(vs.END, day("2020-03-25"))
    design = vs.StudyDesign(["D"], "V")
    names = ["D", "V", "INFLUENZA_POS", "INFLUENZA_NEG", "PCR_AG_Pos", "PCR_AG_Neg"]

    def facts(name, date):
        return spark.createDataFrame([(1, *[int(n == name) for n in names])], "person_id long, " + ", ".join(f"{n} int" for n in names)).withColumn("date", day(date))

    assert [vs.episode_tests(e, facts("INFLUENZA_POS", d), design).count() for d in ("2020-03-09", "2020-03-10", "2020-03-28", "2020-03-29")] == [0, 1, 1, 0]
    assert [vs.episodes_with_diagnosis(e, facts("D", d), ["D"]).count() for d in ("2020-03-19", "2020-03-20", "2020-03-25", "2020-03-26")] == [0, 1, 1, 0]
    assert [vs.drop_recently_vaccinated(e, facts("V", d), design).count() for d in ("2020-03-05", "2020-03-06", "2020-03-20", "2020-03-21")] == [1, 0, 0, 1]
    assert [vs.vaccination_status(e, facts("V", d), design).first()["vaccinated"] for d in ("2019-12-20", "2019-12-21", "2020-03-19", "2020-03-20")] == [0, 1, 1, 0]


def test_kernel_sums_against_all_pairs(spark):
    from mirrorcheck.operators import attribution

    rng = random.Random(3)
    pick = [None, *[x / 4 for x in range(-12, 13)]]
    data = [(i, rng.choice(["a", "b", None]), rng.choice(pick), rng.choice(pick)) for i in range(150)]
    ask = [(i, rng.choice(["a", "b", None, "c"]), rng.choice(pick), rng.choice(pick)) for i in range(40)]
    d, q = (spark.createDataFrame(x, "id long, c string, x double, y double") for x in (data, ask))

    def near(a, b, r):
        return 1.0 if a is None or b is None else max(0.0, 1 - abs(a - b) / r)

    for dims in ([], [("x", 0.75)], [("y", 2.0)], [("x", 0.75), ("y", 2.0)]):
        at = {"x": 2, "y": 3}
        want = {}
        for a in ask:
            for b in data:
                if a[1] == b[1]:
                    w = 1.0
                    for name, r in dims:
                        w *= near(a[at[name]], b[at[name]], r)
                    want[a[0]] = want.get(a[0], 0.0) + w
        got = {r["id"]: r["s"] for r in attribution.kernel_sums(q, d, "id", ["c"], dims).collect()}
        assert {k for k, s in got.items() if s > 1e-9} == {k for k, s in want.items() if s > 0}
        assert all(got[k] == pytest.approx(s, abs=1e-9) for k, s in want.items() if k in got)


def test_top_levels_order_only_ties(spark):
    counts = {"x": {"a": 5, "b": 3, "c": 3, "d": 3, None: 3}, "y": {str(i): 1 for i in range(9)}, "z": {"only": 4}}
    shares = spark.createDataFrame([(v, level, n, n) for v, ls in counts.items() for level, n in ls.items()], "variable string, level string, n_orig long, n_new long")
    got = {(r["variable"], r["level"]) for r in distances.top_levels(shares, 0.5).collect()}
    # x: 17 rows, a and b hold 8 of the 8.5, so c is the crossing one; y: 9 rows, the first five by name
    assert got == {("x", "a"), ("x", "b"), ("x", "c"), *[("y", str(i)) for i in range(5)], ("z", "only")}


def test_thirty_variables_in_grouping_sets(spark):
    from itertools import combinations as combos_of

    wide = spark.range(60).select(*[F.when(F.col("id") % 7 == i % 7, None).otherwise(F.pmod(F.col("id") * (i + 1), F.lit(3))).cast("string").alias(f"v{i}") for i in range(30)]).cache()
    names = wide.columns
    cells = crosstabs.compare_crosstabs(wide, wide, names, 2)
    assert cells.select("crosstab").distinct().count() == 435
    plain = wide.groupBy("v3", "v29").count().collect()
    one = {(r["level_1"], r["level_2"]): (r["n_orig"], r["n_new"]) for r in cells.where("crosstab = 'v3 x v29'").collect()}
    assert one == {(r["v3"], r["v29"]): (r["count"], r["count"]) for r in plain}
    three = crosstabs.compare_combinations(wide, wide, list(combos_of(names[:8], 3)))
    assert three.agg(F.sum("n_orig")).first()[0] == 56 * 60


def test_pool_is_told_from_a_level_of_its_name(spark):
    o = spark.createDataFrame([("Other", "p"), ("Other", "q"), ("r", "p")], "x string, y string")
    top = spark.createDataFrame([("x", "Other"), ("y", "p")], "variable string, level string")
    got = {(r["level_1"], r["other_1"], r["level_2"], r["other_2"]): r["n_orig"] for r in crosstabs.crosstab_report(o, o, ["x", "y"], top).collect()}
    assert got == {("Other", False, "p", False): 1, ("Other", False, "Other", True): 1, ("Other", True, "p", False): 1}


def test_swapped_influenza_results(spark):
    members = spark.createDataFrame([("influenza test", True, 10), ("result positive", True, 1), ("result negative", True, 2)],
                                    "concept_set_name string, is_most_recent_version boolean, concept_id int")
    m = spark.createDataFrame([(1, 10, None, 1)], "person_id long, measurement_concept_id int, value_as_number double, value_as_concept_id int") \
        .withColumn("measurement_date", F.to_date(F.lit("2020-01-01")))
    p = spark.createDataFrame([(1,)], "person_id long")
    assert facts.measurement_facts(m, members, p).select("INFLUENZA_POS", "INFLUENZA_NEG").first() == (1, 0)
    assert facts.measurement_facts(m, members, p, swapped_influenza=True).select("INFLUENZA_POS", "INFLUENZA_NEG").first() == (0, 1)


def test_study_estimates_by_model_and_closed_form(spark):
    data = [(i, v, c, 40.0 + i % 30, "M" if i % 2 else "F", "W") for i, (v, c) in enumerate([(1, 1)] * 20 + [(1, 0)] * 60 + [(0, 1)] * 50 + [(0, 0)] * 70)]
    a = spark.createDataFrame(data, "person_id long, vaccinated int, positive_influenza_test int, age double, sex string, race_ethnicity string")
    odds = 20 * 70 / (60 * 50)
    assert vaccine_study.unadjusted_estimates(a).first()["point_estimate"] == pytest.approx(odds)
    none = vaccine_study.fit_logistic(vaccine_study._cells(a, ["sex"]), ["sex"])
    assert none.names == ["(Intercept)", "vaccinated", "sex_F"] and math.exp(none.beta[0, 1]) == pytest.approx(odds, rel=0.05)
    alone = vaccine_study.adjusted_estimates(a, []).first()
    assert alone["point_estimate"] == pytest.approx(odds) and alone["standard_error"] == pytest.approx(odds * math.sqrt(1 / 20 + 1 / 60 + 1 / 50 + 1 / 70))
    assert [r["point_estimate"] for r in vaccine_study.adjusted_estimates(a.where("false")).collect()] == [None, None]
    wald = vaccine_study.adjusted_estimates(a, ["sex"]).first()
    profile = vaccine_study.adjusted_estimates(a, ["sex"], profile=True).first()
    assert profile["ci_lower"] < profile["point_estimate"] < profile["ci_upper"]
    assert profile["ci_lower"] == pytest.approx(wald["ci_lower"], rel=0.1)


def test_conjunctions_without_equal_variables(spark):
    from mirrorcheck.operators import implicates

    rng = random.Random(4)
    data = [(i, rng.uniform(0, 20), rng.choice([None, *range(8)])) for i in range(120)]
    df = spark.createDataFrame([(i, x, None if y is None else float(y)) for i, x, y in data], "id long, x double, y double")
    got = {r["sample_id"]: r["similarity_orig"] for r in implicates.conjunctions(df, df, "id", {"x": 1.5, "y": 2.0}, n_records=500).collect()}
    for i, x, y in data:
        near = sum(abs(x - a) <= 1.5 and y is not None and b is not None and abs(y - b) <= 2 for _, a, b in data)
        assert got[i] == pytest.approx(near / 120)


def test_long_sequences_are_read_in_chunks(spark, monkeypatch):
    from mirrorcheck.operators import sequences

    tokens = ["year:2001", "age:40", *[t for i in range(50) for t in ([f"i-D{i % 5}"] if i else []) + ["[VS]", "7", "[VE]"]]]
    seqs = spark.createDataFrame([(1, tokens, [None] * len(tokens), [None] * len(tokens)), (2, ["year:xx", "[VS]", "7"], [None] * 3, [None] * 3)],
                                 "person_id long, concept_ids array<string>, number_as_values array<double>, concept_as_values array<string>")
    concept = spark.createDataFrame([(7, "Drug")], "concept_id long, domain_id string")
    whole = sorted(map(str, sequences.sequence_events(seqs, concept).collect()))
    monkeypatch.setattr(sequences, "CHUNK", 3)
    assert sorted(map(str, sequences.sequence_events(seqs, concept).collect())) == whole and len(whole) == 51
    last = sequences.sequence_events(seqs, concept).where("person_id = 1").orderBy(F.desc("pos")).first()
    assert last["visit_no"] == 50 and str(last["event_date"]) == "2001-04-11"


def test_newton_fits_against_plain_numpy(spark):
    import numpy as np
    from mirrorcheck.functions.newton import NotConverged, logistic_fits

    draw = np.random.default_rng(2)
    n = 300
    x, g, y = draw.normal(size=n), draw.choice(["a", "b", "c"], n, p=[0.5, 0.3, 0.2]), draw.integers(0, 2, n)
    w = draw.uniform(0.5, 2, (n, 3))
    df = spark.createDataFrame([(float(a), str(b), int(c), *map(float, d)) for a, b, c, d in zip(x, g, y, w)], "x double, g string, y int, w0 double, w1 double, w2 double")
    fits = logistic_fits(df, ["x", "g"], [F.col(f"w{i}") for i in range(3)], [F.col(f"w{i}") * F.col("y") for i in range(3)])
    assert fits.names == ["(Intercept)", "x", "g_a", "g_b"]
    design = np.stack([np.ones(n), x, g == "a", g == "b"], axis=1).astype(float)
    for i in range(3):
        beta = np.zeros(4)
        for _ in range(30):
            mu = 1 / (1 + np.exp(-design @ beta))
            info = design.T @ (design * (w[:, i] * mu * (1 - mu))[:, None])
            beta += np.linalg.solve(info, design.T @ (w[:, i] * (y - mu)))
        assert np.allclose(fits.beta[i], beta, atol=1e-7) and np.allclose(fits.se[i], np.sqrt(np.diag(np.linalg.inv(info))), atol=1e-6)
    with pytest.raises(NotConverged):
        logistic_fits(df, ["x", "g"], [F.col("w0")], [F.col("w0") * F.col("y")], most_steps=1)
    held = logistic_fits(df, ["g"], [F.col("w0")], [F.col("w0") * F.col("y")], F.col("x"), [float(fits.beta[0, 1]), 0.7])
    assert held.deviance[0] == pytest.approx(fits.deviance[0], abs=1e-6) and held.deviance[1] > held.deviance[0]


# ---------------------------------------------------------------- intervals, implicates, models


def test_interval_overlap_values(spark):
    f = intervals.interval_overlap(*[F.lit(float(x)) for x in (0, 2, 1, 3)])
    assert spark.range(1).select(f).first()[0] == pytest.approx(0.5)


def test_sum_error_forms_and_checks(spark):
    df = spark.createDataFrame([(float(i), float(i)) for i in range(1, 10)], "x double, x_1 double")
    a = intervals.ci_overlap(df, df, ["x"], ["_1"], "sum").first()
    b = intervals.ci_overlap(df, df, ["x"], ["_1"], "total", plain_sd_for_sum=True).first()
    assert a["orig"] == b["orig"] == 45 and (a["orig_upp"] - 45) == pytest.approx(3 * (b["orig_upp"] - 45))
    assert a["overlap"] == pytest.approx(1.0)
    with pytest.raises(ValueError):
        intervals.ci_overlap(df, df, ["x"], statistic="median")


def test_changed_records_and_wrong_implicates(spark):
    df = spark.createDataFrame([(1, 1, None), (None, 2, None), (3, 3, 3), (4, 5, 4)], "x int, x_1 int, x_2 int")
    got = {r["implicate"]: r["pct_changed"] for r in implicates.records_changed(df, ["x"], ["_1", "_2"]).collect()}
    assert got == {"1": 50.0, "2": 25.0}
    with pytest.raises(ValueError):
        implicates.implicate_rollup({"m": (implicates.records_changed(df, ["x"], ["_1", "_2"]), ["variable"], "pct_changed")}, 3)


def test_ols_matches_normal_equations(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0), (2.0, 4.5, 2.0), (3.0, 5.5, 1.0), (4.0, 8.5, 1.0)], "x double, y double, w double")
    got = {r["predictor"]: r["estimate"] for r in models.regression_coefficients(df, "y", ["x"], "w").collect()}
    w = [1, 2, 1, 1]
    mx = sum(a * b for a, b in zip(w, [1, 2, 3, 4])) / 5
    my = sum(a * b for a, b in zip(w, [2, 4.5, 5.5, 8.5])) / 5
    slope = sum(a * (x - mx) * (y - my) for a, x, y in zip(w, [1, 2, 3, 4], [2, 4.5, 5.5, 8.5])) / sum(a * (x - mx) ** 2 for a, x in zip(w, [1, 2, 3, 4]))
    assert got["x"] == pytest.approx(slope) and got["(Intercept)"] == pytest.approx(my - slope * mx)


# ---------------------------------------------------------------- sequences and tables


def test_gap_tokens(spark):
    cases = {"i-D6": 6, "i-D-6": 0, "D12": 12, "[VS]": 0, "x-7": 0, "W-3": 0}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert dict(rows(df.select("t", sequences.gap_days(F.col("t"))))) == cases


def test_text_arrays_and_safe_int(spark):
    df = spark.createDataFrame([("['a' 'b']", float("nan")), ("[]", 2.7), ("['[VS]' '9201']", None)], "t string, v double")
    assert rows(df.select(sequences.parse_token_text(F.col("t")), sequences.safe_int(F.col("v")))) == [
        (["a", "b"], 0), ([], 2), (["[VS]", "9201"], 0)]


def test_shifts_keep_gaps_and_year(spark):
    v = spark.createDataFrame([(1, "2001-03-01"), (1, "2001-04-15"), (2, "1999-12-31"), (3, "2000-02-29")], "person_id long, d string") \
        .select("person_id", F.to_date("d").alias("visit_start_date"))
    p = spark.createDataFrame([(1, 1950), (2, 1999), (3, None)], "person_id long, year_of_birth int")
    shifts = sequences.person_shifts(p, v)
    moved = sequences.shift_events({"v": v}, shifts)["v"]
    gap = moved.groupBy("person_id").agg(F.datediff(F.max("visit_start_date"), F.min("visit_start_date")).alias("g"), F.year(F.min("visit_start_date")).alias("y"))
    assert {r["person_id"]: (r["g"], r["y"]) for r in gap.collect()} == {1: (45, 2001), 2: (0, 1999), 3: (0, 2000)}


def test_sample_is_stable_under_partitioning(spark):
    p = spark.range(500).withColumnRenamed("id", "person_id")
    assert {r[0] for r in tablesets.sample_persons(p, 0.3).collect()} == {r[0] for r in tablesets.sample_persons(p.repartition(7), 0.3).collect()}


def test_null_safe_join_outer(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, a int")
    b = spark.createDataFrame([(None, 3), ("y", 4)], "k string, b int")
    assert set(rows(null_safe_join(a, b, ["k"], "outer").select("k", "a", "b"))) == {(None, 1, 3), ("x", 2, None), ("y", None, 4)}
    with pytest.raises(ValueError):
        stack_sides(a, b, ["a"])


def test_write_read_and_registry(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "x string, y int")
    tables.write_frames({"one": df}, str(tmp_path), "csv")
    assert spark.read.csv(str(tmp_path / "one"), header=True).first()["x"] == "a"
    f = tmp_path / "types.csv"
    f.write_text("﻿Data,Variable,type\nperson,sex,cat\nperson,age,cont\n", encoding="utf-8")
    reg = registry.read_variable_types(spark, str(f))
    assert registry.variables_of(reg, "person", "cat", spark.createDataFrame([("m",)], "sex string")) == ["sex"]


def test_whole_gap_and_year_tokens(spark):
    from mirrorcheck.operators.sequences import VISIT_START, gap_days, sequence_events
    days = spark.createDataFrame([("i-D0000000000005",), ("i-D6",), ("i-D",)], "t string").select(gap_days(F.col("t")).alias("d")).collect()
    assert [r["d"] for r in days] == [5, 6, 0]
    seq = spark.createDataFrame([(1, ["year:20011", VISIT_START, "7"], [None] * 3, [None] * 3), (2, ["year:2001", VISIT_START, "7"], [None] * 3, [None] * 3)],
                                "person_id long, concept_ids array<string>, number_as_values array<double>, concept_as_values array<string>")
    got = {r["person_id"]: r["event_date"] for r in sequence_events(seq, spark.createDataFrame([(7, "Drug")], "concept_id long, domain_id string")).collect()}
    assert got[1] is None and str(got[2]) == "2001-01-01"


def test_every_gender_gives_a_column(spark):
    from mirrorcheck.operators.explore import feature_matrix
    persons = spark.range(300).select(F.col("id").alias("person_id"), F.lit(1950).alias("year_of_birth"), F.col("id").cast("int").alias("gender_concept_id"))
    assert sum(c.startswith("gender_") for c in feature_matrix(persons, {}).columns) == 300


def test_deaths_without_extraction_dates(spark):
    from mirrorcheck.operators.facts import fact_days, patient_deaths
    death = spark.createDataFrame([(1, "2020-05-01"), (2, "1900-01-01")], "person_id long, death_date string")
    members = spark.createDataFrame([("deceased", True, 5)], "concept_set_name string, is_most_recent_version boolean, concept_id int")
    visits = spark.createDataFrame([(3, 5, "2021-01-01", "2021-01-04")], "person_id long, discharge_to_concept_id int, visit_start_date string, visit_end_date string")
    persons = spark.createDataFrame([(1,), (2,), (3,)], "person_id long")
    deaths = patient_deaths(death, members, persons, visits, "2018-01-01")
    assert {r["person_id"]: str(r["date"]) for r in deaths.collect()} == {1: "2020-05-01", 2: "None", 3: "2021-01-04"}
    assert fact_days(visits, [], deaths, "2018-01-01").count() == 3


def test_empty_synthetic_side_keeps_null_rows(spark, monkeypatch):
    from mirrorcheck.operators import vaccine_study as study

    monkeypatch.setattr(study, "study_estimates", lambda df, **kw: spark.createDataFrame([("Odds Ratio", 0.5, 0.1, 0.3, 0.7)], study.ESTIMATES))
    orig = spark.range(3)
    rows = [tuple(r) for r in study.compare_studies(orig, orig.where("false")).orderBy("dataset").collect()]
    assert rows == [("Odds Ratio", 0.5, 0.1, 0.3, 0.7, "Original"), ("Odds Ratio", None, None, None, None, "Synthetic")]
