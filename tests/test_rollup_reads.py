"""The roll-up of implicates and cells with totals read their rows once."""

from pyspark.sql import functions as F

from mirrorcheck.operators import crosstabs, distances, implicates, intervals


def counted(spark, rows, schema):
    """The rows and a counter of how many of them were read."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return spark.createDataFrame(rows, schema).mapInArrow(run, schema), seen


def test_rollup_reads_measures_once(spark):
    df, seen = counted(spark, [("a", "1", 1.0), ("a", "2", 3.0)], "variable string, implicate string, x double")
    out = implicates.implicate_rollup({"m": (df, ["variable"], "x")}, 2).collect()
    assert [(r["n_implicates"], r["mean"]) for r in out] == [(2, 2.0)]
    assert seen.value == 2


def test_cells_are_counted_once(spark):
    rows = [("x", "p", 1.0), ("x", "q", 1.0), ("y", None, 2.0)]
    o, seen = counted(spark, rows, "a string, b string, w double")
    n = spark.createDataFrame([("x", "p", 1.0), ("y", "q", 2.0)], "a string, b string, w double")
    found = crosstabs.total_variation(crosstabs.compare_combinations(o, n, [("a", "b")], "w")).collect()
    assert seen.value == 3 and len(found) == 1
    many = crosstabs.compare_combinations(o, n, [("a", "b"), ("b", "a")], "w")
    assert {(r["level_1"], r["level_2"], r["n_orig"], r["w_new"]) for r in many.where(F.col("crosstab") == "a x b").collect()} == {
        ("x", "p", 1, 1.0), ("x", "q", 1, 0.0), ("y", None, 1, 0.0), ("y", "q", 0, 2.0)}


def test_levels_read_the_original_once_for_all_implicates(spark):
    o, seen = counted(spark, [("x", 1.0), (None, None)], "a string, w double")
    n = spark.createDataFrame([("x", "z", 2.0)], "a_1 string, a_2 string, w double")
    got = {tuple(r) for r in distances.level_counts(o, n, ["a"], "w", ["_1", "_2"]).collect()}
    assert got == {("a", "1", "x", 1, 1, 1.0, 2.0), ("a", "2", "x", 1, 0, 1.0, 0.0), ("a", "2", "z", 0, 1, 0.0, 2.0),
                   ("a", "1", None, 1, 0, None, 0.0), ("a", "2", None, 1, 0, None, 0.0)}
    assert seen.value == 2


def test_simple_overlap_of_subsets(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 1), (9.0, 0), (None, 1)], "v double, s int")
    row = intervals.ci_overlap(df, df, ["v"], subsets=["s"]).first()
    assert row["orig"] == 1.5 and abs(row["overlap"] - 1) < 1e-12
