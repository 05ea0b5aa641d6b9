"""Frames that are stored by columns."""

from datetime import date

from mirrorcheck.functions.session import stored


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_frames_keep_rows_and_types(spark):
    df = spark.createDataFrame([(1, None, date(2001, 1, 1)), (1, None, date(2001, 1, 1)), (None, "x", None)], "a int, b string, c date")
    kept = stored(df)
    assert kept.dtypes == df.dtypes and "Parquet" in plan(kept)
    assert sorted(kept.collect(), key=str) == sorted(df.collect(), key=str)
