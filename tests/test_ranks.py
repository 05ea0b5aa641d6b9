"""Rank correlations look at each value once and join it without going through pairs of row and variable."""

import pytest
from pyspark.sql import functions as F

from mirrorcheck.functions import ordered
from mirrorcheck.functions.session import stored
from mirrorcheck.operators import association


def test_values_are_counted_once_for_all_partners(spark, monkeypatch):
    rows = spark.range(40).select(*[F.when(F.col("id") % (i + 3) > 0, F.col("id") * (i + 1) % 11).cast("double").alias(c) for i, c in enumerate("abc")])
    seen = []
    real = association.value_counts
    monkeypatch.setattr(association, "value_counts", lambda df, *a, **k: seen.append(df.count()) or real(df, *a, **k))
    first = {tuple(r) for r in association.rank_correlations(rows, rows, ["a", "b", "c"]).collect()}
    assert seen == [2 * 3 * 40]  # with a set of values for each partner: 2 * 3 * 40 * 3 less the nulls
    monkeypatch.setattr(association, "MOST_VALUES_SENT", 0)
    second = association.rank_correlations(rows, rows, ["a", "b", "c"]).collect()
    by_pair = {r[:2]: r for r in first}
    assert len(second) == 3
    for r in second:
        assert r["orig_corr"] == pytest.approx(by_pair[r["var_1"], r["var_2"]][2])


def test_attach_by_value_keeps_rows_without_value(spark):
    rows = spark.createDataFrame([(0, 1.0), (0, 2.0), (0, None), (1, 1.0), (1, 5.0)], "g int, v double")
    facts = stored(spark.createDataFrame([(0, 1.0, 1, "a"), (0, 2.0, 5000, "b"), (1, 1.0, 1, "c"), (1, 9.0, 5000, "d")], "g int, v double, n long, f string"))
    want = [(0, 1.0, "a"), (0, 2.0, "b"), (0, None, None), (1, 1.0, "c"), (1, 5.0, None)]
    for small in (True, False):
        got = [tuple(r) for r in ordered.attach_by_value(rows, facts, ["g"], "v", "n", small).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    one = facts.where("g = 0").drop("g")
    got = {tuple(r) for r in ordered.attach_by_value(rows.where("g = 0"), one, [], "v", "n").collect()}
    assert got == {(0, 1.0, "a"), (0, 2.0, "b"), (0, None, None)}
