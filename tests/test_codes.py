"""Events meet lists of concepts without a shuffle by the concept."""

from datetime import date

from mirrorcheck.operators import concepts, facts


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def without_sizes(spark):
    """No join is sent to all tasks for the size that Spark guesses, as with large tables."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold",)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    return before


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


EVENTS = [(p, date(2001, 1, d), c) for p in (1, 2, 3) for d in (1, 2) for c in (5001, 5002, None)] + [(None, date(2001, 1, 1), 5001), (9, date(2001, 1, 1), 5001), (1, None, 5001)]


def test_domain_facts_are_not_shuffled_by_concept(spark):
    events = spark.createDataFrame(EVENTS, "person_id long, day date, concept int")
    codes = spark.createDataFrame([(5001, "ARI"), (5001, "ARI"), (5001, "FLU"), (None, "ARI"), (5002, "other")], "concept_id long, indicator_prefix string")
    people = spark.createDataFrame([(1,), (1,), (2,), (None,)], "person_id long")
    before = without_sizes(spark)
    try:
        out = facts.domain_facts(events, people, codes, "concept", "day", ["ARI", "FLU"])
        assert "hashpartitioning(concept_id" not in plan(out)
        assert rows(out) == [(p, date(2001, 1, d), 1, 1) for p in (1, 2) for d in (1, 2)]
    finally:
        spark.conf.set(*before.popitem())


def test_labels_are_not_shuffled_by_concept(spark):
    members = spark.createDataFrame([("a", True, 1), ("a", True, 1), ("b", True, 1), ("c", True, 2), ("a", False, 3), ("a", True, None)],
                                    "concept_set_name string, is_most_recent_version boolean, concept_id int")
    df = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 3), (5, None)], "id int, c int")
    before = without_sizes(spark)
    try:
        out = concepts.label_by_set(df, members, "c", "sets", ["a", "b"])
        assert "hashpartitioning(c" not in plan(out) and "SortMergeJoin" not in plan(out)
        assert [(i, sorted(s)) for i, _, s in rows(out)] == [(1, ["a", "b"]), (2, ["a", "b"]), (3, []), (4, []), (5, [])]
    finally:
        spark.conf.set(*before.popitem())


def test_long_lists_of_concepts_are_not_sent(spark, monkeypatch):
    monkeypatch.setattr(concepts, "MOST_SENT", 1)
    monkeypatch.setattr(concepts, "MOST_LISTED", 1)
    events = spark.createDataFrame([(1, 7), (2, 8), (3, None)], "id int, c long")
    codes = spark.createDataFrame([(7, "x"), (7, "x"), (8, "y"), (None, "z")], "c long, t string")
    assert rows(concepts.with_codes(events, codes, "c").select("id", "t")) == [(1, "x"), (2, "y")]
