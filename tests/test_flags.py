"""Person flags without a shuffle by the concept."""

from mirrorcheck.operators import risk_inputs


def without_sizes(spark):
    """No join is sent to all tasks for the size that Spark guesses, as with large tables."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold",)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    return before


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_person_flags_are_not_shuffled_by_concept(spark):
    people = spark.createDataFrame([(1,), (2,), (2,), (3,), (None,)], "person_id long")
    conditions = spark.createDataFrame([(1, 10), (1, 10), (2, 11), (3, None), (None, 10)], "person_id long, c int")
    drugs = spark.createDataFrame([(2, 10), (3, 20)], "person_id long, d long")
    sheet = spark.createDataFrame([("CO", 10, "A"), ("CO", 10, "A"), ("CO", 11, "B"), ("DE", 20, "B"), ("DE", 10, "unwanted")], "table_code string, concept_id int, indicator_suffix string")
    before = without_sizes(spark)
    try:
        out = risk_inputs.person_flags(people, {"CO": (conditions, "c"), "DE": (drugs, "d")}, sheet, ["A", "B"])
        assert "hashpartitioning(table_code" not in plan(out) and "hashpartitioning(concept_id" not in plan(out)
        found = sorted(map(tuple, out.collect()), key=str)
        assert found == [(1, 1, 0), (2, 0, 1), (2, 0, 1), (3, 0, 1), (None, 0, 0)]
    finally:
        spark.conf.set(*before.popitem())
