"""Fact days are grouped where the sources lie."""

import datetime as dt

from mirrorcheck.operators import facts

DAY = dt.date(2001, 2, 3)


def sources(spark):
    persons = spark.createDataFrame([(1,), (2,)], "person_id long")
    events = spark.createDataFrame([(1, 7, DAY), (1, 7, DAY), (3, 7, DAY), (2, 8, DAY), (2, 7, None)], "person_id long, cid int, d date")
    sets = spark.createDataFrame([(7, "FLU"), (8, "ARI")], "concept_id long, indicator_prefix string")
    visits = spark.createDataFrame([(1, DAY), (4, DAY)], "person_id long, visit_start_date date")
    deaths = spark.createDataFrame([(2, DAY, 1)], "person_id long, date date, patient_death int")
    return persons, events, sets, visits, deaths


def test_union_of_facts_is_grouped_without_a_shuffle(spark):
    persons, events, sets, visits, deaths = sources(spark)
    found = [facts.domain_facts(events, persons, sets, "cid", "d", [i]) for i in ("FLU", "ARI")]
    out = facts.fact_days(visits, found, deaths, "2000-01-01", unfilled=())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Union" in plan and "Exchange" not in plan[:plan.index("Union")]
    assert {(r["person_id"], r["FLU"], r["ARI"], r["patient_death_at_visit"]) for r in out.collect()} == {
        (1, 1, 0, 0), (2, 0, 1, 1), (4, 0, 0, 0)}
