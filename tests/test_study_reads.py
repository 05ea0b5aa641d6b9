"""The study shuffles of fact days and measurements only what its steps read."""

import datetime as dt

from mirrorcheck.functions.session import stored
from mirrorcheck.operators import facts, vaccine_study as vs
from mirrorcheck.plans import vaccine_study as plans

DESIGN = vs.StudyDesign(diagnoses=["FLU"], vaccination="VACC")


def day(n):
    return dt.date(2001, 1, 1) + dt.timedelta(n)


def joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


def test_days_are_joined_once_unless_an_episode_is_long(spark):
    days = spark.createDataFrame([(1, day(21), 1, 0), (1, day(21), 1, 0), (2, day(900), 1, 0), (2, day(5), 0, 1), (None, day(21), 1, 0)], "person_id long, date date, FLU int, VACC int")
    short = [(1, "1_1", day(20), day(25)), (1, "1_2", day(300), day(305)), (3, "3_1", None, day(3))]
    schema = f"person_id long, {vs.EPISODE} string, {vs.START} date, {vs.END} date"
    few, all_ = (stored(spark.createDataFrame(rows, schema)) for rows in (short, [*short, (2, "2_1", day(10), day(1000))]))
    assert {r[1] for r in vs.episodes_with_diagnosis(few, days, ["FLU"]).collect()} == {"1_1"}
    assert {r[1] for r in vs.episodes_with_diagnosis(all_, days, ["FLU"]).collect()} == {"1_1", "2_1"}
    assert joins(vs.episodes_with_diagnosis(few, days, ["FLU"])) == 2
    assert joins(vs.episodes_with_diagnosis(all_, days, ["FLU"])) == 3
    assert {(r[1], r["vaccinated"]) for r in vs.vaccination_status(all_, days, DESIGN).collect()} == {("1_1", 0), ("1_2", 0), ("3_1", 0), ("2_1", 1)}


def test_wanted_flags_are_those_of_all_measurements(spark):
    persons = spark.createDataFrame([(1,), (2,)], "person_id long")
    members = spark.createDataFrame([("influenza test", True, 4), ("virus test", True, 5), ("virus test", False, 9), ("antibody test", True, 6), ("bmi", True, 1),
                                     ("result positive", True, 71), ("result negative", True, 72)], "concept_set_name string, is_most_recent_version boolean, concept_id int")
    rows = [(1, day(0), 4, 71, None), (1, day(0), 4, 72, None), (1, day(1), 5, facts.EXTRA_NEGATIVE_RESULT, None), (2, day(1), 6, 71, None), (2, day(2), 1, None, 31.0),
            (2, day(3), 4, None, None), (2, day(4), None, 71, None), (2, None, 4, 71, None), (3, day(0), 4, 71, None), (2, day(5), 9, 71, None), (None, day(0), 4, 71, None)]
    measured = spark.createDataFrame(rows, "person_id long, measurement_date date, measurement_concept_id int, value_as_concept_id int, value_as_number double")
    wanted = ["INFLUENZA_POS", "INFLUENZA_NEG", "PCR_AG_Pos", "PCR_AG_Neg"]
    for swapped in (False, True):
        full = facts.measurement_facts(measured, members, persons, swapped_influenza=swapped)
        some = facts.measurement_facts(measured, members, persons, swapped_influenza=swapped, indicators=wanted)
        assert some.dtypes == [x for x in full.dtypes if x[0] in some.columns]
        assert sorted(some.collect()) == sorted(full.select("person_id", "date", *wanted).where(" + ".join(wanted) + " > 0").collect())
    assert {(r["date"], r["BMI_rounded"], r["OBESITY"]) for r in facts.measurement_facts(measured, members, persons).where("BMI_rounded is not null").collect()} == {(day(2), 31.0, 1)}


def test_stored_days_hold_what_the_study_reads(spark):
    days = plans.inputs(plans_tables(spark))[0]
    assert days.columns == ["person_id", "date", "FLU", "ARI", "VACC", "INFLUENZA_POS", "INFLUENZA_NEG", "PCR_AG_Pos", "PCR_AG_Neg"]
    assert {tuple(r) for r in days.collect()} == {(1, dt.date(2000, 5, 6), 0, 0, 0, 1, 0, 0, 0)}


def plans_tables(spark):
    """Two persons: one visit without a fact, one positive test and a measured weight."""
    class Tables:
        def __getattr__(self, name):
            return TABLES[name](spark)
    t = Tables()
    t.spark = spark
    return t


D = dt.date(2000, 5, 6)
EVENT = "person_id long, {0}_concept_id int, {1} date"
TABLES = {
    "person": lambda s: s.createDataFrame([(1, 1950, 1, 1, "a", "White", "MALE", 1), (2, 1960, 1, 1, "a", "White", "FEMALE", 1)],
                                          "person_id long, year_of_birth int, month_of_birth int, day_of_birth int, ethnicity_concept_name string, race_concept_name string, gender_concept_name string, data_partner_id int"),
    "manifest": lambda s: s.createDataFrame([(1, dt.date(2003, 6, 1), "omop", "5", "N", "")], "data_partner_id int, run_date date, cdm_name string, cdm_version string, shift_date_yn string, max_num_shift_days string"),
    "visit_occurrence": lambda s: s.createDataFrame([(1, 2, 9201, D, D, 0)], "visit_occurrence_id long, person_id long, visit_concept_id int, visit_start_date date, visit_end_date date, discharge_to_concept_id int"),
    "condition_occurrence": lambda s: s.createDataFrame([], EVENT.format("condition", "condition_start_date")),
    "device_exposure": lambda s: s.createDataFrame([], EVENT.format("device", "device_exposure_start_date")),
    "drug_exposure": lambda s: s.createDataFrame([], EVENT.format("drug", "drug_exposure_start_date")),
    "observation": lambda s: s.createDataFrame([], EVENT.format("observation", "observation_date")),
    "procedure_occurrence": lambda s: s.createDataFrame([], EVENT.format("procedure", "procedure_date")),
    "measurement": lambda s: s.createDataFrame([(1, D, 4, 71, None), (2, D, 3, None, 70.0)], "person_id long, measurement_date date, measurement_concept_id int, value_as_concept_id int, value_as_number double"),
    "death": lambda s: s.createDataFrame([], "person_id long, death_date date"),
    "concept_set_members": lambda s: s.createDataFrame([("influenza test", True, 4), ("weight", True, 3), ("result positive", True, 71)], "concept_set_name string, is_most_recent_version boolean, concept_id int"),
    "concept_sheet": lambda s: s.createDataFrame([("set A", "FLU", "condition")], "concept_set_name string, indicator_prefix string, domain string"),
}
