"""Queries for table sets."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import union_all
from ..functions.session import scratch_folder
from ..operators import tablesets as ts
from ..sources import tables as src
from .registry import query

ORIG = ["person", "visit_occurrence", "condition_occurrence", "measurement", "death", "concept"]
NEW = {"person": "person_s", "visit_occurrence": "visit_occurrence_s",
       "condition_occurrence": "condition_occurrence_s", "measurement": "measurement_s"}

REGISTRY = [
    ("person", "gender_concept_name", "cat", "1"), ("person", "race_concept_name", "cat", "1"),
    ("person", "ethnicity_concept_name", "cat", "1"), ("person", "year_of_birth", "cont", "1"),
    ("person", "income", "cont", None), ("person", "person_id", "skip", None),
    ("visit_occurrence", "visit_concept_id", "cat", "1"), ("visit_occurrence", "total_charge", "cont", None),
    ("condition_occurrence", "condition_concept_id", "cat", "1"), ("measurement", "measurement_concept_id", "cat", "1"),
    ("measurement", "value_as_concept_id", "cat", None), ("measurement", "value_as_number", "cont", "1"),
    ("lines", "returnflag", "cat", "1"), ("lines", "linestatus", "cat", "1"), ("lines", "line_no", "cat", None), ("lines", "supplier_group", "cat", None),
    ("lines", "quantity", "cont", "1"), ("lines", "price", "cont", "1"), ("lines", "discount", "cont", None), ("lines", "tax", "cont", None),
]


def registry(spark):
    return spark.createDataFrame(REGISTRY, "folder string, col_name string, type string, high_util string")


HASH = "CAST('0x' || substr(md5('{seed}:' || CAST({key} AS STRING)), 1, 8) AS BIGINT) / 4294967296.0"


@query("a01_load_tables", """
SELECT 'customer' AS table_name, count(*) AS n_rows FROM customer UNION ALL
SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem""")
def _(t):
    tables = src.load_tables(t.spark, t.sf_dir, ["customer", "orders", "lineitem"], suffix=".parquet")
    return ts.table_counts(tables).select("table_name", "n_rows")


@query("a03_run_sql", """
SELECT o_orderpriority AS priority, count(*) AS n, round(sum(l_extendedprice), 2) AS total
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderpriority""", digits=2)
def _(t):
    return src.run_sql(t.spark, {"orders": t.orders, "lineitem": t.lineitem}, """
        SELECT o_orderpriority AS priority, count(*) AS n, sum(l_extendedprice) AS total
        FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey GROUP BY o_orderpriority""")


@query("a04_write_frames", """
SELECT l_returnflag, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY l_returnflag""")
def _(t):
    from ..functions.session import ensure_checkpoint_dir
    import uuid
    ensure_checkpoint_dir(t.spark)
    folder = f"{t.spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4()}"
    frame = t.lineitem.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("s"))
    (path,) = src.write_frames({"flags": frame}, folder)
    return t.spark.read.parquet(path)


CONCEPTS = T.StructType([T.StructField("concept_id", T.IntegerType()), T.StructField("concept_name", T.StringType()), T.StructField("domain_id", T.StringType())])


@query("a04_delimited_files", """
SELECT f AS format, concept_id, concept_name, domain_id FROM concept, (VALUES ('csv'), ('tsv')) x(f)""")
def _(t):
    """A table written as CSV and TSV and read back with its declared schema."""
    folder = scratch_folder(t.spark)
    paths = src.write_frames({"concept": t.concept}, folder, "csv") + src.write_frames({"concept_tabs": t.concept}, folder, "tsv")
    return union_all([src.read_delimited(t.spark, path, CONCEPTS, sep).withColumn("format", F.lit(name))
                      for path, sep, name in zip(paths, (",", "\t"), ("csv", "tsv"))])


@query("a05_sample_persons", f"""
SELECT person_id, year_of_birth FROM person WHERE {HASH.format(seed=111, key='person_id')} < 0.2""")
def _(t):
    return ts.sample_persons(t.person, 0.2, 111).select("person_id", "year_of_birth")


@query("a06_restrict_to_persons", f"""
WITH ids AS (SELECT person_id FROM person WHERE {HASH.format(seed=111, key='person_id')} < 0.2)
SELECT 'person' AS table_name, count(*) AS n_rows, count(DISTINCT person_id) AS n_persons FROM person WHERE person_id IN (SELECT person_id FROM ids)
UNION ALL SELECT 'visit_occurrence', count(*), count(DISTINCT person_id) FROM visit_occurrence WHERE person_id IN (SELECT person_id FROM ids)
UNION ALL SELECT 'condition_occurrence', count(*), count(DISTINCT person_id) FROM condition_occurrence WHERE person_id IN (SELECT person_id FROM ids)
UNION ALL SELECT 'concept', count(*), NULL FROM concept""")
def _(t):
    tables = {n: getattr(t, n) for n in ("person", "visit_occurrence", "condition_occurrence", "concept")}
    return ts.table_counts(ts.restrict_to_persons(tables, ts.sample_persons(t.person, 0.2, 111)))


VISIT_SCHEMA = T.StructType([
    T.StructField("visit_occurrence_id", T.LongType()), T.StructField("person_id", T.LongType()),
    T.StructField("visit_concept_id", T.LongType()), T.StructField("visit_start_date", T.DateType()),
    T.StructField("visit_end_date", T.DateType()), T.StructField("discharge_to_concept_id", T.LongType()),
    T.StructField("visit_concept_name", T.StringType()),
])


@query("a07_conform_table", """
SELECT visit_occurrence_id, person_id, CAST(visit_concept_id AS BIGINT) AS visit_concept_id, visit_start_date, visit_end_date,
  CAST(discharged_to_concept_id AS BIGINT) AS discharge_to_concept_id, CAST(NULL AS STRING) AS visit_concept_name FROM visit_occurrence_s""")
def _(t):
    return src.conform(t.visit_occurrence_s, VISIT_SCHEMA, {"discharged_to_concept_id": "discharge_to_concept_id"})


def _parity_sql():
    def side(pairs):
        return " UNION ALL ".join(
            f"SELECT '{n}' AS table_name, count(*) AS r, {'count(DISTINCT person_id)' if n != 'concept' else 'NULL'} AS p FROM {v}"
            for n, v in pairs)
    return f"""
WITH a AS ({side([(n, n) for n in ORIG])}), b AS ({side(NEW.items())})
SELECT coalesce(a.table_name, b.table_name) AS table_name, a.r IS NOT NULL AS in_orig, b.r IS NOT NULL AS in_new,
  a.r AS orig_rows, b.r AS new_rows, a.p AS orig_persons, b.p AS new_persons, coalesce(a.r = b.r, false) AS same_rows
FROM a FULL JOIN b ON a.table_name = b.table_name"""


@query("a08_table_parity", _parity_sql())
def _(t):
    return ts.table_parity({n: getattr(t, n) for n in ORIG}, {n: getattr(t, v) for n, v in NEW.items()})


TWINS = ("person", "visit_occurrence", "condition_occurrence", "measurement", "lines")


def _profile_sql():
    def side(suffix):
        return " UNION ALL ".join(
            f"SELECT '{n}' AS folder, col_name, d FROM (UNPIVOT (SELECT count(DISTINCT COLUMNS('(.*)')) AS '\\1' FROM {n}{suffix}) ON COLUMNS(*) INTO NAME col_name VALUE d)"
            for n in TWINS)
    values = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" for v in r) + ")" for r in REGISTRY)
    return f"""
WITH a AS ({side('')}), b AS ({side('_s')}), r(folder, col_name, type, high_util) AS (VALUES {values})
SELECT coalesce(a.folder, b.folder) AS folder, coalesce(a.col_name, b.col_name) AS col_name, a.d AS orig_distinct, b.d AS new_distinct, r.type, r.high_util
FROM a FULL JOIN b ON a.folder = b.folder AND a.col_name = b.col_name
LEFT JOIN r ON coalesce(a.folder, b.folder) = r.folder AND coalesce(a.col_name, b.col_name) = r.col_name"""


@query("a09_column_profile", _profile_sql())
def _(t):
    """Every column of every table that has a twin."""
    return ts.column_profile({n: getattr(t, n) for n in TWINS}, {n: getattr(t, n + "_s") for n in TWINS}, registry(t.spark))


@query("a10_required_columns", """
WITH c AS (SELECT count(*) AS n, count(measurement_date) AS d, count(value_as_number) AS v, count(value_as_concept_id) AS k FROM measurement)
SELECT 'measurement_date' AS col_name, true AS present, n AS n_rows, d AS non_null_rows, round(d / n, 6) AS non_null_share FROM c
UNION ALL SELECT 'value_as_number', true, n, v, round(v / n, 6) FROM c
UNION ALL SELECT 'value_as_concept_id', true, n, k, round(k / n, 6) FROM c
UNION ALL SELECT 'unit_concept_id', false, n, 0, 0.0 FROM c""")
def _(t):
    return ts.required_columns(t.measurement, ["measurement_date", "value_as_number", "value_as_concept_id", "unit_concept_id"])
