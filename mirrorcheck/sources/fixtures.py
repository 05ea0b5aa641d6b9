"""The given tables seen as clinical tables, and a synthetic twin of each.

Every view is plain SQL that Spark and DuckDB both understand; the text is used by both. All
views keep every row of the table they come from, except ``death``, which takes the customers whose
balance is lowest. The synthetic twin holds the same rows with altered values, so both sides grow
with the data.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
        "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS: dict[str, str] = {}

VIEWS["person"] = """
SELECT c_custkey AS person_id,
  CAST(CASE WHEN c_custkey % 41 = 0 THEN NULL ELSE 1930 + c_custkey % 75 END AS INT) AS year_of_birth,
  CAST(c_custkey % 13 AS INT) AS month_of_birth,
  CAST(c_custkey % 29 AS INT) AS day_of_birth,
  CAST(CASE WHEN c_custkey % 50 = 0 THEN 0 WHEN c_custkey % 2 = 0 THEN 8507 ELSE 8532 END AS INT) AS gender_concept_id,
  CASE WHEN c_custkey % 50 = 0 THEN 'No matching concept' WHEN c_custkey % 2 = 0 THEN 'MALE' ELSE 'FEMALE' END AS gender_concept_name,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'White' WHEN 'MACHINERY' THEN 'Black' WHEN 'HOUSEHOLD' THEN 'Chinese'
    WHEN 'FURNITURE' THEN 'Multiple race' ELSE 'No Information' END AS race_concept_name,
  CAST(CASE c_nationkey % 4 WHEN 0 THEN 38003563 WHEN 3 THEN 0 ELSE 38003564 END AS INT) AS ethnicity_concept_id,
  CASE c_nationkey % 4 WHEN 0 THEN 'Hispanic or Latino' WHEN 3 THEN 'Unknown' ELSE 'Not Hispanic or Latino' END AS ethnicity_concept_name,
  c_nationkey AS data_partner_id,
  c_acctbal AS income,
  CAST(CASE WHEN c_acctbal > 5000 THEN 1 ELSE 0 END AS INT) AS flag_high,
  CAST(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS INT) AS flag_debt
FROM customer"""

VIEWS["person_s"] = """
SELECT person_id,
  CAST(CASE WHEN person_id % 29 = 0 THEN NULL WHEN person_id % 3 = 0 THEN year_of_birth + 1 ELSE year_of_birth END AS INT) AS year_of_birth,
  month_of_birth, day_of_birth,
  CAST(CASE WHEN person_id % 11 = 0 THEN 8507 ELSE gender_concept_id END AS INT) AS gender_concept_id,
  CASE WHEN person_id % 11 = 0 THEN 'MALE' ELSE gender_concept_name END AS gender_concept_name,
  CASE WHEN person_id % 37 = 0 THEN 'NEWLEVEL' WHEN person_id % 7 = 0 THEN 'White' ELSE race_concept_name END AS race_concept_name,
  CAST(CASE WHEN person_id % 5 = 0 THEN 38003563 ELSE ethnicity_concept_id END AS INT) AS ethnicity_concept_id,
  CASE WHEN person_id % 5 = 0 THEN 'Hispanic or Latino' ELSE ethnicity_concept_name END AS ethnicity_concept_name,
  data_partner_id,
  income * (0.9 + (person_id % 21) / 100.0) AS income,
  CAST(CASE WHEN person_id % 13 = 0 THEN 1 - flag_high ELSE flag_high END AS INT) AS flag_high,
  CAST(CASE WHEN person_id % 17 = 0 THEN 1 - flag_debt ELSE flag_debt END AS INT) AS flag_debt
FROM person"""

VIEWS["manifest"] = """
SELECT n_nationkey AS data_partner_id, CAST('2003-06-01' AS DATE) + CAST(n_nationkey AS INT) AS run_date,
  'omop' AS cdm_name, '5.3' AS cdm_version, 'N' AS shift_date_yn,
  CASE n_nationkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'NA' ELSE '30' END AS max_num_shift_days
FROM nation"""

VIEWS["visit_occurrence"] = """
SELECT o_orderkey AS visit_occurrence_id, o_custkey AS person_id,
  CAST(CASE o_orderkey % 6 WHEN 0 THEN 9201 WHEN 1 THEN 262 WHEN 2 THEN 8717 WHEN 3 THEN 581379 WHEN 4 THEN 32037 ELSE 9202 END AS INT) AS visit_concept_id,
  CAST(o_orderdate AS DATE) AS visit_start_date,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 AS INT) END AS visit_end_date,
  CAST(CASE WHEN o_orderkey % 101 = 0 THEN 4216643 WHEN o_orderkey % 103 = 0 THEN 8546 ELSE 0 END AS INT) AS discharge_to_concept_id,
  o_totalprice AS total_charge
FROM orders"""

VIEWS["visit_occurrence_s"] = """
SELECT visit_occurrence_id, person_id, visit_concept_id,
  visit_start_date + CAST(visit_occurrence_id % 5 AS INT) AS visit_start_date,
  visit_end_date + CAST(visit_occurrence_id % 7 AS INT) AS visit_end_date,
  discharge_to_concept_id AS discharged_to_concept_id,
  total_charge * 1.05 AS total_charge
FROM visit_occurrence"""

VIEWS["condition_occurrence"] = """
SELECT o_custkey AS person_id, CAST(1000 + l_partkey % 200 AS INT) AS condition_concept_id,
  CASE WHEN l_orderkey % 53 = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS condition_start_date
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""

VIEWS["condition_occurrence_s"] = """
SELECT person_id, CAST(CASE WHEN person_id % 9 = 0 THEN 1000 + (condition_concept_id + 1) % 200 ELSE condition_concept_id END AS INT) AS condition_concept_id,
  condition_start_date + CAST(person_id % 11 AS INT) AS condition_start_date
FROM condition_occurrence"""

VIEWS["drug_exposure"] = """
SELECT o_custkey AS person_id, CAST(2000 + l_suppkey % 100 AS INT) AS drug_concept_id,
  CAST(l_shipdate AS DATE) AS drug_exposure_start_date,
  CAST(l_shipdate AS DATE) + CAST(l_quantity AS INT) AS drug_exposure_end_date,
  l_quantity AS quantity
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""

VIEWS["procedure_occurrence"] = """
SELECT o_custkey AS person_id, CAST(3000 + l_partkey % 40 AS INT) AS procedure_concept_id,
  CAST(l_shipdate AS DATE) AS procedure_date
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""

VIEWS["observation"] = """
SELECT o_custkey AS person_id, CAST(1000 + o_orderkey % 200 AS INT) AS observation_concept_id,
  CAST(o_orderdate AS DATE) AS observation_date
FROM orders"""

VIEWS["device_exposure"] = """
SELECT o_custkey AS person_id, CAST(5000 + l_linenumber AS INT) AS device_concept_id,
  CAST(l_shipdate AS DATE) AS device_exposure_start_date
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""

VIEWS["measurement"] = """
SELECT o_custkey AS person_id, CAST(o_orderdate AS DATE) AS measurement_date,
  CAST(4000 + l_linenumber AS INT) AS measurement_concept_id,
  CASE l_linenumber WHEN 1 THEN l_quantity * 1.2 WHEN 2 THEN 1.4 + l_discount * 5 WHEN 3 THEN 40 + l_quantity * 2 ELSE NULL END AS value_as_number,
  CAST(CASE l_returnflag WHEN 'A' THEN 45884084 WHEN 'R' THEN 45878583 ELSE NULL END AS INT) AS value_as_concept_id
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""

VIEWS["measurement_s"] = """
SELECT person_id, measurement_date + CAST(person_id % 3 AS INT) AS measurement_date, measurement_concept_id,
  value_as_number * 1.02 AS value_as_number, value_as_concept_id
FROM measurement"""

VIEWS["death"] = """
SELECT c_custkey AS person_id,
  CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE CAST('2000-01-01' AS DATE) + CAST(c_custkey % 1500 AS INT) END AS death_date
FROM customer WHERE c_acctbal < -450"""

VIEWS["concept"] = """
SELECT CAST(1000 + p_partkey % 200 AS INT) AS concept_id, min(p_name) AS concept_name, 'Condition' AS domain_id FROM part GROUP BY CAST(1000 + p_partkey % 200 AS INT)
UNION ALL SELECT CAST(2000 + s_suppkey % 100 AS INT), min(s_name), 'Drug' FROM supplier GROUP BY CAST(2000 + s_suppkey % 100 AS INT)
UNION ALL SELECT CAST(3000 + p_partkey % 40 AS INT), min(p_type), 'Procedure' FROM part GROUP BY CAST(3000 + p_partkey % 40 AS INT)
UNION ALL SELECT CAST(5000 + n_nationkey AS INT), 'device', 'Device' FROM nation
UNION ALL SELECT CAST(4000 + n_nationkey AS INT), CASE WHEN n_nationkey < 4 THEN 'vital sign' ELSE 'laboratory test' END, 'Measurement' FROM nation"""

# Concept sets: three diagnosis sets, one device set, the measurement sets and the two discharge sets.
VIEWS["concept_set_members"] = """
SELECT CASE concept_id % 10 WHEN 0 THEN 'set A' WHEN 1 THEN 'set B' WHEN 2 THEN 'set C' ELSE 'not on the sheet' END AS concept_set_name,
  (concept_id % 7 <> 0) AS is_most_recent_version, concept_id
FROM concept WHERE domain_id <> 'Measurement'
UNION ALL SELECT CASE n_nationkey WHEN 1 THEN 'bmi' WHEN 2 THEN 'height' WHEN 3 THEN 'weight' WHEN 4 THEN 'influenza test'
    WHEN 5 THEN 'virus test' WHEN 6 THEN 'antibody test' ELSE 'other test' END, true, CAST(4000 + n_nationkey AS INT)
  FROM nation
UNION ALL SELECT 'result positive', true, 45884084
UNION ALL SELECT 'result negative', true, 45878583
UNION ALL SELECT 'deceased', true, 4216643
UNION ALL SELECT 'hospice', true, 8546"""

VIEWS["concept_sheet"] = """
SELECT 'set A' AS concept_set_name, 'FLU' AS indicator_prefix, 'condition,observation' AS domain
UNION ALL SELECT 'set B', 'ARI', 'condition,device'
UNION ALL SELECT 'set C', 'VACC', 'condition,drug,procedure'"""

VIEWS["flag_sheet"] = """
SELECT concept_id,
  CASE domain_id WHEN 'Condition' THEN CASE concept_id % 10 WHEN 0 THEN 'COPD' WHEN 1 THEN 'DIABETES' ELSE 'OTHER_CO' END
    WHEN 'Drug' THEN CASE WHEN concept_id % 10 = 3 THEN 'STATIN' ELSE 'OTHER_DE' END
    WHEN 'Procedure' THEN CASE WHEN concept_id % 20 = 4 THEN 'SURGERY' ELSE 'OTHER_PO' END
    ELSE 'NONE' END AS indicator_suffix,
  CASE domain_id WHEN 'Condition' THEN 'CO' WHEN 'Drug' THEN 'DE' WHEN 'Procedure' THEN 'PO' ELSE '' END AS table_code
FROM concept
UNION ALL SELECT 9201, 'INPATIENT', 'VO' UNION ALL SELECT 8717, 'INPATIENT', 'VO'"""

# The order lines as a wide table of numbers and categories, and its altered twin.
VIEWS["lines"] = """
SELECT l_orderkey, l_linenumber, l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax,
  l_returnflag AS returnflag, l_linestatus AS linestatus,
  CAST(CASE WHEN l_orderkey % 31 = 0 THEN NULL ELSE l_linenumber END AS STRING) AS line_no,
  CAST(l_suppkey % 50 AS STRING) AS supplier_group,
  CAST(l_shipdate AS DATE) AS ship_date, CAST(l_shipdate AS DATE) + CAST(l_quantity AS INT) AS end_date
FROM lineitem"""

VIEWS["lines_s"] = """
SELECT l_orderkey, l_linenumber,
  CASE WHEN l_orderkey % 23 = 0 THEN NULL ELSE quantity + l_orderkey % 3 END AS quantity,
  price * (0.95 + (l_orderkey % 11) / 100.0) AS price, discount, tax,
  CASE WHEN l_orderkey % 6 = 0 THEN 'A' WHEN l_orderkey % 97 = 0 THEN 'Z' ELSE returnflag END AS returnflag,
  CASE WHEN l_orderkey % 8 = 0 THEN 'O' ELSE linestatus END AS linestatus,
  CASE WHEN l_orderkey % 5 = 0 THEN '7' ELSE line_no END AS line_no,
  CASE WHEN l_orderkey % 4 = 0 THEN '49' ELSE supplier_group END AS supplier_group,
  ship_date + CAST(l_orderkey % 13 AS INT) AS ship_date, end_date + CAST(l_orderkey % 6 AS INT) AS end_date
FROM lines"""

# One table with original columns and three perturbed implicates, weights and replicate weights.
VIEWS["implicates"] = """
SELECT l_orderkey AS id, l_linenumber,
  CASE WHEN l_orderkey % 19 = 0 THEN NULL ELSE l_quantity END AS quantity,
  CASE WHEN l_orderkey % 11 = 0 THEN l_quantity + 1 WHEN l_orderkey % 31 = 0 THEN NULL ELSE l_quantity END AS quantity_1,
  CASE WHEN l_orderkey % 12 = 0 THEN l_quantity + 2 ELSE l_quantity END AS quantity_2,
  CASE WHEN l_orderkey % 13 = 0 THEN l_quantity + 3 ELSE l_quantity END AS quantity_3,
  l_tax AS tax,
  CASE WHEN l_orderkey % 5 = 0 THEN l_tax + 0.01 ELSE l_tax END AS tax_1,
  CASE WHEN l_orderkey % 6 = 0 THEN l_tax + 0.02 ELSE l_tax END AS tax_2,
  CASE WHEN l_orderkey % 7 = 0 THEN l_tax + 0.03 ELSE l_tax END AS tax_3,
  l_discount AS discount,
  CASE WHEN l_orderkey % 4 = 0 THEN l_discount / 2 ELSE l_discount END AS discount_1,
  CASE WHEN l_orderkey % 3 = 0 THEN l_discount / 2 ELSE l_discount END AS discount_2,
  CASE WHEN l_orderkey % 2 = 0 THEN l_discount / 2 ELSE l_discount END AS discount_3,
  l_returnflag AS flag,
  CASE WHEN l_orderkey % 6 = 0 THEN 'A' ELSE l_returnflag END AS flag_1,
  CASE WHEN l_orderkey % 7 = 0 THEN 'R' ELSE l_returnflag END AS flag_2,
  CASE WHEN l_orderkey % 8 = 0 THEN NULL ELSE l_returnflag END AS flag_3,
  l_linestatus AS status,
  CASE WHEN l_orderkey % 9 = 0 THEN 'O' ELSE l_linestatus END AS status_1,
  CASE WHEN l_orderkey % 10 = 0 THEN 'F' ELSE l_linestatus END AS status_2,
  l_linestatus AS status_3,
  CAST(l_linenumber AS STRING) AS line_no,
  CAST(CASE WHEN l_orderkey % 9 = 0 THEN 1 ELSE l_linenumber END AS STRING) AS line_no_1,
  CAST(CASE WHEN l_orderkey % 14 = 0 THEN 9 ELSE l_linenumber END AS STRING) AS line_no_2,
  CAST(l_linenumber AS STRING) AS line_no_3,
  CAST(CASE WHEN l_linenumber <= 2 THEN 1 ELSE 0 END AS INT) AS early,
  CAST(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS INT) AS cheap,
  CASE WHEN l_suppkey % 3 = 0 THEN 'high' ELSE 'low' END AS tier,
  l_extendedprice AS weight""" + "".join(
    f",\n  l_extendedprice * (1 + ((l_orderkey * {r}) % 7 - 3) / 20.0) AS rep_{r}" for r in range(1, 9)
) + "\nFROM lineitem"

# Token sequences: one row per order, tokens in line order with markers and day gaps.
VIEWS["sequence_tokens"] = """
SELECT o_custkey AS person_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag,
  CAST(o_orderdate AS DATE) AS order_date, CAST(l_shipdate AS DATE) AS ship_date
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


def _depends(name: str, text: str) -> bool:
    return re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text, re.IGNORECASE) is not None


def view_order(text: str) -> list[str]:
    """Names of the views that ``text`` reads, directly or through other views, in build order."""
    order: list[str] = []

    def visit(sql: str) -> None:
        for name in VIEWS:
            if name not in order and _depends(name, sql):
                visit(VIEWS[name])
                order.append(name)

    visit(text)
    return order


def with_views(body: str) -> str:
    """Put the needed view definitions in front of a SELECT (which may start with WITH)."""
    parts = [f"{name} AS ({VIEWS[name].strip()})" for name in view_order(body)]
    body = body.strip()
    if not parts:
        return body
    rest = re.match(r"WITH\s+", body, re.IGNORECASE)
    if rest:
        return "WITH " + ",\n".join(parts) + ",\n" + body[rest.end():]
    return "WITH " + ",\n".join(parts) + "\n" + body


class ClinicalTables:
    """Lazy access to the given tables and the views by attribute: ``t.person``, ``t.lineitem``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        elif name in VIEWS:
            df = self.sql(f"SELECT * FROM {name}")
        else:
            raise AttributeError(name)
        self.__dict__[name] = df
        return df

    def sql(self, text: str) -> DataFrame:
        full = with_views(text)
        base = [
            f"{b} AS (SELECT * FROM parquet.`{self.sf_dir}/{b}.parquet`)"
            for b in BASE if _depends(b, full)
        ]
        if base:
            rest = re.match(r"WITH\s+", full, re.IGNORECASE)
            tail = ",\n" + full[rest.end():] if rest else "\n" + full
            full = "WITH " + ",\n".join(base) + tail
        return self.spark.sql(full)
