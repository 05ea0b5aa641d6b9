"""Table sets: sampling, parity counts, column profiles and audits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import column_counts, hash_uniform, ratio, union_all


def sample_persons(person: DataFrame, fraction: float, seed: int = 111, key: str = "person_id") -> DataFrame:
    """A sample that depends on seed and key only, hence the same under any partitioning."""
    return person.where(hash_uniform(seed, key) < fraction)


def random_sample(person: DataFrame, fraction: float, seed: int = 111) -> DataFrame:
    """Spark's own seeded sample without replacement."""
    return person.sample(withReplacement=False, fraction=fraction, seed=seed)


def restrict_to_persons(tables: Mapping[str, DataFrame], persons: DataFrame, key: str = "person_id") -> dict[str, DataFrame]:
    """Keep, in every table that has the key, the rows of the given persons."""
    ids = persons.select(key).distinct()
    return {n: (t.join(ids, key, "left_semi") if key in t.columns else t) for n, t in tables.items()}


def table_counts(tables: Mapping[str, DataFrame], key: str = "person_id") -> DataFrame:
    """Rows and distinct persons of every table."""
    return union_all([
        t.agg(
            F.count("*").alias("n_rows"),
            (F.count_distinct(F.col(key)) if key in t.columns else F.lit(None).cast("long")).alias("n_persons"),
        ).select(F.lit(n).alias("table_name"), "n_rows", "n_persons")
        for n, t in tables.items()
    ])


def table_parity(orig: Mapping[str, DataFrame], new: Mapping[str, DataFrame], key: str = "person_id") -> DataFrame:
    """Counts of both table sets joined by table name, with presence and row-parity flags."""
    a = table_counts(orig, key).withColumnsRenamed({"n_rows": "orig_rows", "n_persons": "orig_persons"})
    b = table_counts(new, key).withColumnsRenamed({"n_rows": "new_rows", "n_persons": "new_persons"})
    return a.join(b, "table_name", "outer").select(
        "table_name",
        F.col("orig_rows").isNotNull().alias("in_orig"),
        F.col("new_rows").isNotNull().alias("in_new"),
        "orig_rows", "new_rows", "orig_persons", "new_persons",
        F.coalesce(F.col("orig_rows") == F.col("new_rows"), F.lit(False)).alias("same_rows"),
    )


def distinct_values(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Distinct non-null values of every column of every table."""
    return union_all([column_counts(t, t.columns).select(F.lit(name).alias("folder"), F.col("variable").alias("col_name"), "n_distinct") for name, t in tables.items()])


def column_profile(orig: Mapping[str, DataFrame], new: Mapping[str, DataFrame], registry: DataFrame) -> DataFrame:
    """Distinct-value counts of both sides joined to the variable-type list."""
    a = distinct_values(orig).withColumnRenamed("n_distinct", "orig_distinct")
    b = distinct_values(new).withColumnRenamed("n_distinct", "new_distinct")
    return a.join(b, ["folder", "col_name"], "outer").join(registry, ["folder", "col_name"], "left")


def required_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """For each required column: present or not, non-null rows and their share."""
    there = [c for c in required if c in df.columns]
    counts = df.agg(F.count("*").alias("n_rows"), *[F.count(F.col(c)).alias(f"n_{c}") for c in there])
    return counts.select(F.inline(F.array(*[
        F.struct(
            F.lit(c).alias("col_name"),
            F.lit(c in there).alias("present"),
            F.col("n_rows"),
            (F.col(f"n_{c}") if c in there else F.lit(0).cast("long")).alias("non_null_rows"),
            ratio(F.col(f"n_{c}") if c in there else F.lit(0), F.col("n_rows")).alias("non_null_share"),
        ) for c in required
    ])))
