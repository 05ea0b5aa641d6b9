"""The variable-type list: which column of which table is categorical, continuous or skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Header names seen in such lists, and the names used here.
HEADERS = {"folder": "folder", "data": "folder", "col_name": "col_name", "variable": "col_name",
           "type": "type", "high_util": "high_util"}


def read_variable_types(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Read the list with either header form; a byte-order mark is dropped."""
    raw = spark.read.csv(path, header=True, sep=sep)
    out = raw.select(*[
        F.trim(F.col(f"`{c}`")).alias(HEADERS[c.lstrip("﻿").strip().lower()])
        for c in raw.columns if c.lstrip("﻿").strip().lower() in HEADERS
    ])
    if "high_util" not in out.columns:
        out = out.withColumn("high_util", F.lit(None).cast("string"))
    return out.select("folder", "col_name", "type", "high_util")


def variables_of(registry: DataFrame, folder: str, kind: str, *frames: DataFrame) -> list[str]:
    """Names of one kind for one table, in list order, that occur in all frames (a few hundred rows at most)."""
    names = [r["col_name"] for r in registry.where((F.col("folder") == folder) & (F.col("type") == kind)).collect()]
    return [n for n in names if all(n in f.columns for f in frames)]
