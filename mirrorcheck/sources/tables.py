"""Loading, conforming, querying and writing sets of tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def load_tables(spark: SparkSession, folder: str, names: Sequence[str], suffix: str = "",
                schemas: Mapping[str, T.StructType] | None = None) -> dict[str, DataFrame]:
    """Read ``folder/name+suffix`` as parquet for every name; with a schema, conform to it."""
    tables = {}
    for name in names:
        df = spark.read.parquet(f"{folder}/{name}{suffix}")
        tables[name] = conform(df, schemas[name]) if schemas and name in schemas else df
    return tables


def read_delimited(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",") -> DataFrame:
    """Read a CSV or TSV file with a declared schema."""
    return spark.read.csv(path, schema=schema, header=True, sep=sep)


def conform(df: DataFrame, schema: T.StructType, renames: Mapping[str, str] | None = None) -> DataFrame:
    """Give a table the declared columns: rename, cast, and add absent ones as typed nulls."""
    renames = dict(renames or {})
    for old, new in renames.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    return df.select(*[
        (F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schema.fields
    ])


def run_sql(spark: SparkSession, tables: Mapping[str, DataFrame], text: str) -> DataFrame:
    """Run a SQL string on named tables; ``{name}`` in the text stands for the table."""
    return spark.sql(text, **{n: t for n, t in tables.items() if "{" + n + "}" in text})


def write_frames(frames: Mapping[str, DataFrame], folder: str, fmt: str = "parquet") -> list[str]:
    """Write each result frame into its own folder below ``folder`` (parquet, or CSV or TSV with header)."""
    if fmt not in ("parquet", "csv", "tsv"):
        raise ValueError("fmt must be parquet, csv or tsv")
    paths = []
    for name, df in frames.items():
        path = f"{folder}/{name}"
        writer = df.write.mode("overwrite")
        writer.parquet(path) if fmt == "parquet" else writer.csv(path, header=True, sep="," if fmt == "csv" else "\t")
        paths.append(path)
    return paths
