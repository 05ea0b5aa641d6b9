"""Small helpers shared by the text operators: stored frames, words, scale-free numbering."""

from __future__ import annotations

import gc
import math
import uuid
from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Words of letters, digits and everything beyond ASCII (RE2 and Java read it alike).
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder below the one that ``spark.checkpoint.dir`` names; where that is unset, below the warehouse.

    It goes when the driver's JVM ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


#: Paths of frames stored in the running ``temporary`` blocks.
_BLOCKS: list[list[str]] = []


def stored(df: DataFrame, lasting: bool = False) -> DataFrame:
    """Cut lineage: write the frame as Parquet to the shared folder and read it back.

    Within a ``temporary`` block it goes with the block, unless ``lasting``.
    """
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    if _BLOCKS and not lasting:
        _BLOCKS[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def temporary(spark: SparkSession):
    """Frames stored inside, and shuffle files that only they need, are given back at the end; nothing made of them may be used later."""
    paths: list[str] = []
    _BLOCKS.append(paths)
    try:
        yield
    finally:
        _BLOCKS.pop()
        jvm = spark.sparkContext._jvm
        for path in paths:
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        gc.collect()
        jvm.System.gc()  # Spark removes shuffle files of plans that are gone


@contextmanager
def arrow_bytes(spark: SparkSession, size: int = 4_000_000):
    """Frames stored inside give Python batches of about so many bytes at a time."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Frames stored inside give Python at most so many rows at a time, as each of them may be large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def lower_ascii(text: Column) -> Column:
    """Null counts as empty; only A-Z change."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def words(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(text), F.lit(f"({WORD})"), F.lit(1))


def ranges_for(rows: int, groups: int = 1, rows_per_range: int = 5_000) -> int:
    """How many hex digits of a uniform hash cut ``rows`` into ranges of about ``rows_per_range``."""
    return max(0, math.ceil(math.log(max(1.0, rows / max(1, groups) / rows_per_range), 16)))


def running_sums(df: DataFrame, group: str, uniform_hex: str, value: Column, out: str, digits: int,
                 ties: Sequence[str] = ()) -> DataFrame:
    """Exclusive running sum of ``value`` in each group, in the order of a uniform hex hash (then ``ties``).

    No window holds a whole group: the first hex digits cut the order into ranges, each range is summed on
    its own and gets what all ranges before it sum to. The result doesn't depend on ``digits``.
    """
    cut = df.withColumn("_range", F.substring(F.col(uniform_hex), 1, digits)).withColumn("_value", value)
    before = (cut.groupBy(group, "_range").agg(F.sum("_value").alias("_sum"))
              .withColumn("_before", F.coalesce(F.sum("_sum").over(
                  Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .drop("_sum")
              .withColumnsRenamed({group: "_g", "_range": "_r"}))
    inside = Window.partitionBy(group, "_range").orderBy(uniform_hex, *ties).rowsBetween(Window.unboundedPreceding, -1)
    return (cut.join(before, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")))
            .withColumn(out, F.col("_before") + F.coalesce(F.sum("_value").over(inside), F.lit(0)))
            .drop("_g", "_r", "_range", "_value", "_before"))


def in_order(df: DataFrame, order: Sequence[Column], out: str, group: Column | None = None) -> DataFrame:
    """Number the rows from 0 in an order, or those of each ``group``, whose values must lead that order.

    Spark sorts by ranges and numbers each partition by itself; then each gets what stands before it. ``_n`` is how many
    rows the group has. What is joined has a row per partition and group in it.
    """
    own = F.lit(0) if group is None else group
    rows = stored(df.withColumn("_group", own).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    runs = rows.groupBy("_group", part.alias("_part")).agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    whole = Window.partitionBy("_group")
    before = F.coalesce(F.sum("_rows").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = (runs.withColumn("_before", before).withColumn("_n", F.sum("_rows").over(whole))
            .select(F.col("_group").alias("_g"), F.col("_part").alias("_p"), (F.col("_before") - F.col("_first")).alias("_move"), "_n"))
    return (rows.join(runs, F.col("_group").eqNullSafe(F.col("_g")) & (part == F.col("_p")))
            .withColumn(out, F.col("_at") + F.col("_move")).drop("_group", "_at", "_g", "_p", "_move"))


def fresh(name: str, df: DataFrame) -> str:
    """A column name like ``name`` that the frame doesn't have, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Keys up to this many are sent to every task; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def without(documents: DataFrame, tie: Column, keys: DataFrame) -> DataFrame:
    """Documents whose (doc_id, tie) is not among ``keys`` (columns doc_id and tie; null ids match null ids)."""
    id_, tie_ = fresh("_id", documents), fresh("_tie", documents)
    keys = stored(keys.select(F.col("doc_id").alias(id_), F.col("tie").alias(tie_)).distinct())
    if keys.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    return documents.join(keys, F.col("doc_id").eqNullSafe(F.col(id_)) & (tie == F.col(tie_)), "left_anti")
