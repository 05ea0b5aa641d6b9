"""Sharding by rendezvous hashing: a record's key and the shards alone decide where it goes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ranges_for, running_sums, stored


def _choice(key: Column, first: int, weights: Sequence[float]) -> Column:
    """The best (score, shard): the least -ln(u) / weight, u uniform from key and shard."""

    def score(weight, i):
        uniform = (F.conv(F.substring(F.md5(F.concat(key, F.lit(":"), (i + first).cast("string"))), 1, 13), 16, 10)
                   .cast("double") + 0.5) / float(1 << 52)
        return F.struct((-F.log(uniform) / weight).alias("score"), (i + first).cast("int").alias("shard"))

    return F.array_min(F.transform(F.array(*[F.lit(float(w)) for w in weights]), score))


def with_shards(df: DataFrame, key: str, weights: Sequence[float], grown_by: Sequence[float] = ()) -> DataFrame:
    """Add ``shard`` and ``grown_shard`` (the shard with further shards of the weights ``grown_by``; else null).

    Each shard draws a score from (key, shard) and the best draw wins, so a shard gets rows in proportion to
    its weight, and one more shard only takes the rows in which it wins. A null key is a key of its own.
    No rows: no rows. Weights must be positive.
    """
    if not weights or any(w <= 0 for w in [*weights, *grown_by]):
        raise ValueError("weights must be positive")
    text = F.coalesce(F.col(key).cast("string"), F.lit("\x00null"))
    best = df.withColumn("_best", _choice(text, 0, weights))
    if grown_by:
        best = best.withColumn("_new", _choice(text, len(weights), grown_by))
        grown = F.when(F.col("_new.score") < F.col("_best.score"), F.col("_new.shard")).otherwise(F.col("_best.shard"))
    else:
        grown = F.lit(None).cast("int")
    return best.withColumn("shard", F.col("_best.shard")).withColumn("grown_shard", grown).drop("_best", "_new")


def with_slots(df: DataFrame, key: str, ties: Sequence[str] = (), rows_per_range: int = 5_000) -> DataFrame:
    """Number the rows of each shard from 0 without gaps, in the order of a hash of the key.

    A shard is cut into ranges of that hash, so no task holds a whole shard. Repeated keys follow ``ties``.
    """
    n_shards = df.select("shard").distinct().count()
    digits = ranges_for(df.count(), n_shards, rows_per_range)
    hashed = df.withColumn("_order", F.md5(F.coalesce(F.col(key).cast("string"), F.lit("\x00null"))))
    return running_sums(hashed, "shard", "_order", F.lit(1).cast("long"), "slot", digits, [key, *ties]).drop("_order")


def write_shards(df: DataFrame, key: str, weights: Sequence[float], path: str) -> None:
    """Write whole rows into one folder per shard; file sizes are left to ``spark.sql.files.maxRecordsPerFile``."""
    with_shards(df, key, weights).drop("grown_shard").write.partitionBy("shard").mode("overwrite").parquet(path)


def shard_table(documents: DataFrame, n_shards: int = 40) -> DataFrame:
    """One row per document: shard, slot in the shard, shard after growth by one, size and checksum of the text.

    Size: UTF-8 bytes plus 16; a null text has no bytes and the checksum of an empty text.
    """
    rows = with_shards(documents.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
    ), "doc_id", [1.0] * n_shards, [1.0]).withColumn("law", F.lit("key"))
    return with_slots(stored(rows), "doc_id", ["size", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
