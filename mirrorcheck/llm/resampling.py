"""Importance resampling towards a target distribution of hashed n-grams, with Arrow kernels.

Texts are lower-cased, split and flattened by Arrow; words become dictionary indices; n-grams are made by shifting those
indices against each other, so each distinct n-gram is hashed once: the CRC of "a b" goes on from the CRC of "a".
A bucket's gain is the log ratio of its smoothed shares in the target and in the raw texts, a text's weight the mean
gain of its n-grams. Texts are drawn without replacement by the largest weight plus Gumbel noise of a keyed hash.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow_text import slices
from .common import in_order, stored

#: What parts words of lower-cased texts: ASCII other than digits and small letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Settings:
    """``sizes``: words of the longest n-gram (all shorter ones count too). ``buckets``: of the hash; their counts go to the
    driver and their gains to each task. ``percent`` of the texts with at least ``least_words`` words are drawn."""

    sizes: int = 1
    buckets: int = 10_000
    percent: int = 10
    least_words: int = 20
    seed: str = "2024"


def features(column: pa.Array, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row and bucket of every n-gram, number of words of every row); rows ascend within each size."""
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(column, "")), SEPARATORS)
    words = pc.list_flatten(lists).dictionary_encode()
    rows = np.repeat(np.arange(len(column)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    index = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    known = words.dictionary.cast(pa.binary()).to_pylist()
    real = np.array([bool(w) for w in known], bool)[index] if len(known) else np.zeros(0, bool)  # a split leaves empty ends
    index, rows = index[real], rows[real]
    crc = np.array([zlib.crc32(w) for w in known], np.int64)
    of, at, bucket = index, rows, [crc[index] % settings.buckets if len(index) else index]
    places = [rows]
    for n in range(2, settings.sizes + 1):
        same = np.flatnonzero(at[:len(index) - n + 1] == rows[n - 1:]) if len(index) >= n else np.zeros(0, np.int64)
        pairs, of_new = np.unique(of[same] * max(1, len(known)) + index[same + n - 1], return_inverse=True)
        before, word = np.divmod(pairs, max(1, len(known)))
        crc = np.array([zlib.crc32(b" " + known[w], c) for c, w in zip(crc[before].tolist(), word.tolist())], np.int64)
        # n-grams keep the place of their first word, so that the next round can shift again
        of = np.zeros(len(index), np.int64)
        of[same], at = of_new, np.full(len(index), -1)
        at[same] = rows[same]
        bucket.append(crc[of_new] % settings.buckets if len(of_new) else of_new)
        places.append(rows[same])
    return np.concatenate(places), np.concatenate(bucket), np.bincount(rows, minlength=len(column))


def bucket_counts(texts: DataFrame, settings: Settings) -> np.ndarray:
    """How many n-grams of all texts (column ``text``) fall into each bucket; each task sends at most one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(settings.buckets, np.int64)
        for batch in slices(batches):
            total += np.bincount(features(batch.column("text"), settings)[1], minlength=settings.buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[there])], ["bucket", "n"])

    rows = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(settings.buckets, np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, rounded down, of each bucket."""
    k, s_all, t_all = len(raw), float(raw.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + k) / ((s + 1.0) * (t_all + k)))) for s, t in zip(raw.tolist(), target.tolist())], np.int64)


def weighted(documents: DataFrame, gain: np.ndarray, settings: Settings, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row in the struct ``row``, n_words, n_features and weight."""
    shared = documents.sparkSession.sparkContext.broadcast(gain)
    names = [f"_{i}" for i in range(len(keep))]
    schema = T.StructType([*[T.StructField(n, documents.schema[c].dataType) for n, c in zip(names, keep)],
                           *T._parse_datatype_string("n_words long, n_features long, weight long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches):
            rows, bucket, n_words = features(batch.column("text"), settings)
            n = np.bincount(rows, minlength=batch.num_rows)
            order = np.argsort(rows, kind="stable")
            sums = np.zeros(batch.num_rows, np.int64)
            if len(rows):  # segment-reduce over the rows that have n-grams
                some = np.flatnonzero(n)
                sums[some] = np.add.reduceat(own[bucket[order]], (np.cumsum(n) - n)[some])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(n_words.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(sums // np.maximum(n, 1))], schema.names)

    # the text goes to Python once; where it is kept, it comes back from there
    rows = documents.select(F.col("text").cast("string").alias("text"), *[F.col(c).alias(n) for n, c in zip(names, keep)])
    return rows.mapInArrow(run, schema).select(F.struct(*[F.col(n).alias(c) for n, c in zip(names, keep)]).alias("row"), "n_words", "n_features", "weight")


def scored(documents: DataFrame, target: DataFrame, settings: Settings = Settings(), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """As ``weighted``, with ``score`` (weight and noise) and ``rank`` (from 1; null where not drawn).

    Ties go to the smaller doc_id, nulls last, then to fewer n-grams; what still ties is the same row again. A null id
    draws the noise of an empty one. Null and empty texts have no words: they weigh 0 and are never drawn unless
    ``least_words`` is 0. A target without words is the uniform distribution.
    """
    gain = gains(bucket_counts(documents, settings), bucket_counts(target, settings))
    rows = weighted(documents, gain, settings, keep)
    drawn_hash = F.sha2(F.concat(F.lit(f"{settings.seed}:"), F.coalesce(F.col("row.doc_id").cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(drawn_hash, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    rows = stored(rows.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(uniform)))))
    able = F.col("n_words") >= settings.least_words
    n_drawn = settings.percent * rows.where(able).count() // 100
    ranked = in_order(rows.where(able), [F.col("score").desc(), F.col("row.doc_id").asc_nulls_last(), F.col("n_features").asc()], "place").drop("_n")
    ranked = ranked.withColumn("rank", F.when(F.col("place") < n_drawn, F.col("place") + 1)).drop("place")
    return ranked.unionByName(rows.where(~able).withColumn("rank", F.lit(None).cast("long")))


def draw(documents: DataFrame, target: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents that are drawn, with all their columns as they are."""
    return scored(documents, target, settings, tuple(documents.columns)).where("rank is not null").select("row.*")


def resampling_table(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: n_features, weight, score, and rank if it is among the tenth that is drawn."""
    return scored(documents, benchmark).select("row.doc_id", "n_features", "weight", "score", "rank")
