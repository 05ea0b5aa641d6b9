"""Nearest neighbours by several Hilbert orderings of projected vectors, each range-partitioned by Spark."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .vectors import as_matrix


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``cells`` (integers of ``bits`` bits); bits * columns is at most 62.

    Skilling's transform: undo the rotations from the highest bit down, then Gray-decode, then interleave the bits.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):
        q = 1 << b
        low = q - 1
        for i in range(n):
            set_ = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & low
            x[0] = np.where(set_, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = np.where(set_, x[i], x[i] ^ swap)
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[n - 1] >> b) & 1, (1 << b) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _frame(classes: DataFrame, dim: int, curves: int, axes: int, seed: int, sample: int):
    """Projections (curves x dim x axes), the mean and spread of each on a sample of vectors, and shifts of the grids."""
    rows = classes.orderBy(F.xxhash64("cid")).limit(sample).select("v").toArrow().column("v").combine_chunks()
    x = _unit(rows)
    draw = np.random.default_rng(seed)
    turned: list[np.ndarray] = []
    while sum(t.shape[1] for t in turned) < curves * axes:
        turned.append(np.linalg.qr(draw.normal(size=(dim, dim)))[0])
    wide = np.concatenate(turned, axis=1)[:, :curves * axes]
    placed = x @ wide
    spread = placed.std(axis=0)
    return wide, placed.mean(axis=0), np.where(spread > 0, spread, 1.0), draw.uniform(-0.1, 0.1, curves * axes)


def _unit(column: pa.Array) -> np.ndarray:
    x = as_matrix(column)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _nearest_of(classes: DataFrame, asked: pa.Table, k: int) -> DataFrame:
    """The ``k`` nearest classes (q, c) of each row of ``asked`` (cid, v), by brute force over all classes."""
    shared = classes.sparkSession.sparkContext.broadcast((asked.column("cid").to_numpy(), _unit(asked.column("v").combine_chunks())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = shared.value
        best, at = np.full((len(ids), k), -np.inf), np.full((len(ids), k), -1, np.int64)
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                batch = whole.slice(start, 4096)
                cid = batch.column("cid").to_numpy()
                score = x @ _unit(batch.column("v")).T
                score[ids[:, None] == cid[None, :]] = -np.inf
                score, cid = np.concatenate([best, score], axis=1), np.concatenate([at, np.broadcast_to(cid, score.shape)], axis=1)
                top = np.argpartition(-score, k - 1, axis=1)[:, :k]
                best, at = np.take_along_axis(score, top, 1), np.take_along_axis(cid, top, 1)
        q, there = np.repeat(ids, k), np.isfinite(best.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(q[there]), pa.array(at.ravel()[there]), pa.array(best.ravel()[there])], ["q", "c", "score"])

    best = Window.partitionBy("q").orderBy(F.desc("score"), "c")
    return classes.select("cid", "v").mapInArrow(run, "q long, c long, score double").withColumn("i", F.row_number().over(best)).where(F.col("i") <= k).select("q", "c")


def _reach_for(classes: DataFrame, place: DataFrame, k: int, target: float, checked: int) -> int:
    """How many rows on each side of a query hold ``target`` of the true neighbours of ``checked`` queries (all, if fewer) on one of the curves."""
    asked = classes.where("asked").orderBy(F.xxhash64("cid", F.lit("reach"))).limit(checked).select("cid", "v").toArrow()
    if not asked.num_rows:
        return 0
    pairs = stored(_nearest_of(classes, asked, k))  # at most k rows a query
    ends = pairs.select(F.col("q").alias("cid")).union(pairs.select("c")).distinct()
    stands = stored(place.join(F.broadcast(ends), "cid").select("cid", "curve", "place"))
    of = lambda name: F.broadcast(stands).select(F.col("cid").alias(name), "curve", F.col("place").alias(f"{name}_place"))
    apart = (pairs.join(of("q"), "q").join(of("c"), ["c", "curve"]).groupBy("q", "c").agg(F.min(F.abs(F.col("q_place") - F.col("c_place"))).alias("apart"))
             .select("apart").toArrow().column("apart").to_numpy())
    return int(np.sort(apart)[math.ceil(target * len(apart)) - 1]) if len(apart) else 0


def neighbours(embeddings: DataFrame, asked, k: int = 5, key: str = "vec_id", vector: str = "embedding", curves: int = 32, axes: int = 8,
               width: float = 4.0, block: int = 4096, seed: int = 11, sample: int = 20_000, recall: float = 0.95, checked: int = 256) -> DataFrame:
    """The ``k`` nearest rows by cosine, as found, of every row for which the condition ``asked`` holds.

    Rows come back as (query_id, rank from 1, vec_id, score); score is the cosine in double precision. Each curve
    orders all vectors by the Hilbert key of its own ``axes`` directions on a shifted grid; a query is compared with
    the rows before and after it on every curve, and the best of all curves are ranked again. How many rows: at least
    ``width`` * sqrt(vectors), and as many more as it takes to find the share ``recall`` of the true neighbours of
    ``checked`` of the queries, which are looked up by brute force over all rows; so recall doesn't fall as the table
    grows. Keys alone are sorted and numbered; vectors then travel once per curve, in blocks of that order, and a
    query visits each block that its window touches, so the edges of partitions lose nothing.

    Null and zero vectors, those with a null or non-finite component and those whose length isn't the commonest take
    no part. Equal vectors are one class that stands on the curves once, with its k + 1 smallest keys: no other of them
    can be among the nearest. Ties go to the smaller key. The sample only scales the grids.
    """
    spark = embeddings.sparkSession
    rows = embeddings.where(F.col(vector).isNotNull()).select(F.col(key).alias("vec_id"), F.col(vector).alias("v"), F.coalesce(asked, F.lit(False)).alias("asked"))
    double = F.transform("v", lambda c: c.cast("double"))
    finite = F.forall(double, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists(double, lambda c: c != 0)
    rows = rows.where(finite).withColumn("one", F.xxhash64("v")).withColumn("two", F.xxhash64(F.lit(1), "v"))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    out = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return spark.createDataFrame([], out)
    dim = lengths[0]["n"]
    rows = rows.where(F.size("v") == dim)
    least = Window.partitionBy("one", "two").orderBy(F.col("vec_id").asc_nulls_last())
    firsts = (rows.select("one", "two", "vec_id", "v").withColumn("i", F.row_number().over(least)).where(F.col("i") <= k + 1)
              .groupBy("one", "two").agg(F.first("v").alias("v"), F.array_sort(F.collect_list("vec_id")).alias("ids")))
    queries = rows.where("asked").select("one", "two", "vec_id")
    classes = stored(firsts.join(queries.select("one", "two").distinct().withColumn("asked", F.lit(True)), ["one", "two"], "left")
                     .withColumn("asked", F.col("asked").isNotNull()).withColumn("cid", F.monotonically_increasing_id()))
    n = classes.count()
    axes = max(1, min(axes, dim))
    shared = spark.sparkContext.broadcast(_frame(classes, dim, curves, axes, seed, sample))
    bits = max(1, min(6, 60 // axes))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide, mean, spread, shift = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                batch = whole.slice(start, 4096)
                placed = (_unit(batch.column("v")) @ wide - mean) / spread + shift
                cells = np.minimum(((1 / (1 + np.exp(-1.702 * placed))) * (1 << bits)).astype(np.int64), (1 << bits) - 1)
                for c in range(curves):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, c, np.int32)), pa.array(hilbert_keys(cells[:, c * axes:(c + 1) * axes], bits)),
                                                      batch.column("cid"), batch.column("asked")], ["curve", "key", "cid", "asked"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("curve"), batch.column("cid"), batch.column("asked"), pa.array(np.full(batch.num_rows, part, np.int32)),
                                              pa.array(np.arange(at, at + batch.num_rows))], ["curve", "cid", "asked", "part", "at"])
            at += batch.num_rows

    sorted_keys = classes.select("cid", "asked", "v").mapInArrow(keys, "curve int, key long, cid long, asked boolean").repartitionByRange("curve", "key", "cid").sortWithinPartitions("curve", "key", "cid")
    numbered = stored(sorted_keys.mapInArrow(number, "curve int, cid long, asked boolean, part int, at long"))
    before = numbered.groupBy("part").count().withColumn("off", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "off")
    place = numbered.join(before, "part").withColumn("place", F.col("off") + F.col("at"))
    reach = max(64, math.ceil(width * math.sqrt(n)), _reach_for(classes, place, k, recall, checked))
    block = max(block, min(reach, 16 * block))  # a wide window touches few blocks
    low = F.greatest(F.col("place") - reach, F.col("curve").cast("long") * n)
    high = F.least(F.col("place") + reach, (F.col("curve") + 1).cast("long") * n - 1)
    visit = F.when(F.col("asked"), F.sequence(F.floor(low / block), F.floor(high / block)))
    own = F.floor(F.col("place") / block)
    stands = F.struct(own.alias("block"), F.col("place"), F.col("curve"), F.lit(False).alias("query"))
    visits = F.transform(F.coalesce(visit, F.array().cast("array<bigint>")), lambda b: F.struct(b.alias("block"), F.col("place"), F.col("curve"), F.lit(True).alias("query")))
    stops = place.select("cid", F.concat(F.array(stands), visits).alias("stops")).groupBy("cid").agg(F.flatten(F.collect_list("stops")).alias("stops"))
    travelling = classes.select("cid", "v").join(stops, "cid").select("cid", "v", F.explode("stops").alias("s")).select("s.block", "s.place", "s.curve", "s.query", "cid", "v")

    def rerank(group: pa.Table) -> pa.Table:
        query = group.column("query").to_numpy().astype(bool)
        cid, at, curve = (group.column(c).to_numpy() for c in ("cid", "place", "curve"))
        x = as_matrix(group.column("v"))
        size = np.sqrt((x * x).sum(axis=1))
        there = np.flatnonzero(~query)
        there = there[np.argsort(at[there])]
        places = at[there]
        found: list[tuple[int, int, float]] = []
        for q in np.flatnonzero(query):
            a, b = np.searchsorted(places, (at[q] - reach, at[q] + reach + 1))
            near = there[a:b]
            near = near[(cid[near] != cid[q]) & (curve[near] == curve[q])]
            if not len(near):
                continue
            score = (x[near] * x[q]).sum(axis=1) / (size[near] * size[q])
            if len(near) > k:  # all that tie with the k-th stay
                cut = np.partition(score, len(score) - k)[len(score) - k]
                keep = score >= cut
                near, score = near[keep], score[keep]
            found += zip(np.full(len(near), cid[q]).tolist(), cid[near].tolist(), score.tolist())
        return pa.table({"q": pa.array([f[0] for f in found], pa.int64()), "c": pa.array([f[1] for f in found], pa.int64()), "score": pa.array([f[2] for f in found], pa.float64())})

    pairs = stored(travelling.groupBy("block").applyInArrow(rerank, "q long, c long, score double").groupBy("q", "c").agg(F.max("score").alias("score")))
    own_pairs = classes.where("asked and size(ids) > 1").select(F.col("cid").alias("q"), F.col("cid").alias("c"), "v")
    largest = F.array_max(F.transform("v", lambda c: F.abs(c.cast("double"))))
    power = F.pow(F.lit(2.0), F.greatest(F.least(-F.floor(F.log2(largest)), F.lit(1000)), F.lit(-1000)))  # as in ``scaled``
    square = F.aggregate(F.transform("v", lambda c: (c.cast("double") * power) * (c.cast("double") * power)), F.lit(0.0), lambda s, c: s + c)
    own_pairs = own_pairs.select("q", "c", (square / (F.sqrt(square) * F.sqrt(square))).alias("score"))
    members = classes.select(F.col("cid").alias("c"), F.explode("ids").alias("vec_id"))
    best = Window.partitionBy("q").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    # k + 1 members are enough for any row of the class, which leaves itself out
    lists = (pairs.unionByName(own_pairs).join(members, "c").withColumn("i", F.row_number().over(best)).where(F.col("i") <= k + 1)
             .groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id"))).alias("list")))
    own_row = F.filter("list", lambda x, i: ~((x["vec_id"] == F.col("query_id")) & (i == F.array_position(F.transform("list", lambda y: y["vec_id"]), F.col("query_id")) - 1)))
    answered = (queries.withColumnRenamed("vec_id", "query_id").join(classes.select("one", "two", F.col("cid").alias("q")), ["one", "two"]).join(lists, "q")
                .select("query_id", F.posexplode(F.slice(own_row, 1, k)).alias("i", "x")))
    return answered.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.less")).alias("score"))


def neighbour_table(embeddings: DataFrame) -> DataFrame:
    """The 5 nearest of every row whose vec_id is divisible by 50."""
    return neighbours(embeddings, F.col("vec_id") % 50 == 0)
