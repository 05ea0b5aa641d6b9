"""Near duplicates among vectors: sign hashing in several tables, exact verification, connected components.

The sign of a vector's product with a random hyperplane differs between two vectors with probability angle / pi. A table
hashes the signs of some hyperplanes; vectors that share a bucket in any table are candidates, those whose longer
sketches of signs differ too much are dropped, and the cosine of the others is computed. Keys and sketches
travel, vectors only for what is left.

Groups of near copies don't give all their pairs: vectors within half the angle of a leader form a ball, and
any two of a ball are within the whole angle, so they link without being compared. Only pairs of different balls are
looked at. Buckets that are large are cut into blocks of bounded size, which meet pairwise in tasks of their own;
two blocks of one ball never meet.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored
from .components import connected
from .vectors import as_matrix, cosines

SKETCH = 256


@dataclass(frozen=True)
class Settings:
    """``least``: cosine of a link. ``found``: share of the pairs at exactly that cosine that share a bucket; nearer pairs are
    found more often. It sets the number of tables, which grows with the table like the bits of a hash do, since a
    bucket is to hold about ``per_bucket`` vectors. ``block``: rows of a block. ``leaders``: balls of a round at most, so
    that their vectors may go to every task; smaller groups of copies are compared instead."""

    least: float = 0.9
    found: float = 0.97
    per_bucket: int = 8
    block: int = 1024
    leaders: int = 10_000
    rounds: int = 3
    seed: int = 5

    def bits(self, n: int) -> int:
        return min(40, max(6, math.ceil(math.log2(max(2, n / self.per_bucket)))))

    def tables(self, n: int) -> int:
        agree = 1 - math.acos(self.least) / math.pi
        return math.ceil(math.log(1 - self.found) / math.log(1 - agree ** self.bits(n)))

    def most_signs(self) -> int:
        """Signs of a sketch in which a linked pair may differ: six standard deviations above the mean at ``least``."""
        p = math.acos(self.least) / math.pi
        return math.floor(SKETCH * p + 6 * math.sqrt(SKETCH * p * (1 - p)))


def _keyed(embeddings: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vkey, v) of every row; vkey is a digest of the vector's doubles, null where the vector takes no part."""
    rows = embeddings.select(F.col(key).alias("id"), F.col(vector).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            n = pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            row, ends = np.repeat(np.arange(len(v)), n), np.cumsum(n)
            bad = np.bincount(row[~np.isfinite(flat)], minlength=len(v)) > 0
            good = (np.bincount(row[flat != 0], minlength=len(v)) > 0) & ~bad
            keys = [hashlib.blake2b(flat[b - k:b].tobytes(), digest_size=16).digest() if g else None for g, b, k in zip(good.tolist(), ends.tolist(), n.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(keys, pa.binary()), v], ["id", "vkey", "v"])

    schema = T.StructType([rows.schema["id"], T.StructField("vkey", T.BinaryType()), rows.schema["v"]])
    return stored(rows.mapInArrow(run, schema))


def _signed(classes: DataFrame, settings: Settings, n: int) -> DataFrame:
    """(cid, dim, sketch of four longs, keys: the bucket in each table) of the classes."""
    dim = classes.agg(F.max(F.size("v"))).first()[0]
    bits, tables = settings.bits(n), settings.tables(n)
    planes = np.random.default_rng(settings.seed).normal(size=(dim, SKETCH + bits * tables)).astype(np.float32)
    shared = classes.sparkSession.sparkContext.broadcast(planes)

    def packed(signs: np.ndarray, width: int) -> np.ndarray:
        powers = np.left_shift(np.uint64(1), np.arange(width, dtype=np.uint64))
        return (signs.reshape(len(signs), -1, width) * powers).sum(axis=2, dtype=np.uint64).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                sizes = pc.list_value_length(batch.column("v")).to_numpy().astype(np.int64)
                for d in np.unique(sizes):
                    part = batch.filter(pa.array(sizes == d))
                    signs = as_matrix(part.column("v")) @ planes[:d] > 0
                    sketch, keys = packed(signs[:, :SKETCH], 64), packed(signs[:, SKETCH:], bits)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, tables, dtype=np.int32)), pa.array(keys.ravel()))
                    yield pa.RecordBatch.from_arrays([part.column("cid"), pa.array(np.full(len(keys), d, np.int32)), *[pa.array(np.ascontiguousarray(s)) for s in sketch.T], lists],
                                                     ["cid", "dim", "s0", "s1", "s2", "s3", "keys"])

    return stored(classes.select("cid", "v").mapInArrow(run, "cid long, dim int, s0 long, s1 long, s2 long, s3 long, keys array<long>"))


def _near(pairs: DataFrame, least: float) -> DataFrame:
    """(a, b) of the rows whose vectors va and vb have at least that cosine in double precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column("va")).to_numpy()
            for d in np.unique(sizes):
                part = batch.filter(pa.array(sizes == d))
                keep = pa.array(cosines(as_matrix(part.column("va")), as_matrix(part.column("vb"))) >= least)
                yield pa.RecordBatch.from_arrays([part.column("a").filter(keep), part.column("b").filter(keep)], ["a", "b"])

    return pairs.select("a", "b", "va", "vb").mapInArrow(run, "a long, b long")


def _balls(classes: DataFrame, signed: DataFrame, settings: Settings, n: int) -> DataFrame:
    """(cid, ball) of classes within half the angle of the leader (a class too) of their ball.

    A round takes a table, and of each bucket with many classes that are in no ball yet one as leader; a bucket counts as
    having many if there are at most ``leaders`` such. A sum of two angles bounds the third, so any two of a ball link.
    """
    half = math.cos(math.acos(settings.least) / 2) + 1e-9
    least_rows, out = max(32, math.ceil(n / settings.leaders)), None
    for turn in range(min(settings.rounds, settings.tables(n))):
        free = signed.select("cid", "dim", F.col("keys")[turn].alias("key"))
        if out is not None:
            free = free.join(out.select("cid"), "cid", "left_anti")
        leaders = (free.groupBy("dim", "key").agg(F.count("*").alias("rows"), F.min_by("cid", F.xxhash64("cid", F.lit(turn))).alias("ball"))
                   .where(F.col("rows") >= least_rows).select("dim", "key", "ball"))
        led = stored(leaders.join(classes.select(F.col("cid").alias("ball"), F.col("v").alias("vb")), "ball"))
        if led.isEmpty():
            break
        reached = free.join(F.broadcast(led), ["dim", "key"]).join(classes.select("cid", F.col("v").alias("va")), "cid")
        found = stored(_near(reached.select(F.col("cid").alias("a"), F.col("ball").alias("b"), "va", "vb"), half).select(F.col("a").alias("cid"), F.col("b").alias("ball")))
        out = found if out is None else out.unionByName(found)
    return classes.sparkSession.createDataFrame([], "cid long, ball long") if out is None else out


def _candidates(placed: DataFrame, settings: Settings) -> DataFrame:
    """Pairs (a < b) of different balls that share a bucket and whose sketches are alike enough.

    Buckets of more than ``block`` classes are cut: the rows of the ball with most classes in the bucket, and all others,
    each into blocks by a hash; every block of others meets every block, blocks of that ball meet no other of it.
    """
    size, block = ["dim", "table", "key"], settings.block
    rows = placed.select("cid", "ball", "dim", "s0", "s1", "s2", "s3", F.posexplode("keys").alias("table", "key"))
    large = (rows.groupBy(*size, "ball").count().groupBy(*size)
             .agg(F.sum("count").alias("rows"), F.max_by("ball", "count").alias("top"), F.max("count").alias("n_top")).where(F.col("rows") > block)
             .select(*size, "top", F.ceil(F.col("n_top") / block).alias("n_own"), F.greatest(F.ceil((F.col("rows") - F.col("n_top")) / block), F.lit(1)).alias("n_other")))
    rows = rows.join(large, size, "left")
    small, own = F.col("top").isNull(), F.col("ball") == F.col("top")
    at = F.when(small, 0).otherwise(F.pmod(F.xxhash64("cid", F.lit("block")), F.when(own, F.col("n_own")).otherwise(F.col("n_other"))))

    def meet(kind: str, i: Column, j: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"))

    def upto(low: Column, n: Column) -> Column:
        return F.sequence(low.cast("long"), (n - 1).cast("long"))

    alone = F.array(meet("all", F.lit(0), F.lit(0)))
    left = (F.when(small, alone).when(own, F.transform(upto(F.lit(0), F.col("n_other")), lambda j: meet("own", F.col("at"), j)))
            .otherwise(F.transform(upto(F.col("at"), F.col("n_other")), lambda j: meet("all", F.col("at"), j))))
    right = (F.when(small, alone).when(own, F.slice(alone, 1, 0))
             .otherwise(F.concat(F.transform(upto(F.lit(0), F.col("at") + 1), lambda i: meet("all", i, F.col("at"))),
                                 F.transform(upto(F.lit(0), F.col("n_own")), lambda i: meet("own", i, F.col("at"))))))
    rows = rows.withColumn("at", at)
    sides = [rows.withColumn("m", F.explode(x)).select(*size, "m.kind", "m.i", "m.j", "cid", "ball", "s0", "s1", "s2", "s3") for x in (left, right)]
    key = [*size, "kind", "i", "j"]
    a, b = sides[0].alias("a"), sides[1].alias("b")
    apart = sum((F.bit_count(F.col(f"a.{s}").bitwiseXOR(F.col(f"b.{s}"))) for s in ("s0", "s1", "s2", "s3")), F.lit(0))
    once = (F.col("a.kind") == "own") | (F.col("a.i") < F.col("a.j")) | (F.col("a.cid") < F.col("b.cid"))
    same = F.lit(True)
    for c in key:
        same &= F.col(f"a.{c}") == F.col(f"b.{c}")
    return (a.join(b, same & once & (F.col("a.ball") != F.col("b.ball")) & (apart <= settings.most_signs()))
            .select(F.least("a.cid", "b.cid").alias("a"), F.greatest("a.cid", "b.cid").alias("b")).distinct())


def near_vectors(embeddings: DataFrame, settings: Settings = Settings(), key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per vector: its key, n_links (other vectors at that cosine, as found) and component_id (the smallest
    key that links reach, its own included).

    Equal vectors are one class with a number of rows. Vectors that are null, empty or zero, or hold a null or non-finite
    component, link with nothing and are components by themselves; vectors of different length never link. Null keys
    count as rows but are no component's smallest key unless it has no other. Repeated keys are rows of their own.
    """
    rows = _keyed(embeddings, key, vector)
    classes = stored(rows.where("vkey is not null").groupBy("vkey").agg(F.count("*").alias("m"), F.min("id").alias("least"), F.first("v").alias("v"))
                     .withColumn("cid", F.monotonically_increasing_id()))
    n = classes.count()
    if not n:
        return rows.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    signed = _signed(classes, settings, n)
    balls = _balls(classes, signed, settings, n)
    placed = stored(signed.join(balls, "cid", "left").withColumn("ball", F.coalesce("ball", "cid")))
    pairs = stored(_candidates(placed, settings))
    both = pairs.join(classes.select(F.col("cid").alias("a"), F.col("v").alias("va")), "a").join(classes.select(F.col("cid").alias("b"), F.col("v").alias("vb")), "b")
    links = stored(_near(both, settings.least))
    sizes = classes.select("cid", "m", "least").join(placed.select("cid", "ball"), "cid")
    within = sizes.groupBy("ball").agg(F.sum("m").alias("in_ball"))
    ends = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    outside = ends.join(sizes.select(F.col("cid").alias("b"), "m"), "b").groupBy(F.col("a").alias("cid")).agg(F.sum("m").alias("out_ball"))
    roots = connected(links.unionAll(placed.where("ball <> cid").select(F.col("ball").alias("a"), F.col("cid").alias("b")))).withColumnRenamed("node", "cid")
    of_class = stored(sizes.join(within, "ball").join(outside, "cid", "left").join(roots, "cid", "left")
                      .select("cid", "least", F.coalesce("root", "cid").alias("root"), (F.col("in_ball") - 1 + F.coalesce("out_ball", F.lit(0))).alias("n_links")))
    smallest = of_class.groupBy("root").agg(F.min("least").alias("component_id"))
    facts = classes.select("vkey", "cid").join(of_class.join(smallest, "root").select("cid", "n_links", "component_id"), "cid").drop("cid")
    return (rows.select("id", "vkey").join(facts.withColumnRenamed("vkey", "_vkey"), F.col("vkey") == F.col("_vkey"), "left")
            .select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("_vkey").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id")))


def near_vector_table(embeddings: DataFrame) -> DataFrame:
    """One row per vector at a cosine of 0.9; the smallest of each component is kept. See ``near_vectors`` for odd rows."""
    return near_vectors(embeddings).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
