"""Temperature mixing: source shares to a power, found by bisection, realised as permuted blocks within a budget."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, fresh, ranges_for, running_sums, stored

MOST_SOURCES = 100_000


@dataclass(frozen=True)
class Target:
    """What the mixture is to meet. ``entropy``: of the weights, as a share of the greatest (0 to 1). ``repeats``: no source
    is read more often than that. The exponent is the least one (the flattest mixture) within the limit on
    repeats, or the one that gives the entropy; with both, the greater of the two. ``budget``: tokens to
    draw; None: the least with which no source falls below one whole pass, so no document is left out."""

    entropy: float | None = None
    repeats: float | None = 2.0
    budget: float | None = None


def weights_at(tokens: np.ndarray, power: float) -> np.ndarray:
    """Shares to the power, normalised; sources without tokens have no weight."""
    share = np.where(tokens > 0, tokens, 1.0) / max(1.0, tokens.sum())
    raw = np.where(tokens > 0, np.exp(power * np.log(share)), 0.0)
    return raw / raw.sum() if raw.sum() else raw


def passes(tokens: np.ndarray, weights: np.ndarray, budget: float | None) -> np.ndarray:
    """How often each source is read."""
    ratio = np.where(tokens > 0, weights / np.where(tokens > 0, tokens, 1.0), 0.0)
    if budget is None:
        return np.where(tokens > 0, ratio / ratio[tokens > 0].min(), 0.0) if (tokens > 0).any() else ratio
    return ratio * budget


def solve(tokens: np.ndarray, target: Target, steps: int = 60) -> float:
    """The exponent, by bisection between 0 (all sources alike) and 1 (as they are)."""

    def bisect(too_flat) -> float:
        if not too_flat(0.0):
            return 0.0
        low, high = 0.0, 1.0
        for _ in range(steps):
            mid = (low + high) / 2
            low, high = (mid, high) if too_flat(mid) else (low, mid)
        return high

    def entropy(power: float) -> float:
        w = weights_at(tokens, power)
        w = w[w > 0]
        return float(-(w * np.log(w)).sum() / math.log(len(w))) if len(w) > 1 else 0.0

    power = 0.0
    if target.entropy is not None:
        power = bisect(lambda p: entropy(p) > target.entropy)
    if target.repeats is not None:
        power = max(power, bisect(lambda p: passes(tokens, weights_at(tokens, p), target.budget).max(initial=0) > target.repeats * (1 + 1e-12)))
    return power


def mixture(documents: DataFrame, target: Target, source: str = "source", tokens: Column | None = None, docs_per_block: int = 32, seed: str = "mix") -> DataFrame:
    """One row per document: doc_id, tie (hash of the text), source, n_tokens, block, weight, copies.

    ``copies`` says how often the mixture reads the document: once for every whole pass over its source, and once
    more if it comes, in the order of a keyed hash of the blocks and then of the documents in a block, before the rest
    of the source's tokens is used up. Blocks hold about ``docs_per_block`` documents of
    a source, chosen by a hash of id and text, so they can be as many as the source needs and a hot source is spread
    over all tasks. Tokens are words between white space unless given. A null source is a source; null and empty
    texts have no tokens and are read as often as their block.
    """
    spark = documents.sparkSession
    count = F.size(F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), r"\s+"), lambda w: w != "")).cast("long") if tokens is None else tokens
    docs = stored(documents.select("doc_id", F.xxhash64("text").alias("tie"), F.col(source).cast("string").alias("source"), count.alias("n_tokens")))
    totals = docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")).limit(MOST_SOURCES + 1).toPandas()
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    amount = totals["tokens"].to_numpy(np.float64)
    weight = weights_at(amount, solve(amount, target)) if len(totals) else np.zeros(0)
    often = passes(amount, weight, target.budget) if len(totals) else np.zeros(0)
    often = np.where(np.abs(often - np.round(often)) < 1e-9, np.round(often), often)
    plan = spark.createDataFrame([(s, int(max(1, d // docs_per_block)), float(w), int(o), float((o - int(o)) * a)) for s, d, w, o, a in
                                  zip([None if s is None or s != s else s for s in totals["source"]], totals["docs"], weight, often, amount)],
                                 "_source string, blocks long, weight double, whole int, rest double")
    planned = (docs.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
               .withColumn("block", F.pmod(F.xxhash64("doc_id", "tie", F.lit(seed)), F.col("blocks"))))
    blocks = (planned.groupBy("source", "block").agg(F.sum("n_tokens").alias("size"), F.first("whole").alias("whole"), F.first("rest").alias("rest"))
              .withColumn("order", F.md5(F.concat_ws("|", F.lit(seed), F.coalesce("source", F.lit("\x00")), F.col("block").cast("string"), F.col("whole").cast("string")))))
    n_blocks = int(sum(max(1, d // docs_per_block) for d in totals["docs"])) if len(totals) else 0
    drawn = running_sums(stored(blocks), "source", "order", F.col("size"), "before", ranges_for(n_blocks, 1, 2_000), ["block"])
    drawn = drawn.select(F.col("source").alias("_s"), F.col("block").alias("_b"), "before")
    upto = F.sum("n_tokens").over(Window.partitionBy("source", "block").orderBy(F.xxhash64("doc_id", "tie", F.lit(seed), "whole"), "doc_id", "tie"))
    return (planned.join(drawn, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")))
            .withColumn("copies", F.col("whole") + F.when(F.col("before") + upto <= F.col("rest"), 1).otherwise(0))
            .select("doc_id", "tie", "source", "n_tokens", "block", "weight", "copies"))


def mix_table(documents: DataFrame, target: Target = Target()) -> DataFrame:
    """One row per document with its block, the weight of its source and how often it is read."""
    return mixture(documents, target).select("doc_id", "source", "n_tokens", "block", "weight", "copies")


def mixed(documents: DataFrame, target: Target = Target()) -> DataFrame:
    """The documents as the mixture reads them: each as many times as it says, with its columns as they are.

    Null and empty texts have no tokens and are read as often as their block; texts of any length count whole; equal rows are
    read equally often; no documents give none. Columns may have any names.
    """
    id_, tie_, copies = (fresh(x, documents) for x in ("_id", "_tie", "_copies"))
    plan = mixture(documents, target).where("copies <> 1").groupBy("doc_id", "tie").agg(F.first("copies").alias(copies))
    other = stored(plan.withColumnsRenamed({"doc_id": id_, "tie": tie_}))
    if other.count() <= BROADCAST_KEYS:
        other = F.broadcast(other)
    return (documents.join(other, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(tie_)), "left")
            .withColumn(copies, F.explode(F.array_repeat(F.lit(0), F.coalesce(copies, F.lit(1))))).select(*documents.columns))
