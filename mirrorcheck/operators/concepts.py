"""Concept sets: merging sheets, resolving members, labels and names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import null_safe_join
from ..functions.session import stable

#: Lists of concepts of at most so many rows go to all tasks.
MOST_SENT = 1_000_000
#: Lists of at most so many codes become a filter.
MOST_LISTED = 1_000


def merge_sheets(required: DataFrame, custom: DataFrame) -> DataFrame:
    """Outer join on all columns of the required sheet."""
    return required.join(custom, on=required.columns, how="outer")


def newest_members(members: DataFrame) -> DataFrame:
    """Members of the newest version of every set; the flag may be boolean or text."""
    flag = F.lower(F.col("is_most_recent_version").cast("string")) == "true"
    return members.where(flag).select("concept_set_name", F.col("concept_id").cast("long").alias("concept_id"))


def resolve_sets(members: DataFrame, sheet: DataFrame, domain: str, custom: DataFrame | None = None) -> DataFrame:
    """Concept ids with the indicator they raise, for one event domain, plus custom ids."""
    wanted = sheet.where(F.col("domain").contains(domain)).select("concept_set_name", "indicator_prefix")
    out = newest_members(members).join(wanted, "concept_set_name").select("concept_id", "indicator_prefix")
    if custom is not None:
        out = out.unionByName(custom.select(F.col("concept_id").cast("long").alias("concept_id"), "indicator_prefix"))
    return out


def sent(codes: DataFrame) -> DataFrame:
    """The distinct codes, stored; marked to go to all tasks where they are few enough, which is counted.

    Events have few distinct concepts, so a join by a shuffle on the concept puts most of them into a few tasks.
    """
    codes = stable(codes.distinct())
    return F.broadcast(codes) if codes.count() <= MOST_SENT else codes


def with_codes(events: DataFrame, codes: DataFrame, key: str) -> DataFrame:
    """Inner join of events to a list of codes, equal codes once.

    Other events are left out first: by a filter, which Spark moves below the joins that ``events`` is made of, where the
    codes are few, and else by a semi join.
    """
    few = sent(codes)
    listed = [r[0] for r in few.select(key).where(F.col(key).isNotNull()).distinct().limit(MOST_LISTED + 1).collect()]
    kept = events.where(F.col(key).isin(listed)) if len(listed) <= MOST_LISTED else events.join(few.select(key), key, "left_semi")
    return kept.join(few, key)


def label_by_set(df: DataFrame, members: DataFrame, id_col: str, label: str, names: Sequence[str]) -> DataFrame:
    """Add an array of the named concept sets that a row's concept belongs to (empty when none)."""
    sets = (newest_members(members).where(F.col("concept_set_name").isin(list(names)))
            .groupBy(F.col("concept_id").alias("__cid")).agg(F.collect_set("concept_set_name").alias("__sets")))
    return (df.join(sent(sets), F.col(id_col) == F.col("__cid"), "left")
            .withColumn(label, F.coalesce("__sets", F.array().cast("array<string>")))
            .drop("__cid", "__sets"))


def concept_lookup(concept: DataFrame, id_col: str = "concept_id", name_col: str = "concept_name") -> DataFrame:
    """One name per id, the first in name order."""
    return (concept.where(F.col(id_col).isNotNull())
            .groupBy(F.col(id_col).cast("long").alias("concept_id"))
            .agg(F.min(name_col).alias("concept_name")))


def attach_name(df: DataFrame, id_col: str, name_col: str, lookup: DataFrame) -> DataFrame:
    """Add the concept name of ``id_col``; null for unknown ids."""
    names = lookup.select(F.col("concept_id").alias("__cid"), F.col("concept_name").alias(name_col))
    return df.join(names, F.col(id_col) == F.col("__cid"), "left").drop("__cid")


def borrowed_lookup(orig: DataFrame, id_col: str, name_col: str) -> DataFrame:
    """Id to name pairs taken from a table that has both: the most frequent name of every id."""
    pairs = orig.where(F.col(id_col).isNotNull()).groupBy(id_col, name_col).agg(F.count("*").alias("n"))
    w = Window.partitionBy(id_col).orderBy(F.desc("n"), F.col(name_col))
    return (pairs.withColumn("rn", F.row_number().over(w)).where("rn = 1")
            .select(F.col(id_col).alias("concept_id"), F.col(name_col).alias("concept_name")))


def domain_summary(concept: DataFrame) -> DataFrame:
    """Rows, distinct ids and distinct names of the vocabulary by domain."""
    return concept.groupBy("domain_id").agg(
        F.count("*").alias("n_rows"),
        F.count_distinct("concept_id").alias("n_ids"),
        F.count_distinct("concept_name").alias("n_names"),
    )


def top_concepts(df: DataFrame, id_col: str, k: int, lookup: DataFrame) -> DataFrame:
    """The k most frequent concepts with their names, ties by id."""
    top = (df.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("concept_id"))
           .agg(F.count("*").alias("n")).orderBy(F.desc("n"), "concept_id").limit(k))
    return null_safe_join(top, lookup, ["concept_id"], "left")
