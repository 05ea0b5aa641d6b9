"""From raw documents to token files, in stages; each stage reads what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mirrorcheck.llm.common import stored, table
from mirrorcheck.llm.decontaminate import remove_contaminated
from mirrorcheck.llm.jaccard import keep_first
from mirrorcheck.llm.mixing import Target, mixed
from mirrorcheck.llm.queries import tokenizer_path
from mirrorcheck.llm.token_blocks import token_table
from mirrorcheck.llm.toxicity import remove_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the classifier, trained on the labels of these documents, calls toxic."""
    return remove_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest document of each group that links of 80 of 100 on 5-word n-grams reach."""
    return keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which a window of a benchmark item stands."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Flatten the sources as far as no source is read more than one and a half times; none is read less than once."""
    return mixed(docs, Target(repeats=1.5))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token files and read them back: one row per document as mixed."""
    return token_table(docs, tokenizer_path())


STAGES = [("toxicity", toxicity), ("near duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("tokens", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each on what the one before it wrote."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
