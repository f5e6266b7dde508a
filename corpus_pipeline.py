"""A training corpus from raw documents: language, near-duplicates, benchmark leaks, source mix, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import decontamination, language, mixing, near_dedup, sharding
from tidewater.llm.storage import materialise, table
from tidewater.plans.session import prepare

SHARDS = 8


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the language model, learned from the labelled rows of docs, rejects.

    Null, empty and letterless texts go; very long ones are judged whole; repeated rows stay or
    go together; an empty table stays empty; all columns stay as they are.
    """
    prepare(spark)
    return language.identified(docs, language.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of each group of near-duplicates (5-word shingles, similarity 0.8).

    Null and empty texts and rows without doc_id stay; rows of one doc_id stay or go together;
    an empty table stays empty; all columns stay as they are.
    """
    prepare(spark)
    return near_dedup.keep_one_each(docs, k=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold benchmark items, each row judged by its own text.

    Null and empty texts stay; repeated rows stay or go together; an empty table of documents
    or of items changes nothing; all columns stay as they are.
    """
    return decontamination.without_contamination(docs, table(prepare(spark), sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents so that the sources' words meet their targets; the rows lie shuffled in the mix's shards (mix_shard, mix_order).

    A null source is a source; null and empty texts have no words and come with their block;
    repeated rows are read alike; an empty table stays empty; columns copy, mix_shard and
    mix_order are added, or replaced where docs has them.
    """
    return mixing.in_shards(mixing.assigned(docs))


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add each document's shard as shard_id (replaced where docs has it), by doc_id alone; copies of a document share one.

    Rows without doc_id share a shard; texts do not matter; an empty table stays empty.
    """
    return sharding.shard_rows(docs, [1.0] * SHARDS)


STAGES = [
    ("language", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]

#: The language model and the tiling are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each one's rows are written as Parquet in the shared folder and read again."""
    docs = table(prepare(spark), sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, f"stage-{name}")
    return docs
