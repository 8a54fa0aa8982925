"""Corpus pipeline: five stages over `documents`, each one of the operators.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and read again as the next stage's input.  All stages but the last
return the columns of `documents`.

Cases, for every stage: an empty table gives no rows; other columns of
`documents`, whatever their names, are handed on; very long texts are taken
whole.  A null text is an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerframe.llm import decontaminate, mixing, ngram_join, quality, sharding
from ledgerframe.session import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that the quality rules reject go, texts without 50
    words (null and empty ones too) among them; repeated rows and rows without an
    id are decided by their text alike.  Without labels the base rules decide."""
    return quality.keep_good(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: one document of each group of near copies stays, the one of
    the least doc_id (a missing id is the least); of rows that repeat id and text
    one stays, different texts under one id or none are different documents."""
    return ngram_join.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that leak a benchmark item go; repeated rows alike.
    Items without text leak nowhere."""
    return decontaminate.drop_leaks(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: what the mix takes of each document, once per epoch; a null
    source is a source, and the last; rows that repeat an id are documents of
    their own; documents without words are not taken."""
    return mixing.mix_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: every row with its shard, by doc_id; rows without an id share one."""
    return sharding.assign_shards(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_copies", near_copies),
    ("decontaminated", decontaminated),
    ("mix_sources", mix_sources),
    ("shard", shard),
]

# The model of the quality stage and the permutations of the mix have no SQL
# form; tests/llm compare run() with plain versions of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to `documents`; intermediate tables are written below
    the shared folder named by spark.checkpoint.dir."""
    root = scratch_path(spark, "pipeline")
    docs = _table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        out = f"{root}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return STAGES[-1][1](spark, docs, sf_dir)
