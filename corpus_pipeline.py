"""The corpus pipeline: each stage calls one operator of ``stratagrid.llm`` on all that its predecessor kept.

Stages take rows as they are: a null or repeated ``doc_id`` is a document like any other, repeated rows are several documents, and
an empty table stays empty. What else each stage makes of nulls, ties and repeats its function says. All but the last return
the columns of ``documents``; other columns are left out.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagrid.llm import bpe, common, decontaminate, line_dedup, simhash, toxicity

#: The columns that all stages but the last return.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go. Null and empty texts are scored as texts without words; repeated rows are
    scored alike. Without usable labels all stay."""
    scored = toxicity.toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where(~F.col("rejected")).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that recur go from all documents but those with the largest ``doc_id`` that holds them (rows that repeat it all keep the
    line); n_chars follows a text that has lost lines. Null texts stay null, and a document may end with an empty text."""
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts stays that share 0.8 or more of their 5-word shingles: that with the smallest ``doc_id``,
    nulls last, and of several such rows one. Texts without words, null ones among them, are copies of each other."""
    return simhash.keep_one(docs).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go. Null texts hold none, and an empty benchmark hits nothing."""
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=True)
    return found.where(~F.col("contaminated")).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What operator 1 returns for each document that is left: a row for each row; null texts have no tokens."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", tokenize),
]

#: The stages hold a trained model, a transitive closure and byte-pair merges, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
