"""Corpus pipeline over ``documents``: quality rules, SimHash near-duplicates, personal data, mixing, packing.

Each stage takes all that the stage before it kept and is written as Parquet and read again.  All but
the last return the columns of documents.  Mixing repeats rows, so ids repeat from there on: packing takes
each row as a document of its own, and pieces of equal rows differ in their sequence and offset alone.  Null and
repeated ids of documents are treated by each stage as its operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orebed.llm import mixing, packing, pii, quality, simhash
from orebed.llm.common import scratch, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that with the smallest doc_id."""
    return simhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets."""
    return pii.mask(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that all sources weigh the same, in a global random order."""
    return mixing.mix(docs).select(*docs.columns)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    pieces = packing.cut(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.place(pieces)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", simhash_dedup),
    ("PII", personal_data),
    ("mixing sources", mixing_sources),
    ("packing", sequence_packing),
]
#: Texts go through models and iterative searches that SQL cannot express; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name.split()[0].lower())
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
