"""The training-data pipeline: from raw documents to the blocks of a source mixture.

Defined results: documents without text, or whose text has no letter or no main language, go in the first stage, so
an empty table, and one without a text, gives no blocks; without a document whose language is known none can be
identified and all go. A null lang or source is kept (the source as one of its own), a null doc_id too: such
documents are told apart by their texts. Of repeated rows, and of different texts of one doc_id, each is decided by
itself; of near duplicates one stays. Columns besides those of documents are left out. An empty benchmark drops
nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm import decontaminate, langid, mixing, pii, simhash
from textmill.llm.common import drop_staged, stage_table
from textmill.shipping import shipping

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a main language; texts without letters or without one language that leads are rejected."""
    return langid.keep_identified(docs.select(COLUMNS), langid.fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return simhash.near_deduplicate(docs.select(COLUMNS))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item of the benchmark table."""
    return decontaminate.drop_contaminated(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pseudonymized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by pseudonyms of the same format."""
    return pii.pseudonymize(docs.select(COLUMNS)).drop("pii").withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: one row for each output slot, with its block's text and the doc_ids that the block is from."""
    return mixing.mixed_blocks(docs.select(COLUMNS))


STAGES = [
    ("language ID", shipping(identify_language)),
    ("SimHash near-dedup", shipping(near_dedup)),
    ("benchmark decontamination", shipping(decontaminated)),
    ("PII", shipping(pseudonymized)),
    ("mixing", shipping(mixed)),
]

#: No SQL: the stages hash, classify and permute in ways that DuckDB has no functions for; tests/llm holds each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), "pipeline")
        if before is not None:
            drop_staged(before)  # read by the stage just written, and by nothing else
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
