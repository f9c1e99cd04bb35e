"""From raw documents to packed training sequences: five stages, each written before the next one reads it."""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modlake.llm import lines, minhash, packing, quality, substrings
from modlake.llm.common import Scratch

#: Rows of an Arrow batch between the JVM and Python. Spark's 10,000 are some 20 MB of text in each of four places of a task.
BATCH_ROWS = 2000


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.3 go; the others stay as they are."""
    return quality.keep_good(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), 0.3)


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines whose template occurs in five documents or more go, but for the first one's; every document stays."""
    return _counted(lines.drop_template_lines(spark, docs), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id stays."""
    return minhash.keep_one(spark, docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 13 words that a document with a smaller id has too go; every document stays."""
    return _counted(substrings.drop_repeats(spark, docs, stored=True), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens, one row for each piece."""
    return packing.pack_documents(spark, docs, public_tokenizers.path("word_bpe_49k.json"))


def _in_small_batches(stage):
    """The stage, in a session whose Arrow batches have BATCH_ROWS rows at most."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        now = int(spark.conf.get(key))
        spark.conf.set(key, str(min(now, BATCH_ROWS) if now > 0 else BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return run_stage


def _counted(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of the documents, with n_chars of the text that is left."""
    return out.select(*docs.columns).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))


STAGES = [
    ("quality classifier", _in_small_batches(drop_low_quality)),
    ("line dedup", _in_small_batches(drop_recurring_lines)),
    ("minhash near-dedup", _in_small_batches(drop_near_duplicates)),
    ("substring dedup", _in_small_batches(drop_repeated_passages)),
    ("best-fit packing", _in_small_batches(pack_sequences)),
]

#: No SQL says what the classifier and the packer do; tests/llm/test_edges.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``; all but the last are written to the shared folder and read again.

    What a stage has read is deleted once its own rows are written.
    """
    docs, scratch, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline"), []
    for _, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir))
        scratch.free(*read)
        read = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
