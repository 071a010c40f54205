"""The corpus pipeline: five stages from raw documents to packed training sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet in the
shared checkpoint folder and reads it back as the next stage's docs.  All but the last return the columns
of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import decontaminate, jaccard, language, packing, secret_scan
from ledgerlens.llm.common import table
from ledgerlens.llm.queries import tokenizer_path
from ledgerlens.session import configure, scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def columns_of(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The columns of documents, in a session with the library's conventions."""
    configure(spark)
    return docs.select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text or host speaks another language than they declare go."""
    return language.of_documents(columns_of(spark, docs)).where(~F.col("rejected")).select(*COLUMNS)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the least id."""
    return jaccard.one_of_each(columns_of(spark, docs))


def drop_benchmark_overlaps(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    return decontaminate.clean_documents(columns_of(spark, docs), table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars follows the changed texts."""
    docs = columns_of(spark, docs)
    return secret_scan.redact(docs, secret_scan.train(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed training sequences."""
    return packing.pack_documents(columns_of(spark, docs), tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard", join_near_duplicates),
    ("decontamination", drop_benchmark_overlaps),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]

#: trained and greedy stages have no SQL; tests compare run() with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
