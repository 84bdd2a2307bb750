"""The corpus pipeline: five stages from raw documents to packed training sequences.

Each stage works on all documents its predecessor kept and returns the columns of `documents`; the last
returns the packed pieces. A stage's output is written as Parquet and read again as the next one's input.
SQL can express neither the trained classifier nor the tokenizer nor the packing, so ORACLE_SQL is None.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import decontam, line_dedup, near_copies, packing, quality
from gleaner.llm.common import save, table
from gleaner.llm.tokens import default_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine rejects go."""
    model = quality.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return quality.score(docs.select(*COLUMNS), model).where("predicted = 1").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of three-line windows go; so do documents that nothing but blanks is left of."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS))
    left = (F.col("n_removed") == 0) | (F.length(F.trim("text")) > 0)
    return out.where(left).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the document with the smallest doc_id stays."""
    return near_copies.keep_representatives(docs.select(*COLUMNS))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go. Rows are told apart by a saved row number, so a null doc_id hides none."""
    rows = docs.select(F.monotonically_increasing_id().alias("doc_id"), F.col("doc_id").alias("_doc_id"), *COLUMNS[1:])
    left = decontam.clean_documents(save(rows, "numbered"), table(spark, sf_dir, "benchmark"))
    return left.drop("doc_id").withColumnRenamed("_doc_id", "doc_id").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents as pieces of sequences of at most 2048 tokens."""
    out = packing.pack_documents(docs, default_path())
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", drop_low_quality),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("best_fit_packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), name)
    return docs
