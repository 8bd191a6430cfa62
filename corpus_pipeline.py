"""Documents to packed sequences: language ID, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. A stage works on all rows it gets; rows without a doc_id
stay where a stage cannot judge them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import common, decontamination, languages, linededup, neardup, packing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from all documents with a language; rejects those without a letter and those that fit none of the languages.

    Short texts, and all texts with a letter if no document has a language, stay.
    """
    return languages.in_a_language(docs, languages.learn(docs)).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated chunks of lines, and the documents of which nothing is left; n_chars follows the text."""
    left = linededup.dedup_lines(docs)
    removed = common.q(left.columns[-1])
    left = left.filter((removed == 0) | (F.length(F.trim("text")) > 0))
    return left.withColumn("n_chars", F.when(removed > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of five-word shingles' similarity of 0.8 or more the document with the smallest doc_id stays.

    Rows of one doc_id stay or go together.
    """
    gone = common.fresh(docs, "gone")[0]
    rows = neardup.near_duplicates(docs.select("doc_id", "text")).filter("doc_id IS NOT NULL")
    groups = rows.groupBy(F.col("doc_id").alias(gone)).agg(F.bool_or("kept").alias("stays")).filter("NOT stays").select(gone)
    return docs.join(groups, common.q("doc_id") == common.q(gone), "left_anti").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes the documents in which a window of a benchmark item occurs."""
    return decontamination.decontaminate(docs, common.read(spark, sf_dir, "benchmark").select("item_id", "text")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with their token ids (little-endian unsigned 16-bit)."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pack", pack)]

ORACLE_SQL = None  # language ID, near-dedup, and packing have no SQL form; tests hold the stages against plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
