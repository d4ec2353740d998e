"""Corpus pipeline: quality classifier, near-dedup, suffix-array dedup, packing.

Each stage takes all its predecessor kept, as a table, and its decisions take effect. All
stages but the last return the columns of `documents`.

Defined cases: null text is empty text. Rows without a doc_id cannot be told apart and pass
the near-duplicate stage as they are; of rows that share one doc_id and a group one stays there.
Extra columns may have any name and pass all stages but the last. No documents give no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestline.llm import packing, quality_cnn, simhash, suffix_dedup, tokens
from harvestline.llm.support import Scratch, table

# Byte-pair ids and a fitted network are not SQL; the tests hold every stage against brute force.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents the classifier scores below its threshold. It learns from the kept folds
    of the labelled documents of the whole input."""
    model = quality_cnn.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    # whole rows travel as one column, so none of theirs can clash with the score
    scored = quality_cnn.score_documents(docs.select(F.struct(*docs.columns).alias("row"), "text"), model)
    return scored.where(F.col("score") >= quality_cnn.KEEP_FROM).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least id of every group of SimHash near-duplicates: fingerprints of
    four-word shingles linked at four or fewer differing bits."""
    return simhash.first_of_each_group(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove every 50 bytes that a document with a smaller id has; n_chars follows."""
    return suffix_dedup.remove_repeats(docs).withColumn(
        "n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)
    ).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 ids placed into sequences."""
    return packing.pack_documents(docs, tokens.default_path())


STAGES = [("quality_classifier", keep_quality), ("simhash_near_dedup", drop_near_copies),
          ("suffix_array_dedup", cut_repeats), ("best_fit_packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`; each result is written before the next stage reads it."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
