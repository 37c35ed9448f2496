"""A corpus pipeline: quality, exact and near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.  Each is
judged on what its predecessor kept.  Between stages the rows are written as Parquet and read again, so a lost executor
costs at most a stage.

Defined results: a null or empty text is a document like any other: it gets a score, the first of those kept stays (they
are equal to each other), nothing is removed from it, and it is packed as one end token.  Repeated or null ids are
documents of their own, the first of equal texts stays, and an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import exact_dedup, jaccard, packing, quality, substring_dedup
from loomgraph.llm.common import scratch_path
from loomgraph.llm.queries import TRAIN_ROWS, table, tokenizer

#: A document whose quality score is lower is dropped.
LEAST_QUALITY = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of LEAST_QUALITY or more; the model learns from the labelled rows among docs."""
    scored = quality.score_quality(docs, table(spark, sf_dir, "labels"), train_filter=TRAIN_ROWS)
    return scored.filter(F.col("score") >= LEAST_QUALITY).select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for white space, the first."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a Jaccard similarity of 0.75, the first."""
    return jaccard.drop_near_duplicates(docs)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; where nothing is removed the text stays as it was."""
    out = substring_dedup.dedup_substrings(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumns({"n_chars": n_chars, "text": text}).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2,048 tokens and their places in sequences."""
    return packing.pack_documents(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("passage_dedup", passage_stage), ("packing", packing_stage)]

#: Tokenising and learning are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
