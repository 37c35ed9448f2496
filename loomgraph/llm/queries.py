"""The queries of the corpus operators, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bm25, bpe, exact_dedup, html_extract, jaccard, packing, prefix_trie, quality, sharding, substring_dedup, token_counts, vector_codes, warc
from .common import scratch_path

TRAIN_ROWS = "crc32(cast(doc_id as string)) % 5 <> 0"
SHARD_BYTES = 1 << 20
#: Longest block of a WARC record; longer ones continue in segments.
SEGMENT_BYTES = 4_096


def tokenizer(name: str) -> str:
    """Place of a public tokeniser's file; they are never copied here."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op2_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bm25.search(docs, docs.filter("doc_id % 20 = 0")).withColumn("score", F.round("score", 6))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicate_components(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, names = warc.write_warc(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"), segment=SEGMENT_BYTES)
    read = warc.read_warc(files, with_payload=False).select("record_id", "payload_bytes", "payload_digest", "record_type", F.when(F.col("record_type") == "revisit", F.col("refers_to")).alias("refers_to"))
    if names.filter("id IS NULL OR record_id <> concat('<urn:page:', id, '>')").isEmpty():  # records are named by the ids
        id_of = lambda c: F.regexp_extract(c, "^<urn:page:(.*)>$", 1).cast("long")
        return read.select(id_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", id_of("refers_to").alias("refers_to"))
    target = names.select(F.col("record_id").alias("refers_to"), F.col("id").alias("target"))
    named = read.join(names, "record_id").join(target, "refers_to", "left")
    return named.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("target").alias("refers_to"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), scratch_path(spark, "shards")
    given = sharding.write_shards(docs, path, SHARD_BYTES)
    written = sharding.read_shards(docs, path)
    sizes = written.groupBy("shard").agg(F.sum(sharding.row_bytes(docs)).alias("shard_bytes"), F.count(F.lit(1)).alias("shard_rows"))
    return given.join(sizes, "shard").select("doc_id", "shard", "depth", "n_bytes", "oversized", "shard_bytes", "shard_rows")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score_quality(docs, table(spark, sf_dir, "labels"), train_filter=TRAIN_ROWS).drop("text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress_vectors(table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conv_id")
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"), block=c - c % 100, head=F.crc32(c.cast("string")) % 6, most_head=5)


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(table(spark, sf_dir, "pages"))


QUERIES = {
    f.__name__: f
    for f in (op1_exact_dedup, op2_bm25_search, op3_substring_dedup, op4_token_counts, op5_bpe_round_trip, op6_jaccard_join, op7_warc, op8_sharding, op9_quality, op10_packing, op11_vector_codes, op12_prefix_trie, op13_html_text)
}
