"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm import chat_format, embedding_neighbours, language_id, license_scan, line_dedup, media_archive, ngram_jaccard, piece_encoding, shard_packing, source_mixing


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(_table(spark, sf_dir, "conversations"))


def op2_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_encoding.encode_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = language_id.train_language_net(docs)
    held_out = (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("held_out")
    return language_id.predict_language(docs.select("doc_id", held_out, "text"), net, keep_text=False)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_neighbours.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs)


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_archive.archive_and_inspect(_table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op9_shard_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_packing.shard_documents(_table(spark, sf_dir, "documents"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_chat_format, op2_piece_encoding, op3_language_id, op4_near_duplicates, op5_line_dedup, op6_media_columns, op7_license_scan, op8_source_mixing, op9_shard_packing, op10_ngram_jaccard, pipeline]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op7_license_scan": license_scan.scan_licenses_sql()}
