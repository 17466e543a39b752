"""A corpus pipeline: language filter, line dedup, near-duplicate removal, source mixing, encoding."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegraph.llm.language_id import UNKNOWN, predict_language, train_language_net
from tidegraph.llm.line_dedup import dedup_lines
from tidegraph.llm.ngram_jaccard import jaccard_components
from tidegraph.llm.piece_encoding import encode_texts
from tidegraph.llm.source_mixing import mix_sources
from tidegraph.llm.workspace import Workspace
from tidegraph.session import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Below this pooled probability of the best language a text is in none of them.
LEAST_SCORE = 0.4
NEAR_WIDTH, NEAR_PERCENT = 5, 80
#: Words and pairs of tokens an encoding worker keeps: fewer than by itself, as executors hold four stages' code by then.
REMEMBERED = (40_000, 120_000)

# Every stage takes any rows: nulls in any column, empty and very long texts, ties, repeated rows, no rows at all. Extra
# columns of ``documents`` go in the first stage, so their names clash with nothing. What each does with such rows:


def language_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages: the network must name one and give it ``LEAST_SCORE`` or more.

    Texts that are null, empty or without a letter go, as they are in no language. Equal texts share their fate,
    repeated rows stay repeated. If nothing can be learned from (no labelled row), no document goes.
    """
    docs = docs.select(COLUMNS)
    net = train_language_net(docs)
    if net is None:
        return docs
    return predict_language(docs, net).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the blocks of lines that an earlier document has; documents of which nothing is left go.

    Earlier is by doc_id; rows without one neither lose nor delete lines, rows that share one don't delete from each
    other. A text that was empty or null before stays.
    """
    left = dedup_lines(docs.select(COLUMNS)).where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    return left.withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each component of near duplicates: word shingles of ``NEAR_WIDTH``, Jaccard from ``NEAR_PERCENT`` on.

    First is by doc_id. Rows that repeat a doc_id go or stay together; rows without doc_id or without words stay.
    """
    others = jaccard_components(docs, NEAR_WIDTH, NEAR_PERCENT).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.select(COLUMNS).join(others.hint("shuffle_hash"), "doc_id", "left_anti")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it; of those taken in part, so many stay whole as their parts add up to.

    Parts are added up within a shard in the order of size, from a seeded start, and a document stays where the sum
    passes a whole number; so a source's words come near its target, and reruns agree.
    Rows are told apart by doc_id and text together, so one without doc_id is mixed like any other; alike rows share
    what is taken of them evenly. A text without words has nothing to take and goes.
    """
    key = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))))
    mix = mix_sources(docs.select(key.alias("doc_id"), "text", "source")).where("size > 0")
    taken = mix.groupBy("doc_id").agg((F.sum("taken") / F.sum("size")).alias("part"), F.max("size").alias("size"), F.max("source").alias("source"), F.max("shard").alias("shard"))
    shard = Window.partitionBy("source", "shard").orderBy("size", "doc_id")
    start = F.pmod(F.xxhash64("source", "shard"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    before = F.coalesce(F.sum("part").over(shard.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    upto = F.sum("part").over(shard.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    times = taken.select(F.col("doc_id").alias("key"), (F.floor(upto + start) - F.floor(before + start)).cast("int").alias("times")).where("times > 0")
    mixed = docs.select(*COLUMNS, key.alias("key")).join(times.hint("shuffle_hash"), "key")
    return mixed.select(*COLUMNS, F.explode(F.sequence(F.lit(1), "times"))).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the SHA-256 of the text decoded from them; a null text counts as empty."""
    out = encode_texts(docs.select("doc_id", "source", "text"), public_tokenizers.path("piece_bpe_32k.model"), decoded=None, decoded_sha256="decoded_sha256", remembered=REMEMBERED)
    return out.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded_sha256")


STAGES = [("language_id", language_filter), ("line_dedup", line_dedup), ("ngram_jaccard", near_dedup), ("source_mixing", source_mix), ("piece_encoding", encode)]

#: No stage but the mixing can be said in SQL; tests/llm compares each with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each on the written result of the one before."""
    ship(spark)
    space = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = space.keep(stage(spark, docs, sf_dir), name)
    return docs
