"""The queries of this package: each applies its operator, as in production, to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, chat, jaccard, language_model, line_dedup, mixing, quality, secret_scan, warc


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_documents(spark, sf_dir))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_links(_documents(spark, sf_dir))


def op3_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_documents(spark, sf_dir), report=True)


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.replicate(_documents(spark, sf_dir), report=True)


def op6_bpe_backtracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_documents(spark, sf_dir))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(_documents(spark, sf_dir))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(chat.PROBE, "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_records(chat.conversation_records(turns.unionByName(probe)), "conv_id", "record"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digests(_documents(spark, sf_dir))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_ngram_jaccard_join,
        op3_warc_chunks,
        op4_line_dedup,
        op5_mix_sources,
        op6_bpe_backtracking,
        op7_lm_score,
        op8_chat_format,
        op9_secret_scan,
        op10_nearest_neighbours,
    )
}

#: DuckDB SQL for the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {"op3_warc_chunks": warc.ORACLE_SQL, "op5_mix_sources": mixing.ORACLE_SQL, "op8_chat_format": chat.ORACLE_SQL}
