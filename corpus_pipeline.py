"""A corpus pipeline: documents in, token ids out.

Each stage works on all rows that the one before it kept, is written as Parquet to the shared folder, and is read again by the next.

Rows without doc_id can't be named by a link; the similarity stage keeps them. It also keeps every row without words, since these
are linked with nothing. Of rows with one doc_id and text one stays, that with the smallest other columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, jaccard, line_dedup, mixing, quality
from tessera.llm._spark import discard, scratch, unused


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of 50 words or more, in whole lines, are cut from the texts."""
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the smallest doc_id stays."""
    found = jaccard.jaccard_components(docs)
    kept, once = unused(docs, "kept_id", "one_of_its_kind")
    keep = found.where("doc_id = component_id").select(F.col("doc_id").alias(kept)).distinct()
    named = docs.where("doc_id is not null").join(keep, F.col("doc_id") == F.col(kept), "left_semi")
    # rows with one doc_id and text are copies, whatever else they hold; rows without words are not
    named = named.withColumn(once, F.when(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(-1).cast("long")).otherwise(F.monotonically_increasing_id()))
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    if rest:
        named = named.groupBy("doc_id", "text", once).agg(F.min(F.struct(*rest)).alias(kept)).select("doc_id", "text", f"{kept}.*")
    else:
        named = named.dropDuplicates(["doc_id", "text", once])
    return named.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that the sources' shares meet their targets, in shuffled order."""
    return mixing.replicate(docs)


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts as token ids."""
    return bpe.encode_texts(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", bpe_encode),
]

#: No SQL expresses the backtracking encoder; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            discard(spark, f"{folder}/{k - 1}")
    return docs
