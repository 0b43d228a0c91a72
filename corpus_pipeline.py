"""Corpus preparation: documents -> quality rules -> line dedup -> near-dedup -> source mix -> token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns of documents.
n_chars follows the text. run() writes every stage to the shared folder and reads it again, so a lost executor costs a stage's
tasks, not the pipeline.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparvox.llm import byte_bpe, lines, minhash, mixing, quality
from sparvox.llm.queries import tokenizer_file
from sparvox.runtime import stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the robust outlier test accept."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the boilerplate lines of their source; a text of which nothing is left stays as an empty one."""
    return lines.drop_boilerplate(docs, host="source").withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies: that of the smallest doc_id."""
    return minhash.deduplicate(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in order of training position."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids of every copy."""
    path = tokenizer_file("byte_bpe_50k.tiktoken")
    both = byte_bpe.decode(byte_bpe.encode(docs.select("doc_id", "text"), path), path)
    n = (F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return both.select("doc_id", n, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "ids")


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near-dedup", near_dedup), ("source mix", source_mix), ("token ids", encode)]

#: Robust estimation, banded sketches and byte-pair merges can't be expressed in SQL; test_pipeline_run_equals_brute_force holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, apply) in enumerate(STAGES):
        docs = apply(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"stage-{k}")
    return docs
