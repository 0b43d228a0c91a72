"""Queries of runs, shards, sinks and text rules over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparvox.functions import text
from sparvox.operators import runs, scoring
from sparvox.plans.evaluation import counted, query, table
from sparvox.runtime import cut, shared_path
from sparvox.sources import jsonl

SHARD = "(('0x' || substr(sha256({} || chr(0) || {}), 1, 16))::UBIGINT % {})::INT"
LINE_SHARD = SHARD.format("l_orderkey::VARCHAR", "l_linenumber::VARCHAR", 5)


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as results: sample_id, channel, error (of what was returned)."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(F.col("l_orderkey").cast("string").alias("sample_id"), F.col("l_linenumber").cast("string").alias("channel"), F.when(F.col("l_returnflag") == "R", "failed").alias("error"))


@query(f"SELECT {LINE_SHARD} AS shard, count(*) FILTER (WHERE l_returnflag <> 'R') AS completed, count(*) FILTER (WHERE l_returnflag = 'R') AS failed FROM lineitem GROUP BY 1")
def shard_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each shard has done."""
    return runs.coverage(results(spark, sf_dir), 5)


@query("SELECT l_orderkey::VARCHAR AS sample_id, l_linenumber::VARCHAR AS channel, max(CASE WHEN l_returnflag = 'R' THEN 'failed' END) AS error FROM lineitem GROUP BY 1, 2")
def merged_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five shards' results as one run's."""
    once = results(spark, sf_dir).groupBy("sample_id", "channel").agg(F.max("error").alias("error"))
    whole = cut(once.withColumn("shard", text.shard_of(F.col("sample_id"), F.col("channel"), 5)))  # else every shard's reader works it out again
    return runs.merge_shards([whole.where(F.col("shard") == k).drop("shard") for k in range(5)], whole.select("sample_id", "channel"))


@query("""SELECT sample_id, model, n FROM (SELECT l_orderkey AS sample_id, l_returnflag AS model, l_linenumber::BIGINT AS n,
  row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber DESC) AS k FROM lineitem) WHERE k = 1""")
def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last line of each order and flag."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sample_id"), F.col("l_returnflag").alias("model"), F.col("l_linenumber").cast("long").alias("n"))
    return scoring.latest_run(lines, F.col("n"))


@query("""SELECT doc_id, sha256('{"run":"r","sample_id":"' || doc_id || '","channel":"' || lang || '"}') AS task_id FROM documents""")
def task_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities of (document, language) tasks under one run."""
    return table(spark, sf_dir, "documents").select("doc_id", runs.task_id("r", F.col("doc_id").cast("string"), F.col("lang")).alias("task_id"))


@query("""WITH t AS (SELECT conv_id, turn FROM conversations), d AS (SELECT DISTINCT conv_id, (conv_id % 50) + 10 AS s FROM conversations WHERE conv_id % 7 <> 0)
SELECT count(*) AS tasks, round(coalesce(sum(s), 0) / 3600.0, 6) AS audio_hours,
  (SELECT string_agg(c::VARCHAR, ',' ORDER BY c) FROM (SELECT DISTINCT conv_id::VARCHAR AS c FROM conversations WHERE conv_id % 7 = 0 ORDER BY 1 LIMIT 20)) AS missing FROM t LEFT JOIN d USING (conv_id)""")
def preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run over all turns would take; of clips without a duration the first 20 are named, which is the report's form."""
    turns = table(spark, sf_dir, "conversations")
    tasks = turns.select(F.col("conv_id").cast("string").alias("sample_id"), F.col("turn").cast("string").alias("channel"))
    known = turns.where("conv_id % 7 <> 0").select(F.col("conv_id").cast("string").alias("sample_id"), (F.col("conv_id") % 50 + 10).cast("double").alias("duration_s")).distinct()
    found = runs.preflight(tasks, known)
    return spark.createDataFrame([(found["tasks"], round(found["audio_hours"], 6), ",".join(found["missing"]) or None)], "tasks long, audio_hours double, missing string")


@query("""WITH c AS (SELECT l_returnflag AS metric, l_linestatus AS language, l_linenumber::BIGINT AS s, round_even(l_quantity, 0)::BIGINT AS d, round_even(l_tax * 100, 0)::BIGINT AS i, floor(l_extendedprice)::BIGINT AS h FROM lineitem)
SELECT metric, language, count(*) AS items, sum(s)::BIGINT AS substitutions, sum(d)::BIGINT AS deletions, sum(i)::BIGINT AS insertions, sum(h)::BIGINT AS hits,
  sum(s + d + i)::BIGINT AS numerator, sum(h + s + d)::BIGINT AS denominator, sum(s + d + i)::DOUBLE / sum(h + s + d)::DOUBLE AS value FROM c GROUP BY metric, language""")
def lineage_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro-average by lineage."""
    rows = counted(table(spark, sf_dir, "lineitem")).withColumnsRenamed({"l_returnflag": "metric", "l_linestatus": "language"})
    return scoring.aggregate_scores(rows)


@query("SELECT doc_id, quality, toxic FROM labels")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels written as JSON lines and read back strictly."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    path = shared_path(spark, "labels")
    jsonl.write(labels, path)
    return jsonl.read(spark, path, labels.schema)


ASCII = "regexp_replace(text, '[^\\x00-\\x7F]', 'x', 'g')"


@query(f"SELECT doc_id, length(regexp_replace({ASCII}, '\\s', '', 'g'))::BIGINT AS characters, len(regexp_extract_all({ASCII}, '\\S+'))::BIGINT AS words FROM documents")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of both kinds in every text, in ASCII."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"[^\x00-\x7F]", "x").alias("t"))
    return docs.select("doc_id", *(F.size(text.tokens(F.col("t"), m)).cast("long").alias(n) for m, n in (("cer", "characters"), ("wer", "words"))))


@query(f"SELECT doc_id, md5(trim(regexp_replace(regexp_replace({ASCII}, '[!-/:-@\\[-`{{-~]+', ' ', 'g'), '\\s+', ' ', 'g'), ' ')) AS digest FROM documents")
def punctuation_to_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without punctuation and symbols, in ASCII."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"[^\x00-\x7F]", "x").alias("t"))
    return docs.select("doc_id", F.md5(text.punctuation_to_spaces(F.col("t")).cast("binary")).alias("digest"))
