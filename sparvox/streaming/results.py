"""Results as a stream: files of result rows come in, each task counts once, aggregates stay current.

The batch operators have no stream of their own; this is what resuming by task id and re-scoring after each run become when results
arrive continuously. The file source's log and the checkpoint make a restart go on where it was.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCORES = "task_id string, model string, language string, numerator long, denominator long, at timestamp"


def read_results(spark: SparkSession, path: str, schema: str = SCORES, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def once(results: DataFrame, late: str = "1 day") -> DataFrame:
    """Each task's first row; a task's repeats are remembered for as long as rows may be late."""
    return results.withWatermark("at", late).dropDuplicatesWithinWatermark(["task_id"])


def running_rates(results: DataFrame) -> DataFrame:
    """Micro-averages by model and language so far: for complete or update mode."""
    sums = results.groupBy("model", "language").agg(F.count("*").alias("items"), F.sum("numerator").alias("numerator"), F.sum("denominator").alias("denominator"))
    return sums.withColumn("value", F.when(F.col("denominator") != 0, F.col("numerator") / F.col("denominator")))


def hourly_rates(results: DataFrame, late: str = "1 hour") -> DataFrame:
    """Micro-averages by hour, final once the watermark has passed: for append mode."""
    sums = results.withWatermark("at", late).groupBy(F.window("at", "1 hour").alias("hour"), "model").agg(F.count("*").alias("items"), F.sum("numerator").alias("numerator"), F.sum("denominator").alias("denominator"))
    return sums.select(F.col("hour.start").alias("hour"), "model", "items", "numerator", "denominator")


def start(results: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Hands every micro-batch with its number to write, which may be called again with the same number after a failure."""
    return results.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
