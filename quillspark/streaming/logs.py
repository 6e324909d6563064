"""Logs as a stream: the batch summaries, kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.sources.config import RECORD


def records(spark: SparkSession, path: str) -> DataFrame:
    """New log lines under ``path`` as they appear."""
    return spark.readStream.schema(RECORD).option("mode", "DROPMALFORMED").json(path)


def progress(stream: DataFrame) -> DataFrame:
    """Attempts, tokens and score sums by book; for complete or update mode."""
    return stream.groupBy("slug").agg(F.count("*").alias("attempts"), F.sum("score").alias("score_sum"), F.sum(F.coalesce("completion_tokens", F.lit(0))).alias("tokens"))
