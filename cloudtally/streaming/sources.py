"""Streams of scraped text, samples and logs, with back-pressure at the source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloudtally.operators.load_runs import parse_logs
from cloudtally.sources.exposition import parse_exposition, rejected_lines

SCRAPE_FILE = T.StructType(
    [
        T.StructField("target", T.StringType()),
        T.StructField("cloud", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("value", T.StringType()),
    ]
)


# What a collector takes in, before it is told apart: lines of scrapes and of logs.
COLLECTED = T.StructType([T.StructField("kind", T.StringType()), *SCRAPE_FILE])
SCRAPE, LOG = "scrape", "log"


def stream_files(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    file_format: str = "parquet",
    files_per_trigger: int | None = None,
    pattern: str | None = None,
) -> DataFrame:
    """New files of a folder as a stream; a trigger takes at most so many files."""
    reader = spark.readStream.format(file_format).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path)


def stream_scrapes(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Collected exposition text, kept as JSON lines, to sample rows."""
    return parse_exposition(stream_files(spark, path, SCRAPE_FILE, "json", files_per_trigger))


def stream_collected(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Lines of scrapes and of logs, by their ``kind``, kept as JSON lines."""
    return stream_files(spark, path, COLLECTED, "json", files_per_trigger)


def collected_samples(lines: DataFrame) -> DataFrame:
    return parse_exposition(lines.filter(F.col("kind") == SCRAPE).drop("kind"))


def collected_rejects(lines: DataFrame) -> DataFrame:
    """Scraped lines that are no samples, with their target, time and reason."""
    return rejected_lines(lines.filter(F.col("kind") == SCRAPE).drop("kind"))


def collected_logs(lines: DataFrame) -> DataFrame:
    return parse_logs(lines.filter(F.col("kind") == LOG).select("cloud", "value")).filter(F.col("severity").isNotNull())


def stream_logs(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Application logs, kept as ``cloud`` and the JSON line, to log records."""
    lines = T.StructType([T.StructField("cloud", T.StringType()), T.StructField("value", T.StringType())])
    logs = parse_logs(stream_files(spark, path, lines, "json", files_per_trigger))
    return logs.filter(F.col("severity").isNotNull())
