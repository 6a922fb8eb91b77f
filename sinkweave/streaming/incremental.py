"""Incremental extraction from a folder of source files, and a stream of status messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.extract import extract
from ..schema import FILES


def watch(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of (repo, path, lang, text) rows from Parquet files as they arrive."""
    reader = spark.readStream.schema(FILES)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(folder)


def extract_into(files: DataFrame, out: str, checkpoint: str):
    """Starts the query that appends nodes and raw edges of each batch to ``out``; a batch that is run again replaces
    what it wrote before."""

    def write(batch: DataFrame, number: int) -> None:
        nodes, edges, _ = extract(batch)
        nodes.write.mode("overwrite").parquet(f"{out}/nodes/batch={number}")
        edges.write.mode("overwrite").parquet(f"{out}/raw_edges/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_status(messages: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Messages by window and sender, late ones up to ``delay``; (window, sender, n, last)."""
    counted = messages.withWatermark("ts", delay).groupBy(F.window("ts", "5 minutes"), "sender")
    return counted.agg(F.count("*").alias("n"), F.max_by("status", "ts").alias("last")).select("window", "sender", "n", "last")
