"""Streaming ingest of report documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from crashgrid.sources.documents import ingest_batch
from crashgrid.streaming.sinks import read_batches, run_available, run_continuous, run_name, write_batch


FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def document_stream(spark: SparkSession, path: str, max_files: int = 50) -> DataFrame:
    """Stream of (key, text) from document files, at most ``max_files`` per batch."""
    files = (
        spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", "*.[pP][dD][fF]")
        .option("recursiveFileLookup", True).option("maxFilesPerTrigger", max_files).load(path)
    )
    return files.select(F.col("path").alias("key"), F.decode("content", "UTF-8").alias("text"))


def ingest_schema(spark: SparkSession) -> StructType:
    return ingest_batch(spark.createDataFrame([], "key string, text string")).schema


def stream_ingest(documents: DataFrame, out: str, checkpoint: str, continuous: bool = False, every: str = "2 seconds", remember: str = "30 days"):
    """Extract each document into ``out``, one row a key.

    A stream drops a key that it has met within ``remember`` of arrival, by streaming state that expires
    after that; earlier output is never read.  Arrival is the time of the batch, so no file counts as late,
    however old it is.  Keys that another progress folder brings as well, or that return after that time,
    are stored again; ``ingested`` keeps the first row of each.

    A failed document becomes a row with status 'failed', so it never stops the stream.
    """
    run = run_name(checkpoint)
    arrived = documents.withColumn("_arrived", F.current_timestamp())
    fresh = arrived.withWatermark("_arrived", remember).dropDuplicatesWithinWatermark(["key"]).drop("_arrived")

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        write_batch(ingest_batch(batch), batch_id, out, run)

    if continuous:
        return run_continuous(fresh, on_batch, checkpoint, every)
    return run_available(fresh, on_batch, checkpoint)


def ingested(spark: SparkSession, out: str) -> DataFrame:
    """The first row of every key."""
    rows = read_batches(spark, out, ingest_schema(spark))
    first = rows.groupBy("key").agg(F.min_by(F.struct(*rows.columns), F.struct("batch", "run")).alias("r"))
    return first.select("r.*")
