"""Repeatable micro-batch output: one folder per batch, rewritten when a batch is retried."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F


def run_name(checkpoint: str) -> str:
    """Stable name of a progress folder, its whole digest; batch numbers are only unique within one."""
    return hashlib.md5(checkpoint.encode()).hexdigest()


def write_batch(df: DataFrame, batch_id: int, path: str, run: str = "0") -> None:
    df.write.mode("overwrite").parquet(f"{path}/run={run}/batch={batch_id}")


def read_batches(spark: SparkSession, path: str, schema) -> DataFrame:
    """All batches written so far, with their ``run`` and ``batch``."""
    df = spark.read.schema(schema).option("basePath", path).parquet(f"{path}/run=*/batch=*")
    return df.withColumns({"run": F.col("run").cast("string"), "batch": F.col("batch").cast("long")})


def has_batches(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/run=*/batch=*/_SUCCESS")
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def run_available(stream: DataFrame, on_batch, checkpoint: str, mode: str = "append"):
    """Process everything that is available now in bounded micro-batches and stop."""
    q = (
        stream.writeStream.foreachBatch(on_batch).outputMode(mode)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return q


def run_continuous(stream: DataFrame, on_batch, checkpoint: str, every: str = "2 seconds", mode: str = "append"):
    """Keep processing at an interval; ``stop()`` on the returned query ends it."""
    return (
        stream.writeStream.foreachBatch(on_batch).outputMode(mode)
        .option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
    )
