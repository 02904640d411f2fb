"""Session helpers: shared scratch space, lineage cuts and skew-aware joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

# A key is "hot" when it holds more than 1/HOT_SHARE of the rows, so there are
# fewer than HOT_SHARE hot keys whatever the data size.
HOT_SHARE = 500


def scratch_root(spark: SparkSession) -> str:
    """The shared folder in ``spark.checkpoint.dir``; where unset, one below the default file system's home.

    A local master may use a temporary folder.  A cluster whose default file system is local has no
    place that all executors see, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    else:
        fs = spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.get(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.getUri().getScheme() == "file":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"{fs.getHomeDirectory()}/scratch-{uuid.uuid4().hex}"
    spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused folder path below the shared scratch space."""
    return f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back without lineage.

    A table survives lost executors like a checkpoint does; besides, later plans know
    its size (small ones are broadcast, large ones are not) and read single columns.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def drop_cut(*tables: DataFrame) -> None:
    """Delete the files of tables made by ``cut`` that no later plan reads (other frames are left alone)."""
    for df in tables:
        path = getattr(df, "_scratch", None)
        if path:
            jpath = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def hot_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys holding more than 1/HOT_SHARE of the rows: fewer than HOT_SHARE rows by construction."""
    total = df.count()
    counts = df.groupBy(key).agg(F.count("*").alias("_n"))
    return counts.filter(F.col("_n") * HOT_SHARE > total).select(key)


def tag_hot(df: DataFrame, key: str) -> DataFrame:
    """Add ``_hot``: whether the row's key is a hot one.  ``df`` should be materialised."""
    marks = F.broadcast(hot_keys(df, key).withColumn("_mark", F.lit(True)))
    return df.join(marks, key, "left").withColumn("_hot", F.col("_mark").isNotNull()).drop("_mark")


def join_tagged(tagged: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """Inner-join rows carrying ``_hot`` to a lookup that is unique by ``key``.

    Rows with a hot key stay where they are and meet a broadcast of the few hot
    lookup rows; only the evenly spread rest is shuffled.
    """
    hot = tagged.filter("_hot")
    keys = hot.select(key).distinct()
    hot_lookup = lookup.join(F.broadcast(keys), key, "left_semi")
    return hot.join(F.broadcast(hot_lookup), key).unionByName(
        tagged.filter("NOT _hot").join(lookup, key)
    )
