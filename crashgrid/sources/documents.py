"""Document listings and the batch ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from crashgrid.functions.bands import blank_to_null
from crashgrid.functions.reports import base_name, document_gate, extract_report


def list_documents(spark: SparkSession, path: str) -> DataFrame:
    """PDF files below a folder.  The content column is never selected, so no file is read."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", True).load(path)
    )
    return files.select(
        F.col("path").alias("key"), F.col("length").alias("size"), F.col("modificationTime").alias("last_modified")
    )


def unprocessed(files: DataFrame, acc: DataFrame) -> DataFrame:
    """Files whose key is no stored url and whose base name is no stored base name."""
    urls = acc.select(F.col("pdf_url").alias("key")).filter("key IS NOT NULL").distinct()
    names = urls.select(base_name(F.col("key")).alias("_name")).distinct()
    fresh = files.withColumn("_name", base_name(F.col("key")))
    return fresh.join(urls, "key", "left_anti").join(names, "_name", "left_anti").drop("_name")


def flag_processed(files: DataFrame, acc: DataFrame) -> DataFrame:
    """Flag files whose base name occurs anywhere inside a stored url.

    A base name has no slash, so an occurrence lies within one of the url's segments.  A name that
    ends in '.pdf' ends at a '.pdf' of the segment, and its length is one of the file-name lengths
    that are no longer than the segment (file systems bound those by a few hundred).  Each url
    therefore yields a few candidate substrings, and the substring search becomes an equi-join.
    Names that do not end in '.pdf' match as whole urls only.
    """
    named = files.withColumn("_name", base_name(F.col("key")))
    urls = acc.select("pdf_url").filter("pdf_url IS NOT NULL").distinct()
    lengths = named.agg(F.collect_set(F.length("_name")).alias("_lengths"))
    segments = F.filter(F.split("pdf_url", "/"), lambda s: F.lower(s).contains(".pdf"))
    parts = urls.select(F.explode(segments).alias("_part")).distinct().join(F.broadcast(lengths))
    ends = F.filter(
        F.sequence(F.lit(4), F.length("_part")), lambda e: F.lower(F.substring(F.col("_part"), e - 3, F.lit(4))) == ".pdf")
    candidates = (
        parts.select("_part", "_lengths", F.explode(ends).alias("_end"))
        .select("_part", "_end", F.explode(F.filter("_lengths", lambda n: n <= F.col("_end"))).alias("_len"))
        .select(F.substring(F.col("_part"), F.col("_end") - F.col("_len") + 1, F.col("_len")).alias("_name"))
        .distinct().withColumn("_hit", F.lit(True))
    )
    exact = urls.select(F.col("pdf_url").alias("key"), F.lit(True).alias("_same"))
    flagged = named.join(candidates, "_name", "left").join(exact, "key", "left")
    done = F.coalesce("_hit", F.lit(False)) | F.coalesce("_same", F.lit(False))
    return flagged.withColumn("already_processed", done).drop("_name", "_hit", "_same")


def processed_totals(flagged: DataFrame) -> DataFrame:
    return flagged.agg(
        F.count("*").alias("total"), F.count_if("already_processed").alias("already_processed"),
        F.count_if(~F.col("already_processed")).alias("to_process"),
    )


def take_batch(files: DataFrame, size: int | None = None) -> DataFrame:
    """All files of a run, or the first ``size`` by key where the caller asks for so many."""
    return files if size is None else files.orderBy("key").limit(size)


def ingest_batch(documents: DataFrame) -> DataFrame:
    """Extraction record per document (key, text) with its status; a bad document fails alone."""
    records = extract_report(documents, "text", "key", "text")
    error = (
        F.when(document_gate(F.col("text")) == "HTML", "Invalid file")
        .when(blank_to_null(F.col("fir_number")).isNull(), "No report number")
    )
    return records.withColumn("error", error).withColumn(
        "status", F.when(F.col("error").isNull(), "processed").otherwise("failed")
    ).drop("text")


def ingest_errors(status: DataFrame) -> DataFrame:
    """(key, error) of every failed document."""
    return status.filter("status = 'failed'").select("key", "error")


def ingest_batch_summary(status: DataFrame) -> DataFrame:
    """Counts of processed and failed documents, one row."""
    return status.agg(
        F.count_if(F.col("status") == "processed").alias("processed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )
