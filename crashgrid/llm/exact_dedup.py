"""Exact dedup with a persistent digest index, bucketed and sorted by digest.

DataFrame functions only.  Texts are equal when they are identical after lower-casing A-Z.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from crashgrid.llm.registry import query
from crashgrid.llm.rows import numbered, without_rows
from crashgrid.session import HOT_SHARE, cut, drop_cut


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.  For texts of one byte a character that is ``lower``, which is much faster."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


class DigestIndex:
    """Digests of all texts seen so far, one row each, in a table bucketed and sorted by digest.

    Columns: text_sha256, keep_id, group_size (rows of the batch that brought the text), batch.
    A batch that is run again after a failure finds its own rows and appends nothing twice.
    """

    def __init__(self, spark: SparkSession, table: str, buckets: int | None = None):
        """``buckets`` holds for the life of the table; some 100 million digests a bucket are fine."""
        self.spark, self.table = spark, table
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _rows(self, id_kind: str) -> DataFrame:
        """The table, made empty before the first batch, so that every batch takes the same path."""
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (text_sha256 string, keep_id {id_kind}, group_size bigint, batch string) USING parquet"
            f" CLUSTERED BY (text_sha256) SORTED BY (text_sha256) INTO {self.buckets} BUCKETS")
        return self.spark.table(self.table)

    def deduplicate(self, docs: DataFrame, batch: str, row: str | None = None) -> DataFrame:
        """Decisions on a batch of documents; texts that are new enter the index.

        Of equal texts the row with the largest doc_id stays, one row also where ids repeat (a null
        id counts as smallest).  A text that an earlier batch brought is dropped, and keep_id is the
        id kept then.  A null text counts as empty; other columns are ignored.  Returns _row (the
        row's number in the batch as read), doc_id, keep_id, group_size (rows of this batch),
        kept and text_sha256.  ``row`` names a column of distinct numbers to use as _row.

        The rows are hashed once and written without their texts; group sizes are counted before
        the shuffle.  Digests with over 1/HOT_SHARE of the rows are fewer than HOT_SHARE, so those
        are broadcast to the rows and only the even rest is joined by shuffle.
        """
        text = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
        slim = cut(docs.select((F.col(row) if row else F.monotonically_increasing_id()).alias("_row"), "doc_id", F.sha2(text, 256).alias("text_sha256")))
        groups = slim.groupBy("text_sha256").agg(
            F.max(F.struct("doc_id", "_row")).alias("last"), F.count("*").alias("group_size"))
        groups = groups.select("text_sha256", "group_size", F.col("last.doc_id").alias("keep_id"), F.col("last._row").alias("_keep_row"))
        index, total, mine = self._rows(docs.schema["doc_id"].dataType.simpleString()), slim.count(), F.col("batch") == batch
        earlier = index.filter(~mine)
        fresh = groups.join(earlier.hint("merge"), "text_sha256", "left_anti")
        old = groups.join(earlier.select("text_sha256", F.col("keep_id").alias("_old")).hint("merge"), "text_sha256")
        old = old.select("text_sha256", "group_size", F.col("_old").alias("keep_id"), F.lit(None).cast("long").alias("_keep_row"))
        decided = cut(fresh.unionByName(old))
        if index.filter(mine).isEmpty():
            entering = decided.filter("_keep_row IS NOT NULL").select("text_sha256", "keep_id", "group_size", F.lit(batch).alias("batch"))
            entering.repartition(self.buckets, "text_sha256").write.bucketBy(self.buckets, "text_sha256").sortBy(
                "text_sha256").mode("append").format("parquet").saveAsTable(self.table)
        hot = decided.filter(F.col("group_size") * HOT_SHARE > total)
        marks = hot.select("text_sha256", F.lit(True).alias("_hot"))
        tagged = slim.join(F.broadcast(marks), "text_sha256", "left")
        rows = tagged.filter("_hot").join(F.broadcast(hot), "text_sha256").unionByName(
            tagged.filter("_hot IS NULL").join(decided, "text_sha256"))
        result = cut(rows.select(
            "_row", "doc_id", "keep_id", "group_size", F.coalesce(F.col("_row") == F.col("_keep_row"), F.lit(False)).alias("kept"), "text_sha256"))
        drop_cut(slim, decided)
        return result

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def exact_dedup(docs: DataFrame, row: str | None = None) -> DataFrame:
    """Decisions on one batch against an index of its own, dropped afterwards."""
    index = DigestIndex(docs.sparkSession, f"digest_index_{uuid.uuid4().hex}")
    decisions = index.deduplicate(docs, "all", row)
    index.drop()
    return decisions


def keep_distinct(docs: DataFrame) -> DataFrame:
    """The documents that ``exact_dedup`` keeps, all columns.

    Only the numbers of dropped rows meet the documents, so no text is copied or shuffled.
    """
    stored = numbered(docs)
    decisions = exact_dedup(stored, "_row")
    kept = without_rows(stored, decisions.filter("NOT kept"))
    drop_cut(decisions)
    return kept


_SQL = f"""
WITH n AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')) AS text_sha256
           FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY 1)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, n.text_sha256 FROM n JOIN g USING (text_sha256)
"""


@query("op10_exact_dedup", "documents", _SQL)
def op10_exact_dedup(documents: DataFrame) -> DataFrame:
    return exact_dedup(documents).drop("_row")
