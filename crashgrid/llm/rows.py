"""Rows of a stored table by number: marked, dropped or repeated without a copy or a shuffle of their texts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

from crashgrid.session import cut

# A number is a file's number and a place in the file, which takes so many bits.
PLACE_BITS = 40
# So many words of 64 rows are broadcast at most (some 67 million rows); Spark decides about more.
MOST_WORDS = 1 << 20


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_row``, a number that every plan gives to the same row: its file and its place there.

    A Parquet table as it was read is not copied.  Other frames may come out in another order when a
    task is run again, so they are written once.
    """
    table = docs if docs._jdf.queryExecution().analyzed().children().isEmpty() else cut(docs)
    try:
        placed = table.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_place"))
    except AnalysisException:  # not a table of Parquet files
        return numbered(cut(docs))
    files = sorted(r[0] for r in placed.select("_file").distinct().collect())
    numbers = docs.sparkSession.createDataFrame(list(zip(files, range(len(files)))), "_file string, _number long")
    row = F.shiftleft("_number", PLACE_BITS) + F.col("_place")
    return placed.join(F.broadcast(numbers), "_file").select(*docs.columns, row.alias("_row"))


def _word() -> Column:
    return F.shiftright("_row", 6).alias("_word")


def _bit() -> Column:
    return F.col("_row").bitwiseAND(63).cast("int")


def _mark(table: DataFrame, values: DataFrame, planes: int) -> DataFrame:
    """``table`` with ``_value``, the number below 2 ** planes that ``values`` (_row, _value) has for its row, else 0.

    64 rows make one word of each binary place, so a row costs ``planes`` bits and an eighth of a byte
    where its word is met.
    """
    place = F.expr("shiftleft(1L, CAST(_row & 63 AS int))")
    bits = [F.bit_or(F.when(F.col("_value").bitwiseAND(1 << k) != 0, place).otherwise(F.lit(0).cast("long"))).alias(f"_plane{k}") for k in range(planes)]
    words = cut(values.groupBy(_word()).agg(*bits))
    if words.count() <= MOST_WORDS:
        words = F.broadcast(words)
    value = F.lit(0)
    for k in range(planes):
        value = value + F.coalesce(F.getbit(f"_plane{k}", _bit()).cast("int"), F.lit(0)) * (1 << k)
    joined = table.withColumn("_word", _word()).join(words, "_word", "left")
    return joined.withColumn("_value", value).drop("_word", *[f"_plane{k}" for k in range(planes)])


def without_rows(table: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of a numbered table whose number is not in ``dropped`` (_row), without the number."""
    marked = _mark(table, dropped.select("_row", F.lit(1).alias("_value")), 1)
    return marked.filter("_value = 0").drop("_row", "_value")


def repeat_rows(table: DataFrame, copies: DataFrame) -> DataFrame:
    """Each row of a numbered table as often as ``copies`` (_row, _value) says, without the number."""
    most = copies.agg(F.max("_value")).first()[0] or 0
    marked = _mark(table, copies, max(1, int(most).bit_length())).filter("_value > 0")
    return marked.withColumn("_value", F.explode(F.sequence(F.lit(1), F.col("_value")))).drop("_row", "_value")
