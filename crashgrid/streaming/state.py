"""Counts held in streaming state by period, until the watermark has passed the period.

A stream of (kind, label) with an event time is summed within its tasks, then added to the state.  A key is
one of SLOTS slots, each with the periods that hash to it.  Every batch gives the whole counts of the periods
that it touched, so a sink replaces those periods and nothing else, and a batch that is run again writes the
same.  Whenever a slot gets rows, the counts of its periods that the watermark has passed leave the state.
Rows that come later still are not lost: they are counted apart, on the side "late", whose counters stay.
State and output grow with periods and labels, never with batches or rows.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from crashgrid.streaming.sinks import run_available, run_continuous, run_name

FOREVER = "always"  # the period of rows without a time; it never closes
STORED = "kind string, label string, count bigint, run string, side string, period string"
SLOTS = 64


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        t = pa.Table.from_batches([b]).group_by(["period", "closes", "kind", "label"]).aggregate([("at", "max"), ("count", "sum")])
        t = t.select(["period", "closes", "kind", "label", "at_max", "count_sum"]).rename_columns(["period", "closes", "kind", "label", "at", "count"])
        yield from t.to_batches()


def _advance(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Add a batch's rows to their slot's state and give all counts of the periods and sides they fall on."""
    held: dict[tuple[str, str], Counter] = {}
    closes: dict[str, int] = {}
    for side, period, end, rows in json.loads(state.get[0]) if state.exists else []:
        held[side, period], closes[period] = Counter({(kind, label): n for kind, label, n in rows}), end
    watermark, touched = state.getCurrentWatermarkMs(), set()
    passed = lambda period: period != FOREVER and closes[period] <= watermark
    for part in parts:
        for period, end, kind, label, n in zip(*(part[c] for c in ("period", "closes", "kind", "label", "count"))):
            closes[period] = int(end)
            place = ("late" if passed(period) else "open", period)
            held.setdefault(place, Counter())[kind, label] += int(n)
            touched.add(place)
    kept = [(side, period, closes[period], [[*k, n] for k, n in c.items()]) for (side, period), c in held.items() if side == "late" or not passed(period)]
    state.update((json.dumps(kept),))
    yield pd.DataFrame([(*place, *k, n) for place in sorted(touched) for k, n in held[place].items()], columns=["side", "period", "kind", "label", "count"])


def counted(rows: DataFrame, at: Column, period: str, delay: str) -> DataFrame:
    """side, period, kind, label, count of the periods ("day", "month", ...) that a batch of (kind, label) touched.

    ``at`` is the event time, null for rows that belong to no period; rows of null label are ignored.
    """
    moment = at.cast("timestamp")
    start = F.date_trunc(period, "at")
    dated = rows.select(moment.alias("at"), "kind", "label", F.lit(1).cast("long").alias("count")).filter("label IS NOT NULL")
    dated = dated.select(
        F.coalesce(F.date_format(start, "yyyy-MM-dd"), F.lit(FOREVER)).alias("period"),
        F.coalesce(F.unix_millis(start + F.expr(f"INTERVAL 1 {period}")), F.lit(0)).alias("closes"), "kind", "label", "at", "count")
    parts = dated.mapInArrow(_summed, "period string, closes long, kind string, label string, at timestamp, count long")
    parts = parts.withColumn("slot", F.pmod(F.hash("period"), F.lit(SLOTS))).withWatermark("at", delay)
    return parts.groupBy("slot").applyInPandasWithState(
        _advance, "side string, period string, kind string, label string, count long", "data string", "update", GroupStateTimeout.NoTimeout)


def store_counts(counts: DataFrame, out: str, checkpoint: str, continuous: bool = False, every: str = "2 seconds"):
    """Write the counts, one folder for each progress folder, side and period, replaced when touched."""
    run = run_name(checkpoint)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("run", F.lit(run)).repartition("side", "period")  # one file a period
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "side", "period").parquet(out)

    if continuous:
        return run_continuous(counts, on_batch, checkpoint, every, "update")
    return run_available(counts, on_batch, checkpoint, "update")


def read_counts(spark: SparkSession, out: str) -> DataFrame:
    """kind, label, count, run, side, period as stored; a label's count is the sum of its rows."""
    return spark.read.schema(STORED).parquet(out)
