"""Streams give the batch result; retries and repeats change nothing."""

import time

import pandas as pd
from pyspark.sql import functions as F

from crashgrid.streaming import ingest, refresh, sinks, state


def test_documents_are_ingested_once(spark, tmp_path):
    docs, out, mark = tmp_path / "docs", str(tmp_path / "out"), str(tmp_path / "mark")
    docs.mkdir()
    for i in range(5):
        (docs / f"{i}.pdf").write_text(f"FIR No: {i}/2024\nThe victim died")
    (docs / "bad.pdf").write_text("<html>error page</html>")
    stream = lambda: ingest.document_stream(spark, str(docs), max_files=2)
    ingest.stream_ingest(stream(), out, mark)
    first = ingest.ingested(spark, out)
    assert first.count() == 6 and first.filter("status = 'failed'").count() == 1
    assert first.select("batch").distinct().count() == 3  # two files per batch
    (docs / "6.pdf").write_text("FIR No: 6/2024\nfracture")
    ingest.stream_ingest(stream(), out, mark)
    # a new progress folder replays every file; known keys are skipped
    ingest.stream_ingest(stream(), out, mark + "2")
    again = ingest.ingested(spark, out)
    assert again.count() == 7 and again.select("key").distinct().count() == 7
    own = sinks.read_batches(spark, out, ingest.ingest_schema(spark)).filter(F.col("run") == sinks.run_name(mark))
    assert own.count() == 7  # the restarted stream stored the new file only


def test_repeated_keys_of_a_stream(spark, tmp_path):
    """The same key in one batch, in a later batch and after a restart is stored once."""
    path, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    rows = spark.createDataFrame([(f"k{i % 4}", "FIR No: 1/2024 fracture") for i in range(9)], "key string, text string")
    stream = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    for keys in (rows, rows.filter("key < 'k2'"), rows.filter("key > 'k1'")):
        keys.repartition(2).write.mode("append").parquet(path)
        ingest.stream_ingest(stream(), out, mark)
    stored = sinks.read_batches(spark, out, ingest.ingest_schema(spark))
    assert sorted(r.key for r in stored.collect()) == ["k0", "k1", "k2", "k3"]


def test_stop_request(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "1.pdf").write_text("FIR No: 1/2024\nfracture here")
    q = ingest.stream_ingest(ingest.document_stream(spark, str(docs)), str(tmp_path / "o"), str(tmp_path / "m"), continuous=True, every="1 second")
    for _ in range(60):
        if sinks.has_batches(spark, str(tmp_path / "o")):
            break
        time.sleep(0.5)
    q.stop()
    assert not q.isActive and ingest.ingested(spark, str(tmp_path / "o")).count() == 1


def _event_files(spark, path):
    for day in range(3):
        spark.sql(f"""SELECT id, TIMESTAMP_NTZ '2024-01-0{day + 1} 00:00:00' + make_dt_interval(0, 0, cast(id * 7 AS int), 0) AS ts,
            CASE WHEN id % 2 = 0 THEN 'Fatal' ELSE 'Grievous' END AS severity FROM range(100)""").coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    # one late record
    spark.sql("SELECT 1000L AS id, TIMESTAMP_NTZ '2024-01-03 00:01:00' AS ts, 'Fatal' AS severity").coalesce(1).write.mode("append").parquet(path)


def test_activity_and_counts_match_batch(spark, tmp_path):
    path = str(tmp_path / "events")
    _event_files(spark, path)
    batch = spark.read.parquet(path)
    stream = lambda: spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(path)
    refresh.stream_activity(stream(), "ts", str(tmp_path / "a"), str(tmp_path / "ma"))
    key = lambda df: sorted((r["start"], r["count"]) for r in df.collect())
    assert key(refresh.stored_activity(spark, str(tmp_path / "a"))) == key(refresh.activity(batch, "ts"))
    acc = lambda df: df.select(F.col("ts").alias("incident_date"), "severity")
    refresh.stream_counts(acc(stream()), str(tmp_path / "c"), str(tmp_path / "mc"))
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(refresh.stored_counts(spark, str(tmp_path / "c"))) == rows(refresh.additive_counts(acc(batch)))


def _months(spark, path, *dates):
    spark.createDataFrame([(d, s) for d, s in dates], "d string, severity string").select(F.col("d").cast("timestamp_ntz").alias("incident_date"), "severity").coalesce(1).write.mode("append").parquet(path)


def test_late_rows_restart_and_bounded_state(spark, tmp_path):
    """Months close behind the watermark, later records of theirs go to the late side, and a restart goes on from the state."""
    path, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    rows = lambda df: sorted(tuple(r) for r in df.collect())

    def go():
        source = spark.readStream.schema("incident_date timestamp_ntz, severity string").option("maxFilesPerTrigger", 1).parquet(path)
        return refresh.stream_counts(source, out, mark, delay="40 days")

    _months(spark, path, ("2023-01-05", "Fatal"), ("2023-01-06", "Fatal"), (None, "Fatal"))
    go()
    _months(spark, path, ("2023-06-01", "Grievous"), ("2023-01-31", "Fatal"))  # the month is open until a watermark has passed it
    go()
    assert not refresh.late_counts(spark, out).count()
    for d in (1, 6, 12):
        _months(spark, path, (f"2024-{d:02}-15", "Fatal"))
    _months(spark, path, ("2023-01-07 03:00:00", "Grievous"), (None, "Grievous"))
    _months(spark, path, ("2023-01-08 03:00:00", "Grievous"), ("2024-12-16", "Fatal"))
    query = go()
    late = {tuple(r) for r in refresh.late_counts(spark, out).collect()}
    assert ("severity", "Grievous", 2) in late and ("month_severity", "2023-01|Grievous", 2) in late
    batch = spark.read.parquet(path)
    assert rows(refresh.stored_counts(spark, out)) == rows(refresh.additive_counts(batch))
    stored = state.read_counts(spark, out)
    assert stored.groupBy("side", "period", "kind", "label").count().filter("count > 1").isEmpty()
    assert stored.select("period").distinct().count() == 6  # five months and the rows without a date
    held = query.lastProgress["stateOperators"][0]
    assert held["numRowsTotal"] <= state.SLOTS
    files = lambda: stored.inputFiles()
    before = len(files())
    _months(spark, path, ("2024-12-17", "Fatal"))
    go()
    assert len(state.read_counts(spark, out).inputFiles()) == before and rows(refresh.stored_counts(spark, out)) == rows(refresh.additive_counts(spark.read.parquet(path)))


def test_slots_forget_closed_periods():
    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

        def getCurrentWatermarkMs(self):
            return self.mark

    slot = State()
    frame = lambda *rows: iter([pd.DataFrame(rows, columns=["period", "closes", "kind", "label", "count"])])
    slot.mark = 0
    out = list(state._advance((0,), frame(("a", 10, "k", "x", 2), ("a", 10, "k", "x", 3), ("b", 90, "k", "x", 1)), slot))[0]
    assert sorted(map(tuple, out.itertuples(index=False))) == [("open", "a", "k", "x", 5), ("open", "b", "k", "x", 1)]
    slot.mark = 50
    out = list(state._advance((0,), frame(("b", 90, "k", "y", 1)), slot))[0]
    assert sorted(map(tuple, out.itertuples(index=False))) == [("open", "b", "k", "x", 1), ("open", "b", "k", "y", 1)] and '"a"' not in slot.get[0]
    for n in (4, 5):
        out = list(state._advance((0,), frame(("a", 10, "k", "x", n)), slot))[0]
    assert list(map(tuple, out.itertuples(index=False))) == [("late", "a", "k", "x", 9)]


def test_windows_are_summed_from_panes(spark):
    at = [0, 1, 299, 300, 3599, 3600, 7000, 90_000, None]
    events = spark.createDataFrame([(t,) for t in at], "t long").select(F.timestamp_seconds("t").alias("ts"))
    got = {int(r.start.timestamp()): r["count"] for r in refresh.activity(events, "ts").collect()}
    brute = {s: sum(t is not None and s <= t < s + 3600 for t in at) for s in range(-3600, 100_000, 300)}
    assert got == {s: n for s, n in brute.items() if n}


def test_two_sources_share_one_output(spark, tmp_path):
    """A second stream into the same output adds to the counts of the first."""
    path, out, act = str(tmp_path / "events"), str(tmp_path / "c"), str(tmp_path / "a")
    _event_files(spark, path)
    batch = spark.read.parquet(path)
    stream = lambda: spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(path)
    acc = lambda df: df.select(F.col("ts").alias("incident_date"), "severity")
    for k in range(2):
        refresh.stream_counts(acc(stream()), out, str(tmp_path / f"mc{k}"))
        refresh.stream_activity(stream(), "ts", act, str(tmp_path / f"ma{k}"))
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    twice = batch.unionByName(batch)
    assert rows(refresh.stored_counts(spark, out)) == rows(refresh.additive_counts(acc(twice)))
    assert rows(refresh.stored_activity(spark, act)) == rows(refresh.activity(twice, "ts"))


def test_refresh_only_when_stale(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.sql(f"SELECT {len(calls)} AS n")

    root = str(tmp_path / "r")
    acc = spark.range(5)
    for frame, force in ((acc, False), (acc, False), (spark.range(6), False), (acc, True)):
        row = refresh.refresh_stored(spark, root, frame, "global", "all", compute, force)
    assert len(calls) == 3 and row.first()["data"] == '{"n":3}'
    refresh.refresh_stored(spark, root, acc, "trends", "all", compute)
    assert len(calls) == 4


def test_each_batch_of_a_streamed_table_spreads_over_tasks(spark, tmp_path):
    """str_01, str_03, str_04: four batches, none read by a single task."""
    from crashgrid.plans.stream_queries import _stream
    from crashgrid.sources.star import Star
    from crashgrid.streaming.sinks import run_available

    seen = []
    rows = _stream(Star(spark, "/root/testdata/sf0.001"), "orders").select("o_orderkey")
    run_available(rows, lambda batch, _: seen.append((batch.count(), batch.rdd.getNumPartitions())), str(tmp_path / "mark"))
    assert len(seen) == 4 and sum(n for n, _ in seen) == 1500
    assert all(parts >= spark.sparkContext.defaultParallelism // 2 for _, parts in seen)
