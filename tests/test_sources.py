"""Listings, fan-out, table maintenance and joins on hand-made frames."""

import datetime as dt

from pyspark.sql import functions as F

from crashgrid.operators import aggregates as ag
from crashgrid.operators import joins, ranking
from crashgrid.sources import documents, maintenance


def test_listing_keeps_pdf_names(spark, tmp_path):
    for name in ("a.pdf", "b.PDF", "c.txt", "sub/d.Pdf"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(b"12345")
    rows = documents.list_documents(spark, str(tmp_path)).collect()
    assert sorted(r["key"].split("/")[-1] for r in rows) == ["a.pdf", "b.PDF", "d.Pdf"]
    assert {r["size"] for r in rows} == {5}


def test_strict_and_loose_matching(spark):
    files = spark.createDataFrame([("in/Report.pdf",), ("other/Final Report.pdf",), ("in/new.pdf",), ("x/UP.PDF",)], "key string")
    acc = spark.createDataFrame([("https://h/fir-pdfs/Final Report.pdf",), ("y/SCAN-UP.PDF",), (None,)], "pdf_url string")
    strict = {r["key"] for r in documents.unprocessed(files, acc).collect()}
    assert strict == {"in/Report.pdf", "in/new.pdf", "x/UP.PDF"}
    loose = {r["key"]: r["already_processed"] for r in documents.flag_processed(files, acc).collect()}
    assert loose == {"in/Report.pdf": True, "other/Final Report.pdf": True, "in/new.pdf": False, "x/UP.PDF": True}
    t = documents.processed_totals(documents.flag_processed(files, acc)).first()
    assert tuple(t) == (4, 3, 1)


def test_batch_errors_are_isolated(spark):
    docs = spark.createDataFrame([("1", "FIR No: 7/2024 some text"), ("2", "<html>bad page</html>")], "key string, text string")
    status = documents.ingest_batch(documents.take_batch(docs))
    assert tuple(documents.ingest_batch_summary(status).first()) == (1, 1)
    assert [r["key"] for r in documents.ingest_errors(status).collect()] == ["2"]
    assert documents.take_batch(docs, 1).count() == 1


SCHEMA = ("k int, fir_number string, date_time string, cause string, severity string, location struct<address:string,area:string,city:string,lat:double,lng:double>,"
          "victims array<struct<name:string,age:int,gender:string,injury:string>>, vehicles array<struct<type:string,number:string,driver_name:string>>,"
          "confidence_score double, raw_text string")


def test_fan_out(spark):
    rows = [
        (2, "F2", "UNKNOWN", "informant details", "fatal", ("p.s. x", None, None, 1.0, 1.0), [("n", 3, "Male", "i"), (None, None, None, None)], [], 0.5, "t"),
        (1, "F" * 150, "05-03-2024 10:30", "rash", "Simple", ("Near Benz Circle", "b", "", 1.0, 1.0), [("m", 9, "Female", "x" * 150)], [("Car", "AP", "d")], 0.9, "u"),
    ]
    acc, loc, vic, veh = maintenance.fan_out(spark.createDataFrame(rows, SCHEMA), "k", {"accidents": 10, "victims": 100})
    a = {r["id"]: r for r in acc.collect()}
    assert sorted(a) == [11, 12] and len(a[11]["fir_number"]) == 100 and a[11]["incident_date"] == dt.datetime(2024, 3, 5, 10, 30)
    assert (a[12]["severity"], a[12]["cause"], a[12]["incident_date"]) == ("Fatal", "Under Investigation", None)
    where = {r["accident_id"]: r for r in loc.collect()}
    assert where[12]["address"] == "NTR District" and where[12]["city"] == "NTR District" and where[12]["latitude"] is None
    assert (where[11]["latitude"], where[11]["longitude"]) == (16.4996, 80.6634)
    v = sorted(tuple(r) for r in vic.select("id", "accident_id", "age", "is_fatality", F.length("injury_severity")).collect())
    assert v == [(101, 11, 9, False, 100), (102, 12, 3, True, 1), (103, 12, None, True, None)]
    assert [tuple(r) for r in veh.select("id", "accident_id").collect()] == [(1, 11)]


def test_numbers_are_consecutive_over_many_partitions(spark):
    df = spark.range(5000).withColumn("w", (F.col("id") % 3).cast("int")).repartition(9)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    out = maintenance.number_rows(df, "id", w=F.col("w")).orderBy("id").collect()
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    total = 0
    for i, r in enumerate(out):
        assert r["_row"] == i and r["_at_w"] == total
        total += r["w"]


def test_upsert_fill_and_delete(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 9), ("c", 3)], "k string, v int")
    assert sorted(tuple(r) for r in maintenance.upsert(old, new, ["k"]).collect()) == [("a", 1), ("b", 9), ("c", 3)]
    base = spark.createDataFrame([("a", None), ("b", 2)], "k string, v int")
    assert sorted(tuple(r) for r in maintenance.fill_missing(base, old.withColumn("v", F.lit(7)), "k", ["v"]).collect()) == [("a", 7), ("b", 2)]
    acc = spark.createDataFrame([(1,), (2,)], "id long")
    child = spark.createDataFrame([(5, 1), (6, 2)], "id long, accident_id long")
    kept = maintenance.cascade_delete(acc, child, child, child, acc.filter("id = 1"))
    assert [k.count() for k in kept] == [1, 1, 1, 1]
    assert maintenance.clear(acc).count() == 0


def test_versions_and_log(spark, tmp_path):
    root = str(tmp_path / "t")
    assert maintenance.current(spark, root) is None
    maintenance.publish(spark.range(3), root)
    maintenance.publish(spark.range(5), root)
    (tmp_path / "t" / "version=9").mkdir()  # unfinished write
    assert maintenance.versions(spark, root) == [1, 2] and maintenance.current(spark, root).count() == 5
    log = str(tmp_path / "log")
    for i in range(3):
        maintenance.append_report(spark.sql(f"SELECT {i}L AS id, TIMESTAMP_NTZ '2024-01-0{i + 1} 00:00:00' AS created_at"), log)
    assert [r["id"] for r in maintenance.report_history(spark.read.parquet(log), 2).collect()] == [2, 1]


def test_two_locations_and_no_children(spark):
    acc = spark.createDataFrame([(1, "Fatal"), (2, None)], "id long, severity string")
    loc = spark.createDataFrame([(8, 1, "B"), (7, 1, "A")], "id long, accident_id long, area string").withColumns(
        {c: F.lit(None).cast("string") for c in ("address", "city")}).withColumns({c: F.lit(None).cast("double") for c in ("latitude", "longitude")})
    assert joins.acc_loc(acc, loc).count() == 3
    assert joins.first_location(loc).select("area").first()[0] == "A"
    vic = spark.createDataFrame([(1, 1, True)], "id long, accident_id long, is_fatality boolean")
    rows = joins.with_child_counts(acc, vic, vic.drop("is_fatality")).orderBy("id").collect()
    assert [tuple(r)[2:] for r in rows] == [(1, 1, 1), (0, 0, 0)]
    groups = {r["name"]: r["total"] for r in ag.group_summary(acc, loc).collect()}
    assert groups["OTHER AREAS"] == 2 and len(groups) == 7


def test_empty_tables(spark):
    acc = spark.createDataFrame([], "id long, severity string, cause string, incident_date timestamp_ntz, confidence_score double")
    assert ag.fatality_rate(acc).first()["fatality_rate"] == 0.0
    assert ag.high_water_mark(acc).first()[0] == 0
    assert ag.top_label(ag.cause_dist(acc), "cause").first()[0] == "Unknown"
    assert ag.peak_hour(acc).first()["hour"] is None


def test_ties_and_first_seen(spark):
    acc = spark.sql("""SELECT TIMESTAMP_NTZ '2024-05-12 09:00:00' AS incident_date UNION ALL SELECT TIMESTAMP_NTZ '2024-05-13 07:00:00'""")
    assert ag.peak_hour(acc).first()["hour"] == 7
    assert tuple(ag.peak_safe_day(acc).first()) == ("Sunday", "Sunday")
    df = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3)], "k string, v int")
    assert sorted(tuple(r) for r in ranking.keep_first(df, "k", "v").collect()) == [("a", 1), ("b", 3)]
    assert sorted(tuple(r) for r in ranking.keep_last(df, "k", "v").collect()) == [("a", 2), ("b", 3)]
    both = ranking.concat_first(df.filter("v = 2"), df.filter("v <> 2"), "k", "v")
    assert sorted((r["k"], r["v"]) for r in both.collect()) == [("a", 2), ("b", 3)]


def test_records_of_two_places_are_in_both(spark):
    from crashgrid.plans import profiles

    acc = spark.createDataFrame([(1,), (2,)], "id long")
    loc = spark.createDataFrame([(1, 1, "Krishnalanka"), (2, 1, "Gunadala"), (3, 1, "Gunadala"), (4, 2, None)], "id long, accident_id long, area string")
    got = [tuple(r) for r in profiles.keys_by_node(acc, loc, profiles.PLACES).collect()]
    single = lambda n: {tuple(r) for r in profiles.keys_by_node(acc, loc.filter(f"id = {n}"), profiles.PLACES).collect()}
    assert single(1) and single(2) and single(1) != single(2)
    assert len(got) == len(set(got)) and set(got) == single(1) | single(2)
