"""Text, date and address expressions on hand-made edge cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from crashgrid import fixed_values as fv
from crashgrid.functions import bands, codes, json_text, places, reports, stations
from crashgrid.operators import filters


def apply(spark, build, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[1] for r in df.select("i", build(F.col("x")).alias("y")).orderBy("i").collect()]


def test_severity_normalisation(spark):
    values = ["fatal", "Non-Fatal", "non-fatal", "Serious injury", "No injury", "", None, "Fatal", "MINOR", "grievous non-fatal"]
    assert apply(spark, reports.normalise_severity, values) == [
        "Fatal", "Non-Fatal", "Unknown", "Grievous", "Non-Fatal", "Unknown", "Unknown", "Fatal", "Non-Fatal", "Grievous"]


def test_report_dates(spark):
    values = ["5/3/24 7:05", "05-03-2024 07:15:30", "05-03-2024", "UNKNOWN", "garbage", None, "2024-05-12", "31-02-2024 10:00"]
    d = dt.datetime
    assert apply(spark, reports.parse_report_date, values) == [
        d(2024, 3, 5, 7, 5), d(2024, 3, 5, 7, 15), d(2024, 3, 5), None, None, None, d(2024, 5, 12), d(2024, 3, 2, 10, 0)]


def test_ages_and_plates(spark):
    assert apply(spark, reports.sanitise_age, ["25", "25 years", "about", None, "99999999999"]) == [25, 25, None, None, None]
    text = "Vehicle No: AP 16 AB 1234\nReg. No. ap16ab1234\nRegistration No - AP1"
    assert apply(spark, reports.plates_from_text, [text]) == [["AP16AB1234"]]


def test_stations(spark):
    values = ["P.S.: Gunadala\nx", "P.S.: \nFIR No: 1/2024\n", "Police Station: A. Konduru | Year 2024", "nothing here", None, "PS Machavaram, Vijayawada"]
    assert apply(spark, stations.extract_station, values) == [
        "Gunadala", None, "A. Konduru", None, None, "Machavaram, Vijayawada"]
    assert apply(spark, stations.canonical_station, values) == [
        "Gunadala", None, "A. Konduru", None, None, "Machavaram - CRIME"]


def test_every_station_rule(spark):
    names = ["cyber crime", "CCS", "Mahila UPS", "Traffic I", "Traffic II", "Traffic III", "Traffic IV", "Traffic V", "G.Konduru", "A Konduru",
             "Krishna Lanka", "1 Town", "II Town", "Vijayawada Town", "Singh Nagar", "Vatsvai", "Nowhere"]
    assert apply(spark, stations.station_from_name, names) == [
        "Cyber Crime", "CCS, Vijayawada", "Mahila UPS, Vijayawada", "Vijayawada Traffic I (T)", "Vijayawada Traffic II (T)",
        "Vijayawada Traffic III (T)", "Vijayawada Traffic IV (T)", "Vijayawada Traffic V (T)", "G. Konduru", "A. Konduru",
        "Krishnalanka - CRIME", "Vijayawada I Town - CRIME", "Vijayawada II Town - CRIME", "Vijayawada I Town - CRIME",
        "Ajith Singh Nagar", "Vatsavai", None]
    assert {s for _, s in fv.STATION_RULES} <= set(fv.STATIONS)


def test_groups(spark):
    values = ["Vijayawada", "Old Vijayawada", "Cyber Crime", "near I Town", "A Konduru mandal", None, "  ", "Machavaram"]
    got = apply(spark, filters.group_of, values)
    assert got[2:7] == ["DCP CRIMES", "DCP LAW & ORDER - 2", "MYLAVARAM SDPO", "OTHER AREAS", "OTHER AREAS"]
    assert filters.stations_of("DCP TRAFFIC")[0] == "Vijayawada Traffic I" and filters.stations_of("Nunna") == ["Nunna"]
    assert filters.stations_of("Mahila UPS") == ["Mahila UPS"]


def test_content_ids_skip_empty_parts(spark):
    import hashlib

    df = spark.createDataFrame([("F", 0, None), ("F", 1, "")], "f string, i int, n string")
    got = [r[0] for r in df.select(codes.content_id(F.col("f"), F.lit("victim"), F.col("i"), F.col("n"))).collect()]
    assert got == [hashlib.md5(x.encode()).hexdigest() for x in ("F_victim", "F_victim_1")]


def test_crime_types_and_codes(spark):
    values = ["rash and over speed", "OVERSPEEDING", "hit & run", "brakes", "", None]
    assert apply(spark, codes.crime_type, values) == ["Rash Driving", "Over Speeding", "Hit and Run", "Road Accident", "Unknown", "Unknown"]
    assert apply(spark, codes.cause_code, values) == [1, 1, 7, 0, 0, 0]


def test_temporal_defaults(spark):
    df = spark.createDataFrame([("2024-05-12 14:30",), ("2024-05-12 23:30:00",), ("",), (None,)], "s string")
    rows = [tuple(r) for r in df.select(*[c.alias(n) for n, c in codes.temporal_features(F.col("s")).items()]).collect()]
    assert rows == [(12, 0, 1, 0, 0), (23, 6, 5, 1, 1), (12, 0, 1, 0, 0), (12, 0, 1, 0, 0)]


def test_document_gates(spark):
    assert apply(spark, reports.document_gate, ["   short ", "<!DOCTYPE HTML><p>long enough", None, "FIR No: 12/2024 text"]) == [
        "EMPTY", "HTML", "EMPTY", "OK"]
    df = spark.createDataFrame([("<html> error page </html>",), ("x",)], "t string")
    rows = reports.extract_report(df, "t").orderBy("fir_number").collect()
    assert [(r["fir_number"], r["confidence_score"], r["severity"]) for r in rows] == [("INVALID_FILE", 0.0, "Unknown"), ("UNKNOWN", 0.0, "Unknown")]


def test_gazetteer_longest_name_wins(spark):
    got = apply(spark, lambda c: places.gazetteer_match(c)["name"], ["near MG Road, Ajit Singh Nagar", "NH-65 crossing", "nowhere", None, ""])
    assert got == ["ajit singh nagar", "nh-65", None, None, None]


def test_box_edges_and_placeholders(spark):
    df = spark.createDataFrame([(16.25, 80.0), (16.95, 80.9), (16.2499, 80.5), (16.5062, 80.648), (0.0, 80.5), (None, None), (16.7, 80.2)], "a double, b double")
    rows = df.select(filters.inside_box(F.col("a"), F.col("b")), filters.placeholder_coordinates(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in rows] == [True, True, False, True, False, None, True]
    assert [r[1] for r in rows] == [False, False, False, True, True, True, False]


def test_lenient_json(spark):
    values = ['{"k": 1}', '```json\n{"k": 2}\n```', 'Sure: {"k": 3} ok', "{broken", None]
    assert apply(spark, lambda c: F.try_variant_get(json_text.lenient_json(c), "$.k", "int"), values) == [1, 2, 3, None, None]


def test_initial_caps(spark):
    assert apply(spark, bands.initial_caps, ["g.konduru-road x", "OLD town", ""]) == ["G.Konduru-Road X", "Old Town", ""]


def test_percent_rounds_half_up(spark):
    df = spark.createDataFrame([(9, 400), (1, 3), (0, 0)], "a int, b int")
    assert [r[0] for r in df.select(bands.percent(F.col("a"), F.col("b"))).collect()] == [2.3, 33.3, 0.0]


@pytest.mark.parametrize("text,size,want", [("abcdef", 4, ["abcd", "ef"]), ("abcd", 4, ["abcd"]), ("", 4, [])])
def test_chunks(spark, text, size, want):
    assert apply(spark, lambda c: reports.chunks(c, size), [text]) == [want]


def test_object_keys(spark):
    values = ["https://x/fir-pdfs/1-a.pdf", "fir-pdfs/b.pdf", "/tmp/c.pdf"]
    assert apply(spark, reports.object_key, values) == ["fir-pdfs/1-a.pdf", "fir-pdfs/b.pdf", "/tmp/c.pdf"]
    assert apply(spark, reports.object_name, ["my file (1).pdf"]) == ["my_file__1_.pdf"]
