import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "2").config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sample_graph(spark):
    """Five reports, three locations, three persons, four crime types, thirteen edges."""
    def fir(n, severity):
        return (f"FIR/2024/00{n}", "FIR", severity, None)

    vertices = [
        fir(1, "Fatal"), fir(2, "Grievous"), fir(3, "Non-Fatal"), fir(4, "Fatal"), fir(5, "Grievous"),
        ("LOC_BENZ_CIRCLE", "Location", None, "Benz Circle"), ("LOC_PNBS", "Location", None, "PNBS"),
        ("LOC_RAMAVARAPPADU", "Location", None, "Ramavarappadu"),
        ("P_001", "Person", None, None), ("P_002", "Person", None, None), ("P_003", "Person", None, None),
        *[(c, "CrimeType", None, None) for c in ("OVERSPEEDING", "DRUNKEN_DRIVING", "MECHANICAL_FAILURE", "TRAFFIC_VIOLATION")],
    ]
    links = {
        "OCCURRED_AT": [(1, "LOC_BENZ_CIRCLE"), (2, "LOC_PNBS"), (3, "LOC_RAMAVARAPPADU"), (4, "LOC_BENZ_CIRCLE"), (5, "LOC_PNBS")],
        "INVOLVES_PERSON": [(1, "P_001"), (1, "P_002"), (2, "P_003")],
        "CLASSIFIED_AS": [(1, "OVERSPEEDING"), (2, "DRUNKEN_DRIVING"), (3, "MECHANICAL_FAILURE"), (4, "TRAFFIC_VIOLATION"), (5, "OVERSPEEDING")],
    }
    edges = [(f"FIR/2024/00{n}", d, r, None, 1.0) for r, pairs in links.items() for n, d in pairs]
    from pyspark.sql import functions as F

    v = spark.createDataFrame(vertices, "id string, node_type string, severity string, area string").withColumns({
        "cause": F.lit(None).cast("string"), "city": F.lit(None).cast("string"), "lat": F.lit(None).cast("double"),
        "lng": F.lit(None).cast("double"), "confidence": F.lit(0.5), "incident_date": F.lit(None).cast("string"),
        "postgres_id": F.lit(None).cast("bigint"), "vehicle_number": F.lit(None).cast("string")})
    return v, spark.createDataFrame(edges, "src string, dst string, rel_type string, role string, weight double")
