"""Building, merging and loading the incident graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from crashgrid import fixed_values as fv
from crashgrid.functions.bands import trimmed
from crashgrid.functions.codes import content_id, crime_type
from crashgrid.operators.ranking import keep_last
from crashgrid.session import cut

# Vertex rows that one task counts, about.
PART_ROWS = 1_000_000

VERTEX_COLUMNS = {
    "id": "string", "node_type": "string", "severity": "string", "cause": "string", "confidence": "double",
    "incident_date": "string", "postgres_id": "bigint", "area": "string", "city": "string", "lat": "double",
    "lng": "double", "name": "string", "age": "int", "gender": "string", "role": "string",
    "vehicle_type": "string", "vehicle_number": "string",
}


def _vertices(df: DataFrame, node_type: str, **columns: str) -> DataFrame:
    """Vertex rows; ``columns`` are SQL expressions, absent columns become null."""
    given = {"node_type": f"'{node_type}'", **columns}
    return df.selectExpr(*[f"CAST({given.get(n, 'NULL')} AS {t}) AS {n}" for n, t in VERTEX_COLUMNS.items()])


def _edges(df: DataFrame, src: str, dst: str, rel: str, role: str = "NULL") -> DataFrame:
    return df.selectExpr(
        f"{src} AS src", f"{dst} AS dst", f"'{rel}' AS rel_type", f"CAST({role} AS string) AS role", "1.0D AS weight")


def _union(frames) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def crime_key(cause: Column) -> Column:
    """Vertex id of a cause, null for missing and placeholder causes."""
    key = F.regexp_replace(F.upper(trimmed(cause)), " ", "_")
    return F.when((cause != "") & (cause != fv.CAUSE_PLACEHOLDER), key)


def graph_from_tables(acc: DataFrame, loc: DataFrame, vic: DataFrame, veh: DataFrame):
    """(vertices, edges) of the relational tables.

    Reports sharing a number are one vertex with the attributes of the last record;
    locations sharing a normalised area are one vertex with the attributes of the first.
    """
    base = acc.selectExpr(
        "id", "incident_date", "cause", "severity", "confidence_score",
        "coalesce(nullif(fir_number, ''), concat('FIR_', id)) AS fir_id")
    firs = _vertices(
        keep_last(base, "fir_id", "id"), "FIR", id="fir_id", severity="coalesce(severity, 'Unknown')", cause="cause",
        confidence="coalesce(confidence_score, 0)", postgres_id="id",
        incident_date="coalesce(date_format(incident_date, 'yyyy-MM-dd HH:mm:ss'), '')",
    )
    numbers = base.selectExpr("id AS accident_id", "fir_id")

    places = loc.selectExpr(
        "id", "accident_id", f"coalesce(nullif(area, ''), nullif(address, ''), '{fv.UNKNOWN_AREA}') AS label",
        "city", "latitude", "longitude",
    ).withColumn("loc_key", F.upper(trimmed(F.col("label")))).join(numbers, "accident_id")
    first = places.groupBy("loc_key").agg(
        F.min("id").alias("first_id"), F.min_by(F.struct("label", "city", "latitude", "longitude"), "id").alias("r"))
    loc_id = "concat('LOC_', first_id)"
    locations = _vertices(
        first, "Location", id=loc_id, area="r.label", city="coalesce(nullif(r.city, ''), 'Vijayawada')",
        lat="nullif(r.latitude, 0)", lng="nullif(r.longitude, 0)",
    )
    occurred = _edges(places.join(first.select("loc_key", "first_id"), "loc_key"), "fir_id", loc_id, "OCCURRED_AT")

    victims = vic.select("id", "accident_id", "victim_name", "age", "gender").join(numbers, "accident_id")
    persons = _vertices(
        victims, "Person", id="concat('P_', id)", age="age", gender="gender", role="'Victim'",
        name="coalesce(nullif(victim_name, ''), concat('Person ', id))",
    )
    vehicles = veh.select("id", "accident_id", "vehicle_type", "vehicle_number", "driver_name").join(numbers, "accident_id")
    cars = _vertices(vehicles, "Vehicle", id="concat('V_', id)", vehicle_type="vehicle_type", vehicle_number="vehicle_number")
    driven = vehicles.filter("driver_name <> '' AND driver_name <> 'Unknown'")
    drivers = _vertices(driven, "Person", id="concat('P_DRV_', id)", name="driver_name", role="'Driver'")

    classified = base.select("fir_id", crime_key(F.col("cause")).alias("crime")).filter("crime IS NOT NULL")
    crimes = _vertices(classified.select("crime").distinct(), "CrimeType", id="crime")

    vertices = _union([firs, locations, persons, cars, drivers, crimes])
    edges = _union([
        occurred,
        _edges(victims, "fir_id", "concat('P_', id)", "INVOLVES_PERSON", "'Victim'"),
        _edges(vehicles, "fir_id", "concat('V_', id)", "INVOLVES_VEHICLE"),
        _edges(driven, "fir_id", "concat('P_DRV_', id)", "INVOLVES_PERSON", "'Driver'"),
        _edges(classified, "fir_id", "crime", "CLASSIFIED_AS"),
    ])
    return vertices, edges


def graph_from_records(extracted: DataFrame, seq: str):
    """(vertices, edges) of nested extraction records with content-addressed ids.

    Nodes and edges are unique; where records repeat a key, the record with the highest
    ``seq`` decides.  Person nodes also get an INJURED_IN edge back to the report.
    """
    fir = F.coalesce(F.col("fir_number"), F.lit("UNKNOWN"))
    r = extracted.select(
        F.col(seq).alias("_seq"), fir.alias("fir_id"), "cause", "severity", "confidence_score", "date_time",
        "location", "victims", "vehicles",
    )
    firs = _vertices(
        keep_last(r.select("_seq", "fir_id", "cause", "severity", "confidence_score", "date_time"), "fir_id", "_seq"),
        "FIR", id="fir_id", severity="coalesce(severity, 'Unknown')", cause="cause",
        confidence="coalesce(confidence_score, 0)", incident_date="date_time",
    )
    located = r.filter("location IS NOT NULL").select("_seq", "fir_id", "location.*").withColumn(
        "nid", content_id(F.col("address"), F.col("area"), F.coalesce("city", F.lit("Vijayawada"))))
    locations = _vertices(
        keep_last(located.drop("fir_id"), "nid", "_seq"), "Location", id="nid", area="area",
        city="coalesce(city, 'Vijayawada')", lat="nullif(lat, 0)", lng="nullif(lng, 0)",
    )
    v = r.select("_seq", "fir_id", "severity", F.posexplode("victims").alias("_i", "v")).withColumn(
        "nid", content_id(F.col("fir_id"), F.lit("victim"), F.col("_i"), F.col("v.name"), F.col("v.age")))
    persons = _vertices(
        keep_last(v, "nid", "_seq"), "Person", id="nid", name="coalesce(v.name, 'Unknown')", age="v.age",
        gender="v.gender", role="'Victim'",
    )
    w = r.select("_seq", "fir_id", F.posexplode("vehicles").alias("_i", "w")).withColumn(
        "nid", content_id(F.col("w.number"), F.col("w.type"), F.col("fir_id"), F.col("_i")))
    cars = _vertices(
        keep_last(w, "nid", "_seq"), "Vehicle", id="nid", vehicle_number="w.number",
        vehicle_type="coalesce(w.type, 'Unknown')",
    )
    c = r.select("fir_id", crime_type(F.col("cause")).alias("nid"))
    crimes = _vertices(c.select("nid").distinct(), "CrimeType", id="nid")
    back = v.selectExpr(
        "nid AS src", "fir_id AS dst", "'INJURED_IN' AS rel_type",
        "CASE WHEN severity = 'Fatal' THEN 'fatality' END AS role", "1.0D AS weight")
    edges = _union([
        _edges(located, "fir_id", "nid", "OCCURRED_AT"),
        _edges(v, "fir_id", "nid", "INVOLVES_PERSON", "'victim'"), back,
        _edges(w, "fir_id", "nid", "INVOLVES_VEHICLE"),
        _edges(c, "fir_id", "nid", "CLASSIFIED_AS"),
    ]).groupBy("src", "rel_type", "dst").agg(F.max("role").alias("role"), F.max("weight").alias("weight"))
    return _union([firs, locations, persons, cars, crimes]), edges.select("src", "dst", "rel_type", "role", "weight")


def _one(df: DataFrame, *keys: str) -> DataFrame:
    """One row a key, that with the largest other columns (in their order)."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_row")).select(*keys, "_row.*")


def graph_upsert(vertices: DataFrame, edges: DataFrame, extracted: DataFrame, seq: str):
    """Existing graph merged with new records; new attributes overwrite old ones.

    A merged graph has one row for a vertex (of one type) and one for an edge; of rows that share
    the key in the existing graph that with the largest attributes stays.
    """
    new_v, new_e = graph_from_records(extracted, seq)
    keys = new_v.select("node_type", "id")
    edge_keys = new_e.select("src", "rel_type", "dst")
    return (
        _one(vertices.join(keys, ["node_type", "id"], "left_anti"), "node_type", "id").select(*new_v.columns).unionByName(new_v),
        _one(edges.join(edge_keys, ["src", "rel_type", "dst"], "left_anti"), "src", "rel_type", "dst").select(*new_e.columns).unionByName(new_e),
    )


def ingest_status(extracted: DataFrame) -> DataFrame:
    """Per record: created nodes and relationships, or an error for records without number."""
    victims, vehicles = F.size("victims"), F.size("vehicles")
    located = F.col("location").isNotNull().cast("int")
    good = F.coalesce("fir_number", F.lit("INVALID_FILE")) != "INVALID_FILE"
    return extracted.select(
        "fir_number", F.when(good, "success").otherwise("error").alias("status"),
        F.when(good, (F.lit(1) + located + victims + vehicles).cast("long")).alias("nodes_created"),
        F.when(good, (located + victims * 2 + vehicles + 1).cast("long")).alias("relationships_created"),
        F.when(~good, F.lit("invalid document")).alias("error"),
    )


def graph_ingest_summary(status: DataFrame) -> DataFrame:
    return status.agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "success").alias("success"),
        F.count_if(F.col("status") == "skipped").alias("skipped"), F.count_if(F.col("status") == "error").alias("errors"),
        F.coalesce(F.sum("nodes_created"), F.lit(0)).alias("total_nodes"),
        F.coalesce(F.sum("relationships_created"), F.lit(0)).alias("total_relationships"),
    )


def valid_edges(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose two end points are loaded."""
    ids = vertices.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(
        ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def subgraph(vertices, edges, persons=True, vehicles=True, locations=True, limit: int | None = None):
    """Load chosen node types; INJURED_IN is never analysed; ``limit`` bounds the reports."""
    skipped = [n for n, on in (("Person", persons), ("Vehicle", vehicles), ("Location", locations)) if not on]
    kept = vertices.filter(~F.col("node_type").isin(skipped)) if skipped else vertices
    if limit is not None:
        chosen = kept.filter("node_type = 'FIR'").orderBy("postgres_id", "id").limit(limit)
        kept = chosen.unionByName(kept.filter("node_type <> 'FIR'"))
    return kept, valid_edges(kept, edges.filter("rel_type <> 'INJURED_IN'"))


def graph_counts(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts per node label and per relationship type."""
    n = vertices.groupBy(F.col("node_type").alias("name")).agg(F.count("*").alias("count"))
    r = edges.groupBy(F.col("rel_type").alias("name")).agg(F.count("*").alias("count"))
    return n.select(F.lit("node").alias("kind"), "*").unionByName(r.select(F.lit("relationship").alias("kind"), "*")).orderBy(
        "kind", F.desc("count"), "name")


def type_counts(vertices: DataFrame) -> DataFrame:
    """Vertex rows (n) and distinct ids (ids) of each node type.

    Types and ids are written once, so that their number is known and as many tasks count them as it
    asks for: a task holds about PART_ROWS of them, however large the graph is.
    """
    keys = cut(vertices.select("node_type", "id"))
    parts = keys.count() // PART_ROWS + 1
    once = keys.repartition(parts, "node_type", "id").groupBy("node_type", "id").agg(F.count("*").alias("n"))
    return once.groupBy("node_type").agg(F.sum("n").alias("n"), F.count("id").alias("ids"))


def with_attrs(df: DataFrame, vertices: DataFrame, on: str = "node") -> DataFrame:
    """Add node_type and the non-null attributes (as JSON) of a vertex column."""
    rest = [c for c in vertices.columns if c not in ("id", "node_type")]
    attrs = vertices.select(F.col("id").alias(on), "node_type", F.to_json(F.struct(*rest)).alias("attrs"))
    return df.join(attrs, on)


def neighbours(vertices: DataFrame, edges: DataFrame, direction: str = "out") -> DataFrame:
    """Distinct successors ('out') or predecessors ('in') with their node type."""
    a, b = ("src", "dst") if direction == "out" else ("dst", "src")
    pairs = edges.select(F.col(a).alias("id"), F.col(b).alias("neighbour")).distinct()
    types = vertices.select(F.col("id").alias("neighbour"), F.col("node_type").alias("neighbour_type"))
    return pairs.join(types, "neighbour").select("id", "neighbour", "neighbour_type")


def ego_counts(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct persons and vehicles per report; person and vehicle rows that share an id count once."""
    involved = edges.filter(F.col("rel_type").isin("INVOLVES_PERSON", "INVOLVES_VEHICLE"))
    counted = involved.select(F.col("src").alias("id"), "dst", "rel_type").distinct().groupBy("id").agg(
        F.count_if(F.col("rel_type") == "INVOLVES_PERSON").alias("num_victims"),
        F.count_if(F.col("rel_type") == "INVOLVES_VEHICLE").alias("num_vehicles"))
    firs = vertices.filter("node_type = 'FIR'").select("id")
    return firs.join(counted, "id", "left").fillna(0, ["num_victims", "num_vehicles"])


def edge_sample(edges: DataFrame, n: int = 500) -> DataFrame:
    return edges.select("src", "dst", "rel_type").orderBy("src", "dst", "rel_type").limit(n)
