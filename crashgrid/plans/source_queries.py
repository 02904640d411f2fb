"""Queries over listings, ingest and table maintenance."""

from pyspark.sql import functions as F

from crashgrid.functions import reports
from crashgrid.operators import joins as jn
from crashgrid.plans import check_sql as cs
from crashgrid.plans.registry import query
from crashgrid.plans.text_queries import FIELDS, GAZETTEER, IN_DISTRICT, REPORT_DATE, START_GUARD
from crashgrid.sources import documents as dc
from crashgrid.sources import maintenance as mt

_KEYS = "CASE WHEN o_orderkey % 2 = 0 THEN concat('fir-pdfs/in/', CAST(o_orderkey AS VARCHAR(20)), '.pdf')" \
        " ELSE concat('fir-pdfs/in/Report-', CAST(o_orderkey * 3 AS VARCHAR(20)), '.pdf') END"
_FILES = f"files AS (SELECT {_KEYS} AS key, o_orderkey AS size FROM orders)"


def _files(t):
    return t.raw("orders").select(F.expr(_KEYS).alias("key"), F.col("o_orderkey").alias("size"))


@query("src_02_record_detail",
       "SELECT a.id, fir_number, l.area AS area, s.extracted AS police_station,"
       " (SELECT count(*) FROM victims v WHERE v.accident_id = a.id) AS n_victims,"
       " (SELECT count(*) FROM vehicles v WHERE v.accident_id = a.id) AS n_vehicles"
       f" FROM accidents a LEFT JOIN locations l ON l.accident_id = a.id LEFT JOIN stations s ON s.id = a.id WHERE a.severity = 'Unknown'",
       ctes=cs.STATIONS)
def _(t):
    ids = t.acc.filter("severity = 'Unknown'").select("id")
    d = jn.record_detail(t.acc, t.loc, t.vic, t.veh, ids)
    return d.select("id", "fir_number", F.col("location.area").alias("area"), "police_station",
                    F.size("victims").cast("long").alias("n_victims"), F.size("vehicles").cast("long").alias("n_vehicles"))


@query("src_04a_unprocessed_strict",
       "SELECT key, size FROM files WHERE key NOT IN (SELECT pdf_url FROM accidents)"
       " AND string_split(key, '/')[-1] NOT IN (SELECT string_split(pdf_url, '/')[-1] FROM accidents)", ctes=_FILES)
def _(t):
    return dc.unprocessed(_files(t), t.acc)


@query("src_04b_flag_processed_loose",
       "SELECT key, size, key IN (SELECT pdf_url FROM accidents) OR EXISTS (SELECT 1 FROM accidents"
       " WHERE contains(pdf_url, string_split(key, '/')[-1])) AS already_processed FROM files", ctes=_FILES)
def _(t):
    return dc.flag_processed(_files(t), t.acc)


@query("src_04b_processed_totals",
       "SELECT count(*) AS total, count(*) FILTER (WHERE done) AS already_processed, count(*) FILTER (WHERE NOT done) AS to_process"
       " FROM (SELECT EXISTS (SELECT 1 FROM accidents WHERE contains(pdf_url, string_split(key, '/')[-1])) AS done FROM files)", ctes=_FILES)
def _(t):
    return dc.processed_totals(dc.flag_processed(_files(t), t.acc))


@query("src_05_ingest_all",
       "SELECT count(*) FILTER (WHERE NOT html) AS processed, count(*) FILTER (WHERE html) AS failed FROM ("
       " SELECT false AS html FROM accidents UNION ALL SELECT contains(lower(html), '<html') OR contains(lower(html), '<!doctype html') FROM pages)")
def _(t):
    docs = t.acc.select(F.col("pdf_url").alias("key"), F.col("raw_text").alias("text")).unionByName(
        t.raw("pages").select(F.col("url").alias("key"), F.col("html").alias("text")))
    return dc.ingest_batch_summary(dc.ingest_batch(docs)).select("processed", "failed")


@query("src_05_first_batch",
       "SELECT key, fir_number FROM (SELECT pdf_url AS key, f.fir_number FROM accidents a JOIN fields f USING (id))", ctes=FIELDS)
def _(t):
    docs = t.acc.select(F.col("pdf_url").alias("key"), F.col("raw_text").alias("text"))
    return dc.ingest_batch(dc.take_batch(docs)).select("key", "fir_number")


def _fanned(t):
    extracted = reports.extract_report(t.acc.select(F.col("id").alias("source_id"), "raw_text"), "raw_text", "source_id")
    return mt.fan_out(extracted, "source_id", {"accidents": 1000, "locations": 70, "victims": 500})


_GUARD = ("CASE WHEN regexp_matches(trim(lower(cause)), '^(?:reasons for delay in reporting|s for delay in reporting|informant|delay in reporting"
          "|complainant|ion report|first information report|p[.]s[.]|police station|date and time|landmark)') AND length(cause) < 50"
          " THEN 'Under Investigation' ELSE cause END")


@query("src_06_fan_out_accidents",
       f"SELECT 1000 + row_number() OVER (ORDER BY id) AS id, fir_number, {REPORT_DATE} AS incident_date, {_GUARD} AS cause, severity FROM fields", ctes=FIELDS)
def _(t):
    return _fanned(t)[0].select("id", "fir_number", "incident_date", "cause", "severity")


# the place stored with a report: its address unless that is a form header, and the gazetteer's point for the whole address
_STORED = ("stored AS (SELECT row_number() OVER (ORDER BY id) AS r, 'Vijayawada' AS area, 'Vijayawada' AS city,"
           f" CASE WHEN {START_GUARD} THEN 'Vijayawada' ELSE address END AS address FROM fields),"
           f" hit AS (SELECT r, glat, glng, row_number() OVER (PARTITION BY r ORDER BY length(name) DESC, pos) AS rn FROM stored JOIN {GAZETTEER}"
           " ON contains(lower(array_to_string(list_filter([address, area, city], lambda x: x <> ''), ', ')), name))")


@query("src_06_fan_out_locations",
       f"SELECT 70 + r AS id, 1000 + r AS accident_id, address, area, city, CASE WHEN {IN_DISTRICT} THEN glat END AS latitude,"
       f" CASE WHEN {IN_DISTRICT} THEN glng END AS longitude FROM stored LEFT JOIN (SELECT * FROM hit WHERE rn = 1) USING (r)", ctes=f"{FIELDS}, {_STORED}")
def _(t):
    return _fanned(t)[1].select("id", "accident_id", "address", "area", "city", "latitude", "longitude")


@query("src_06_fan_out_victims",
       "SELECT 500 + row_number() OVER (ORDER BY id, i) AS id, 1000 + r AS accident_id, TRY_CAST(ages[i] AS INT) AS age, genders[i] AS gender,"
       " severity = 'Fatal' AS is_fatality FROM (SELECT *, row_number() OVER (ORDER BY id) AS r FROM fields), unnest(range(1, n_victims + 1)) u(i)",
       ctes=FIELDS)
def _(t):
    return _fanned(t)[2].select("id", "accident_id", "age", "gender", "is_fatality")


@query("src_06_fan_out_vehicles",
       "SELECT row_number() OVER (ORDER BY id, i) AS id, 1000 + r AS accident_id, plates[i] AS vehicle_number"
       " FROM (SELECT *, row_number() OVER (ORDER BY id) AS r FROM fields), unnest(range(1, len(plates) + 1)) u(i)", ctes=FIELDS)
def _(t):
    return _fanned(t)[3].select("id", "accident_id", "vehicle_number")


_CACHE_OLD = "SELECT area AS identifier, 'area' AS analysis_type, max(a.id) AS last_accident_id FROM accidents a JOIN locations l ON l.accident_id = a.id WHERE area IS NOT NULL AND severity = 'Fatal' GROUP BY 1"
_CACHE_NEW = _CACHE_OLD.replace("severity = 'Fatal'", "severity = 'Unknown'")


@query("src_11_upsert_reports",
       f"SELECT * FROM ({_CACHE_OLD}) o WHERE NOT EXISTS (SELECT 1 FROM ({_CACHE_NEW}) n WHERE n.identifier = o.identifier)"
       f" UNION ALL SELECT * FROM ({_CACHE_NEW})")
def _(t):
    def cache(severity):
        rows = jn.acc_loc(t.acc, t.loc, "inner").filter((F.col("severity") == severity) & F.col("area").isNotNull())
        return rows.groupBy(F.col("area").alias("identifier")).agg(F.max("id").alias("last_accident_id")).withColumn("analysis_type", F.lit("area"))
    return mt.upsert(cache("Fatal"), cache("Unknown"), ["analysis_type", "identifier"])


@query("src_12_report_history", "SELECT id, created_at FROM accidents ORDER BY created_at DESC, id DESC LIMIT 20")
def _(t):
    return mt.report_history(t.acc.select("id", "created_at"))


@query("src_13_cascade_delete",
       "SELECT 'accidents' AS t, count(*) AS n FROM accidents WHERE severity <> 'Fatal' UNION ALL"
       " SELECT 'locations', count(*) FROM locations l JOIN accidents a ON a.id = l.accident_id WHERE severity <> 'Fatal' UNION ALL"
       " SELECT 'victims', count(*) FROM victims v JOIN accidents a ON a.id = v.accident_id WHERE severity <> 'Fatal' UNION ALL"
       " SELECT 'vehicles', count(*) FROM vehicles v WHERE accident_id NOT IN (SELECT id FROM accidents WHERE severity = 'Fatal')")
def _(t):
    kept = mt.cascade_delete(t.acc, t.loc, t.vic, t.veh, t.acc.filter("severity = 'Fatal'"))
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(n).alias("t"), "n")
             for n, df in zip(("accidents", "locations", "victims", "vehicles"), kept)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("src_14_fill_missing",
       "SELECT a.id, coalesce(a.cause, f.cause) AS cause, a.severity FROM accidents a JOIN fields f ON f.id = a.id", ctes=FIELDS)
def _(t):
    updates = t.acc.select("id", reports.cause_from_text(F.col("raw_text")).alias("cause"),
                           reports.severity_from_text(F.col("raw_text")).alias("severity"))
    return mt.fill_missing(t.acc.select("id", "cause", "severity"), updates, "id", ["cause", "severity"])


@query("join_07_unprocessed_both_ways",
       "SELECT count(*) AS strict_left FROM files WHERE string_split(key, '/')[-1] NOT IN (SELECT string_split(pdf_url, '/')[-1] FROM accidents)", ctes=_FILES)
def _(t):
    return dc.unprocessed(_files(t), t.acc).agg(F.count("*").alias("strict_left"))
