"""Queries over the incident tables: filters, joins, aggregates, windows, sorts, sets."""

from pyspark.sql import functions as F

from crashgrid import fixed_values as fv
from crashgrid.functions import bands
from crashgrid.functions.stations import canonical_station
from crashgrid.operators import aggregates as ag
from crashgrid.operators import filters as ft
from crashgrid.operators import joins as jn
from crashgrid.operators import ranking as rk
from crashgrid.plans import check_sql as cs
from crashgrid.plans.registry import query

AL = "accidents a LEFT JOIN locations l ON l.accident_id = a.id"


@query("slice_top_causes_with_fatality",
       f"SELECT cause, count(*) AS total, {cs.FATAL} AS fatal, {cs.RATE} AS fatality_rate FROM {AL}"
       " WHERE cause IS NOT NULL AND cause <> 'Under Investigation' GROUP BY cause ORDER BY total DESC, cause LIMIT 10")
def _(t):
    base = ft.drop_placeholders(jn.acc_loc(t.acc, t.loc), "cause", fv.CAUSE_PLACEHOLDER)
    return ag.fatality_rate(base, "cause").orderBy(F.desc("total"), "cause").limit(10)


# ------------------------------------------------------------------ filters
@query("flt_01_with_coordinates",
       "SELECT accident_id, latitude, longitude FROM locations WHERE latitude IS NOT NULL AND longitude IS NOT NULL")
def _(t):
    return ft.with_coordinates(t.loc).select("accident_id", "latitude", "longitude")


_SEARCH_COLS = "id, fir_number, incident_date, cause, severity, confidence_score, created_at, address, area, city"


def _search_sql(term):
    return (
        "SELECT DISTINCT a.id, fir_number, incident_date, cause, severity, confidence_score, created_at, address, area, city"
        f" FROM {AL} LEFT JOIN vehicles vh ON vh.accident_id = a.id WHERE "
        + " OR ".join(f"{c} ILIKE '%{term}%'" for c in (
            "fir_number", "cause", "severity", "address", "area", "city", "vehicle_number", "vehicle_type"))
        + " ORDER BY created_at DESC, a.id DESC"
    )


@query("flt_02_search_keyword", _search_sql("nandi"))
def _(t):
    return ft.search(t.acc, t.loc, t.veh, " nandi ")


@query("flt_02_search_wildcard_vehicle", _search_sql("ap1_ab0%7"))
def _(t):
    return ft.search(t.acc, t.loc, t.veh, "ap1_ab0%7")


@query("flt_03_list_filter",
       "SELECT a.id, fir_number, cause, severity, address, incident_date FROM " + AL +
       " WHERE (contains(lower(coalesce(fir_number,'')), 'rash') OR contains(lower(coalesce(cause,'')), 'rash')"
       " OR contains(lower(coalesce(address,'')), 'rash')) AND severity = 'Fatal'"
       " AND incident_date >= TIMESTAMP '1996-03-01' AND incident_date <= TIMESTAMP '1997-06-30 23:59:59'")
def _(t):
    base = jn.acc_loc(t.acc, t.loc).select("id", "fir_number", "cause", "severity", "address", "incident_date")
    return ft.list_filter(base, "Rash", "Fatal", "1996-03-01", "1997-06-30")


@query("flt_04_drop_placeholders",
       "SELECT 'cause' AS kind, count(*) AS n FROM accidents WHERE cause IS NOT NULL AND cause <> 'Under Investigation'"
       " UNION ALL SELECT 'vehicle', count(*) FROM vehicles WHERE vehicle_type IS NOT NULL AND vehicle_type <> 'Unknown'"
       " UNION ALL SELECT 'age', count(*) FROM victims WHERE age IS NOT NULL")
def _(t):
    def n(df, kind):
        return df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return n(ft.drop_placeholders(t.acc, "cause", fv.CAUSE_PLACEHOLDER), "cause").unionByName(
        n(ft.drop_placeholders(t.veh, "vehicle_type", "Unknown"), "vehicle")
    ).unionByName(n(t.vic.filter("age IS NOT NULL"), "age"))


@query("flt_05_area_is",
       f"SELECT a.id, area FROM {AL} WHERE lower(trim(coalesce(area,''))) = 'patamata center'")
def _(t):
    return jn.acc_loc(t.acc.select("id"), t.loc).filter(ft.area_is(F.col("area"), " Patamata CENTER ")).select("id", "area")


@query("flt_05_unknown_area", f"SELECT a.id, area FROM {AL} WHERE area IS NULL OR trim(area) = ''")
def _(t):
    return jn.acc_loc(t.acc.select("id"), t.loc).filter(ft.area_is(F.col("area"), "Unknown Area")).select("id", "area")


@query("flt_06_match_stations",
       f"SELECT accident_id, area, coalesce(regexp_matches(area, '{ft.area_pattern(ft.stations_of('MYLAVARAM SDPO'))}'), false)"
       " AS matched FROM locations")
def _(t):
    return t.loc.select("accident_id", "area", ft.area_in(F.col("area"), ft.stations_of("MYLAVARAM SDPO")).alias("matched"))


@query("flt_07_assign_group", f"SELECT accident_id, {cs.GROUP_CASE} AS group_name FROM locations")
def _(t):
    return t.loc.select("accident_id", ft.group_of(F.col("area")).alias("group_name"))


_DIM_VALUES = ", ".join(
    f"('{g}','{z}','{s}','{ft.matching_name(s)}')"
    for g, zs in fv.STATION_TREE.items() for z, ss in zs.items() for s in ss
)


@query("flt_08_hierarchy_counts",
       "SELECT group_name, zone, station, count(area) AS records FROM"
       " (SELECT DISTINCT group_name, zone, station, match_name FROM (VALUES " + _DIM_VALUES +
       ") d(group_name, zone, station, match_name)) LEFT JOIN locations"
       " ON lower(area) = lower(match_name) GROUP BY ALL")
def _(t):
    dim = ft.station_dimension(t.spark).withColumn("k", F.lower("match_name"))
    areas = t.loc.groupBy(F.lower("area").alias("k")).agg(F.count("area").alias("n"))
    return F.broadcast(dim).join(areas, "k", "left").select(
        "group_name", "zone", "station", F.coalesce("n", F.lit(0)).alias("records"))


@query("flt_09_id_list", "SELECT id, severity FROM accidents WHERE id IN"
       " (SELECT accident_id FROM victims WHERE is_fatality AND age < 18)")
def _(t):
    ids = t.vic.filter("is_fatality AND age < 18").select(F.col("accident_id").alias("id"))
    return ft.semi(t.acc.select("id", "severity"), ids, "id")


@query("flt_10_inside_box",
       "SELECT accident_id, coalesce(latitude BETWEEN 16.25 AND 16.95 AND longitude BETWEEN 80.0 AND 80.9, false) AS inside"
       " FROM locations")
def _(t):
    return t.loc.select("accident_id", F.coalesce(
        ft.inside_box(F.col("latitude"), F.col("longitude")), F.lit(False)).alias("inside"))


@query("flt_11_placeholder_coordinates",
       "SELECT accident_id, (latitude IS NULL OR latitude = 0 OR longitude IS NULL OR longitude = 0"
       " OR (abs(latitude - 16.5) < 0.01 AND abs(longitude - 80.6) < 0.01)"
       " OR (abs(latitude - 16.5062) < 0.01 AND abs(longitude - 80.648) < 0.01)) AS is_placeholder FROM locations")
def _(t):
    return t.loc.select("accident_id", ft.placeholder_coordinates(
        F.col("latitude"), F.col("longitude")).alias("is_placeholder"))


_NOW = "TIMESTAMP '2001-08-02 01:30:00'"


@query("flt_12_recent_hour",
       f"SELECT id, created_at FROM accidents WHERE created_at > {_NOW} - INTERVAL 1 HOUR")
def _(t):
    return ft.recent(t.acc.select("id", "created_at"), "created_at", F.expr("TIMESTAMP_NTZ '2001-08-02 01:30:00'"))


_MARKER_COLS = ("id, fir_number, severity, cause, incident_date, address, area, city, police_station, lat, lng,"
                " victim_count, fatality_count, confidence_score, created_at")


@query("flt_13_markers", f"SELECT {_MARKER_COLS} FROM markers WHERE lat IS NOT NULL AND lng IS NOT NULL",
       ctes=f"{cs.STATIONS}, {cs.MARKERS}")
def _(t):
    return ag.markers(t.acc, t.loc, t.vic)


@query("flt_13_markers_all", f"SELECT {_MARKER_COLS} FROM markers", ctes=f"{cs.STATIONS}, {cs.MARKERS}")
def _(t):
    return ag.markers(t.acc, t.loc, t.vic, everything=True)


@query("flt_14_list_by_name",
       f"SELECT {cs.AREA_LABEL} AS area, count(*) AS total, {cs.RATE} AS fatality_rate FROM {AL}"
       " GROUP BY 1 HAVING contains(lower(area), 'konduru')".replace("lower(area)", f"lower({cs.AREA_LABEL})"))
def _(t):
    return ft.name_contains(ag.area_rates(t.acc, t.loc), "area", "Konduru")


@query("flt_14_markers_of_area",
       f"SELECT a.id, latitude, longitude FROM {AL} WHERE {cs.AREA_LABEL} = 'Auto Nagar'"
       " AND latitude IS NOT NULL AND longitude IS NOT NULL")
def _(t):
    base = jn.acc_loc(t.acc.select("id"), t.loc).filter(ft.area_label(F.col("area")) == "Auto Nagar")
    return ft.with_coordinates(base).select("id", "latitude", "longitude")


@query("flt_15_non_zero_stations",
       f"SELECT coalesce(station,'OTHER STATIONS') AS name, count(*) AS total, {cs.FATAL} AS fatal FROM stations GROUP BY 1",
       ctes=cs.STATIONS)
def _(t):
    return ft.non_zero(ag.station_summary(t.acc, t.loc), "total").select("name", "total", "fatal")


# ------------------------------------------------------------------ joins
@query("src_01_scan_counts",
       "SELECT 'accidents' AS t, count(*) AS n, count(DISTINCT id) AS ids FROM accidents UNION ALL"
       " SELECT 'locations', count(*), count(DISTINCT id) FROM locations UNION ALL"
       " SELECT 'victims', count(*), count(DISTINCT id) FROM victims UNION ALL"
       " SELECT 'vehicles', count(*), count(DISTINCT id) FROM vehicles")
def _(t):
    parts = [
        df.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids")).select(F.lit(n).alias("t"), "n", "ids")
        for n, df in [("accidents", t.acc), ("locations", t.loc), ("victims", t.vic), ("vehicles", t.veh)]
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("join_01_accidents_with_locations", f"SELECT a.id, fir_number, severity, area, city FROM {AL}")
def _(t):
    return jn.acc_loc(t.acc, t.loc).select("id", "fir_number", "severity", "area", "city")


@query("join_02_child_counts",
       "SELECT id, (SELECT count(*) FROM victims v WHERE v.accident_id = a.id) AS victim_count,"
       " (SELECT count(*) FROM vehicles v WHERE v.accident_id = a.id) AS vehicle_count,"
       " (SELECT count(*) FROM victims v WHERE v.accident_id = a.id AND is_fatality) AS fatality_count FROM accidents a")
def _(t):
    return jn.with_child_counts(t.acc.select("id"), t.vic, t.veh)


@query("join_03_located_accidents",
       "SELECT a.id, severity, latitude, longitude FROM accidents a JOIN locations l ON l.accident_id = a.id"
       " WHERE latitude IS NOT NULL AND longitude IS NOT NULL")
def _(t):
    return ft.with_coordinates(jn.acc_loc(t.acc, t.loc, "inner")).select("id", "severity", "latitude", "longitude")


@query("join_04_victims_of_area",
       f"SELECT {cs.AGE} AS age_group, count(*) AS count FROM victims v JOIN accidents a ON v.accident_id = a.id"
       " LEFT JOIN locations l ON l.accident_id = a.id WHERE lower(trim(coalesce(area,''))) = 'nunna village'"
       " AND age IS NOT NULL GROUP BY 1")
def _(t):
    rows = jn.child_with_area(t.vic, t.acc, t.loc).filter(ft.area_is(F.col("area"), "Nunna Village"))
    return ag.age_bands(rows)


@query("join_05_first_location",
       "SELECT accident_id, area, city FROM (SELECT *, row_number() OVER (PARTITION BY accident_id ORDER BY id) AS rn"
       " FROM locations) WHERE rn = 1")
def _(t):
    return jn.first_location(t.loc, "area", "city")


@query("join_06_search_distinct", _search_sql("economy"))
def _(t):
    return ft.search(t.acc, t.loc, t.veh, "economy")


@query("join_08_selected_profile",
       "SELECT vehicle_type, count(*) AS count FROM vehicles WHERE accident_id IN (SELECT id FROM stations"
       " WHERE station = 'Gunadala') AND vehicle_type <> 'Unknown' GROUP BY 1", ctes=cs.STATIONS)
def _(t):
    ids = t.acc.filter(canonical_station(F.col("raw_text")) == "Gunadala").select(F.col("id").alias("accident_id"))
    return ag.vehicle_dist(ft.semi(t.veh, ids, "accident_id"))


@query("join_10_area_dictionary",
       f"SELECT area, {cs.GROUP_CASE} AS group_name, count(*) AS n FROM locations WHERE area IS NOT NULL GROUP BY 1, 2")
def _(t):
    per_area = t.loc.filter("area IS NOT NULL").groupBy("area").agg(F.count("*").alias("n"))
    return per_area.select("area", ft.group_of(F.col("area")).alias("group_name"), "n")


@query("join_14_zero_filled_stations",
       f"SELECT name, count(s.id) AS total FROM {cs.ALL_STATIONS} LEFT JOIN stations s"
       " ON name = coalesce(station, 'OTHER STATIONS') GROUP BY name", ctes=cs.STATIONS)
def _(t):
    return ag.station_summary(t.acc, t.loc).select("name", "total")


# ------------------------------------------------------------------ aggregates
@query("agg_01_totals", "SELECT (SELECT count(*) FROM accidents) AS total_accidents,"
       " (SELECT count(*) FROM victims) AS total_victims")
def _(t):
    return ag.totals(t.acc, t.vic)


def _dist_sql(table, expr, label, where="true", limit=""):
    return (f"SELECT {expr} AS {label}, count(*) AS count FROM {table} WHERE {where} GROUP BY 1"
            f" ORDER BY count DESC, 1 {limit}")


DIST = {
    "causes": _dist_sql("accidents", "cause", "cause", "cause IS NOT NULL AND cause <> 'Under Investigation'"),
    "ages": _dist_sql("victims", cs.AGE, "age_group", "age IS NOT NULL"),
    "slots": _dist_sql("accidents", cs.SLOT, "time_slot", "incident_date IS NOT NULL"),
    "areas": _dist_sql("locations", "area", "area", "area IS NOT NULL", "LIMIT 10"),
    "all_areas": _dist_sql("locations", "area", "area", "area IS NOT NULL"),
    "vehicle_types": _dist_sql("vehicles", "vehicle_type", "vehicle_type",
                               "vehicle_type IS NOT NULL AND vehicle_type <> 'Unknown'"),
}


@query("agg_02_severity_distribution", _dist_sql("accidents", "severity", "severity"))
def _(t):
    return ag.severity_dist(t.acc)


@query("agg_03_hour_histogram",
       "SELECT hour(incident_date) AS hour, count(*) AS count FROM accidents WHERE incident_date IS NOT NULL GROUP BY 1")
def _(t):
    return ag.hour_hist(t.acc)


@query("agg_04_cause_distribution", DIST["causes"])
def _(t):
    return ag.cause_dist(t.acc)


@query("agg_04_top_causes", DIST["causes"] + " LIMIT 3")
def _(t):
    return ag.cause_dist(t.acc, 3)


@query("agg_05_age_bands", DIST["ages"])
def _(t):
    return ag.age_bands(t.vic)


@query("agg_06_vehicle_types", DIST["vehicle_types"])
def _(t):
    return ag.vehicle_dist(t.veh)


@query("agg_07_monthly_series",
       "SELECT strftime(incident_date, '%Y-%m') AS month, strftime(incident_date, '%b %Y') AS label, count(*) AS count"
       " FROM accidents WHERE incident_date IS NOT NULL GROUP BY 1, 2")
def _(t):
    return ag.monthly(t.acc)


@query("agg_08_mean_confidence",
       "SELECT round(avg(confidence_score), 2) AS avg_confidence FROM accidents WHERE confidence_score > 0")
def _(t):
    return ag.mean_confidence(t.acc)


@query("agg_09_peak_hour",
       "SELECT hour(incident_date) AS hour, count(*) AS count FROM accidents WHERE incident_date IS NOT NULL"
       " GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def _(t):
    return ag.peak_hour(t.acc)


@query("agg_10_fatality_rate", f"SELECT count(*) AS total, {cs.FATAL} AS fatal, {cs.RATE} AS fatality_rate FROM accidents")
def _(t):
    return ag.fatality_rate(t.acc)


@query("agg_11_time_slots", DIST["slots"])
def _(t):
    return ag.time_slots(t.acc)


@query("agg_12_top_areas", DIST["areas"])
def _(t):
    return ag.area_top(t.loc)


def _months_sql(direction):
    return ("SELECT month, count FROM (SELECT strftime(incident_date, '%b-%Y') AS month, date_trunc('month', incident_date)"
            " AS m, count(*) AS count FROM accidents WHERE incident_date IS NOT NULL GROUP BY 1, 2)"
            f" ORDER BY m {direction} LIMIT 12")


@query("agg_13_recent_months", _months_sql("DESC"))
def _(t):
    return ag.recent_months(t.acc)


@query("agg_14_first_months", _months_sql("ASC"))
def _(t):
    return ag.first_months(t.acc)


_WEEK = ("SELECT dayofweek(incident_date) AS day_num, dayname(incident_date) AS day_name, count(*) AS count"
         " FROM accidents WHERE incident_date IS NOT NULL GROUP BY 1, 2")


@query("agg_15_weekdays", _WEEK)
def _(t):
    return ag.weekday_dist(t.acc)


@query("agg_16_month_severity",
       "SELECT strftime(incident_date, '%Y-%m') AS month, severity, count(*) AS count FROM accidents"
       " WHERE incident_date IS NOT NULL AND severity IS NOT NULL GROUP BY 1, 2")
def _(t):
    return ag.month_severity(t.acc)


@query("agg_17_month_severity_pivot",
       "SELECT strftime(incident_date, '%Y-%m') AS month, " + ", ".join(
           f"count(*) FILTER (WHERE severity = '{s}') AS \"{s}\"" for s in fv.SEVERITIES)
       + " FROM accidents WHERE incident_date IS NOT NULL GROUP BY 1")
def _(t):
    return ag.month_severity_pivot(t.acc)


@query("agg_18_area_summary",
       "SELECT array_to_string(list_transform(regexp_extract_all(lower(coalesce(area, 'Unknown')),"
       " '[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+'), lambda p: concat(upper(p[1]), p[2:])), '') AS name,"
       f" count(*) AS total_accidents, {cs.FATAL} AS fatal_count,"
       " count(*) FILTER (WHERE severity = 'Grievous') AS grievous_count,"
       f" count(*) FILTER (WHERE severity = 'Non-Fatal') AS non_fatal_count FROM {AL} GROUP BY 1")
def _(t):
    return ag.area_summary(t.acc, t.loc)


@query("agg_19_group_summary",
       f"SELECT name, coalesce(total, 0) AS total, coalesce(fatal, 0) AS fatal,"
       " coalesce(round(100.0 * fatal / total, 1), 0.0) AS fatality_rate FROM " + cs.GROUP_RANK +
       f" LEFT JOIN (SELECT {cs.GROUP_CASE} AS g, count(DISTINCT a.id) AS total,"
       f" count(DISTINCT CASE WHEN severity = 'Fatal' THEN a.id END) AS fatal FROM {AL} GROUP BY 1) ON g = name")
def _(t):
    return ag.group_summary(t.acc, t.loc)


_STATION_SUMMARY = (
    "SELECT name, count(s.id) AS total, count(s.id) FILTER (WHERE severity = 'Fatal') AS fatal,"
    " coalesce(round(100.0 * count(s.id) FILTER (WHERE severity = 'Fatal') / nullif(count(s.id), 0), 1), 0.0) AS fatality_rate"
    f" FROM {cs.ALL_STATIONS} LEFT JOIN stations s ON name = coalesce(station, 'OTHER STATIONS') GROUP BY name"
)


@query("agg_20_station_summary", _STATION_SUMMARY, ctes=cs.STATIONS)
def _(t):
    return ag.station_summary(t.acc, t.loc)


@query("agg_21_station_list",
       f"SELECT name, total, fatal FROM ({_STATION_SUMMARY}) WHERE total > 0", ctes=cs.STATIONS)
def _(t):
    return ag.station_list(t.acc, t.loc)


@query("agg_22_top_label_filtered",
       "SELECT 'cause' AS kind, " + cs.top_label(f"({DIST['causes']})", "cause", fv.CAUSE_BLACKLIST) + " AS label UNION ALL "
       "SELECT 'area', " + cs.top_label(f"({DIST['all_areas']})", "area", fv.LOCATION_BLACKLIST) + " UNION ALL "
       "SELECT 'age', " + cs.top_label(f"({DIST['ages']})", "age_group", ["unknown"]))
def _(t):
    def row(kind, dist, label, words):
        return ag.top_label(dist, label, words).select(F.lit(kind).alias("kind"), "label")
    return row("cause", ag.cause_dist(t.acc), "cause", fv.CAUSE_BLACKLIST).unionByName(
        row("area", ag.area_top(t.loc, None), "area", fv.LOCATION_BLACKLIST)
    ).unionByName(row("age", ag.age_bands(t.vic), "age_group", fv.UNKNOWN_BLACKLIST))


@query("agg_23_top_label", "SELECT " + cs.top_label(f"({DIST['vehicle_types']})", "vehicle_type", None) + " AS label")
def _(t):
    return ag.top_label(ag.vehicle_dist(t.veh), "vehicle_type")


@query("agg_24_area_rates",
       f"SELECT {cs.AREA_LABEL} AS area, count(*) AS total, {cs.RATE} AS fatality_rate FROM {AL} GROUP BY 1")
def _(t):
    return ag.area_rates(t.acc, t.loc)


@query("agg_25_centroid",
       f"SELECT {cs.AREA_LABEL} AS area, round(coalesce(avg(CASE WHEN longitude IS NOT NULL THEN latitude END), 16.5062), 6) AS lat,"
       f" round(coalesce(avg(CASE WHEN latitude IS NOT NULL THEN longitude END), 80.62), 6) AS lng FROM {AL} GROUP BY 1")
def _(t):
    located = jn.acc_loc(t.acc.select("id"), t.loc).select(
        ft.area_label(F.col("area")).alias("area"), F.col("latitude").alias("lat"), F.col("longitude").alias("lng"))
    return ag.centroid(located, "area")


@query("agg_26_map_cards",
       f"SELECT count(*) AS mapped, {cs.FATAL} AS fatal, count(*) FILTER (WHERE severity = 'Grievous') AS grievous,"
       f" round(sum(confidence_score) / greatest(count(*), 1) * 100, 0) AS confidence_pct FROM {AL}"
       " WHERE latitude IS NOT NULL AND longitude IS NOT NULL")
def _(t):
    return ag.map_cards(ft.with_coordinates(jn.acc_loc(t.acc, t.loc)))


_MONTHS = "SELECT strftime(incident_date, '%Y-%m') AS month, count(*) AS count FROM accidents WHERE incident_date IS NOT NULL GROUP BY 1"
_MOM = (
    "SELECT month, count, previous, CASE WHEN previous > 0 THEN round((count - previous) * 100.0 / previous, 1) ELSE 0.0 END AS pct,"
    " CASE WHEN count > coalesce(previous, 0) THEN 'up' WHEN count < coalesce(previous, 0) THEN 'down' ELSE 'flat' END AS direction"
    f" FROM (SELECT *, lag(count) OVER (ORDER BY month) AS previous FROM ({_MONTHS}))"
)


@query("agg_27_month_over_month", _MOM)
def _(t):
    return ag.month_over_month(t.acc)


@query("win_02_previous_month", f"SELECT month, previous FROM ({_MOM})")
def _(t):
    return ag.month_over_month(t.acc).select("month", "previous")


@query("agg_28_peak_safe_day",
       f"SELECT (SELECT day_name FROM ({_WEEK}) ORDER BY count DESC, day_num LIMIT 1) AS peak_day,"
       f" (SELECT day_name FROM ({_WEEK}) ORDER BY count, day_num LIMIT 1) AS safest_day")
def _(t):
    return ag.peak_safe_day(t.acc)


@query("agg_29_share_of_total",
       f"SELECT name, total, round(100.0 * total / sum(total) OVER (), 1) AS pct FROM (SELECT {cs.GROUP_CASE} AS name,"
       f" count(*) AS total FROM {AL} GROUP BY 1)")
def _(t):
    return ag.share(ag.group_summary(t.acc, t.loc).filter("total > 0").select("name", "total"), "total")


@query("agg_30_pct_of_max",
       f"SELECT cause, count, round(100.0 * count / max(count) OVER (), 1) AS pct FROM ({DIST['causes']})")
def _(t):
    return ag.pct_of_max(ag.cause_dist(t.acc), "count")


@query("agg_31_digest_latest",
       "SELECT string_agg(line, chr(10) ORDER BY incident_date DESC NULLS FIRST, id DESC) AS text FROM (SELECT a.id, incident_date, "
       + cs.digest_line("area", "1/1/1970") + f" AS line FROM {AL} ORDER BY incident_date DESC NULLS FIRST, a.id DESC LIMIT 50)")
def _(t):
    return ag.digest(t.acc, t.loc, 50)


@query("agg_31_digest_by_area",
       "SELECT area_key, string_agg(line, chr(10) ORDER BY incident_date DESC NULLS LAST, id DESC) AS text FROM (SELECT"
       " coalesce(nullif(lower(trim(coalesce(area,''))), ''), 'unknown area') AS area_key, a.id, incident_date, "
       + cs.digest_line("address", "Unknown date") +
       " AS line, row_number() OVER (PARTITION BY coalesce(nullif(lower(trim(coalesce(area,''))), ''), 'unknown area')"
       f" ORDER BY incident_date DESC NULLS LAST, a.id DESC) AS rn FROM {AL}) WHERE rn <= 30 GROUP BY 1")
def _(t):
    base = jn.acc_loc(t.acc, t.loc).withColumn("area_key", ft.area_key(F.col("area")))
    return ag.digest_by(base, "area_key", 30)


@query("agg_32_high_water_mark", "SELECT max(id) AS max_id FROM accidents")
def _(t):
    return ag.high_water_mark(t.acc)


@query("agg_38_distinct_counts",
       "SELECT area, count(DISTINCT v.accident_id) AS records, count(DISTINCT CASE WHEN is_fatality THEN v.accident_id END) AS fatal"
       " FROM victims v JOIN accidents a ON a.id = v.accident_id LEFT JOIN locations l ON l.accident_id = v.accident_id GROUP BY 1")
def _(t):
    rows = jn.child_with_area(t.vic, t.acc, t.loc)
    return rows.groupBy("area").agg(
        F.count_distinct("accident_id").alias("records"),
        F.count_distinct(F.when(F.col("is_fatality"), F.col("accident_id"))).alias("fatal"))


@query("agg_39_load_gauge",
       f"SELECT least(95.0::DOUBLE, 5.5::DOUBLE + count(*) * 4.2::DOUBLE) AS load FROM accidents WHERE created_at > {_NOW} - INTERVAL 1 HOUR")
def _(t):
    now = F.expr("TIMESTAMP_NTZ '2001-08-02 01:30:00'")
    return ag.load_gauge(ft.recent(t.acc.select("created_at"), "created_at", now))


# ------------------------------------------------------------------ windows, sorts, sets
@query("win_01_area_density",
       "SELECT a.id, latitude, longitude, severity, count(*) OVER (PARTITION BY area) AS area_accident_count,"
       " CASE severity WHEN 'Fatal' THEN 1.0::DOUBLE WHEN 'Grievous' THEN 0.7::DOUBLE WHEN 'Non-Fatal' THEN 0.4::DOUBLE ELSE 0.3::DOUBLE END AS intensity"
       " FROM accidents a JOIN locations l ON l.accident_id = a.id WHERE latitude IS NOT NULL AND longitude IS NOT NULL")
def _(t):
    return ag.area_density(t.acc, t.loc)


@query("win_03_ratio_to_total",
       f"SELECT severity, count, round(100.0 * count / sum(count) OVER (), 1) AS pct FROM ({_dist_sql('accidents', 'severity', 'severity')})")
def _(t):
    return ag.share(ag.severity_dist(t.acc), "count")


@query("win_04_first_seen",
       "SELECT vehicle_number, accident_id, id FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_number ORDER BY accident_id, id)"
       " AS rn FROM vehicles) WHERE rn = 1")
def _(t):
    return rk.keep_first(t.veh.select("vehicle_number", "accident_id", "id"), "vehicle_number", "accident_id", "id")


@query("win_05_first_victim",
       "SELECT accident_id, id, age FROM (SELECT *, row_number() OVER (PARTITION BY accident_id ORDER BY id) AS rn FROM victims) WHERE rn = 1")
def _(t):
    return rk.keep_first(t.vic.select("accident_id", "id", "age"), "accident_id", "id", "age")


@query("win_06_last_write_wins",
       "SELECT vehicle_number, accident_id, id FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_number ORDER BY id DESC)"
       " AS rn FROM vehicles) WHERE rn = 1")
def _(t):
    return rk.keep_last(t.veh.select("vehicle_number", "accident_id", "id"), "vehicle_number", "id")


@query("ord_01_newest_first", "SELECT id, created_at FROM accidents ORDER BY created_at DESC, id DESC")
def _(t):
    return rk.newest(t.acc.select("id", "created_at"))


@query("ord_02_recent_five",
       f"SELECT a.id, fir_number, severity, cause, incident_date, created_at, area, city FROM {AL}"
       " ORDER BY created_at DESC, a.id DESC LIMIT 5")
def _(t):
    return rk.recent_list(t.acc, t.loc)


def _sorted(name, sql_order, mode):
    @query(f"ord_03_sort_{name}",
           f"SELECT id, severity, incident_date FROM accidents ORDER BY {sql_order}, id")
    def _(t):
        return rk.sort_list(t.acc.select("id", "severity", "incident_date"), mode)


_MOMENT = "coalesce(incident_date, TIMESTAMP '1970-01-01' + to_milliseconds(id))"
_sorted("newest", f"{_MOMENT} DESC", "newest")
_sorted("oldest", _MOMENT, "oldest")
_sorted("severity", "CASE severity WHEN 'Fatal' THEN 0 WHEN 'Grievous' THEN 1 WHEN 'Unknown' THEN 4 ELSE 5 END", "severity")


def _summary_sort(mode, sql_order):
    @query(f"ord_04_summary_{mode.replace('-', '_')}",
           f"SELECT name, total, fatality_rate, row_number() OVER (ORDER BY {sql_order}) AS position FROM"
           f" (SELECT {cs.GROUP_CASE} AS name, count(*) AS total, {cs.RATE} AS fatality_rate FROM {AL} GROUP BY 1)")
    def _(t):
        from pyspark.sql import Window

        base = ag.group_summary(t.acc, t.loc).filter("total > 0").select("name", "total", "fatality_rate")
        orders = {"accidents-high": [F.desc("total"), "name"], "accidents-low": ["total", "name"],
                  "fatality-high": [F.desc("fatality_rate"), F.desc("total"), "name"], "alphabetical": ["name"]}
        # seven rows: the position makes the order visible to an order-blind comparison
        return rk.sort_summary(base, mode).withColumn("position", F.row_number().over(Window.orderBy(*orders[mode])).cast("long"))


_summary_sort("accidents-high", "total DESC, name")
_summary_sort("accidents-low", "total, name")
_summary_sort("fatality-high", "fatality_rate DESC, total DESC, name")
_summary_sort("alphabetical", "name")


def _nulls(kind):
    @query(f"ord_05_date_desc_nulls_{kind}",
           f"SELECT id, incident_date FROM accidents ORDER BY incident_date DESC NULLS {kind}, id DESC")
    def _(t):
        return rk.by_date_desc(t.acc.select("id", "incident_date"), kind)


_nulls("first")
_nulls("last")


@query("ord_10_display_cuts",
       f"SELECT 'slots' AS kind, time_slot AS label, count FROM (SELECT * FROM ({DIST['slots']}) LIMIT 6) UNION ALL"
       f" SELECT 'causes', cause, count FROM (SELECT * FROM ({DIST['causes']}) LIMIT 5)")
def _(t):
    a = ag.time_slots(t.acc).limit(6).select(F.lit("slots").alias("kind"), F.col("time_slot").alias("label"), "count")
    b = ag.cause_dist(t.acc).limit(5).select(F.lit("causes").alias("kind"), F.col("cause").alias("label"), "count")
    return a.unionByName(b)


@query("set_01_distinct", "SELECT DISTINCT severity, cause FROM accidents")
def _(t):
    return t.acc.select("severity", "cause").distinct()


@query("set_02_concat_first",
       "SELECT cause, min(part) AS part FROM (SELECT cause, 0 AS part FROM (SELECT cause, count(*) AS n FROM accidents"
       " WHERE severity = 'Fatal' AND cause IS NOT NULL GROUP BY 1 ORDER BY n DESC, cause LIMIT 4) UNION ALL"
       " SELECT cause, 1 FROM (SELECT cause, count(*) AS n FROM accidents WHERE severity = 'Grievous' AND cause IS NOT NULL GROUP BY 1"
       " ORDER BY n DESC, cause LIMIT 6)) GROUP BY 1")
def _(t):
    def top(severity, n, part):
        rows = t.acc.filter((F.col("severity") == severity) & F.col("cause").isNotNull())
        return ag.distribution(rows, "cause", "cause").limit(n).withColumn("part", F.lit(part))
    both = rk.concat_first(top("Fatal", 4, 0), top("Grievous", 6, 1), "cause", "count")
    return both.select("cause", "part")


@query("set_04_unmatched_areas",
       f"SELECT accident_id, area FROM locations WHERE {cs.GROUP_CASE} = 'OTHER AREAS'")
def _(t):
    return t.loc.filter(ft.group_of(F.col("area")) == fv.OTHER_AREAS).select("accident_id", "area")


@query("scl_23_weights",
       "SELECT id, CASE severity WHEN 'Fatal' THEN 3.0::DOUBLE WHEN 'Grievous' THEN 2.0::DOUBLE WHEN 'Non-Fatal' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS danger,"
       " CASE severity WHEN 'Fatal' THEN 2 WHEN 'Grievous' THEN 1 ELSE 0 END AS label FROM accidents")
def _(t):
    s = F.col("severity")
    return t.acc.select("id", bands.lookup(s, fv.DANGER_WEIGHT, 0.5).alias("danger"),
                        bands.lookup(s, fv.SEVERITY_LABEL, 0).alias("label"))


@query("scl_24_risk_levels",
       "SELECT area, score, CASE WHEN score >= 70 THEN 'Critical' WHEN score >= 40 THEN 'High' WHEN score >= 20 THEN 'Medium' ELSE 'Low' END AS risk,"
       " CASE WHEN score >= 5 THEN 'Critical' WHEN score >= 3 THEN 'High' ELSE 'Medium' END AS danger FROM"
       f" (SELECT {cs.AREA_LABEL} AS area, count(*) AS score FROM {AL} GROUP BY 1)")
def _(t):
    base = ag.area_rates(t.acc, t.loc).select("area", F.col("total").alias("score"))
    return base.select("area", "score", bands.risk_level(F.col("score")).alias("risk"), bands.danger_level(F.col("score")).alias("danger"))


@query("scl_35_date_formats",
       "SELECT id, strftime(incident_date, '%Y-%m') AS ym, strftime(incident_date, '%b %Y') AS mon_year,"
       " strftime(incident_date, '%b-%Y') AS mon_dash, dayname(incident_date) AS day FROM accidents")
def _(t):
    d = F.col("incident_date")
    return t.acc.select("id", bands.month_key(d).alias("ym"), F.date_format(d, "MMM yyyy").alias("mon_year"),
                        F.date_format(d, "MMM-yyyy").alias("mon_dash"), F.date_format(d, "EEEE").alias("day"))


@query("scl_36_percent",
       "SELECT id, coalesce(round(100.0::DOUBLE * (id % 7) / nullif(id % 9, 0), 1), 0.0::DOUBLE) AS pct FROM accidents")
def _(t):
    return t.acc.select("id", bands.percent(F.col("id") % 7, F.col("id") % 9).alias("pct"))
