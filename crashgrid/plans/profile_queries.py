"""Queries over profiles, dashboards and report texts."""

from pyspark.sql import functions as F

from crashgrid import fixed_values as fv
from crashgrid.plans import check_sql as cs
from crashgrid.plans import profiles as pf
from crashgrid.plans import reports as rp
from crashgrid.operators.filters import area_pattern, stations_of
from crashgrid.plans.registry import query
from crashgrid.plans.incident_queries import AL, DIST

_AREA_KEY = "coalesce(nullif(lower(trim(coalesce(area,''))), ''), 'unknown area')"


def _keyed(keys: str) -> str:
    """dist(key, kind, label, count) for a CTE keys(id, key)."""
    parts = [
        ("severity", "severity", "accidents x JOIN keys k ON k.id = x.id", "severity IS NOT NULL"),
        ("cause", "cause", "accidents x JOIN keys k ON k.id = x.id", "cause <> 'Under Investigation'"),
        ("time_slot", cs.SLOT, "accidents x JOIN keys k ON k.id = x.id", "incident_date IS NOT NULL"),
        ("hour", "CAST(hour(incident_date) AS VARCHAR)", "accidents x JOIN keys k ON k.id = x.id", "incident_date IS NOT NULL"),
        ("month", "strftime(incident_date, '%Y-%m')", "accidents x JOIN keys k ON k.id = x.id", "incident_date IS NOT NULL"),
        ("age_group", cs.AGE, "victims x JOIN keys k ON k.id = x.accident_id", "age IS NOT NULL"),
        ("vehicle_type", "vehicle_type", "vehicles x JOIN keys k ON k.id = x.accident_id", "vehicle_type <> 'Unknown'"),
    ]
    body = " UNION ALL ".join(
        f"SELECT key, '{kind}' AS kind, {expr} AS label, count(*) AS count FROM {src} WHERE {where} GROUP BY ALL"
        for kind, expr, src, where in parts)
    return f"keys AS ({keys}), dist AS ({body})"


ALL = _keyed("SELECT id, 'all' AS key FROM accidents")
BY_STATION = cs.STATIONS + ", " + _keyed("SELECT id, coalesce(station, 'OTHER STATIONS') AS key FROM stations")
BY_GROUP = _keyed(f"SELECT accident_id AS id, {cs.GROUP_CASE} AS key FROM locations")
BY_AREA = _keyed(f"SELECT accident_id AS id, {_AREA_KEY} AS key FROM locations")


def _top(kind):
    return f"coalesce((SELECT label FROM dist d WHERE d.key = q.key AND kind = '{kind}' ORDER BY count DESC, label LIMIT 1), 'Unknown')"


SUMMARY = (
    "SELECT q.key, sum(count)::BIGINT AS total_accidents, coalesce(sum(count) FILTER (WHERE label = 'Fatal'), 0)::BIGINT AS fatal,"
    " coalesce(round(100.0 * sum(count) FILTER (WHERE label = 'Fatal') / sum(count), 1), 0.0) AS fatality_percentage,"
    f" {_top('cause')} AS most_common_cause, {_top('age_group')} AS high_risk_age_group, {_top('time_slot')} AS peak_time,"
    f" {_top('vehicle_type')} AS most_risky_vehicle FROM dist q WHERE kind = 'severity' GROUP BY q.key"
)
_SHOWN = (
    "SELECT key, kind, position, CASE WHEN kind = 'month' THEN strftime(CAST(label || '-01' AS DATE), '%b-%Y') ELSE label END AS label, count"
    " FROM (SELECT *, row_number() OVER (PARTITION BY key, kind ORDER BY CASE WHEN kind = 'month' THEN label END {d}, count DESC, label) AS position FROM dist)"
)
_STRICT = (
    f"SELECT 'all' AS key, count(*) AS total_accidents, {cs.FATAL} AS fatal, {cs.RATE} AS fatality_percentage, "
    + cs.top_label(f"({DIST['causes']})", "cause", fv.CAUSE_BLACKLIST) + " AS most_common_cause, "
    + cs.top_label(f"({DIST['ages']})", "age_group", ["unknown"]) + " AS high_risk_age_group, "
    + cs.top_label(f"({DIST['slots']})", "time_slot", ["unknown"]) + " AS peak_time, "
    + cs.top_label(f"({DIST['vehicle_types']})", "vehicle_type", ["unknown"]) + " AS most_risky_vehicle, "
    + cs.top_label(f"({DIST['all_areas']})", "area", fv.LOCATION_BLACKLIST) + " AS hotspot_location, "
    + "(SELECT count(*) FROM victims) AS total_victims, coalesce((SELECT string_agg(line, chr(10) ORDER BY incident_date DESC NULLS FIRST, id DESC) FROM ("
    + "SELECT a.id, incident_date, " + cs.digest_line("area", "1/1/1970") + f" AS line FROM {AL} ORDER BY incident_date DESC NULLS FIRST, a.id DESC LIMIT 50)), '')"
    + " AS accident_summaries FROM accidents"
)


@query("agg_33_global_profile", _STRICT)
def _(t):
    return pf.global_profile(t.acc, t.loc, t.vic, t.veh)


_ALL_WITH_AREAS = ALL.replace("dist AS (", "dist AS (SELECT 'all' AS key, 'area' AS kind, area AS label, count(*) AS count FROM locations WHERE area IS NOT NULL GROUP BY area UNION ALL ")


@query("agg_33_global_distributions", _SHOWN.format(d="DESC"), ctes=_ALL_WITH_AREAS)
def _(t):
    return pf.shown_rows(pf.distributions(t.acc, t.vic, t.veh, loc=t.loc), months="latest")


_NODE_KEYS = "SELECT accident_id AS id, z.name AS key FROM locations JOIN (VALUES {rows}) z(name, pattern) ON regexp_matches(area, z.pattern)"


def _node_rows(names):
    return ", ".join("('{}', '{}')".format(n.replace("'", "''"), area_pattern(stations_of(n)).replace("'", "''")) for n in names)


def _by_node(names):
    """Keys of tree nodes: an area may name several."""
    return _keyed(_NODE_KEYS.format(rows=_node_rows(names)))


def _digests(keys: str) -> str:
    """Check SQL of the latest 30 records of every key, for a CTE keys(id, key)."""
    return (f"SELECT key, string_agg(line, chr(10) ORDER BY incident_date DESC NULLS LAST, id DESC) AS accident_summaries FROM (SELECT k.key, a.id, incident_date, "
            + cs.digest_line("address", "Unknown date") + " AS line, row_number() OVER (PARTITION BY k.key ORDER BY incident_date DESC NULLS LAST, a.id DESC) AS rn"
            f" FROM {AL} JOIN ({keys}) k ON k.id = a.id) WHERE rn <= 30 GROUP BY 1")


@query("agg_34_station_digests", _digests("SELECT id, coalesce(station, 'OTHER STATIONS') AS key FROM stations"), ctes=cs.STATIONS)
def _(t):
    return pf.keyed_profiles(t.acc, t.loc, t.vic, t.veh, pf.keys_by_station(t.acc)).select("key", "accident_summaries")


@query("agg_34_group_digests", _digests(f"SELECT accident_id AS id, {cs.GROUP_CASE} AS key FROM locations"))
def _(t):
    return pf.keyed_profiles(t.acc, t.loc, t.vic, t.veh, pf.keys_by_group(t.acc, t.loc)).select("key", "accident_summaries")


@query("agg_34_zone_digests", _digests(_NODE_KEYS.format(rows=_node_rows(pf.ZONES))))
def _(t):
    return pf.keyed_profiles(t.acc, t.loc, t.vic, t.veh, pf.keys_by_node(t.acc, t.loc, pf.ZONES)).select("key", "accident_summaries")


@query("agg_34_station_profiles", SUMMARY, ctes=BY_STATION)
def _(t):
    return pf.summaries(pf.distributions(t.acc, t.vic, t.veh, pf.keys_by_station(t.acc)), strict=False)


@query("agg_34_zone_profiles", SUMMARY, ctes=_by_node(pf.ZONES))
def _(t):
    return pf.summaries(pf.distributions(t.acc, t.vic, t.veh, pf.keys_by_node(t.acc, t.loc, pf.ZONES)), strict=False)


@query("agg_34_place_profiles", SUMMARY, ctes=_by_node(pf.PLACES))
def _(t):
    return pf.summaries(pf.distributions(t.acc, t.vic, t.veh, pf.keys_by_node(t.acc, t.loc, pf.PLACES)), strict=False)


@query("agg_34_group_distributions", _SHOWN.format(d="ASC"), ctes=BY_GROUP)
def _(t):
    return pf.shown_rows(pf.distributions(t.acc, t.vic, t.veh, pf.keys_by_group(t.acc, t.loc)))


@query("agg_35_area_profiles", SUMMARY, ctes=BY_AREA)
def _(t):
    full = pf.keyed_profiles(t.acc, t.loc, t.vic, t.veh, pf.keys_by_area(t.acc, t.loc))
    return full.drop("accident_summaries")


@query("agg_35_area_distributions", _SHOWN.format(d="ASC"), ctes=BY_AREA)
def _(t):
    return pf.shown_rows(pf.distributions(t.acc, t.vic, t.veh, pf.keys_by_area(t.acc, t.loc)))


@query("agg_36_dashboard",
       f"SELECT count(*) AS total_accidents, {cs.RATE} AS fatality_rate,"
       " round(avg(confidence_score) FILTER (WHERE confidence_score > 0), 2) AS avg_confidence, (SELECT count(*) FROM victims) AS total_victims,"
       " (SELECT hour(incident_date) FROM accidents WHERE incident_date IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS peak_hour,"
       " (SELECT count(*) FROM accidents WHERE incident_date IS NOT NULL GROUP BY hour(incident_date) ORDER BY 1 DESC LIMIT 1) AS peak_count FROM accidents")
def _(t):
    return pf.dashboard(t.acc, t.vic, t.veh)


@query("agg_36_dashboard_sections",
       "SELECT kind, position, label, count FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY"
       " CASE WHEN kind IN ('month', 'hour') THEN lpad(label, 7, '0') END, count DESC, label) AS position FROM dist WHERE kind <> 'time_slot')", ctes=ALL)
def _(t):
    return pf.dashboard_sections(t.acc, t.vic, t.veh)


@query("rpt_01_global_report",
       "SELECT 'Analysis of accident data from Vijayawada Commissionerate reveals that \"' || most_common_cause || '\" is the primary cause of accidents."
       " The age group ' || high_risk_age_group || ' is most affected, with a fatality rate of ' || regexp_replace(CAST(fatality_percentage AS VARCHAR), '[.]0$', '') || '%.' AS summary,"
       " concat_ws('|', 'Peak accident time: ' || peak_time, 'Highest risk vehicle type: ' || most_risky_vehicle, 'Hotspot location: ' || hotspot_location,"
       " 'Fatality percentage: ' || regexp_replace(CAST(fatality_percentage AS VARCHAR), '[.]0$', '') || '%') AS key_insights,"
       " concat_ws('|', 'Increase patrolling during ' || peak_time, 'Deploy speed cameras near ' || hotspot_location,"
       " 'Target enforcement for ' || most_risky_vehicle || ' violations', 'Conduct regular drunk driving checkpoints') AS policy_recommendations,"
       " concat_ws('|', 'Awareness campaigns targeting ' || high_risk_age_group || ' age group', 'Road safety signage near ' || hotspot_location,"
       " 'Promote helmet and seatbelt usage through social media', 'Community workshops on defensive driving') AS public_awareness_suggestions"
       f" FROM ({_STRICT})")
def _(t):
    r = rp.global_report(pf.global_profile(t.acc, t.loc, t.vic, t.veh))
    return r.select("summary", *[F.array_join(c, "|").alias(c) for c in r.columns[1:]])


@query("rpt_02_trend_report",
       "SELECT 'Data indicates consistent accident patterns. Peak volume observed on ' || (SELECT dayname(incident_date) FROM accidents"
       " WHERE incident_date IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) || '.' AS executive_summary,"
       " 'Monthly variations follow standard traffic density patterns.' AS seasonal_analysis, 'Weekends show slightly higher incident rates.' AS day_of_week_analysis,"
       " 'Maintain standard patrolling schedules.|Monitor peak hours closey.' AS operational_recommendations")
def _(t):
    r = rp.trend_report(t.acc)
    return r.withColumn("operational_recommendations", F.array_join("operational_recommendations", "|"))


@query("rpt_03_jurisdiction_reports",
       "SELECT key, 'Analysis for ' || key || ' indicates significant accident patterns, primarily late at night or early morning. Enforcement is required on key stretch roads.' AS summary,"
       " concat_ws('|', 'The primary cause observed in this jurisdiction is ' || most_common_cause || '.', 'The most vulnerable demographic is the ' || high_risk_age_group || ' age group.',"
       " 'Accidents peak during ' || peak_time || '.') AS key_insights, concat_ws('|', 'Increase nighttime patrolling in ' || key || '.',"
       " 'Engage local community leaders for awareness programs.', 'Identify and rectify blackspots causing frequent collisions.') AS policy_recommendations"
       f" FROM ({SUMMARY})", ctes=BY_GROUP)
def _(t):
    s = pf.summaries(pf.distributions(t.acc, t.vic, t.veh, pf.keys_by_group(t.acc, t.loc)), strict=False)
    r = rp.jurisdiction_report(s)
    return r.select("key", "summary", *[F.array_join(c, "|").alias(c) for c in ("key_insights", "policy_recommendations")])


@query("src_15_report_from_json",
       "SELECT 'Analysis of accident data from Vijayawada Commissionerate reveals that \"' || label || '\" is the primary cause of accidents."
       " The age group Unknown is most affected, with a fatality rate of ' || count || '%.' AS summary FROM"
       f" (SELECT cause AS label, count FROM ({DIST['causes']}))")
def _(t):
    from crashgrid.operators.aggregates import cause_dist

    stats = cause_dist(t.acc).select(F.to_json(F.struct(
        F.col("cause").alias("most_common_cause"), F.col("count").cast("double").alias("fatality_percentage"))).alias("j"))
    return rp.report_from_json(stats, "j").select("summary")
