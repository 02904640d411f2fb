"""SQL fragments the check queries share (written for an independent engine)."""

from crashgrid import fixed_values as fv
from crashgrid.operators.filters import area_pattern, stations_of

AGE = (
    "CASE WHEN age >= 0 AND age <= 17 THEN '0-17' WHEN age >= 18 AND age <= 25 THEN '18-25'"
    " WHEN age >= 26 AND age <= 35 THEN '26-35' WHEN age >= 36 AND age <= 50 THEN '36-50'"
    " WHEN age > 50 THEN '50+' ELSE 'Unknown' END"
)
SLOT = (
    "CASE hour(incident_date) // 4 WHEN 0 THEN 'Late Night (00-04)' WHEN 1 THEN 'Early Morning (04-08)'"
    " WHEN 2 THEN 'Morning Peak (08-12)' WHEN 3 THEN 'Afternoon (12-16)' WHEN 4 THEN 'Evening Peak (16-20)'"
    " ELSE 'Night (20-00)' END"
)
FATAL = "count(*) FILTER (WHERE severity = 'Fatal')"
RATE = f"coalesce(round(100.0 * {FATAL} / nullif(count(*), 0), 1), 0.0)"
AREA_LABEL = (
    "CASE WHEN regexp_replace(coalesce(area,''), '^\\s+|\\s+$', '', 'g') = '' THEN 'Unknown Area'"
    " ELSE regexp_replace(area, '^\\s+|\\s+$', '', 'g') END"
)


def _clean(x: str) -> str:
    x = f"regexp_replace({x}, '\\s+', ' ', 'g')"
    x = f"regexp_replace({x}, '[|]+', ' ', 'g')"
    x = f"regexp_replace({x}, '{fv.STATION_TAIL}', '')"
    return f"regexp_replace(trim({x}), '{fv.STATION_EDGES}', '', 'g')"


def _case(subject: str, rules) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({subject}, '{p}') THEN '{s}'" for p, s in rules)


# stations(id, severity, extracted, station)
STATIONS = (
    "heads AS (SELECT id, severity, replace(raw_text, chr(13), '') AS head FROM accidents), "
    "cleaned AS (SELECT id, severity,"
    f" {_clean(f'''regexp_extract(head, '{fv.STATION_PATTERNS[0]}', 1)''')} AS c1,"
    f" {_clean(f'''regexp_extract(head, '{fv.STATION_PATTERNS[1]}', 1)''')} AS c2,"
    " list_filter(list_transform(list_filter(list_transform(string_split(head, chr(10)), lambda l: trim(l)),"
    f" lambda l: regexp_matches(l, '{fv.STATION_LINE}') AND NOT regexp_matches(l, '{fv.STATION_LINE_SKIP[0]}')"
    f" AND NOT regexp_matches(l, '{fv.STATION_LINE_SKIP[1]}')),"
    f" lambda l: {_clean(f'''regexp_replace(l, '{fv.STATION_LINE_PREFIX}', '')''')}),"
    " lambda l: length(l) >= 2) AS scanned FROM heads), "
    "extracted AS (SELECT id, severity, CASE WHEN length(c1) >= 2 THEN c1 WHEN length(c2) >= 2 THEN c2"
    " ELSE scanned[1] END AS extracted FROM cleaned), "
    "normal AS (SELECT *, trim(regexp_replace(regexp_replace(upper(coalesce(extracted, '')), '[|.,]', ' ', 'g'),"
    " '\\s+', ' ', 'g')) AS st FROM extracted), "
    f"stations AS (SELECT id, severity, extracted, {_case('st', fv.STATION_RULES)} END AS station FROM normal)"
)
ALL_STATIONS = (
    "(SELECT unnest([" + ", ".join(f"'{s}'" for s in [*fv.STATIONS, fv.OTHER_STATIONS]) + "]) AS name)"
)
GROUP_CASE = (
    "CASE " + " ".join(
        f"WHEN regexp_matches(area, '{area_pattern(stations_of(g))}') THEN '{g}'" for g in fv.GROUP_PRIORITY
    ) + " ELSE 'OTHER AREAS' END"
)
GROUP_RANK = "(SELECT unnest([" + ", ".join(f"'{g}'" for g in [*fv.GROUP_PRIORITY, fv.OTHER_AREAS]) + "]) AS name)"
MARKERS = (
    "markers AS (SELECT a.id, fir_number, a.severity, cause, incident_date, address, coalesce(area,'') AS area,"
    " coalesce(city,'') AS city, s.station AS police_station, nullif(latitude,0) AS lat, nullif(longitude,0) AS lng,"
    " (SELECT count(*) FROM victims v WHERE v.accident_id = a.id) AS victim_count,"
    " (SELECT count(*) FROM victims v WHERE v.accident_id = a.id AND is_fatality) AS fatality_count,"
    " confidence_score, created_at FROM accidents a LEFT JOIN locations l ON l.accident_id = a.id"
    " LEFT JOIN stations s ON s.id = a.id)"
)


def digest_line(place: str, missing: str) -> str:
    return (
        "'- FIR ' || coalesce(fir_number,'null') || ' (' || "
        f"coalesce(strftime(incident_date, '%-m/%-d/%Y'), '{missing}') || '): ' || coalesce(severity,'null')"
        f" || ' accident at ' || coalesce(nullif({place},''),'Unknown') || '. Cause: ' || coalesce(nullif(cause,''),'Unknown')"
    )


def top_label(table: str, label: str, blacklist) -> str:
    """Scalar subquery: first clean label by count, else the first, else Unknown."""
    if blacklist is None:
        unfit = f"{label} IS NULL"
    else:
        words = " OR ".join(f"contains(lower({label}), '{w}')" for w in blacklist)
        unfit = f"({label} IS NULL OR {label} = '' OR length({label}) > 60 OR {words})"
    return f"coalesce((SELECT {label} FROM {table} ORDER BY {unfit}, count DESC, {label} LIMIT 1), 'Unknown')"
