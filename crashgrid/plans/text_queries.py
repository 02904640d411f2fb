"""Queries over report text, document tables, addresses and JSON records."""

from pyspark.sql import functions as F

from crashgrid import fixed_values as fv
from crashgrid.functions import codes, json_text, places, reports
from crashgrid.functions.stations import canonical_station, extract_station
from crashgrid.plans import check_sql as cs
from crashgrid.plans.registry import query


def _rx(phrases) -> str:
    return "|".join(p.replace(".", "[.]").replace("&", "[&]") for p in phrases)


LONG = _rx([p for p in fv.FORM_PHRASES if len(p) > 5])
FORM = _rx(fv.FORM_PHRASES)
_WS = "'^\\s+|\\s+$', '', 'g'"


def _first(text, patterns, default):
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({text}, '{p}', 1), '')" for p in patterns) + f", '{default}')"


def _place(text):
    found = f"regexp_replace(regexp_extract({text}, '{fv.PLACE_PATTERN}', 1), {_WS})"
    return (f"coalesce(nullif(CASE WHEN NOT regexp_matches(lower({found}), '{LONG}') THEN substr({found}, 1, 200) END, ''),"
            " 'Vijayawada')")


def _cause(text):
    tries = []
    for p in fv.CAUSE_PATTERNS:
        found = f"regexp_replace(regexp_extract({text}, '{p}', 1), {_WS})"
        tries.append(f"nullif(CASE WHEN NOT regexp_matches(lower({found}), '{FORM}') THEN {found} END, '')")
    return f"coalesce({', '.join(tries)}, 'Under Investigation')"


def _severity(text):
    return (f"CASE WHEN regexp_matches({text}, '(?i){'|'.join(fv.FATAL_WORDS)}') THEN 'Fatal'"
            f" WHEN regexp_matches({text}, '(?i){'|'.join(fv.GRIEVOUS_WORDS)}') THEN 'Grievous' ELSE 'Non-Fatal' END")


_AGES = f"regexp_extract_all(raw_text, '{fv.AGE_PATTERN}', 1)"
_GENDERS = f"regexp_extract_all(raw_text, '{fv.GENDER_PATTERN}', 1)"
_PLATES = (
    f"list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(raw_text, '{fv.PLATE_PATTERN}', 1),"
    " lambda p: regexp_replace(upper(p), '\\s+', '', 'g')), lambda p: length(p) >= 6)))"
)
# fields(id, fir_number, date_time, cause, severity, address, victims, vehicles) of every report text
FIELDS = (
    f"fields AS (SELECT id, {_first('raw_text', fv.REPORT_NUMBER_PATTERNS, 'UNKNOWN')} AS fir_number,"
    f" {_first('raw_text', fv.DATE_TOKEN_PATTERNS, 'UNKNOWN')} AS date_time, {_cause('raw_text')} AS cause,"
    f" {_severity('raw_text')} AS severity, {_place('raw_text')} AS address,"
    f" greatest(len({_AGES}), len({_GENDERS})) AS n_victims, {_AGES} AS ages, {_GENDERS} AS genders,"
    f" {_PLATES} AS plates, raw_text FROM accidents)"
)


_DAY_PARTS = "list_transform(string_split(split_part(date_time,' ',1),'-'), lambda x: TRY_CAST(x AS INT))"
_TIME_PARTS = "list_transform(string_split(split_part(date_time,' ',2),':'), lambda x: coalesce(TRY_CAST(x AS INT), 0))"
REPORT_DATE = (
    f"CASE WHEN date_time <> 'UNKNOWN' THEN make_timestamp({_DAY_PARTS}[3], 1, 1, 0, 0, 0.0) + to_months({_DAY_PARTS}[2] - 1) + to_days({_DAY_PARTS}[1] - 1)"
    f" + to_hours({_TIME_PARTS}[1]) + to_minutes(coalesce({_TIME_PARTS}[2], 0)) END"
)


@query("scl_01_report_date",
       "SELECT id, date_time, make_timestamp(y, 1, 1, 0, 0, 0.0) + to_months(m - 1) + to_days(d - 1) + to_hours(h) + to_minutes(mi)"
       " AS incident_date FROM (SELECT id, date_time, CAST(split_part(split_part(date_time,' ',1),'-',3) AS INT) AS y,"
       " CAST(split_part(date_time,'-',2) AS INT) AS m, CAST(split_part(date_time,'-',1) AS INT) AS d,"
       " CAST(coalesce(nullif(split_part(split_part(date_time,' ',2),':',1),''),'0') AS INT) AS h,"
       " CAST(coalesce(nullif(split_part(split_part(date_time,' ',2),':',2),''),'0') AS INT) AS mi FROM fields)", ctes=FIELDS)
def _(t):
    base = t.acc.select("id", reports.date_token(F.col("raw_text")).alias("date_time"))
    return base.select("id", "date_time", reports.parse_report_date(F.col("date_time")).alias("incident_date"))


_MESSY = ("CASE id % 9 WHEN 0 THEN severity || ' injury' WHEN 1 THEN upper(severity) WHEN 2 THEN lower(severity)"
          " WHEN 3 THEN 'Serious ' || severity WHEN 4 THEN 'Minor' WHEN 5 THEN 'No Injury' WHEN 6 THEN NULL WHEN 7 THEN '' ELSE severity END")


@query("scl_02_normalise_severity",
       "SELECT id, CASE WHEN contains(lower(s),'fatal') AND NOT contains(lower(s),'non') THEN 'Fatal'"
       " WHEN contains(lower(s),'grievous') OR contains(lower(s),'serious') THEN 'Grievous'"
       " WHEN contains(lower(s),'simple') OR contains(lower(s),'minor') OR contains(lower(s),'non-injury') OR contains(lower(s),'no injury')"
       " THEN 'Non-Fatal' WHEN s IN ('Fatal','Grievous','Non-Fatal','Unknown') THEN s ELSE 'Unknown' END AS severity"
       f" FROM (SELECT id, {_MESSY} AS s FROM accidents)")
def _(t):
    return t.acc.select("id", F.expr(_MESSY).alias("s")).select("id", reports.normalise_severity(F.col("s")).alias("severity"))


_AGE_TEXT = ("CASE id % 5 WHEN 0 THEN CAST(age AS VARCHAR(5)) WHEN 1 THEN concat(CAST(age AS VARCHAR(5)), ' years')"
             " WHEN 2 THEN 'about' WHEN 3 THEN concat('aged ', CAST(age AS VARCHAR(5)), '-', CAST(age AS VARCHAR(5))) ELSE '' END")


@query("scl_03_sanitise_age",
       f"SELECT id, TRY_CAST(nullif(regexp_extract({_AGE_TEXT}, '[0-9]+', 0), '') AS INT) AS age FROM victims WHERE age IS NOT NULL")
def _(t):
    return t.vic.filter("age IS NOT NULL").select("id", F.expr(_AGE_TEXT).alias("x")).select(
        "id", reports.sanitise_age(F.col("x")).alias("age"))


@query("scl_04_clip_lengths",
       "SELECT doc_id, substr(text, 1, 100) AS fir_number, substr(text, 1, 200) AS area, substr(text, 1, 50) AS type,"
       " substr(text, 1, 30) AS number FROM documents")
def _(t):
    c, w = F.col("text"), reports.WIDTHS
    return t.raw("documents").select("doc_id", *[
        reports.clip(c, w[n]).alias(n) for n in ("fir_number", "area", "type", "number")])


@query("scl_05_report_number", "SELECT id, fir_number FROM fields", ctes=FIELDS)
def _(t):
    return t.acc.select("id", reports.report_number(F.col("raw_text")).alias("fir_number"))


@query("scl_06_date_token", "SELECT id, date_time FROM fields", ctes=FIELDS)
def _(t):
    return t.acc.select("id", reports.date_token(F.col("raw_text")).alias("date_time"))


@query("scl_07_place", "SELECT id, address FROM fields", ctes=FIELDS)
def _(t):
    return t.acc.select("id", reports.place(F.col("raw_text")).alias("address"))


@query("scl_08_severity_keywords", f"SELECT doc_id, {_severity('text')} AS severity FROM documents")
def _(t):
    return t.raw("documents").select("doc_id", reports.severity_from_text(F.col("text")).alias("severity"))


@query("scl_09_cause", "SELECT id, cause FROM fields", ctes=FIELDS)
def _(t):
    return t.acc.select("id", reports.cause_from_text(F.col("raw_text")).alias("cause"))


@query("scl_10_victim_list",
       "SELECT id, n_victims AS victims, list_sum(list_transform(ages, lambda a: CAST(a AS BIGINT)))::BIGINT AS age_sum,"
       " len(list_filter(genders, lambda g: g = 'Male')) AS males FROM fields", ctes=FIELDS)
def _(t):
    v = t.acc.select("id", reports.victims_from_text(F.col("raw_text")).alias("v"))
    known = F.transform(F.filter("v", lambda x: x["age"].isNotNull()), lambda x: x["age"].cast("long"))
    return v.select(
        "id", F.size("v").cast("long").alias("victims"),
        F.when(F.size(known) > 0, F.aggregate(known, F.lit(0).cast("long"), lambda a, b: a + b)).alias("age_sum"),
        F.size(F.filter("v", lambda x: x["gender"] == "Male")).cast("long").alias("males"))


@query("scl_11_vehicle_numbers", "SELECT id, plates FROM fields", ctes=FIELDS)
def _(t):
    return t.acc.select("id", reports.plates_from_text(F.col("raw_text")).alias("plates"))


@query("set_05_plate_sets", "SELECT id, len(plates) AS n, array_to_string(plates, ',') AS plates FROM fields", ctes=FIELDS)
def _(t):
    p = t.acc.select("id", reports.plates_from_text(F.col("raw_text")).alias("p"))
    return p.select("id", F.size("p").cast("long").alias("n"), F.array_join("p", ",").alias("plates"))


@query("scl_12_extract_report",
       "SELECT id, fir_number, date_time, cause, severity, address, n_victims, len(plates) AS n_vehicles,"
       " greatest(round((CAST(fir_number <> 'UNKNOWN' AS INT) + CAST(date_time <> 'UNKNOWN' AS INT) + CAST(severity <> 'Non-Fatal' AS INT)"
       " + CAST(cause <> 'Under Investigation' AS INT) + CAST(n_victims > 0 AS INT) + CAST(len(plates) > 0 AS INT)"
       " + CAST(address NOT IN ('', 'Unknown') AS INT)) / 7.0::DOUBLE, 2), 0.1::DOUBLE) AS confidence_score FROM fields", ctes=FIELDS)
def _(t):
    r = reports.extract_report(t.acc.select("id", "raw_text"), "raw_text", "id")
    return r.select("id", "fir_number", "date_time", "cause", "severity", "location.address",
                    F.size("victims").cast("long").alias("n_victims"), F.size("vehicles").cast("long").alias("n_vehicles"),
                    "confidence_score")


@query("scl_13_document_gate",
       "SELECT page_id AS id, CASE WHEN length(trim(coalesce(html,''))) < 10 THEN 'EMPTY' WHEN contains(lower(html), '<!doctype html')"
       " OR contains(lower(html), '<html') THEN 'HTML' ELSE 'OK' END AS gate FROM pages UNION ALL"
       f" SELECT doc_id, CASE WHEN length(regexp_replace(coalesce(text,''), {_WS})) < 10 THEN 'EMPTY' WHEN contains(lower(text), '<!doctype html')"
       " OR contains(lower(text), '<html') THEN 'HTML' ELSE 'OK' END FROM documents")
def _(t):
    a = t.raw("pages").select(F.col("page_id").alias("id"), reports.document_gate(F.col("html")).alias("gate"))
    b = t.raw("documents").select(F.col("doc_id").alias("id"), reports.document_gate(F.col("text")).alias("gate"))
    return a.unionByName(b)


@query("scl_13_gated_records",
       "SELECT page_id, CASE WHEN contains(lower(html), '<!doctype html') OR contains(lower(html), '<html') THEN 'INVALID_FILE'"
       " ELSE 'other' END AS fir_number, 'Unknown' AS severity, 0.0::DOUBLE AS confidence_score FROM pages")
def _(t):
    r = reports.extract_report(t.raw("pages"), "html", "page_id")
    return r.select("page_id", "fir_number", "severity", "confidence_score")


_LABELS = " + ".join(f"CAST(contains(lower(text), '{w}') AS BIGINT)" for w in fv.FORM_LABELS)


@query("scl_14_form_density",
       f"SELECT doc_id, {_LABELS} AS labels, text = '' OR (({_LABELS}) >= 3 AND length(regexp_replace(text, {_WS})) < 500) AS form_only FROM documents")
def _(t):
    c = F.col("text")
    return t.raw("documents").select("doc_id", reports.form_label_count(c).alias("labels"), reports.is_form_only(c).alias("form_only"))


_STARTS = f"trim(lower(address))"


START_GUARD = f"coalesce({_STARTS} IN ({', '.join(repr(h) for h in fv.FORM_HEADERS)}) OR (length({_STARTS}) < 50 AND regexp_matches({_STARTS}, '^(?:{_rx(fv.FORM_HEADERS)})')), false)"


@query("scl_15_boilerplate_guards",
       f"SELECT accident_id, coalesce(regexp_matches(address, '{fv.FORM_GUARD_PATTERN}'), false) AS upload,"
       f" coalesce({_STARTS} IN ({', '.join(repr(h) for h in fv.FORM_HEADERS)})"
       f" OR (length({_STARTS}) < 50 AND regexp_matches({_STARTS}, '^(?:{_rx(fv.FORM_HEADERS)})')), false) AS batch,"
       f" coalesce(regexp_matches(lower(address), '{FORM}'), false) AS extractor,"
       f" CASE WHEN regexp_matches(address, '{fv.FORM_GUARD_PATTERN}') THEN coalesce(nullif(area, ''), 'NTR District') ELSE address END AS guarded"
       " FROM locations")
def _(t):
    c = F.col("address")
    return t.loc.select(
        "accident_id", reports.has_form_phrase(c).alias("upload"), reports.starts_as_form(c).alias("batch"),
        reports.contains_form_phrase(c).alias("extractor"),
        reports.guard_address(c, F.col("area"), reports.has_form_phrase(c)).alias("guarded"))


@query("scl_16_extract_station", "SELECT id, extracted FROM stations", ctes=cs.STATIONS)
def _(t):
    return t.acc.select("id", extract_station(F.col("raw_text")).alias("extracted"))


@query("scl_18_canonical_station", "SELECT id, station FROM stations", ctes=cs.STATIONS)
def _(t):
    return t.acc.select("id", canonical_station(F.col("raw_text")).alias("station"))


@query("scl_17_normalise_station",
       "SELECT DISTINCT trim(regexp_replace(regexp_replace(upper(coalesce(area,'')), '[|.,]', ' ', 'g'), '\\s+', ' ', 'g')) AS name FROM locations")
def _(t):
    from crashgrid.functions.stations import normalise_station

    return t.loc.select("area").distinct().select(normalise_station(F.col("area")).alias("name")).distinct()


@query("scl_19_content_id",
       "SELECT id, md5(array_to_string(list_filter([fir_number, 'victim', CAST(id % 3 AS VARCHAR), cause, ''],"
       " lambda x: x IS NOT NULL AND x <> '' AND x <> '0'), '_')) AS content_id FROM accidents")
def _(t):
    return t.acc.select("id", codes.content_id(
        F.col("fir_number"), F.lit("victim"), F.col("id") % 3, F.col("cause"), F.lit("")).alias("content_id"))


def _keywords(col, rules, default, empty):
    body = " ".join(f"WHEN contains(lower({col}), '{k}') THEN {v!r}" for k, v in rules)
    return f"CASE WHEN coalesce({col}, '') = '' THEN {empty!r} {body} ELSE {default!r} END"


@query("scl_20_crime_type", f"SELECT id, {_keywords('cause', fv.CRIME_TYPES, 'Road Accident', 'Unknown')} AS crime_type FROM fields", ctes=FIELDS)
def _(t):
    c = t.acc.select("id", reports.cause_from_text(F.col("raw_text")).alias("cause"))
    return c.select("id", codes.crime_type(F.col("cause")).alias("crime_type"))


@query("scl_21_cause_code", f"SELECT id, CAST({_keywords('cause', fv.CAUSE_CODES, 0, 0)} AS BIGINT) AS cause_code FROM accidents")
def _(t):
    return t.acc.select("id", codes.cause_code(F.col("cause")).alias("cause_code"))


_DATE_TEXT = (
    "CASE CAST(id % 6 AS INT) WHEN 0 THEN strftime(incident_date, '%Y-%m-%dT%H:%M:%S') WHEN 1 THEN strftime(incident_date, '%Y-%m-%d %H:%M:%S')"
    " WHEN 2 THEN strftime(incident_date, '%Y-%m-%d') WHEN 3 THEN strftime(incident_date, '%d-%m-%Y')"
    " WHEN 4 THEN strftime(incident_date, '%d/%m/%Y') ELSE strftime(incident_date, '%Y-%m-%d %H:%M') END")


@query("scl_22_temporal_features",
       "SELECT id, CASE WHEN ok THEN h ELSE 12 END AS hour, CASE WHEN ok THEN isodow(incident_date) - 1 ELSE 0 END AS day_of_week,"
       " CASE WHEN ok THEN month(incident_date) ELSE 1 END AS month, CASE WHEN ok AND isodow(incident_date) >= 6 THEN 1 ELSE 0 END::BIGINT AS is_weekend,"
       " CASE WHEN ok AND (h < 6 OR h >= 22) THEN 1 ELSE 0 END::BIGINT AS is_night FROM (SELECT id, incident_date,"
       " incident_date IS NOT NULL AND id % 6 <> 5 AS ok, CASE WHEN id % 6 < 2 THEN hour(incident_date) ELSE 0 END AS h FROM accidents)")
def _(t):
    d = F.col("incident_date")
    layouts = ["yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yyyy", "yyyy-MM-dd HH:mm"]
    text = F
    for i, layout in enumerate(layouts):
        text = text.when(F.col("id") % 6 == i, F.date_format(d, layout))
    base = t.acc.select("id", text.alias("s"))
    return base.select("id", *[c.alias(n) for n, c in codes.temporal_features(F.col("s")).items()])


_FULL = "array_to_string(list_filter([address, area, city], lambda x: x IS NOT NULL AND x <> ''), ', ')"


@query("scl_25_full_address", f"SELECT accident_id, {_FULL} AS full_address, length({_FULL}) > 3 AS usable FROM locations")
def _(t):
    full = places.full_address(F.col("address"), F.col("area"), F.col("city"))
    return t.loc.select("accident_id", full.alias("full_address")).withColumn("usable", F.length("full_address") > 3)


_REGION = "|".join(w.replace(".", "[.]") for w in fv.REGION_WORDS)


@query("scl_26_geo_query",
       f"SELECT accident_id, CASE WHEN regexp_matches(lower(address), '{_REGION}') THEN address || ', Andhra Pradesh, India'"
       " ELSE address || ', NTR District, Andhra Pradesh, India' END AS geo_query FROM locations")
def _(t):
    return t.loc.select("accident_id", places.geo_query(F.col("address")).alias("geo_query"))


_PARTS = (
    "list_filter(list_transform(string_split(regexp_replace(address, '" + fv.ADDRESS_PREFIX + "', ''), ','), lambda p: trim(p)),"
    " lambda p: length(p) > 2 AND NOT regexp_matches(p, '" + fv.GENERIC_ADDRESS_PART + "'))"
)


@query("scl_27_simplify_address",
       f"SELECT accident_id, CASE WHEN address <> '' THEN nullif(array_to_string({_PARTS}[-2:], ', '), '') END AS simple FROM locations")
def _(t):
    return t.loc.select("accident_id", places.simplify_address(F.col("address")).alias("simple"))


GAZETTEER = "(VALUES " + ", ".join(f"('{n}', {la}::DOUBLE, {ln}::DOUBLE, {i})" for i, (n, la, ln) in enumerate(fv.GAZETTEER)) + ") g(name, glat, glng, pos)"
GAZ = (
    f"full_addr AS (SELECT *, {_FULL} AS full_address FROM locations), gaz AS (SELECT * FROM {GAZETTEER}),"
    " hits AS (SELECT accident_id, name, glat, glng, row_number() OVER (PARTITION BY accident_id ORDER BY length(name) DESC, pos) AS rn"
    " FROM full_addr JOIN gaz ON contains(lower(full_address), name)), best AS (SELECT * FROM hits WHERE rn = 1)"
)


@query("join_09_gazetteer_match",
       "SELECT f.accident_id, full_address, name AS area_match, glat AS lat, glng AS lng FROM full_addr f LEFT JOIN best b USING (accident_id)",
       ctes=GAZ)
def _(t):
    base = t.loc.select("accident_id", places.full_address(F.col("address"), F.col("area"), F.col("city")).alias("full_address"))
    return places.match_area(base, "full_address")


_MISSING = ("(latitude IS NULL OR longitude IS NULL OR latitude = 0 OR longitude = 0 OR (abs(latitude - 16.5) < 0.01 AND abs(longitude - 80.6) < 0.01)"
            " OR (abs(latitude - 16.5062) < 0.01 AND abs(longitude - 80.648) < 0.01))")
IN_DISTRICT = "glat BETWEEN 16.25 AND 16.95 AND glng BETWEEN 80.0 AND 80.9"


@query("scl_28_fill_coordinates",
       f"SELECT f.accident_id, CASE WHEN {_MISSING} AND {IN_DISTRICT} THEN glat ELSE latitude END AS latitude,"
       f" CASE WHEN {_MISSING} AND {IN_DISTRICT} THEN glng ELSE longitude END AS longitude FROM full_addr f LEFT JOIN best b USING (accident_id)",
       ctes=GAZ)
def _(t):
    return places.fill_coordinates(t.loc, replace_placeholders=True).select("accident_id", "latitude", "longitude")


@query("agg_40_geocode_summary",
       f"SELECT count(*) AS total, count(*) FILTER (WHERE {IN_DISTRICT}) AS geocoded, count(*) FILTER (WHERE NOT coalesce({IN_DISTRICT}, false)) AS failed"
       " FROM full_addr f LEFT JOIN best b USING (accident_id) WHERE (latitude IS NULL OR longitude IS NULL)"
       " AND (address IS NOT NULL OR area IS NOT NULL)", ctes=GAZ)
def _(t):
    return places.geocode_summary(places.fill_coordinates(t.loc))


@query("scl_29_object_keys",
       "SELECT id, 'fir-pdfs/' || string_split(pdf_url, '/fir-pdfs/')[2] AS object_key, string_split(pdf_url, '/')[-1] AS base_name,"
       " regexp_replace(pdf_url, '[^A-Za-z0-9._-]', '_', 'g') AS safe_name FROM accidents")
def _(t):
    u = F.col("pdf_url")
    return t.acc.select("id", reports.object_key(u).alias("object_key"), reports.base_name(u).alias("base_name"),
                        reports.object_name(u).alias("safe_name"))


@query("scl_30_chunks",
       "SELECT doc_id, pos - 1 AS pos, substr(text, CAST((pos - 1) * 4500 + 1 AS BIGINT), 4500) AS chunk FROM documents,"
       " unnest(range(1, CAST(ceil(length(text) / 4500.0) AS BIGINT) + 1)) r(pos)")
def _(t):
    pieces = t.raw("documents").select("doc_id", F.posexplode(reports.chunks(F.col("text"))).alias("pos", "chunk"))
    return pieces.withColumn("pos", F.col("pos").cast("long"))


@query("scl_31_script_share",
       "SELECT doc_id, coalesce(round(len(regexp_extract_all(text, '\\p{Telugu}')) / nullif(length(text), 0), 4), 0.0) AS telugu,"
       " coalesce(round(len(regexp_extract_all(text, '\\p{Latin}')) / nullif(length(text), 0), 4), 0.0) AS latin FROM documents")
def _(t):
    c = F.col("text")
    return t.raw("documents").select("doc_id", reports.script_share(c).alias("telugu"), reports.script_share(c, "Latin").alias("latin"))


_MODEL_TEXT = ("CASE CAST(event_id % 4 AS INT) WHEN 0 THEN props WHEN 1 THEN concat('```json', chr(10), props, chr(10), '```')"
               " WHEN 2 THEN concat('Here you are: ', props, ' done') ELSE 'no json {here' END")


@query("scl_32_lenient_json",
       "SELECT event_id, CASE WHEN event_id % 4 < 3 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events")
def _(t):
    v = json_text.lenient_json(F.expr(_MODEL_TEXT))
    return t.events.select("event_id", F.try_variant_get(v, "$.k", "long").alias("k"))


_REPORT_JSON = (
    "CASE CAST(id % 5 AS INT) WHEN 0 THEN concat('{\"summary\":\"s', CAST(id AS VARCHAR(20)), '\",\"key_insights\":[\"a\",\"b\"],\"policy_recommendations\":\"one\",\"public_awareness_suggestions\":[\"c\"]}')"
    " WHEN 1 THEN '{\"summary\":\"x\",\"key_insights\":\"k\",\"policy_recommendations\":[\"p\"],\"public_awareness_suggestions\":[\"q\",\"r\",\"t\"]}'"
    " WHEN 2 THEN '{\"summary\":\"\",\"key_insights\":[\"a\"],\"policy_recommendations\":[\"p\"],\"public_awareness_suggestions\":[\"q\"]}'"
    " WHEN 3 THEN '{\"summary\":\"y\",\"key_insights\":[\"a\"]}' ELSE 'sorry' END")


@query("scl_33_report_fields",
       "SELECT id, CASE id % 5 WHEN 0 THEN 's' || id WHEN 1 THEN 'x' WHEN 2 THEN '' WHEN 3 THEN 'y' END AS summary,"
       " CASE id % 5 WHEN 0 THEN 2 WHEN 4 THEN 0 ELSE 1 END::BIGINT AS n_insights, CASE WHEN id % 5 < 3 THEN 1 ELSE 0 END::BIGINT AS n_policy,"
       " CASE id % 5 WHEN 1 THEN 3 WHEN 0 THEN 1 WHEN 2 THEN 1 ELSE 0 END::BIGINT AS n_tips, id % 5 < 2 AS valid FROM accidents")
def _(t):
    r = json_text.report_fields(t.acc.select("id", F.expr(_REPORT_JSON).alias("j")), "j", "id")
    n = lambda c: F.coalesce(F.array_size(c), F.lit(0)).cast("long")
    return r.select("id", "summary", n("key_insights").alias("n_insights"), n("policy_recommendations").alias("n_policy"),
                    n("public_awareness_suggestions").alias("n_tips"), "valid")


@query("scl_34_overlay",
       "SELECT f.id, coalesce(CASE WHEN f.id % 4 < 2 THEN a.cause END, f.cause) AS cause, CASE WHEN f.id % 4 < 2 THEN a.severity ELSE f.severity END AS severity,"
       " f.fir_number, CASE WHEN f.id % 4 < 2 THEN 0.95::DOUBLE ELSE 0.5::DOUBLE END AS confidence_score FROM fields f JOIN accidents a ON a.id = f.id", ctes=FIELDS)
def _(t):
    base = reports.extract_report(t.acc.select("id", "raw_text"), "raw_text", "id").withColumn("confidence_score", F.lit(0.5))
    enriched = t.acc.filter("id % 4 < 2").select("id", "cause", "severity")
    return reports.overlay(base, enriched, "id").select("id", "cause", "severity", "fir_number", "confidence_score")


@query("scl_37_analysis_fields",
       "SELECT id, json_extract_string(j, '$.summary') AS summary, CAST(json_extract(j, '$.risk_score') AS DOUBLE) AS risk_score,"
       " coalesce(json_array_length(j, '$.contributing_factors'), 0)::BIGINT AS n_factors,"
       " CASE WHEN json_type(j, '$.legal_analysis') = 'VARCHAR' THEN json_extract_string(j, '$.legal_analysis') END AS legal_text,"
       " json_extract_string(j, '$.legal_analysis.applicable_sections') AS applicable_sections,"
       " json_extract_string(j, '$.legal_analysis.penalty_range') AS penalty_range"
       " FROM (SELECT id, CASE WHEN json_valid(ai_analysis) THEN CAST(ai_analysis AS JSON) END AS j FROM accidents)")
def _(t):
    r = json_text.analysis_fields(t.acc.select("id", "ai_analysis"), "ai_analysis", "id")
    return r.select("id", "summary", "risk_score", F.coalesce(F.array_size("contributing_factors"), F.lit(0)).cast("long").alias("n_factors"),
                    "legal_text", "applicable_sections", "penalty_range")
