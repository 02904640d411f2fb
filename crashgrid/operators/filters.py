"""Row filters and flags over the incident tables."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from crashgrid import fixed_values as fv
from crashgrid.functions.bands import trimmed


def with_coordinates(df: DataFrame, everything: bool = False) -> DataFrame:
    return df if everything else df.filter("latitude IS NOT NULL AND longitude IS NOT NULL")


def inside_box(lat: Column, lng: Column, box=fv.DISTRICT_BOX) -> Column:
    south, north, west, east = box
    return lat.between(south, north) & lng.between(west, east)


def placeholder_coordinates(lat: Column, lng: Column) -> Column:
    """Missing, zero, or within tolerance of a known default point."""
    near = [
        (F.abs(lat - a) < fv.PLACEHOLDER_TOLERANCE) & (F.abs(lng - b) < fv.PLACEHOLDER_TOLERANCE)
        for a, b in fv.PLACEHOLDER_POINTS
    ]
    missing = F.coalesce(lat, F.lit(0.0)) == 0, F.coalesce(lng, F.lit(0.0)) == 0
    return reduce(lambda a, b: a | b, [*missing, *[F.coalesce(n, F.lit(False)) for n in near]])


def list_filter(df, term=None, severity=None, date_from=None, date_to=None) -> DataFrame:
    """Case-insensitive substring filter with optional severity and inclusive day range."""
    if term is not None:
        needle = term.lower()
        hit = [F.coalesce(F.lower(c).contains(needle), F.lit(False)) for c in ("fir_number", "cause", "address")]
        df = df.filter(reduce(lambda a, b: a | b, hit))
    if severity is not None:
        df = df.filter(F.col("severity") == severity)
    if date_from is not None:
        df = df.filter(F.col("incident_date") >= F.lit(date_from).cast("timestamp_ntz"))
    if date_to is not None:
        df = df.filter(F.col("incident_date") <= F.lit(f"{date_to} 23:59:59").cast("timestamp_ntz"))
    return df


def drop_placeholders(df: DataFrame, column: str, value: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull() & (F.col(column) != value))


def search(acc: DataFrame, loc: DataFrame, veh: DataFrame, term: str, limit: int | None = None) -> DataFrame:
    """Keyword search over report, location and vehicle fields, newest first; all hits unless ``limit`` is given.

    Matching vehicles are reduced to distinct accident ids before the join, so the
    vehicle fan-out never reaches the result.
    """
    needle = term.strip()
    if len(needle) < 2:
        raise ValueError("search term needs at least 2 characters")
    pattern = f"%{needle}%"

    def any_like(*columns):
        return reduce(
            lambda a, b: a | b, [F.coalesce(F.col(c).ilike(pattern), F.lit(False)) for c in columns]
        )

    vehicle_hits = (
        veh.filter(any_like("vehicle_number", "vehicle_type"))
        .select(F.col("accident_id").alias("id")).distinct().withColumn("_veh", F.lit(True))
    )
    places = loc.select(F.col("accident_id").alias("id"), "address", "area", "city")
    base = acc.select("id", "fir_number", "incident_date", "cause", "severity", "confidence_score", "created_at")
    joined = base.join(places, "id", "left").join(vehicle_hits, "id", "left")
    hits = joined.filter(
        any_like("fir_number", "cause", "severity", "address", "area", "city")
        | F.coalesce("_veh", F.lit(False))
    ).drop("_veh")
    found = hits.distinct().orderBy(F.desc("created_at"), F.desc("id"))
    return found if limit is None else found.limit(limit)


def area_is(area: Column, name: str) -> Column:
    """Area equals ``name`` ignoring case and outer blanks; the unknown area means blank or null."""
    wanted = name.strip().lower()
    if wanted == fv.UNKNOWN_AREA.lower():
        return area.isNull() | (F.trim(area) == "")
    return F.lower(F.trim(F.coalesce(area, F.lit("")))) == wanted


def area_key(area: Column) -> Column:
    """Grouping key under which :func:`area_is` holds for every area at once."""
    key = F.lower(F.trim(F.coalesce(area, F.lit(""))))
    return F.when(key == "", fv.UNKNOWN_AREA.lower()).otherwise(key)


def area_label(area: Column) -> Column:
    """Display label: trimmed area, or the unknown-area label."""
    text = trimmed(F.coalesce(area, F.lit("")))
    return F.when(text == "", fv.UNKNOWN_AREA).otherwise(text)


def matching_name(name: str) -> str:
    """Tree name without its unit suffixes."""
    for suffix in fv.STATION_SUFFIXES:
        name = re.sub(suffix, "", name)
    return name.strip()


def stations_of(name: str) -> list[str]:
    """Match names of a group, else of a zone, else the name itself."""
    if name in fv.STATION_TREE:
        found = [s for zone in fv.STATION_TREE[name].values() for s in zone]
    else:
        zones = [z[name] for z in fv.STATION_TREE.values() if name in z]
        found = zones[0] if zones else [name]
    return [matching_name(s) for s in found]


def area_pattern(names: list[str]) -> str:
    """One case-insensitive alternation; generic names must match the whole area."""
    names = list(dict.fromkeys(names))
    whole = [n for n in names if n.lower() in fv.WHOLE_AREA_NAMES]
    part = [n for n in names if n.lower() not in fv.WHOLE_AREA_NAMES]
    alternatives = [rf"^(?:{'|'.join(whole)})$"] if whole else []
    alternatives += [rf"\b(?:{'|'.join(part)})\b"] if part else []
    return "(?i)" + "|".join(alternatives)


def area_in(area: Column, names: list[str]) -> Column:
    return F.coalesce(area.rlike(area_pattern(names)), F.lit(False))


def group_of(area: Column) -> Column:
    """First group in priority order whose stations match; other areas otherwise."""
    out = F
    for group in fv.GROUP_PRIORITY:
        out = out.when(area.rlike(area_pattern(stations_of(group))), group)
    return out.otherwise(fv.OTHER_AREAS)


def station_dimension(spark) -> DataFrame:
    """The tree as rows (group_name, zone, station, match_name); a fixed small table."""
    rows = [
        (g, z, s, matching_name(s))
        for g, zones in fv.STATION_TREE.items() for z, names in zones.items() for s in names
    ]
    return spark.createDataFrame(rows, "group_name string, zone string, station string, match_name string")


def semi(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Keep rows whose key is in ``ids`` (a frame, so the list may be of any size)."""
    return df.join(ids.select(key), key, "left_semi")


def recent(df: DataFrame, ts: str, now: Column, interval: str = "INTERVAL 1 HOUR") -> DataFrame:
    return df.filter(F.col(ts) > now - F.expr(interval))


def non_zero(df: DataFrame, column: str, drop_name: str | None = None) -> DataFrame:
    out = df.filter(F.col(column) > 0)
    return out if drop_name is None else out.filter(F.col("name") != drop_name)


def name_contains(df: DataFrame, column: str, term: str) -> DataFrame:
    needle = term.strip().lower()
    return df if not needle else df.filter(F.lower(column).contains(needle))
