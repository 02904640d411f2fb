"""Incident profiles: every distribution of every key from one pass per table.

A profile key is 'all', a station, a jurisdiction group or an area.  Each record is
expanded to one small row per distribution kind and counted by (key, kind, label);
the counts are combined map-side, so the shuffle carries aggregated rows only and a
key that owns most records costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from crashgrid import fixed_values as fv
from crashgrid.functions.bands import age_band, month_key, percent, time_slot
from crashgrid.functions.stations import canonical_station
from crashgrid.operators.aggregates import digest_by
from crashgrid.operators.filters import area_in, area_key, group_of, matching_name, stations_of
from crashgrid.operators.joins import first_location
from crashgrid.sources.maintenance import number_rows

def keys_all(acc: DataFrame) -> DataFrame:
    return acc.select("id", F.lit("all").alias("key"))


def keys_by_station(acc: DataFrame) -> DataFrame:
    name = F.coalesce(canonical_station(F.col("raw_text")), F.lit(fv.OTHER_STATIONS))
    return acc.select("id", name.alias("key"))


def keys_by_group(acc: DataFrame, loc: DataFrame) -> DataFrame:
    place = first_location(loc, "area").select(F.col("accident_id").alias("id"), "area")
    return acc.select("id").join(place, "id", "left").select("id", group_of(F.col("area")).alias("key"))


def keys_by_area(acc: DataFrame, loc: DataFrame) -> DataFrame:
    place = loc.select(F.col("accident_id").alias("id"), "area")
    return acc.select("id").join(place, "id", "left").select("id", area_key(F.col("area")).alias("key"))


# tree nodes below the groups, by the names that profiles are asked for
ZONES = list(dict.fromkeys(z for zones in fv.STATION_TREE.values() for z in zones))
PLACES = list(dict.fromkeys(matching_name(s) for zones in fv.STATION_TREE.values() for names in zones.values() for s in names))


def keys_by_node(acc: DataFrame, loc: DataFrame, names: list[str]) -> DataFrame:
    """(id, key) for every zone or place whose stations the record's area names; it may name several.

    All locations of a record count; a key holds a record once.  The patterns run once for each
    distinct area.
    """
    place = loc.select(F.col("accident_id").alias("id"), "area").distinct()
    hits = F.array_compact(F.array(*[F.when(area_in(F.col("area"), stations_of(n)), F.lit(n)) for n in names]))
    nodes = place.select("area").distinct().select("area", F.explode(hits).alias("key"))
    return acc.select("id").join(place.join(nodes, "area"), "id").select("id", "key").distinct()


def _known(c: str, placeholder: str) -> Column:
    return F.when(F.col(c) != placeholder, F.col(c))


def _count(df: DataFrame, kinds: dict[str, Column]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), c.cast("string").alias("label")) for k, c in kinds.items()])
    rows = df.select("key", F.explode(pairs).alias("p")).select("key", "p.*").filter("label IS NOT NULL")
    return rows.groupBy("key", "kind", "label").agg(F.count("*").alias("count"))


def distributions(acc: DataFrame, vic: DataFrame, veh: DataFrame, keys: DataFrame | None = None, loc: DataFrame | None = None) -> DataFrame:
    """(key, kind, label, count) for severity, cause, time_slot, hour, month, age_group, vehicle_type.

    With ``loc`` also for area, one count a location.  Without ``keys`` everything falls under 'all' and
    no join is needed.
    """
    def keyed(df, on):
        if keys is None:
            return df.withColumn("key", F.lit("all"))
        return df.join(keys.withColumnRenamed("id", on), on)

    date = F.col("incident_date")
    dated = lambda c: F.when(date.isNotNull(), c)
    from_acc = _count(keyed(acc.select("id", "severity", "cause", "incident_date"), "id"), {
        "severity": F.col("severity"), "cause": _known("cause", fv.CAUSE_PLACEHOLDER),
        "time_slot": dated(time_slot(date)), "hour": F.hour(date), "month": month_key(date),
    })
    from_vic = _count(keyed(vic.select("accident_id", "age"), "accident_id"), {
        "age_group": F.when(F.col("age").isNotNull(), age_band(F.col("age")))})
    from_veh = _count(keyed(veh.select("accident_id", "vehicle_type"), "accident_id"), {
        "vehicle_type": _known("vehicle_type", "Unknown")})
    found = from_acc.unionByName(from_vic).unionByName(from_veh)
    if loc is None:
        return found
    return found.unionByName(_count(keyed(loc.select("accident_id", "area"), "accident_id"), {"area": F.col("area")}))


def _ranked(dist: DataFrame, by: list[str], time_key: Column) -> DataFrame:
    """``position`` of each row within its kind: by time key (null for untimed kinds), falling count and label.

    Rows are numbered by one range sort, and a kind's first number is taken off, so a kind with very
    many labels is spread over tasks like any other.
    """
    keyed = dist.withColumns({"_time": time_key, "_most": -F.col("count")})
    rows = number_rows(keyed, *by, "kind", "_time", "_most", "label")
    firsts = rows.groupBy(*by, "kind").agg(F.min("_row").alias("_first"))
    joined = rows.join(firsts, [*by, "kind"])
    return joined.withColumn("position", F.col("_row") - F.col("_first") + 1).drop("_time", "_most", "_row", "_first")


def shown_rows(dist: DataFrame, months: str = "first") -> DataFrame:
    """All rows of every distribution with their position; months oldest first or latest first."""
    month = F.when(F.col("kind") == "month", F.replace("label", F.lit("-"), F.lit("")).cast("int"))
    label = F.when(
        F.col("kind") == "month", F.date_format(F.to_date(F.concat("label", F.lit("-01"))), "MMM-yyyy")
    ).otherwise(F.col("label"))
    ranked = _ranked(dist, ["key"], month if months == "first" else -month)
    return ranked.select("key", "kind", "position", label.alias("label"), "count")


def _top(kind: str, blacklist) -> Column:
    text = F.lower("label")
    unfit = F.lit(False)
    if blacklist is not None:
        unfit = F.length("label") > 60
        for word in blacklist:
            unfit = unfit | text.contains(word)
    order = F.struct(F.when(F.col("kind") == kind, unfit).alias("u"), (-F.col("count")).alias("n"), F.col("label"))
    return F.coalesce(
        F.min_by(F.when(F.col("kind") == kind, F.col("label")), F.when(F.col("kind") == kind, order)), F.lit("Unknown")
    )


def summaries(dist: DataFrame, strict: bool = True) -> DataFrame:
    """One row per key: totals, fatality and the top label of each kind.

    ``strict`` skips labels with disqualifying words (global report); station and area
    reports take the plain first label.
    """
    sev = F.col("kind") == "severity"
    total = F.coalesce(F.sum(F.when(sev, F.col("count"))), F.lit(0))
    fatal = F.coalesce(F.sum(F.when(sev & (F.col("label") == "Fatal"), F.col("count"))), F.lit(0))
    words = fv.UNKNOWN_BLACKLIST if strict else None
    return dist.groupBy("key").agg(
        total.alias("total_accidents"), fatal.alias("fatal"), percent(fatal, total).alias("fatality_percentage"),
        _top("cause", fv.CAUSE_BLACKLIST if strict else None).alias("most_common_cause"),
        _top("age_group", words).alias("high_risk_age_group"),
        _top("time_slot", words).alias("peak_time"),
        _top("vehicle_type", words).alias("most_risky_vehicle"),
    )


def global_profile(acc, loc, vic, veh) -> DataFrame:
    """The global summary row with its hotspot area, victims and the digest of the latest 50 records.

    Its distributions are ``distributions`` with ``loc``.
    """
    from crashgrid.operators.aggregates import area_top, digest, top_label

    hotspot = top_label(area_top(loc, None), "area", fv.LOCATION_BLACKLIST).withColumnRenamed("label", "hotspot_location")
    victims = vic.agg(F.count("*").alias("total_victims"))
    text = digest(acc, loc).agg(F.coalesce(F.max("text"), F.lit("")).alias("accident_summaries"))
    return summaries(distributions(acc, vic, veh)).crossJoin(hotspot).crossJoin(victims).crossJoin(text)  # single rows


def keyed_profiles(acc, loc, vic, veh, keys: DataFrame, lines: int = 30) -> DataFrame:
    """Summary and narrative digest of every key at once."""
    base = acc.join(keys, "id").join(
        first_location(loc, "address").select(F.col("accident_id").alias("id"), "address"), "id", "left")
    text = digest_by(base, "key", lines).withColumnRenamed("text", "accident_summaries")
    return summaries(distributions(acc, vic, veh, keys), strict=False).join(text, "key", "left")


def dashboard(acc: DataFrame, vic: DataFrame, veh: DataFrame) -> DataFrame:
    """Headline numbers of the dashboard, one row."""
    scalars = acc.agg(
        F.count("*").alias("total_accidents"),
        percent(F.count_if(F.col("severity") == "Fatal"), F.count("*")).alias("fatality_rate"),
        F.coalesce(F.round(F.avg(F.when(F.col("confidence_score") > 0, F.col("confidence_score"))), 2), F.lit(0.0))
        .alias("avg_confidence"),
    )
    victims = vic.agg(F.count("*").alias("total_victims"))
    from crashgrid.operators.aggregates import peak_hour

    peak = peak_hour(acc).select(F.col("hour").alias("peak_hour"), F.col("count").alias("peak_count"))
    return scalars.crossJoin(victims).crossJoin(peak)  # single rows


def dashboard_sections(acc: DataFrame, vic: DataFrame, veh: DataFrame) -> DataFrame:
    """All dashboard distributions as ranked rows (months and hours in time order)."""
    dist = distributions(acc, vic, veh).filter("kind <> 'time_slot'")
    time_key = F.when(F.col("kind").isin("month", "hour"), F.lpad("label", 7, "0"))
    return _ranked(dist.drop("key"), [], time_key).select("kind", "position", "label", "count")
