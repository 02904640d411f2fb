"""Distributions, rates and series over the incident tables.

Every function is one grouped aggregate (map-side combined) over columns the
parquet scan can prune to; top-k results use TakeOrdered instead of a full sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from crashgrid import fixed_values as fv
from crashgrid.functions.bands import (
    age_band, initial_caps, lookup, month_key, percent, time_slot,
)
from crashgrid.operators.filters import area_label, drop_placeholders, group_of, with_coordinates
from crashgrid.operators.joins import acc_loc, first_location, zero_fill



def totals(acc: DataFrame, vic: DataFrame) -> DataFrame:
    a = acc.agg(F.count("*").alias("total_accidents"))
    return a.crossJoin(vic.agg(F.count("*").alias("total_victims")))  # 1 row x 1 row


def distribution(df: DataFrame, column: str | Column, label: str) -> DataFrame:
    """Counts per label, most frequent first, ties by label."""
    named = df.select(F.col(column).alias(label) if isinstance(column, str) else column.alias(label))
    return named.groupBy(label).agg(F.count("*").alias("count")).orderBy(F.desc("count"), F.asc(label))


def severity_dist(acc: DataFrame) -> DataFrame:
    return distribution(acc, "severity", "severity")


def cause_dist(acc: DataFrame, n: int | None = None) -> DataFrame:
    out = distribution(drop_placeholders(acc, "cause", fv.CAUSE_PLACEHOLDER), "cause", "cause")
    return out if n is None else out.limit(n)


def vehicle_dist(veh: DataFrame) -> DataFrame:
    return distribution(drop_placeholders(veh, "vehicle_type", "Unknown"), "vehicle_type", "vehicle_type")


def age_bands(vic: DataFrame) -> DataFrame:
    return distribution(vic.filter("age IS NOT NULL"), age_band(F.col("age")), "age_group")


def time_slots(acc: DataFrame) -> DataFrame:
    return distribution(acc.filter("incident_date IS NOT NULL"), time_slot(F.col("incident_date")), "time_slot")


def area_top(loc: DataFrame, n: int | None = 10) -> DataFrame:
    out = distribution(loc.filter("area IS NOT NULL"), "area", "area")
    return out if n is None else out.limit(n)


def hour_hist(acc: DataFrame) -> DataFrame:
    dated = acc.filter("incident_date IS NOT NULL")
    return dated.groupBy(F.hour("incident_date").cast("long").alias("hour")).agg(F.count("*").alias("count")).orderBy("hour")


def monthly(acc: DataFrame) -> DataFrame:
    dated = acc.filter("incident_date IS NOT NULL")
    return (
        dated.groupBy(
            month_key(F.col("incident_date")).alias("month"),
            F.date_format("incident_date", "MMM yyyy").alias("label"),
        ).agg(F.count("*").alias("count")).orderBy("month")
    )


def _months(acc: DataFrame, n: int, newest: bool) -> DataFrame:
    grouped = (
        acc.filter("incident_date IS NOT NULL")
        .groupBy(month_key(F.col("incident_date")).alias("_key"),
                 F.date_format("incident_date", "MMM-yyyy").alias("month"))
        .agg(F.count("*").alias("count"))
    )
    return grouped.orderBy(F.desc("_key") if newest else F.asc("_key")).limit(n).select("month", "count")


def recent_months(acc: DataFrame, n: int = 12) -> DataFrame:
    """Latest n months that have records, newest first."""
    return _months(acc, n, True)


def first_months(acc: DataFrame, n: int = 12) -> DataFrame:
    """Earliest n months that have records, oldest first."""
    return _months(acc, n, False)


def mean_confidence(acc: DataFrame) -> DataFrame:
    scored = acc.filter("confidence_score > 0")
    return scored.agg(F.round(F.avg("confidence_score"), 2).alias("avg_confidence"))


def fatality_rate(acc: DataFrame, *by: str) -> DataFrame:
    fatal = F.count_if(F.col("severity") == "Fatal")
    return acc.groupBy(*by).agg(
        F.count("*").alias("total"), fatal.alias("fatal"),
        percent(fatal, F.count("*")).alias("fatality_rate"),
    )


def peak_hour(acc: DataFrame) -> DataFrame:
    """Busiest hour, the earliest one on ties."""
    return hour_hist(acc).agg(
        F.max_by("hour", F.struct("count", -F.col("hour"))).alias("hour"), F.max("count").alias("count")
    )


def weekday_dist(acc: DataFrame) -> DataFrame:
    dated = acc.filter("incident_date IS NOT NULL")
    return dated.groupBy(
        (F.dayofweek("incident_date") - 1).cast("long").alias("day_num"),
        F.date_format("incident_date", "EEEE").alias("day_name"),
    ).agg(F.count("*").alias("count")).orderBy("day_num")


def peak_safe_day(acc: DataFrame) -> DataFrame:
    """Busiest and safest weekday, the first in week order on ties."""
    return weekday_dist(acc).agg(
        F.max_by("day_name", F.struct("count", -F.col("day_num"))).alias("peak_day"),
        F.min_by("day_name", F.struct("count", "day_num")).alias("safest_day"),
    )


def month_severity(acc: DataFrame) -> DataFrame:
    dated = acc.filter("incident_date IS NOT NULL AND severity IS NOT NULL")
    return dated.groupBy(month_key(F.col("incident_date")).alias("month"), "severity").agg(F.count("*").alias("count"))


def month_severity_pivot(acc: DataFrame) -> DataFrame:
    """One zero-filled column per legal severity."""
    dated = acc.filter("incident_date IS NOT NULL AND severity IS NOT NULL")
    return (
        dated.groupBy(month_key(F.col("incident_date")).alias("month"))
        .agg(*[F.count_if(F.col("severity") == s).alias(s) for s in fv.SEVERITIES])
        .orderBy("month")
    )


def month_over_month(acc: DataFrame) -> DataFrame:
    """Change against the previous month with records.

    The window runs over the aggregated months (a handful of rows per year), not
    over the records.
    """
    previous = F.lag("count").over(Window.orderBy("month"))
    series = monthly(acc).select("month", "count").withColumn("previous", previous)
    change = F.round((F.col("count") - F.col("previous")) * 100.0 / F.col("previous"), 1)
    return series.select(
        "month", "count", "previous",
        F.when(F.col("previous") > 0, change).otherwise(0.0).alias("pct"),
        F.when(F.col("count") > F.coalesce("previous", F.lit(0)), "up")
        .when(F.col("count") < F.coalesce("previous", F.lit(0)), "down").otherwise("flat").alias("direction"),
    )


def area_summary(acc: DataFrame, loc: DataFrame) -> DataFrame:
    """Totals per capitalised area name.  Grouped on the raw area first, so the
    capitalisation runs once per distinct area instead of once per record."""
    joined = acc.select("id", "severity").join(
        loc.select(F.col("accident_id").alias("id"), "area"), "id", "left"
    )
    names = ["total_accidents", "fatal_count", "grievous_count", "non_fatal_count"]
    per_area = joined.groupBy("area").agg(
        F.count("*").alias(names[0]),
        *[F.count_if(F.col("severity") == s).alias(n) for s, n in zip(fv.SEVERITIES, names[1:])],
    )
    name = initial_caps(F.coalesce("area", F.lit("Unknown"))).alias("name")
    return (
        per_area.groupBy(name).agg(*[F.sum(n).alias(n) for n in names])
        .orderBy(F.desc("total_accidents"), "name")
    )


def area_rates(acc: DataFrame, loc: DataFrame) -> DataFrame:
    joined = acc.select("id", "severity").join(
        loc.select(F.col("accident_id").alias("id"), "area"), "id", "left"
    )
    out = fatality_rate(joined.withColumn("area", area_label(F.col("area"))), "area")
    return out.select("area", "total", "fatality_rate")


def group_summary(acc: DataFrame, loc: DataFrame) -> DataFrame:
    """Exclusive totals per jurisdiction group, every group present, in one pass."""
    place = first_location(loc, "area").select(F.col("accident_id").alias("id"), "area")
    placed = acc.select("id", "severity").join(place, "id", "left")
    per_area = placed.groupBy("area").agg(
        F.count("*").alias("total"), F.count_if(F.col("severity") == "Fatal").alias("fatal")
    )
    per_group = per_area.groupBy(group_of(F.col("area")).alias("name")).agg(
        F.sum("total").alias("total"), F.sum("fatal").alias("fatal")
    )
    dim = acc.sparkSession.createDataFrame([(n,) for n in [*fv.GROUP_PRIORITY, fv.OTHER_AREAS]], "name string")
    filled = zero_fill(per_group, F.broadcast(dim), "name", "total", "fatal")
    return filled.withColumn("fatality_rate", percent(F.col("fatal"), F.col("total")))


def station_summary(acc: DataFrame, loc: DataFrame) -> DataFrame:
    """Totals per canonical station, zero-filled over all stations.

    Records are counted by the station text first; the station rules then run once per
    distinct text.
    """
    from crashgrid.functions.stations import extract_station, station_from_name

    placed = acc.select("id", "severity", extract_station(F.col("raw_text")).alias("_text")).join(
        loc.select(F.col("accident_id").alias("id")), "id", "left"
    )
    by_text = placed.groupBy("_text").agg(
        F.count("*").alias("total"), F.count_if(F.col("severity") == "Fatal").alias("fatal")
    )
    name = F.coalesce(station_from_name(F.col("_text")), F.lit(fv.OTHER_STATIONS))
    counted = by_text.groupBy(name.alias("name")).agg(F.sum("total").alias("total"), F.sum("fatal").alias("fatal"))
    dim = acc.sparkSession.createDataFrame([(n,) for n in [*fv.STATIONS, fv.OTHER_STATIONS]], "name string")
    filled = zero_fill(counted, F.broadcast(dim), "name", "total", "fatal")
    return filled.withColumn("fatality_rate", percent(F.col("fatal"), F.col("total")))


def station_list(acc: DataFrame, loc: DataFrame) -> DataFrame:
    return station_summary(acc, loc).filter("total > 0").select("name", "total", "fatal")


def top_label(dist: DataFrame, label: str, blacklist: list[str] | None = None) -> DataFrame:
    """Most frequent label; with a blacklist the first clean short label, else the first."""
    rank = [-F.col("count"), F.col(label)]
    if blacklist is not None:
        text = F.lower(F.coalesce(F.col(label), F.lit("")))
        unfit = F.col(label).isNull() | (text == "") | (F.length(label) > 60)
        for word in blacklist:
            unfit = unfit | text.contains(word)
        rank.insert(0, unfit)
    return dist.agg(F.coalesce(F.min_by(label, F.struct(*rank)), F.lit("Unknown")).alias("label"))


def centroid(markers: DataFrame, *by: str, default=fv.MAP_CENTRE) -> DataFrame:
    mapped = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    return markers.groupBy(*by).agg(
        F.round(F.coalesce(F.avg(F.when(mapped, F.col("lat"))), F.lit(default[0])), 6).alias("lat"),
        F.round(F.coalesce(F.avg(F.when(mapped, F.col("lng"))), F.lit(default[1])), 6).alias("lng"),
    )


def map_cards(markers: DataFrame) -> DataFrame:
    return markers.agg(
        F.count("*").alias("mapped"),
        F.count_if(F.col("severity") == "Fatal").alias("fatal"),
        F.count_if(F.col("severity") == "Grievous").alias("grievous"),
        F.round(F.sum("confidence_score") / F.greatest(F.count("*"), F.lit(1)) * 100, 0).alias("confidence_pct"),
    )


def share(df: DataFrame, column: str) -> DataFrame:
    """Share of the column total; ``df`` is an aggregated frame."""
    total = F.broadcast(df.agg(F.sum(column).alias("_total")))
    return df.join(total).withColumn("pct", percent(F.col(column), F.col("_total"))).drop("_total")


def pct_of_max(df: DataFrame, column: str) -> DataFrame:
    top = F.broadcast(df.agg(F.max(column).alias("_max")))
    return df.join(top).withColumn("pct", percent(F.col(column), F.col("_max"))).drop("_max")


def _line(date: Column, place: Column) -> Column:
    cause = F.coalesce(F.when(F.col("cause") != "", F.col("cause")), F.lit("Unknown"))
    return F.format_string(
        fv.DIGEST_LINE, F.coalesce("fir_number", F.lit("null")), date, F.coalesce("severity", F.lit("null")), place, cause)


def _day(ts: str, missing: str) -> Column:
    return F.coalesce(F.date_format(ts, "M/d/yyyy"), F.lit(missing))


def digest(acc: DataFrame, loc: DataFrame, n: int = 50) -> DataFrame:
    """One text line per record, the latest ``n`` records, undated records first."""
    latest = acc.select("id", "fir_number", "incident_date", "cause", "severity").orderBy(
        F.desc_nulls_first("incident_date"), F.desc("id")
    ).limit(n)
    ids = latest.select(F.col("id").alias("accident_id"))
    place = first_location(loc.join(F.broadcast(ids), "accident_id", "left_semi"), "area")
    joined = latest.join(place.select(F.col("accident_id").alias("id"), "area"), "id", "left")
    lines = joined.select(
        F.struct(
            F.col("incident_date").isNotNull().alias("dated"), F.col("incident_date").alias("d"), F.col("id")
        ).alias("k"),
        _line(_day("incident_date", "1/1/1970"), F.coalesce(F.when(F.col("area") != "", F.col("area")), F.lit("Unknown"))).alias("line"),
    )
    return _join_lines(lines, undated_first=True)


def _join_lines(lines: DataFrame, *by: str, undated_first: bool) -> DataFrame:
    """Join at most n lines per key, newest first.

    Sorting descending puts dated rows first; swapping the flag puts undated ones
    first.
    """
    flag = ~F.col("k.dated") if undated_first else F.col("k.dated")
    keyed = F.struct(flag.alias("f"), F.col("k.d").alias("d"), F.col("k.id").alias("id"), F.col("line").alias("line"))
    ordered = F.sort_array(F.collect_list(keyed), asc=False)
    return lines.groupBy(*by).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))


def digest_by(base: DataFrame, by: str, n: int = 30) -> DataFrame:
    """The same per key: latest ``n`` records of each key, undated last.

    ``base`` has the key and the report columns with address.  ``row_number() <= n``
    lets Spark keep only n rows per key and task before the shuffle, so a key that
    owns most rows does not pile up in one task.
    """
    order = Window.partitionBy(by).orderBy(F.desc_nulls_last("incident_date"), F.desc("id"))
    latest = base.select(by, "id", "fir_number", "incident_date", "cause", "severity", "address").withColumn(
        "_rank", F.row_number().over(order)
    ).filter(F.col("_rank") <= n)
    place = F.coalesce(F.when(F.col("address") != "", F.col("address")), F.lit("Unknown"))
    lines = latest.select(
        by,
        F.struct(
            F.col("incident_date").isNotNull().alias("dated"), F.col("incident_date").alias("d"), F.col("id")
        ).alias("k"),
        _line(_day("incident_date", "Unknown date"), place).alias("line"),
    )
    return _join_lines(lines, by, undated_first=False)


def high_water_mark(acc: DataFrame) -> DataFrame:
    return acc.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long").alias("max_id"))


def load_gauge(recent_rows: DataFrame) -> DataFrame:
    return recent_rows.agg(
        F.least(F.lit(95.0), F.lit(5.5) + F.count("*") * F.lit(4.2)).alias("load")
    )


def area_density(acc: DataFrame, loc: DataFrame) -> DataFrame:
    """Heat points with the number of mapped accidents in the same area.

    Written as an aggregate joined back instead of a window: a window would pull a
    busy area into one task, the aggregate combines map-side and the per-area
    counts are small.
    """
    mapped = acc_loc(acc.select("id", "severity"), loc, "inner")
    mapped = with_coordinates(mapped).select("id", "latitude", "longitude", "severity", "area")
    per_area = mapped.groupBy("area").agg(F.count("*").alias("area_accident_count"))
    joined = mapped.alias("m").join(per_area.alias("c"), F.expr("m.area <=> c.area"))
    return joined.select(
        "m.id", "latitude", "longitude", "severity", "area_accident_count",
        lookup(F.col("severity"), fv.HEAT_WEIGHT, 0.3).alias("intensity"),
    )


def markers(acc: DataFrame, loc: DataFrame, vic: DataFrame, everything: bool = False) -> DataFrame:
    """Map markers: located records with station and victim counts."""
    from crashgrid.functions.stations import canonical_station
    from crashgrid.operators.joins import with_child_counts

    base = acc.select(
        "id", "fir_number", "severity", "cause", "incident_date", "confidence_score", "created_at",
        canonical_station(F.col("raw_text")).alias("police_station"),
    )
    located = with_coordinates(acc_loc(base, loc), everything)
    counted = with_child_counts(located, vic)
    return counted.select(
        "id", "fir_number", "severity", "cause", "incident_date", "address",
        F.coalesce("area", F.lit("")).alias("area"), F.coalesce("city", F.lit("")).alias("city"),
        "police_station",
        F.when(F.col("latitude") != 0, F.col("latitude").cast("double")).alias("lat"),
        F.when(F.col("longitude") != 0, F.col("longitude").cast("double")).alias("lng"),
        "victim_count", "fatality_count", "confidence_score", "created_at",
    )
