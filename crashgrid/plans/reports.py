"""Rule-based report texts over profile rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from crashgrid import fixed_values as fv
from crashgrid.operators.aggregates import distribution


def _or(c: str, default: str) -> Column:
    return F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit(default))


def _number(c: str) -> Column:
    """Number without a trailing '.0'; missing counts as 0."""
    return F.regexp_replace(F.coalesce(F.col(c), F.lit(0.0)).cast("string"), r"\.0$", "")


def _say(text: str, *values: Column) -> Column:
    return F.format_string(text, *values) if values else F.lit(text)


def _list(texts: list[str], *values: Column) -> Column:
    """The sentences as an array; the first ones take one value each."""
    return F.array(*[_say(t, *values[i:i + 1]) for i, t in enumerate(texts)])


def global_report(profile: DataFrame) -> DataFrame:
    """Summary, four insights, four recommendations, four tips per profile row."""
    pct, place = _number("fatality_percentage"), "hotspot_location"
    r = fv.GLOBAL_REPORT
    return profile.select(
        _say(r["summary"], _or("most_common_cause", "Unknown"), _or("high_risk_age_group", "Unknown"), pct).alias("summary"),
        _list(r["key_insights"], _or("peak_time", "Unknown"), _or("most_risky_vehicle", "Unknown"), _or(place, "Unknown"), pct)
        .alias("key_insights"),
        _list(r["policy_recommendations"], _or("peak_time", "peak hours"), _or(place, "identified hotspots"),
              _or("most_risky_vehicle", "high-risk vehicle")).alias("policy_recommendations"),
        _list(r["public_awareness_suggestions"], _or("high_risk_age_group", "high-risk"), _or(place, "hotspot areas"))
        .alias("public_awareness_suggestions"),
    )


def report_from_json(df: DataFrame, column: str) -> DataFrame:
    """The global report for statistics given as JSON text."""
    fields = ("most_common_cause", "high_risk_age_group", "peak_time", "most_risky_vehicle", "hotspot_location")
    schema = "struct<" + ",".join(f"{f}:string" for f in fields) + ",fatality_percentage:double>"
    parsed = df.select(F.from_json(column, schema).alias("s"))
    return global_report(parsed.select("s.*"))


def trend_report(acc: DataFrame) -> DataFrame:
    """Trend texts with the busiest weekday."""
    dated = acc.filter("incident_date IS NOT NULL")
    days = distribution(dated, F.date_format("incident_date", "EEEE"), "day_name")
    peak = days.agg(F.min_by("day_name", F.struct(-F.col("count"), F.col("day_name"))).alias("peak_day"))
    r = fv.TREND_REPORT
    return peak.select(
        _say(r["executive_summary"], F.coalesce("peak_day", F.lit("Unknown"))).alias("executive_summary"),
        F.lit(r["seasonal_analysis"]).alias("seasonal_analysis"), F.lit(r["day_of_week_analysis"]).alias("day_of_week_analysis"),
        _list(r["operational_recommendations"]).alias("operational_recommendations"),
    )


def jurisdiction_report(profiles: DataFrame) -> DataFrame:
    """One report per jurisdiction profile row."""
    r = fv.JURISDICTION_REPORT
    return profiles.select(
        "key", _say(r["summary"], F.col("key")).alias("summary"),
        _list(r["key_insights"], _or("most_common_cause", "negligent driving"), _or("high_risk_age_group", "18-25"),
              _or("peak_time", "night hours")).alias("key_insights"),
        _list(r["policy_recommendations"], F.col("key")).alias("policy_recommendations"),
    )
