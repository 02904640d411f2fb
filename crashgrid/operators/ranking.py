"""Sort modes, first/last record per key and list set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from crashgrid.functions.bands import severity_rank


def newest(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("created_at"), F.desc("id"))


def recent_list(acc: DataFrame, loc: DataFrame, n: int = 5) -> DataFrame:
    """Latest n records with area and city; the limit is taken before the join."""
    latest = newest(acc.select("id", "fir_number", "severity", "cause", "incident_date", "created_at")).limit(n)
    places = loc.select(F.col("accident_id").alias("id"), "area", "city").join(
        F.broadcast(latest.select("id")), "id", "left_semi"
    )
    return newest(latest.join(places, "id", "left")).limit(n)


def sort_list(df: DataFrame, mode: str) -> DataFrame:
    """Order by 'newest', 'oldest' (undated rows count their id as milliseconds) or 'severity'."""
    epoch = F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")
    moment = F.coalesce(F.col("incident_date"), epoch + F.expr("make_dt_interval(0, 0, 0, id / 1000.0)"))
    orders = {
        "newest": [F.desc(moment), F.asc("id")],
        "oldest": [F.asc(moment), F.asc("id")],
        "severity": [severity_rank(F.col("severity")), F.asc("id")],
    }
    return df.orderBy(*orders[mode])


def sort_summary(df: DataFrame, mode: str, name: str = "name", total: str = "total", rate: str = "fatality_rate"):
    orders = {
        "accidents-high": [F.desc(total), F.asc(name)],
        "accidents-low": [F.asc(total), F.asc(name)],
        "fatality-high": [F.desc(rate), F.desc(total), F.asc(name)],
        "alphabetical": [F.asc(name)],
    }
    return df.orderBy(*orders[mode])


def by_date_desc(df: DataFrame, nulls: str = "first") -> DataFrame:
    date = F.desc_nulls_first("incident_date") if nulls == "first" else F.desc_nulls_last("incident_date")
    return df.orderBy(date, F.desc("id"))


def keep_first(df: DataFrame, key: str, *order: str) -> DataFrame:
    """First row per key in the given order, as a mergeable aggregate."""
    rest = [c for c in df.columns if c != key]
    picked = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(key, "_row.*").select(*df.columns)


def keep_last(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Last write per key wins."""
    rest = [c for c in df.columns if c != key]
    picked = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(key, "_row.*").select(*df.columns)


def concat_first(a: DataFrame, b: DataFrame, key: str, rank: str) -> DataFrame:
    """``a`` followed by ``b``, keeping the first occurrence of each key."""
    both = a.withColumn("_part", F.lit(0)).unionByName(b.withColumn("_part", F.lit(1)), allowMissingColumns=True)
    return keep_first(both, key, "_part", rank).drop("_part")
