"""Joins between accidents and their child tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def acc_loc(acc: DataFrame, loc: DataFrame, how: str = "left") -> DataFrame:
    """Accidents with their locations; several locations repeat the accident."""
    places = loc.select(
        F.col("accident_id").alias("id"), "address", "area", "city", "latitude", "longitude"
    )
    return acc.join(places, "id", how)


def child_counts(child: DataFrame, *counts) -> DataFrame:
    return child.groupBy(F.col("accident_id").alias("id")).agg(*counts)


def with_child_counts(acc: DataFrame, vic: DataFrame, veh: DataFrame | None = None) -> DataFrame:
    """Victim, fatal victim and vehicle counts; each child is aggregated before its join."""
    victims = child_counts(
        vic,
        F.count("*").alias("victim_count"),
        F.count_if(F.col("is_fatality")).alias("fatality_count"),
    )
    out = acc.join(victims, "id", "left")
    names = ["victim_count", "fatality_count"]
    if veh is not None:
        out = out.join(child_counts(veh, F.count("*").alias("vehicle_count")), "id", "left")
        names.append("vehicle_count")
    return out.fillna(0, names)


def child_with_area(child: DataFrame, acc: DataFrame, loc: DataFrame) -> DataFrame:
    """Child rows of existing accidents with the accident's area."""
    keys = acc.select(F.col("id").alias("accident_id"))
    return child.join(keys, "accident_id").join(loc.select("accident_id", "area"), "accident_id", "left")


def first_location(loc: DataFrame, *columns: str) -> DataFrame:
    """One location per accident: the lowest id.  Partial aggregation, no window."""
    columns = columns or ("address", "area", "city", "latitude", "longitude")
    picked = loc.groupBy("accident_id").agg(
        F.min_by(F.struct(*columns), "id").alias("_first")
    )
    return picked.select("accident_id", *[F.col(f"_first.{c}").alias(c) for c in columns])


def zero_fill(agg: DataFrame, dim: DataFrame, key: str, *measures: str) -> DataFrame:
    """Every dimension row, with 0 where nothing was counted."""
    return dim.join(agg, key, "left").fillna(0, list(measures))


def record_detail(acc, loc, vic, veh, ids: DataFrame) -> DataFrame:
    """Full records of the given ids: first location, victims and vehicles as arrays."""
    from crashgrid.functions.stations import extract_station

    chosen = acc.join(ids.select("id"), "id", "left_semi")
    keys = chosen.select(F.col("id").alias("accident_id"))

    def nested(child, name, *columns):
        own = child.join(keys, "accident_id", "left_semi")
        return own.groupBy(F.col("accident_id").alias("id")).agg(
            F.sort_array(F.collect_list(F.struct("id", *columns))).alias(name)
        )

    place = first_location(loc.join(keys, "accident_id", "left_semi"))
    place = place.select(
        F.col("accident_id").alias("id"),
        F.struct("address", "area", "city", "latitude", "longitude").alias("location"),
    )
    return (
        chosen.join(place, "id", "left")
        .join(nested(vic, "victims", "victim_name", "age", "gender", "injury_severity", "is_fatality"), "id", "left")
        .join(nested(veh, "vehicles", "vehicle_type", "vehicle_number", "driver_name"), "id", "left")
        .withColumn("victims", F.coalesce("victims", F.array()))
        .withColumn("vehicles", F.coalesce("vehicles", F.array()))
        .withColumn("police_station", extract_station(F.col("raw_text")))
    )
