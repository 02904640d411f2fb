"""Writes to the incident tables: fan-out, upsert, delete, conditional update, versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from crashgrid.functions.bands import blank_to_null
from crashgrid.functions.places import full_address, gazetteer_point
from crashgrid.functions.reports import (
    clip, clip_vehicles, clip_victims, guard_address, guard_cause, normalise_severity, parse_report_date,
    starts_as_form, WIDTHS,
)
from crashgrid.session import cut


def number_rows(df: DataFrame, *order: str, **widths) -> DataFrame:
    """Consecutive numbers ``_row`` (from 0) in key order without a single-task window.

    Rows are range partitioned and numbered inside their partition; partition totals
    (one small row each) give every partition its offset.  For each ``name=column`` in
    ``widths`` the column ``_at_<name>`` is the running total of that column before the
    row, so children can be numbered from the same pass.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    slot = F.monotonically_increasing_id()
    staged = cut(ranged.withColumn("_pid", F.spark_partition_id()).withColumn("_pos", slot))
    sums = {"_row": F.lit(1).cast("long"), **{f"_at_{n}": F.coalesce(c, F.lit(0)).cast("long") for n, c in widths.items()}}
    totals = staged.groupBy("_pid").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    earlier = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_o{n}") for n in sums])
    inside = Window.partitionBy("_pid").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    local = staged.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(n) for n, c in sums.items()])
    joined = local.join(F.broadcast(offsets), "_pid")
    for n in sums:
        joined = joined.withColumn(n, F.col(n) + F.col(f"_o{n}"))
    return joined.drop("_pid", "_pos", *[f"_o{n}" for n in sums])


def prepare(extracted: DataFrame) -> DataFrame:
    """Guards, severity normalisation and column widths before records are stored."""
    loc = F.col("location")
    cause = guard_cause(F.col("cause"), starts_as_form(F.col("cause")))
    address = guard_address(loc["address"], loc["area"], starts_as_form(loc["address"]))
    return extracted.withColumns({
        "fir_number": clip(F.col("fir_number"), WIDTHS["fir_number"]),
        "cause": cause,
        "severity": normalise_severity(F.col("severity")),
        "location": F.when(loc.isNotNull(), F.struct(
            address.alias("address"), clip(loc["area"], WIDTHS["area"]).alias("area"),
            clip(loc["city"], WIDTHS["city"]).alias("city"), loc["lat"].alias("lat"), loc["lng"].alias("lng"))),
        "victims": clip_victims(F.col("victims")),
        "vehicles": clip_vehicles(F.col("vehicles")),
    })


def fan_out(extracted: DataFrame, key: str, start: dict[str, int] | None = None):
    """Nested records -> (accidents, locations, victims, vehicles) with consecutive ids.

    ``key`` orders the new ids and must be unique; ``start`` holds the highest ids in
    use per table.  Coordinates always come from the gazetteer, never from the record.
    """
    start = {"accidents": 0, "locations": 0, "victims": 0, "vehicles": 0, **(start or {})}
    # numbering materialises the extraction; the guards then read plain stored columns
    numbered = number_rows(
        extracted, key,
        loc=F.col("location").isNotNull().cast("long"), vic=F.size("victims"), veh=F.size("vehicles"),
    )
    numbered = prepare(numbered).withColumn("accident_id", F.col("_row") + start["accidents"] + 1)

    acc = numbered.select(
        F.col("accident_id").alias("id"), "fir_number",
        F.when(F.col("date_time") != "UNKNOWN", parse_report_date(F.col("date_time"))).alias("incident_date"),
        "cause", "severity", F.col(key).cast("string").alias("pdf_url"), F.lit("Processed").alias("status"),
        "confidence_score", "raw_text",
    )
    place = numbered.filter("location IS NOT NULL").select("accident_id", "_at_loc", "location.*")
    address = full_address(F.col("address"), F.col("area"), F.col("city"))
    place = place.withColumn("_point", F.when(F.length(address) > 3, gazetteer_point(address)))
    loc = place.select(
        (F.col("_at_loc") + start["locations"] + 1).alias("id"), "accident_id", "address", "area",
        F.coalesce(blank_to_null(F.col("city")), F.lit("NTR District")).alias("city"),
        F.col("_point.lat").alias("latitude"), F.col("_point.lng").alias("longitude"),
    )
    v = numbered.select("accident_id", "severity", "_at_vic", F.posexplode("victims").alias("_i", "v"))
    vic = v.select(
        (F.col("_at_vic") + F.col("_i") + start["victims"] + 1).alias("id"), "accident_id",
        F.col("v.name").alias("victim_name"), "v.age", "v.gender", F.col("v.injury").alias("injury_severity"),
        (F.col("severity") == "Fatal").alias("is_fatality"),
    )
    w = numbered.select("accident_id", "_at_veh", F.posexplode("vehicles").alias("_i", "w"))
    veh = w.select(
        (F.col("_at_veh") + F.col("_i") + start["vehicles"] + 1).alias("id"), "accident_id",
        F.col("w.type").alias("vehicle_type"), F.col("w.number").alias("vehicle_number"), "w.driver_name",
    )
    return acc, loc, vic, veh


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows replace existing rows with the same key."""
    kept = existing.join(incoming.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(incoming.select(*existing.columns))


def report_history(reports: DataFrame, n: int = 20) -> DataFrame:
    return reports.orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def append_report(report: DataFrame, path: str) -> None:
    report.write.mode("append").parquet(path)


def cascade_delete(acc, loc, vic, veh, ids: DataFrame):
    """The four tables without the given accidents and their children."""
    gone = ids.select("id").distinct()
    child_gone = gone.withColumnRenamed("id", "accident_id")
    return (
        acc.join(gone, "id", "left_anti"),
        *[child.join(child_gone, "accident_id", "left_anti") for child in (loc, vic, veh)],
    )


def clear(df: DataFrame) -> DataFrame:
    """Empty frame of the same shape, for overwriting a stored graph."""
    return df.limit(0)


def fill_missing(base: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Fill nulls of ``columns`` from ``updates`` (unique by key); other values stay."""
    new = updates.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = base.join(new, key, "left")
    filled = {c: F.coalesce(F.col(c), F.col(f"_new_{c}")) for c in columns}
    return joined.withColumns(filled).select(*base.columns)


# ------------------------------------------------------------------ versioned folders
def _fs(spark: SparkSession, path: str):
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def versions(spark: SparkSession, root: str) -> list[int]:
    """Complete versions below ``root``, oldest first."""
    fs, jroot = _fs(spark, root)
    if not fs.exists(jroot):
        return []
    found = []
    for status in fs.listStatus(jroot):
        name = status.getPath().getName()
        done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if name.startswith("version=") and fs.exists(done):
            found.append(int(name.split("=")[1]))
    return sorted(found)


def publish(df: DataFrame, root: str) -> int:
    """Write the next version; readers of the previous one are not disturbed."""
    spark = df.sparkSession
    version = (versions(spark, root) or [0])[-1] + 1
    df.write.mode("overwrite").parquet(f"{root}/version={version}")
    return version


def current(spark: SparkSession, root: str) -> DataFrame | None:
    """Latest complete version, or None where nothing has been published."""
    known = versions(spark, root)
    return spark.read.parquet(f"{root}/version={known[-1]}") if known else None
