"""Address assembly and gazetteer lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from crashgrid import fixed_values as fv
from crashgrid.functions.bands import blank_to_null, let, trimmed
from crashgrid.operators.filters import inside_box, placeholder_coordinates


def full_address(address: Column, area: Column, city: Column) -> Column:
    """Non-empty parts joined by ', '."""
    return F.concat_ws(", ", blank_to_null(address), blank_to_null(area), blank_to_null(city))


def has_region(address: Column) -> Column:
    words = "|".join(w.replace(".", "[.]") for w in fv.REGION_WORDS)
    return F.lower(address).rlike(words)


def geo_query(address: Column) -> Column:
    return F.concat(
        address, F.when(has_region(address), fv.REGION_SUFFIX).otherwise(fv.DISTRICT_SUFFIX)
    )


def simplify_address(address: Column) -> Column:
    """Last two meaningful comma-separated parts, null if there are none."""
    text = F.trim(F.regexp_replace(F.regexp_replace(address, fv.ADDRESS_PREFIX, ""), r",\s*", ", "))
    parts = F.filter(
        F.transform(F.split(text, ","), trimmed),
        lambda p: (F.length(p) > 2) & ~p.rlike(fv.GENERIC_ADDRESS_PART),
    )
    last = F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2)
    return F.when(address != "", blank_to_null(F.array_join(last, ", ")))


def gazetteer_match(text: Column) -> Column:
    """Longest gazetteer name contained in the text (list order on ties), else null.

    The names are ordered by length once, so the first hit is the answer and the
    whole lookup is one CASE expression without a join.
    """

    def first_name(lowered):
        out = F
        for name, lat, lng in sorted(fv.GAZETTEER, key=lambda g: -len(g[0])):
            out = out.when(lowered.contains(name), F.struct(
                F.lit(name).alias("name"), F.lit(lat).alias("lat"), F.lit(lng).alias("lng")))
        return out

    return let(F.lower(text), first_name)


def match_area(df: DataFrame, column: str) -> DataFrame:
    hit = df.withColumn("_hit", gazetteer_match(F.col(column)))
    return hit.select(
        *df.columns, F.col("_hit.name").alias("area_match"), F.col("_hit.lat").alias("lat"),
        F.col("_hit.lng").alias("lng"),
    )


def gazetteer_point(address: Column, jitter_key: Column | None = None) -> Column:
    """(lat, lng) of the matched name if inside the district, else null.

    With ``jitter_key`` the point is moved by up to 0.0015 degrees, derived from a
    hash of the key so that reruns agree.
    """
    hit = gazetteer_match(address)
    if jitter_key is None:
        moved = F.struct(hit["lat"].alias("lat"), hit["lng"].alias("lng"))
    else:
        shift = lambda salt: (F.pmod(F.xxhash64(jitter_key, F.lit(salt)), F.lit(10001)) / 10000.0 - 0.5) * 0.003
        moved = F.struct((hit["lat"] + shift("lat")).alias("lat"), (hit["lng"] + shift("lng")).alias("lng"))
    return F.when(inside_box(hit["lat"], hit["lng"]), moved)


def fill_coordinates(loc: DataFrame, replace_placeholders: bool = False, jitter: bool = False) -> DataFrame:
    """Fill missing (optionally also placeholder) coordinates from the gazetteer.

    Adds ``was_missing`` and ``filled`` for :func:`geocode_summary`.
    """
    missing = F.col("latitude").isNull() | F.col("longitude").isNull()
    if replace_placeholders:
        missing = missing | placeholder_coordinates(F.col("latitude"), F.col("longitude"))
    missing = missing & (F.col("address").isNotNull() | F.col("area").isNotNull())
    address = full_address(F.col("address"), F.col("area"), F.col("city"))
    point = F.when(missing & (F.length(address) > 3), gazetteer_point(address, F.col("id") if jitter else None))
    staged = loc.withColumn("was_missing", missing).withColumn("_point", point)
    filled = F.col("_point").isNotNull()
    return (
        staged.withColumn("filled", filled)
        .withColumn("latitude", F.when(filled, F.col("_point.lat")).otherwise(F.col("latitude")))
        .withColumn("longitude", F.when(filled, F.col("_point.lng")).otherwise(F.col("longitude")))
        .drop("_point")
    )


def geocode_summary(filled: DataFrame) -> DataFrame:
    return filled.agg(
        F.count_if("was_missing").alias("total"), F.count_if("filled").alias("geocoded"),
        F.count_if(F.expr("was_missing AND NOT filled")).alias("failed"),
    )
