"""Field extraction, normalisation and guards for report text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from crashgrid import fixed_values as fv
from crashgrid.functions.bands import blank_to_null, contains_any, found, let, trimmed


def _any_of(phrases) -> str:
    return "|".join(re.sub(r"([.&])", r"[\1]", p) for p in phrases)


FORM_PHRASE = _any_of(fv.FORM_PHRASES)
LONG_FORM_PHRASE = _any_of([p for p in fv.FORM_PHRASES if len(p) > 5])


def _first_match(text: Column, patterns) -> Column:
    return F.coalesce(*[found(F.regexp_extract(text, p, 1)) for p in patterns])


def report_number(text: Column) -> Column:
    return F.coalesce(_first_match(text, fv.REPORT_NUMBER_PATTERNS), F.lit("UNKNOWN"))


def date_token(text: Column) -> Column:
    return F.coalesce(_first_match(text, fv.DATE_TOKEN_PATTERNS), F.lit("UNKNOWN"))


def _unless_form(text: Column, pattern: str, form: str) -> Column:
    """First match of the pattern, trimmed; null if empty or a phrase of the printed form."""
    match = trimmed(F.regexp_extract(text, pattern, 1))
    return let(match, lambda m: F.when((m != "") & ~F.lower(m).rlike(form), m))


def place(text: Column) -> Column:
    return F.coalesce(F.substring(_unless_form(text, fv.PLACE_PATTERN, LONG_FORM_PHRASE), 1, 200), F.lit("Vijayawada"))


def severity_from_text(text: Column) -> Column:
    return let(F.lower(text), lambda t: F.when(contains_any(t, fv.FATAL_WORDS), "Fatal").when(
        contains_any(t, fv.GRIEVOUS_WORDS), "Grievous").otherwise("Non-Fatal"))


def cause_from_text(text: Column) -> Column:
    """First usable cause; a pattern only runs on texts holding one of its words."""
    tries = [
        F.when(contains_any(F.lower(text), words), _unless_form(text, pattern, FORM_PHRASE))
        for pattern, words in zip(fv.CAUSE_PATTERNS, (["cause", "reason"], ["over", "rash", "drunk", "negligent"]))
    ]
    return F.coalesce(*tries, F.lit(fv.CAUSE_PLACEHOLDER))


def victims_from_text(text: Column) -> Column:
    """Ages and genders paired by position; the shorter list is padded with null."""
    ages = F.regexp_extract_all(text, F.lit(fv.AGE_PATTERN), F.lit(1))
    genders = F.regexp_extract_all(text, F.lit(fv.GENDER_PATTERN), F.lit(1))
    return F.transform(
        F.arrays_zip(ages.alias("age"), genders.alias("gender")),
        lambda v: F.struct(
            F.lit(None).cast("string").alias("name"), v["age"].cast("int").alias("age"),
            v["gender"].alias("gender"), F.lit("Unknown").alias("injury"),
        ),
    )


def plates_from_text(text: Column) -> Column:
    """Distinct registration numbers, upper case without spaces, at least 6 characters."""
    found = F.regexp_extract_all(text, F.lit(fv.PLATE_PATTERN), F.lit(1))
    compact = F.transform(found, lambda p: F.regexp_replace(F.upper(p), r"\s+", ""))
    return F.sort_array(F.array_distinct(F.filter(compact, lambda p: F.length(p) >= 6)))


def document_gate(text: Column) -> Column:
    """'EMPTY' for fewer than 10 characters, 'HTML' for a web page, else 'OK'."""
    return F.when(F.length(trimmed(F.coalesce(text, F.lit("")))) < 10, "EMPTY").when(
        contains_any(F.lower(text), ["<!doctype html", "<html"]), "HTML").otherwise("OK")


def form_label_count(text: Column) -> Column:
    lowered = F.lower(text)
    return sum((lowered.contains(w).cast("long") for w in fv.FORM_LABELS), F.lit(0).cast("long"))


def is_form_only(text: Column) -> Column:
    """Many form labels in a short text, or no text at all."""
    empty = F.coalesce(text, F.lit("")) == ""
    return empty | ((form_label_count(text) >= 3) & (F.length(trimmed(text)) < 500))


def has_form_phrase(c: Column) -> Column:
    """Boilerplate guard of single uploads."""
    return F.coalesce(c.rlike(fv.FORM_GUARD_PATTERN), F.lit(False))


def starts_as_form(c: Column) -> Column:
    """Boilerplate guard of batch ingest: a short text that begins with a form header."""
    text = trimmed(F.lower(c))
    equal = text.isin(fv.FORM_HEADERS)
    prefix = text.rlike(f"^(?:{_any_of(fv.FORM_HEADERS)})") & (F.length(text) < 50)
    return F.coalesce(equal | prefix, F.lit(False))


def contains_form_phrase(c: Column) -> Column:
    """Boilerplate guard of the extractor: any form phrase anywhere."""
    return F.coalesce(F.lower(c).rlike(FORM_PHRASE), F.lit(False))


def guard_cause(cause: Column, is_form: Column) -> Column:
    return F.when(is_form, fv.CAUSE_PLACEHOLDER).otherwise(cause)


def guard_address(address: Column, area: Column, is_form: Column) -> Column:
    return F.when(is_form, F.coalesce(blank_to_null(area), F.lit("NTR District"))).otherwise(address)


def normalise_severity(c: Column) -> Column:
    s = F.lower(c)
    return (
        F.when(s.contains("fatal") & ~s.contains("non"), "Fatal")
        .when(s.contains("grievous") | s.contains("serious"), "Grievous")
        .when(s.rlike("simple|minor|non-injury|no injury"), "Non-Fatal")
        .when(c.isin(fv.SEVERITIES), c)
        .otherwise("Unknown")
    )


def sanitise_age(c: Column) -> Column:
    """First run of digits as a number; longer runs than a number holds give null."""
    digits = blank_to_null(F.regexp_extract(c.cast("string"), r"\d+", 0))
    return digits.try_cast("int")


def parse_report_date(c: Column) -> Column:
    """Day-month-year text with optional time; overflowing days and months roll over."""
    part = lambda i: F.regexp_extract(c, r"(?:^|\D)" + fv.REPORT_DATE_PATTERN, i)
    num = lambda i: F.coalesce(blank_to_null(part(i)).cast("int"), F.lit(0))
    year = F.when(F.length(part(3)) == 2, num(3) + 2000).otherwise(num(3))
    first = F.make_date(year, F.lit(1), F.lit(1))
    day = F.date_add(F.add_months(first, num(2) - 1), num(1) - 1).cast("timestamp_ntz")
    stamped = day + F.make_dt_interval(hours=num(4), mins=num(5))
    layouts = ["yyyy-M-d H:m:s", "yyyy-M-d'T'H:m:s", "yyyy-M-d H:m", "yyyy-M-d", "MMM d, yyyy", "d MMM yyyy"]
    text = blank_to_null(trimmed(c))
    generic = F.coalesce(*[F.try_to_timestamp(text, F.lit(p)) for p in layouts]).cast("timestamp_ntz")
    return F.when(part(1) != "", stamped).otherwise(generic)


def clip(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


# fixed values: column widths of the stored tables
WIDTHS = {"fir_number": 100, "city": 100, "area": 200, "injury": 100, "name": 200, "type": 50, "number": 30,
          "driver_name": 200}


def clip_victims(c: Column) -> Column:
    return F.transform(c, lambda v: F.struct(
        clip(v["name"], WIDTHS["name"]).alias("name"), v["age"].alias("age"), v["gender"].alias("gender"),
        clip(v["injury"], WIDTHS["injury"]).alias("injury")))


def clip_vehicles(c: Column) -> Column:
    return F.transform(c, lambda v: F.struct(
        clip(v["type"], WIDTHS["type"]).alias("type"), clip(v["number"], WIDTHS["number"]).alias("number"),
        clip(v["driver_name"], WIDTHS["driver_name"]).alias("driver_name")))


def confidence(number, date, severity, cause, victims, vehicles, address) -> Column:
    """Share of the seven fields that were found, never below 0.1."""
    found = [
        number != "UNKNOWN", date != "UNKNOWN", severity != "Non-Fatal", cause != fv.CAUSE_PLACEHOLDER,
        F.size(victims) > 0, F.size(vehicles) > 0, ~address.isin("Unknown", ""),
    ]
    total = sum((f.cast("int") for f in found), F.lit(0))
    return F.greatest(F.round(total / F.lit(7.0), 2), F.lit(0.1))


def extract_report(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """Nested extraction record of every text; unreadable texts give marker records.

    Three projections - gate, fields, confidence - so each pattern runs once per text.
    """
    t, gate = F.col("_text"), F.col("_gate")
    df = df.select(*keep, F.col(text).alias("_text"), document_gate(F.col(text)).alias("_gate"))
    good = gate == "OK"
    pick = lambda value, empty, html: F.when(good, value).when(gate == "EMPTY", empty).otherwise(html)
    vehicles = F.transform(
        plates_from_text(t),
        lambda p: F.struct(F.lit("Unknown").alias("type"), p.alias("number"), F.lit("Unknown").alias("driver_name")),
    )
    base = df.select(
        *keep,
        pick(report_number(t), F.lit("UNKNOWN"), F.lit("INVALID_FILE")).alias("fir_number"),
        pick(date_token(t), F.lit("UNKNOWN"), F.lit("UNKNOWN")).alias("date_time"),
        pick(cause_from_text(t), F.lit("Could not extract text from PDF"),
             F.lit("Corrupt File (HTML/Error Page)")).alias("cause"),
        pick(severity_from_text(t), F.lit("Unknown"), F.lit("Unknown")).alias("severity"),
        pick(place(t), F.lit("Unknown"), F.lit("Unknown")).alias("_address"),
        F.when(good, victims_from_text(t)).otherwise(F.array()).alias("victims"),
        F.when(good, vehicles).otherwise(F.array()).alias("vehicles"),
        F.when(good, t).alias("raw_text"),
    )
    score = F.when(
        F.col("raw_text").isNull(), 0.0
    ).otherwise(confidence(*[F.col(c) for c in (
        "fir_number", "date_time", "severity", "cause", "victims", "vehicles", "_address")]))
    located = F.struct(
        F.col("_address").alias("address"),
        F.when(F.col("raw_text").isNotNull(), "Vijayawada").alias("area"),
        F.lit("Vijayawada").alias("city"),
        F.when(F.col("raw_text").isNotNull(), 16.5062).alias("lat"),
        F.when(F.col("raw_text").isNotNull(), 80.6480).alias("lng"),
    )
    return base.select(
        *keep, "fir_number", "date_time", "cause", "severity", located.alias("location"),
        "victims", "vehicles", score.alias("confidence_score"), "raw_text",
    )


def overlay(base: DataFrame, enriched: DataFrame, key: str) -> DataFrame:
    """Enriched fields win where present; touched records get confidence 0.95."""
    fields = ["fir_number", "date_time", "cause", "severity", "location", "victims", "vehicles"]
    present = [f for f in fields if f in enriched.columns and f in base.columns]
    e = enriched.select(key, *[F.col(f).alias(f"_e_{f}") for f in present], F.lit(True).alias("_hit"))
    joined = base.join(e, key, "left")
    for f in present:
        joined = joined.withColumn(f, F.coalesce(F.col(f"_e_{f}"), F.col(f)))
    score = F.when(F.col("_hit"), 0.95).otherwise(F.col("confidence_score"))
    return joined.withColumn("confidence_score", score).drop("_hit", *[f"_e_{f}" for f in present])


def chunks(text: Column, size: int = 4500) -> Column:
    """Fixed-size pieces of a text, in order."""
    count = F.ceil(F.length(text) / F.lit(size)).cast("int")
    starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(text, i * size + 1, F.lit(size)))


def script_share(text: Column, script: str = "Telugu") -> Column:
    """Share of the characters that belong to a Unicode script."""
    hits = F.regexp_count(text, F.lit(rf"\p{{Is{script}}}"))
    return F.coalesce(F.round(F.try_divide(hits.cast("double"), F.length(text).cast("double")), 4), F.lit(0.0))


def object_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9._-]", "_")


def object_key(url: Column, folder: str = "fir-pdfs") -> Column:
    """Key below the document folder of a stored url; other texts stay as they are."""
    piece = F.get(F.split(url, f"/{folder}/"), F.lit(1))
    return F.when(url.startswith(f"{folder}/"), url).otherwise(
        F.coalesce(F.concat(F.lit(f"{folder}/"), piece), url))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)
