"""Banding, ranking and rounding expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from crashgrid import fixed_values as fv


def age_band(age: Column) -> Column:
    """Age band label; negative or missing ages are 'Unknown'."""
    out = F
    for label, low, high in fv.AGE_BANDS:
        out = out.when(age.between(low, high), label)
    return out.when(age > 50, "50+").otherwise("Unknown")


def time_slot(ts: Column) -> Column:
    """Four-hour slot label of a timestamp."""
    out = F
    for label, start, end in fv.TIME_SLOTS:
        out = out.when(F.hour(ts).between(start, end), label)
    return out.otherwise("Unknown")


def lookup(c: Column, table: dict, default) -> Column:
    """Small constant lookup as a CASE expression."""
    out = F
    for key, value in table.items():
        out = out.when(c == key, F.lit(value))
    return out.otherwise(F.lit(default))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """100 * part / whole rounded half up, 0 where the whole is empty."""
    return F.coalesce(
        F.round(F.try_divide(part.cast("double") * 100.0, whole.cast("double")), digits), F.lit(0.0)
    )


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def severity_rank(c: Column) -> Column:
    """Rank of a severity in the list view; labels outside the table sort last."""
    return lookup(c, fv.SORT_RANK, 5)


def risk_level(score: Column) -> Column:
    return (
        F.when(score >= 70, "Critical").when(score >= 40, "High").when(score >= 20, "Medium")
        .otherwise("Low")
    )


def danger_level(score: Column) -> Column:
    return F.when(score >= 5, "Critical").when(score >= 3, "High").otherwise("Medium")


def trimmed(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.transform(F.array(value), body)[0]


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def found(c: Column) -> Column:
    """Same as :func:`blank_to_null` for costly expressions: evaluated once."""
    return let(c, blank_to_null)


def contains_any(c: Column, words) -> Column:
    """Whether a lower-cased text contains one of the words; much cheaper than a pattern."""
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def initial_caps(c: Column) -> Column:
    """Upper-case the first letter of every alphanumeric run, lower-case the rest."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"), F.lit(0))
    capitalised = F.transform(parts, lambda p: F.concat(F.upper(p.substr(1, 1)), F.substring(p, 2, 2147483647)))
    return F.array_join(capitalised, "")
