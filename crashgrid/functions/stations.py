"""Police-station extraction from report headers and canonical station names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from crashgrid import fixed_values as fv
from crashgrid.functions.bands import let, trimmed


def _clean(c: Column) -> Column:
    c = F.regexp_replace(c, r"\s+", " ")
    c = F.regexp_replace(c, r"[|]+", " ")
    c = F.regexp_replace(c, fv.STATION_TAIL, "")
    return F.regexp_replace(F.trim(c), fv.STATION_EDGES, "")


def _usable(c: Column) -> Column:
    return let(c, lambda v: F.when(F.length(v) >= 2, v))


def extract_station(raw_text: Column) -> Column:
    """Station named in the text: labelled patterns first, then a scan of its lines."""
    head = F.regexp_replace(raw_text, "\r", "")
    labelled = [_usable(_clean(F.regexp_extract(head, p, 1))) for p in fv.STATION_PATTERNS]

    lines = F.transform(F.split(head, "\n"), trimmed)
    named = F.filter(
        lines,
        lambda x: x.rlike(fv.STATION_LINE)
        & ~x.rlike(fv.STATION_LINE_SKIP[0]) & ~x.rlike(fv.STATION_LINE_SKIP[1]),
    )
    scanned = F.transform(named, lambda x: _clean(F.regexp_replace(x, fv.STATION_LINE_PREFIX, "")))
    first = F.get(F.filter(scanned, lambda x: F.length(x) >= 2), F.lit(0))
    return F.coalesce(*labelled, first)


def normalise_station(name: Column) -> Column:
    c = F.upper(F.coalesce(name, F.lit("")))
    c = F.regexp_replace(c, r"[|.,]", " ")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def station_from_name(name: Column) -> Column:
    """Canonical station of an extracted name: the first matching rule, else null."""

    def rules(text):
        out = F
        for pattern, station in fv.STATION_RULES:
            hit = text.rlike(pattern) if "\\" in pattern or "|" in pattern else text.contains(pattern)
            out = out.when(hit, station)
        return out

    return let(normalise_station(name), rules)


def canonical_station(raw_text: Column) -> Column:
    return station_from_name(extract_station(raw_text))
