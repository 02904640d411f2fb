"""Lenient JSON reading and access to semi-structured analysis records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from crashgrid.functions.bands import blank_to_null

REPORT_FIELDS = ["summary", "key_insights", "policy_recommendations", "public_awareness_suggestions"]
LIST_FIELDS = REPORT_FIELDS[1:]


def lenient_json(text: Column) -> Column:
    """Variant of the text itself, of the text without code fences, or of its outermost braces."""
    unfenced = F.trim(F.regexp_replace(F.regexp_replace(text, r"(?i)```json\s*", ""), r"```\s*", ""))
    braces = blank_to_null(F.regexp_extract(text, r"(?s)\{.*\}", 0))
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(unfenced), F.try_parse_json(braces))


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def report_fields(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """Report fields of a JSON text; a scalar in a list field becomes a one-element list.

    ``valid`` is false where a required field is absent, empty, zero or false.
    """
    staged = df.select(*keep, lenient_json(F.col(text)).alias("_v"))
    v = F.col("_v")

    def present(name):
        return ~F.coalesce(_text(v, f"$.{name}"), F.lit("")).isin("", "0", "false")

    def as_list(name):
        items = F.try_variant_get(v, f"$.{name}", "array<string>")
        scalar = _text(v, f"$.{name}")
        return F.coalesce(items, F.when(scalar.isNotNull(), F.array(scalar)))

    valid = present(REPORT_FIELDS[0])
    for name in LIST_FIELDS:
        valid = valid & present(name)
    return staged.select(
        *keep, _text(v, "$.summary").alias("summary"), *[as_list(n).alias(n) for n in LIST_FIELDS],
        F.coalesce(valid, F.lit(False)).alias("valid"),
    )


def analysis_fields(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """Fields of a stored analysis record; ``legal_analysis`` may be a text or an object."""
    staged = df.select(*keep, F.try_parse_json(F.col(column)).alias("_v"))
    v = F.col("_v")
    plain = F.schema_of_variant(F.try_variant_get(v, "$.legal_analysis", "variant")) == "STRING"
    return staged.select(
        *keep, _text(v, "$.summary").alias("summary"),
        F.try_variant_get(v, "$.risk_score", "double").alias("risk_score"),
        F.try_variant_get(v, "$.contributing_factors", "array<string>").alias("contributing_factors"),
        F.when(plain, _text(v, "$.legal_analysis")).alias("legal_text"),
        _text(v, "$.legal_analysis.applicable_sections").alias("applicable_sections"),
        _text(v, "$.legal_analysis.charges_explanation").alias("charges_explanation"),
        _text(v, "$.legal_analysis.penalty_range").alias("penalty_range"),
        _text(v, "$.recommendations.engineering").alias("engineering"),
        _text(v, "$.recommendations.enforcement").alias("enforcement"),
        _text(v, "$.recommendations.education").alias("education"),
    )
