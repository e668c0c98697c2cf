"""Drug labels: single-ingredient filter and information cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from larder.functions import text
from larder.operators import scale

MAX_CHARS = 1000


def single_ingredient(labels: DataFrame) -> DataFrame:
    """Drop combinations: ' and ' or '/' in the generic or brand names."""
    def plain(names: Column) -> Column:
        line = F.lower(text.join_or(names, ""))
        return ~(F.contains(line, F.lit(" and ")) | F.contains(line, F.lit("/")))

    return labels.filter(plain(F.col("openfda.generic_name")) & plain(F.col("openfda.brand_name")))


def _first_text(column: str, default: str) -> Column:
    first = F.when(F.col(column).isNull(), default).otherwise(F.get(column, F.lit(0)))
    return text.clip(first, MAX_CHARS)


def cards(labels: DataFrame, *carry: str) -> DataFrame:
    return labels.select(
        *carry, "label_id",
        *(text.join_or(F.col(f"openfda.{c}"), "N/A").alias(c)
          for c in ("generic_name", "brand_name", "route", "dosage_form")),
        _first_text("indications_and_usage", "Not specified.").alias("indications"),
        _first_text("adverse_reactions", "Not specified.").alias("side_effects"),
        _first_text("dosage_and_administration", "Not available.").alias("dosage"),
    )


def find_cards(labels: DataFrame, names: list[str]) -> DataFrame:
    """Card of the first single-ingredient label per searched generic name.

    Each label is matched against the given names in place, so nothing is joined.
    """
    line = F.lower(text.join_or(F.col("openfda.generic_name"), ""))
    hits = F.array_compact(F.array(*(F.when(F.contains(line, F.lit(n.lower())), F.lit(n)) for n in names)))
    matched = single_ingredient(labels).select("*", F.explode(hits).alias("search"))
    return cards(scale.first_per_key(matched, ["search"], [F.col("label_id")]), "search")
