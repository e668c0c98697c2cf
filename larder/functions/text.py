"""Text column builders."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Every blank that str.split() and str.strip() know; all lie below U+3001.
BLANKS = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())

# The Unicode-aware class knows the same blanks but for four control characters, and is far
# faster than listing them.
TOKEN = r"(?U)[^\s\x1c-\x1f]+"


def strip(col: Column) -> Column:
    """Trim every kind of blank (plain `trim` only drops U+0020)."""
    return F.btrim(col, F.lit(BLANKS))


def token_count(col: Column) -> Column:
    """Number of blank-separated tokens."""
    return F.regexp_count(col, F.lit(TOKEN))


def slug(col: Column) -> Column:
    """Storage-safe recipe key: trimmed, lower case, blanks and slashes to `_`."""
    return F.translate(F.lower(strip(col)), " /", "__")


def contains_ci(col: Column, needle: Column | str) -> Column:
    """Case-insensitive substring test; `%` and `_` are ordinary characters."""
    return F.contains(F.lower(col), F.lower(needle if isinstance(needle, Column) else F.lit(needle)))


def conform(col: Column) -> Column:
    return F.lower(strip(col))


def url_without_query(col: Column) -> Column:
    return F.split_part(col, F.lit("?"), F.lit(1))


def base_name(col: Column) -> Column:
    return F.element_at(F.split(col, "/"), -1)


def without_extension(col: Column) -> Column:
    """Drop the last extension; a leading dot does not start one."""
    return F.regexp_replace(col, r"(?<=[^/.])\.[^./]*$", "")


def file_prefix(col: Column) -> Column:
    """The part of a file name before its first underscore."""
    return F.split_part(col, F.lit("_"), F.lit(1))


def clip(col: Column, size: int) -> Column:
    return F.substring(col, 1, size)


def preview(col: Column, size: int = 200) -> Column:
    """First `size` characters, with an ellipsis only if something was cut."""
    return F.when(F.length(col) > size, F.concat(clip(col, size), F.lit("..."))).otherwise(col)


def title_words(col: Column) -> Column:
    """`saturated_g` -> `Saturated G`."""
    return F.initcap(F.replace(col, F.lit("_"), F.lit(" ")))


def join_or(col: Column, default: str, sep: str = ", ") -> Column:
    """Join an array of strings; a missing array reads as one default entry."""
    return F.array_join(F.coalesce(col, F.array(F.lit(default))), sep)


def seeded_order(seed: int, *cols: Column) -> Column:
    """Sort key that shuffles rows the same way for the same seed, on any engine."""
    return F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *cols)), 1, 16)


def non_blank(col: Column) -> Column:
    return col.isNotNull() & (col != "")


def zip_is_valid(col: Column) -> Column:
    """Five digits with an optional four-digit extension; a missing code is invalid."""
    return F.coalesce(col.rlike(r"^[0-9]{5}(-[0-9]{4})?$"), F.lit(False))
