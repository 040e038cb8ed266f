"""Text columns: normalization, case tests, display cleaning."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tablewright.functions.patterns import CONTROL_CHARACTERS


def strip(text: Column) -> Column:
    """Remove white space of every kind from both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(r"\S")


def normalize_text(text: Column) -> Column:
    """Comparison form of a text: lower case, stripped, punctuation dropped, white space collapsed."""
    plain = F.regexp_replace(strip(F.lower(text)), r"[^\p{L}\p{N}_\s]", "")
    return F.regexp_replace(plain, r"\s+", " ")


def is_upper(text: Column) -> Column:
    """At least one cased letter, and no lower-case one."""
    return (text == F.upper(text)) & (text != F.lower(text))


def is_lower(text: Column) -> Column:
    return (text == F.lower(text)) & (text != F.upper(text))


def is_mixed_case(text: Column) -> Column:
    """Both upper-case and lower-case letters."""
    return (text != F.upper(text)) & (text != F.lower(text))


def is_digits(text: Column) -> Column:
    """Digits only, once dots and dashes are taken out."""
    return F.regexp_replace(text, r"[.\-]", "").rlike(r"^[0-9]+$")


def display_text(text: Column, width: int = 100) -> Column:
    """Drop control characters and shorten to ``width``, ending in dots when shortened."""
    clean = F.regexp_replace(text, CONTROL_CHARACTERS, "")
    return F.when(F.length(clean) > width, F.concat(F.substring(clean, 1, width - 3), F.lit("..."))).otherwise(clean)
