"""Names: what makes two equal, and their parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_name(name: Column) -> Column:
    """Lower case, letters and digits only. A capital sigma is lowered as a letter of its own, not by its place in the word."""
    return F.regexp_replace(F.lower(F.replace(name, F.lit("Σ"), F.lit("σ"))), r"[^\p{L}\p{Nd}]", "")


def normalize_sql_name(name: Column) -> Column:
    """A dotted SQL name with the quotes of each part removed."""
    return F.array_join(F.transform(F.split(name, r"\."), lambda p: F.regexp_replace(F.trim(p), r'^[`"\[\]]+|[`"\[\]]+$', "")), ".")


def table_leaf_name(name: Column) -> Column:
    return F.element_at(F.split(normalize_sql_name(name), r"\."), -1)


def line_locator(start: Column, end: Column) -> Column:
    return F.format_string("L%d-L%d", start, end)


def is_http_token(method: Column) -> Column:
    return method.rlike(r"^[!#$%&'*+.^_`|~0-9A-Za-z-]+$")


def is_valid_string(value: Column, most: int) -> Column:
    """Of at most so many bytes, without NUL, not blank."""
    return (F.octet_length(value) <= most) & (F.instr(value, "\x00") == 0) & (F.length(F.trim(value)) > 0)
