"""Small column builders: text clean-up, guarded division, value types."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def upper_collapsed(text: Column) -> Column:
    """Upper case, every whitespace run to one blank, trimmed; empty becomes null."""
    return F.nullif(F.trim(F.regexp_replace(F.upper(text), r"(?U)\s+", " ")), F.lit(""))


def trimmed_or_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def is_administrative(code: Column, exact: Sequence[str], patterns: Sequence[str]) -> Column:
    """True for charge and fee codes: an exact list, or a pattern anchored at the start."""
    key = F.trim(F.upper(code))
    hit = key.isin([value.strip().upper() for value in exact])
    for pattern in patterns:
        body = pattern[1:] if pattern.startswith("^") else pattern
        hit = hit | key.rlike(f"(?i)^(?:{body})")
    return F.coalesce(hit, F.lit(False))


def ratio(numerator: Column, denominator: Column, default: float | None = 0.0) -> Column:
    """Double division; a zero or null denominator gives ``default``."""
    value = F.try_divide(numerator.cast("double"), F.nullif(denominator.cast("double"), F.lit(0.0)))
    return value if default is None else F.coalesce(value, F.lit(default))


def r6(column: Column) -> Column:
    return F.round(column.cast("double"), 6)


def flag_count(column: Column) -> Column:
    return F.count_if(column).cast("bigint")


def line_value(quantity: Column, price: Column) -> Column:
    """Quantity times price as exact money, so sums do not depend on the order of tasks."""
    return (quantity.cast("decimal(12,0)") * price.cast("decimal(18,4)")).cast("decimal(18,4)")
