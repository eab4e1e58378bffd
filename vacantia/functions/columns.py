"""Small column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(c: Column, digits: int = 2) -> Column:
    """Rounded half up."""
    return F.round(c, digits)


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """Part of a whole in percent, null for an empty whole."""
    return F.round(F.try_divide(part * F.lit(100.0), whole.cast("double")), digits)
