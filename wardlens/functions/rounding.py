"""Rounding that does not depend on the order in which doubles were added.

A mean of the same rows can differ in its last bits between two runs. Passing
through a decimal with nine places removes that noise, so a value on a rounding
tie always goes the same way.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EXACT = "decimal(28,9)"
_WHOLE = 1e18  # doubles from here on have no decimal places, so rounding leaves them as they are


def _rounded(c: Column | str, rule, digits: int) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    value = c.cast("double")
    return F.when(F.abs(value) < _WHOLE, rule(c.cast(_EXACT), digits).cast("double")).otherwise(value)


def half_up(c: Column | str, digits: int) -> Column:
    """Ties away from zero (SQL ROUND)."""
    return _rounded(c, F.round, digits)


def half_even(c: Column | str, digits: int) -> Column:
    """Ties to the even digit (numpy and Python rounding)."""
    return _rounded(c, F.bround, digits)
