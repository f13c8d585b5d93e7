"""Cleaning of all-text release columns into typed values.

Bad text becomes NULL, never an error and never NaN.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words the publisher writes for a missing value.
MISSING_TOKENS = ("Not Available", "Not Applicable", "", "N/A", "NA", "*")
NOT_AVAILABLE = "Not Available"

# Characters a plain decimal or scientific number can hold. Anything else
# ("NaN", "Infinity", "5d", hex) would still pass a double cast on the JVM; the int
# and decimal casts take none of these and need no guard.
NUMBER_CHARS = "0123456789+-.eE"
BLANKS = " \t\r\n"

WORSE_COUNTS = {
    "mort": "count_mort_measures_worse",
    "safety": "count_safety_measures_worse",
    "readm": "count_readm_measures_worse",
}
BETTER_COUNTS = {
    "mort": "count_mort_measures_better",
    "safety": "count_safety_measures_better",
    "readm": "count_readm_measures_better",
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Remove blanks, tabs and line ends on both sides."""
    return F.btrim(_col(c), F.lit(BLANKS))


def num(c: Column | str, dtype: str = "double") -> Column:
    """Safe cast of text to a number: int, double or decimal(p,s).

    Decimal text in an ``int`` cast is NULL, and so is a number too large for a double.
    """
    if dtype not in ("double", "float"):
        return _col(c).try_cast(dtype)
    text = strip(c)
    value = text.try_cast(dtype)
    return F.when((F.translate(text, NUMBER_CHARS, "") == "") & (F.abs(value) < float("inf")), value)


def to_num(c: Column | str) -> Column:
    """Text to double; every missing word becomes NULL."""
    return num(c, "double")


def _stored(df: DataFrame | None, column: str, kind: str) -> Column | None:
    """The typed companion a clean table keeps next to a text column (see plans.ingest)."""
    name = f"{column}__{kind}"
    return F.col(name) if df is not None and name in df.columns else None


def number(df: DataFrame | None, column: str, kind: str = "double") -> Column:
    """Typed value of a text column: the stored companion, else a safe cast."""
    stored = _stored(df, column, kind)
    return num(column, kind) if stored is None else stored


def rating(df: DataFrame | None = None, column: str = "overall_rating") -> Column:
    """Star rating: read as decimal(3,1), carried as double."""
    stored = _stored(df, column, "rating")
    return num(column, "decimal(3,1)").cast("double") if stored is None else stored


def worse(group: str, df: DataFrame | None = None) -> Column:
    """Worse-than-average measure count of one group, as int."""
    return number(df, WORSE_COUNTS[group], "int")


def better(group: str, df: DataFrame | None = None) -> Column:
    """Better-than-average measure count of one group, as int."""
    return number(df, BETTER_COUNTS[group], "int")


def fold(c: Column | str) -> Column:
    """Key under which two texts count as equal: case and outer blanks ignored."""
    return F.lower(F.trim(_col(c)))


def same_text(c: Column | str, value: str) -> Column:
    """Case-insensitive equality with a literal."""
    return fold(c) == value.strip().lower()


def text_is(df: DataFrame, column: str, value: str) -> Column:
    """``same_text`` that compares the stored key of a clean table, so the filter reaches the scan."""
    stored = _stored(df, column, "key")
    return same_text(column, value) if stored is None else stored == value.strip().lower()


def is_missing(c: Column | str) -> Column:
    """NULL or one of the missing words, in any letter case."""
    return _col(c).isNull() | fold(c).isin([t.lower() for t in MISSING_TOKENS])


def zero_if_null(c: Column | str) -> Column:
    return F.coalesce(_col(c), F.lit(0))


def row_sum0(cols: list[Column | str]) -> Column:
    """Sum across columns of one row; NULL counts as 0."""
    return reduce(add, [zero_if_null(c) for c in cols])


def composite_risk(df: DataFrame | None = None) -> Column:
    """Worse counts of the three groups added up; a missing count adds 0."""
    return row_sum0([worse(g, df) for g in WORSE_COUNTS])


def yes_flag(c: Column | str) -> Column:
    """1 for exactly ``Yes``, else 0, also for missing."""
    return F.coalesce(strip(c) == "Yes", F.lit(False)).cast("int")


def underperformer_flag(overall_rating: Column | str, worse_total: Column | str) -> Column:
    """1 when rated 2 or lower, or any measure is worse; a missing rating alone is 0."""
    low = F.coalesce(_col(overall_rating) <= 2, F.lit(False))
    bad = F.coalesce(_col(worse_total) > 0, F.lit(False))
    return (low | bad).cast("int")


def pick(df: DataFrame, *names: str, dtype: str = "string") -> Column:
    """First of ``names`` the frame has; a typed NULL when it has none."""
    for name in names:
        if name in df.columns:
            return df[f"`{name}`"]
    return F.lit(None).cast(dtype)


def pick_num(df: DataFrame, *names: str) -> Column:
    """Numeric form of ``pick``."""
    return to_num(pick(df, *names))
