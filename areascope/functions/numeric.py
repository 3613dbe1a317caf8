"""Numeric and date expressions with null / zero guards (ANSI mode safe)."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_date(c, fmt: str = "d-M-yyyy") -> Column:
    """Parse day-month-year text; unparsable or impossible dates become null."""
    parsed = F.try_to_date(_col(c), fmt)
    if fmt != "d-M-yyyy":
        return parsed
    # Two-digit days and months, which nearly all dates have, need no pattern parser (it throws for impossible dates).
    text = _col(c).cast("string")
    iso = F.concat(F.substring(text, 7, 4), F.lit("-"), F.substring(text, 4, 2), F.lit("-"), F.substring(text, 1, 2))
    return F.when(text.rlike(r"^[0-9]{2}-[0-9]{2}-(?!0000)[0-9]{4}\z"), iso.try_cast("date")).otherwise(parsed)


def coerce_count(c) -> Column:
    """Text count -> integer: unparsable -> 0, fractions truncated toward zero."""
    text = _col(c).cast("string")
    # Java's parser also takes type suffixes ('12d', '7f'), which are no numbers here.
    d = F.when(text.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), text.try_cast("double"))
    d = F.when(F.isnan(d) | (F.abs(d) == float("inf")), None).otherwise(d)
    # Short numbers that begin and end with a digit, which nearly all counts are, need neither pattern nor double.
    last = F.right(text, F.lit(1))
    short = (text >= "0") & (text < ":") & (last >= "0") & (last < ":") & (F.octet_length(text) <= 15)
    return F.coalesce(F.when(short, text.try_cast("bigint")), F.coalesce(d, F.lit(0.0)).cast("bigint"))


def safe_ratio(x, d) -> Column:
    """x / d with a zero denominator replaced by 1 (the original's guard)."""
    den = _col(d)
    return _col(x) / F.when(den == 0, F.lit(1)).otherwise(den)


def row_sum(cols) -> Column:
    """Sum across columns, nulls counted as 0."""
    return reduce(add, [F.coalesce(_col(c), F.lit(0)) for c in cols])


def finite_or_zero(c) -> Column:
    """NaN, +-inf and null -> 0.0."""
    v = _col(c).cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(0.0)).otherwise(v)


def floor_zero(c) -> Column:
    """Negative values -> 0, nulls stay null."""
    v = _col(c)
    return F.when(v.isNotNull(), F.greatest(v, F.lit(0)))


def month_start(ym) -> Column:
    """'yyyy-MM' text -> first day of that month."""
    return F.to_date(F.concat(_col(ym), F.lit("-01")))


def month_label(ym) -> Column:
    """'yyyy-MM' -> 'MMMM yyyy' (e.g. 'March 2025')."""
    return F.date_format(month_start(ym), "MMMM yyyy")
