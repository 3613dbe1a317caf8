"""Column expressions. Every helper returns a ``Column`` built from
``pyspark.sql.functions`` so it stays inside whole-stage code generation."""

from .text import (apply_aliases, normalise_district, normalise_state, pincode_region, strip,
                   title_case, valid_pincode, visible_blanks, whitespace_issue)
from .numeric import (coerce_count, finite_or_zero, floor_zero, parse_date, row_sum,
                      safe_ratio, month_start, month_label)
from .labels import (insight_summary, profile_field, risk_category, risk_explanation,
                     risk_reason, trend_status)

__all__ = [
    "apply_aliases", "normalise_district", "normalise_state", "pincode_region", "strip", "title_case",
    "valid_pincode", "visible_blanks", "whitespace_issue", "coerce_count", "finite_or_zero",
    "floor_zero", "parse_date", "row_sum", "safe_ratio", "month_start", "month_label",
    "insight_summary", "profile_field", "risk_category", "risk_explanation", "risk_reason",
    "trend_status",
]
