"""Text columns of result tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Display texts (fixed values).
SRM_BAD = (
    "⚠️ Sample Ratio Mismatch detected! Randomization may be broken. "
    "Do NOT act on these results."
)
SRM_GOOD = "✅ No Sample Ratio Mismatch — randomization looks correct."
SIGNIFICANT = "✅ Significant"
NOT_SIGNIFICANT = "❌ Not significant"
NOT_AVAILABLE = "N/A"
METHOD_LABELS = {"benjamini_hochberg": "BH", "bonferroni": "Bonferroni"}


def _decimal(value: Column, digits: int) -> Column:
    """Fixed-point text; ties are decided on the exact binary value, then half to even."""
    return F.translate(F.format_number(value, digits), ",", "")


def _signed(value: Column, digits: int) -> Column:
    sign = F.when(value >= 0, F.lit("+")).otherwise(F.lit(""))
    return F.concat(sign, _decimal(value, digits))


def format_lift(lift: Column) -> Column:
    """0.023 as ``+2.3%``."""
    return F.coalesce(F.concat(_signed(lift * 100, 1), F.lit("%")), F.lit(NOT_AVAILABLE))


def format_p_value(p_value: Column) -> Column:
    return F.when(p_value < 0.001, F.lit("p < 0.001")).otherwise(
        F.coalesce(F.concat(F.lit("p = "), _decimal(p_value, 3)), F.lit(NOT_AVAILABLE))
    )


def format_ci(lower: Column, upper: Column) -> Column:
    return F.coalesce(
        F.concat(F.lit("["), _signed(lower, 4), F.lit(", "), _signed(upper, 4), F.lit("]")),
        F.lit(NOT_AVAILABLE),
    )


def significance_label(significant: Column, method: str = "BH") -> Column:
    return F.when(significant, F.lit(f"{SIGNIFICANT} ({method})")).otherwise(
        F.lit(NOT_SIGNIFICANT)
    )


def srm_color(srm_detected: Column) -> Column:
    return F.when(srm_detected, F.lit("red")).otherwise(F.lit("green"))


def srm_message(srm_detected: Column) -> Column:
    return F.when(srm_detected, F.lit(SRM_BAD)).otherwise(F.lit(SRM_GOOD))
