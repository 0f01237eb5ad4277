"""Views over results: display table and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftgrid.functions.display import (
    METHOD_LABELS,
    format_ci,
    format_lift,
    format_p_value,
    significance_label,
    srm_color,
    srm_message,
)

ADJUSTMENT_LIMIT = 0.01


def decision_view(
    tests: DataFrame, srm: DataFrame, method: str = "benjamini_hochberg"
) -> DataFrame:
    """Display table of corrected tests with the split banner of their experiment."""
    return tests.join(srm.select("experiment_id", "srm_detected"), "experiment_id", "left").select(
        "experiment_id", "variant", "metric",
        format_p_value(F.col("p_value")).alias("p_value_text"),
        format_lift(F.col("absolute_lift")).alias("absolute_lift_text"),
        format_lift(F.col("relative_lift")).alias("relative_lift_text"),
        format_ci(F.col("ci_lower"), F.col("ci_upper")).alias("ci_text"),
        significance_label(F.col("significant_corrected"), METHOD_LABELS[method]).alias(
            "significance"
        ),
        srm_color(F.col("srm_detected")).alias("srm_color"),
        srm_message(F.col("srm_detected")).alias("srm_message"),
    )


def propensity_verdict(adjusted: DataFrame) -> DataFrame:
    """Marks experiments whose lift moves by more than a point under weighting."""
    return adjusted.withColumn(
        "adjustment_warning", F.col("adjustment_magnitude") > ADJUSTMENT_LIMIT
    )
