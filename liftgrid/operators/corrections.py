"""Multiple-testing corrections over a long table of test results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALPHA = 0.05


def benjamini_hochberg(
    results: DataFrame,
    alpha: float = ALPHA,
    family: Sequence[str] = ("experiment_id",),
    order: Sequence[str] = ("metric", "variant"),
) -> DataFrame:
    """Step-up false discovery control within each family of tests.

    Every row up to the largest rank i with p <= i/m * alpha is rejected. Undefined
    p-values count in m and are never rejected.
    """
    family_rows = Window.partitionBy(*family)
    ranked = family_rows.orderBy(F.col("p_value").asc_nulls_last(), *order)
    rank, total = F.col("p_rank"), F.col("n_tests")
    passing = F.when(F.col("p_value") <= rank / total * alpha, rank)
    return (
        results.withColumn("p_rank", F.row_number().over(ranked))
        .withColumn("n_tests", F.count(F.lit(1)).over(family_rows))
        .withColumn("last_rejected", F.coalesce(F.max(passing).over(family_rows), F.lit(0)))
        .withColumn("significant_corrected", rank <= F.col("last_rejected"))
        .drop("p_rank", "n_tests", "last_rejected")
    )


def bonferroni(
    results: DataFrame, alpha: float = ALPHA, family: Sequence[str] = ("experiment_id",)
) -> DataFrame:
    """Family-wise control: p <= alpha / m."""
    tests: Column = F.count(F.lit(1)).over(Window.partitionBy(*family))
    return results.withColumn(
        "significant_corrected",
        F.coalesce(F.col("p_value") <= F.lit(alpha) / tests, F.lit(False)),
    )


def check_method(method: str) -> None:
    if method not in ("benjamini_hochberg", "bonferroni"):
        raise ValueError(f"Unknown correction method: {method!r}")


def apply_corrections(
    results: DataFrame,
    method: str = "benjamini_hochberg",
    family: Sequence[str] = ("experiment_id",),
    order: Sequence[str] = ("metric", "variant"),
) -> DataFrame:
    check_method(method)
    if method == "bonferroni":
        return bonferroni(results, family=family)
    return benjamini_hochberg(results, family=family, order=order)


def rejection_summary(corrected: DataFrame, family: Sequence[str] = ("experiment_id",)) -> DataFrame:
    return corrected.groupBy(*family).agg(
        F.count_if("significant_corrected").alias("n_rejected"),
        F.count(F.lit(1)).alias("n_tests"),
    )
