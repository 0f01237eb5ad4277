"""Long table of metric tests: one row per experiment, treatment arm and metric."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftgrid.functions.binding import let
from liftgrid.operators.corrections import apply_corrections
from liftgrid.operators.frequentist import two_proportion_z, welch_t
from liftgrid.operators.metrics import METRICS


def _rate_test(metric: str, successes: str, alpha: float) -> Column:
    test = two_proportion_z(
        F.col("control_n_users"), F.col(f"control_{successes}"),
        F.col("treatment_n_users"), F.col(f"treatment_{successes}"), alpha,
    )
    return _row(metric, test, "z_stat", "absolute_lift", "relative_lift")


def _mean_test(metric: str, measure: str, alpha: float) -> Column:
    test = welch_t(
        F.col("control_n_users"), F.col(f"control_mean_{measure}"),
        F.col(f"control_var_{measure}"), F.col("treatment_n_users"),
        F.col(f"treatment_mean_{measure}"), F.col(f"treatment_var_{measure}"), alpha,
    )
    return _row(metric, test, "t_stat", None, None)


def _row(metric: str, test: Column, statistic: str, lift: str | None, relative: str | None) -> Column:
    def row(s: Column) -> Column:
        test = s["test"]
        nothing = F.lit(None).cast("double")
        return F.struct(
            F.lit(metric).alias("metric"),
            test[statistic].alias("statistic"),
            test["p_value"].alias("p_value"),
            test["significant"].alias("significant"),
            (test[lift] if lift else nothing).alias("absolute_lift"),
            (test[relative] if relative else nothing).alias("relative_lift"),
            test["ci_lower"].alias("ci_lower"),
            test["ci_upper"].alias("ci_upper"),
        )

    return let(row, test=test)


def check_metrics(metrics: Sequence[str]) -> None:
    unknown = [m for m in metrics if m not in METRICS]
    if unknown:
        raise ValueError(f"Unknown metrics: {unknown}")


def metric_tests(metrics: Sequence[str] = METRICS, alpha: float = 0.05) -> Column:
    """The tests of a row of pairs, one struct per metric."""
    check_metrics(metrics)
    tests = {
        "conversion_rate": lambda: _rate_test("conversion_rate", "n_converters", alpha),
        "revenue_per_user": lambda: _mean_test("revenue_per_user", "revenue", alpha),
        "add_to_cart_rate": lambda: _rate_test("add_to_cart_rate", "n_carted", alpha),
    }
    return F.array(*[tests[m]() for m in metrics])


def run_tests(
    pairs: DataFrame,
    metrics: Sequence[str] = METRICS,
    method: str = "benjamini_hochberg",
    alpha: float = 0.05,
) -> DataFrame:
    """All tests of all experiments, corrected over each experiment's (metric, arm) rows."""
    rows = pairs.select(
        "experiment_id", "control", "variant", F.explode(metric_tests(metrics, alpha)).alias("test")
    ).select("experiment_id", "control", "variant", "test.*")
    return apply_corrections(rows, method)
