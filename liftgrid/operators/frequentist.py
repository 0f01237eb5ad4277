"""Two-sample tests, power and novelty on sufficient statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from liftgrid.functions.binding import let
from liftgrid.functions.distributions import (
    detectable_shift,
    normal_quantile,
    normal_two_sided,
    student_critical,
    student_two_sided,
)

NOVELTY_ALPHA = 0.05


def _significant(p_value: Column, alpha: float) -> Column:
    return F.coalesce(p_value < alpha, F.lit(False))


def _users(count: Column) -> Column:
    """A sample size to divide by; an empty arm gives NULL."""
    return F.nullif(count.cast("double"), F.lit(0.0))


def spread_struct(df: DataFrame, struct: Column) -> DataFrame:
    """``df`` with the fields of ``struct`` as further columns."""
    return df.withColumn("_fields", struct).select("*", "_fields.*").drop("_fields")


def two_proportion_z(
    n_control: Column, conv_control: Column, n_treatment: Column, conv_treatment: Column,
    alpha: float = 0.05,
) -> Column:
    """Pooled z-test of two rates; the interval on the lift uses the unpooled error.

    The statistic is NULL, and nothing significant, when nobody or everybody converts.
    """

    def test(s: Column) -> Column:
        n_c, x_c, n_t, x_t = s["n_c"], s["x_c"], s["n_t"], s["x_t"]
        rate_c, rate_t = F.try_divide(x_c, n_c), F.try_divide(x_t, n_t)
        pooled = F.try_divide(x_c + x_t, n_c + n_t)
        return let(
            report,
            rate_c=rate_c,
            lift=rate_t - rate_c,
            z=F.try_divide(
                rate_t - rate_c, F.sqrt(pooled * (1 - pooled) * (1 / n_c + 1 / n_t))
            ),
            half=normal_quantile(1 - alpha / 2)
            * F.sqrt(rate_c * (1 - rate_c) / n_c + rate_t * (1 - rate_t) / n_t),
        )

    def report(s: Column) -> Column:
        rate_c, lift, half = s["rate_c"], s["lift"], s["half"]
        return let(
            lambda b: F.struct(
                s["z"].alias("z_stat"),
                b["p"].alias("p_value"),
                F.when(rate_c > 0, lift / rate_c).otherwise(F.lit(0.0)).alias("relative_lift"),
                lift.alias("absolute_lift"),
                (lift - half).alias("ci_lower"),
                (lift + half).alias("ci_upper"),
                _significant(b["p"], alpha).alias("significant"),
            ),
            p=normal_two_sided(s["z"]),
        )

    return let(
        test,
        n_c=_users(n_control), x_c=conv_control.cast("double"),
        n_t=_users(n_treatment), x_t=conv_treatment.cast("double"),
    )


def welch_statistic(
    n_a: Column, mean_a: Column, var_a: Column, n_b: Column, mean_b: Column, var_b: Column
) -> tuple[Column, Column, Column]:
    """t of mean_a - mean_b, its Welch-Satterthwaite df and the standard error.

    Without any variance the t of different means is infinite, of equal means NULL.
    """
    share_a, share_b = var_a / n_a, var_b / n_b
    error2 = share_a + share_b
    df = F.try_divide(
        error2 * error2, share_a * share_a / (n_a - 1) + share_b * share_b / (n_b - 1)
    )
    error = F.sqrt(error2)
    difference = mean_a - mean_b
    t = F.when(
        (error2 == 0) & (difference != 0), F.signum(difference) * F.lit(float("inf"))
    ).otherwise(F.try_divide(difference, error))
    return t, df, error


def welch_p_value(t: Column, df: Column) -> Column:
    return F.when(F.abs(t) == float("inf"), F.lit(0.0)).otherwise(student_two_sided(t, df))


def welch_t(
    n_control: Column, mean_control: Column, var_control: Column,
    n_treatment: Column, mean_treatment: Column, var_treatment: Column,
    alpha: float = 0.05,
) -> Column:
    """Welch's t-test from counts, means and sample variances.

    ``ci_lower``/``ci_upper`` use n1+n2-2 degrees of freedom; the ``_welch`` interval uses
    those of the test itself and never contradicts ``significant``.
    """

    def test(s: Column) -> Column:
        t, df, error = welch_statistic(
            s["n_t"], s["mean_t"], s["var_t"], s["n_c"], s["mean_c"], s["var_c"]
        )
        return let(
            tails,
            t=t,
            df=df,
            error=error,
            df_total=s["n_c"] + s["n_t"] - 2,
            difference=s["mean_t"] - s["mean_c"],
            pooled_std=F.sqrt((s["var_c"] + s["var_t"]) / 2),
        )

    def tails(s: Column) -> Column:
        return let(
            lambda b: F.struct(
                s["t"].alias("t_stat"),
                b["p"].alias("p_value"),
                F.coalesce(F.try_divide(s["difference"], s["pooled_std"]), F.lit(0.0)).alias(
                    "cohens_d"
                ),
                (s["difference"] - b["half"]).alias("ci_lower"),
                (s["difference"] + b["half"]).alias("ci_upper"),
                (s["difference"] - b["half_welch"]).alias("ci_lower_welch"),
                (s["difference"] + b["half_welch"]).alias("ci_upper_welch"),
                _significant(b["p"], alpha).alias("significant"),
            ),
            p=welch_p_value(s["t"], s["df"]),
            half=student_critical(alpha, s["df_total"]) * s["error"],
            half_welch=student_critical(alpha, s["df"]) * s["error"],
        )

    n_c, n_t = _users(n_control), _users(n_treatment)
    return let(
        test,
        n_c=n_c, mean_c=mean_control, var_c=F.when(n_c > 1, var_control),
        n_t=n_t, mean_t=mean_treatment, var_t=F.when(n_t > 1, var_treatment),
    )


def two_proportion_z_test(pairs: DataFrame, successes: str, alpha: float = 0.05) -> DataFrame:
    """z-test of ``successes`` (``n_converters`` or ``n_carted``) on paired arms."""
    return spread_struct(
        pairs,
        two_proportion_z(
            F.col("control_n_users"), F.col(f"control_{successes}"),
            F.col("treatment_n_users"), F.col(f"treatment_{successes}"), alpha,
        ),
    )


def two_sample_t_test(pairs: DataFrame, measure: str = "revenue", alpha: float = 0.05) -> DataFrame:
    """Welch's t-test of ``mean_<measure>`` on paired arms."""
    return spread_struct(
        pairs,
        welch_t(
            F.col("control_n_users"), F.col(f"control_mean_{measure}"),
            F.col(f"control_var_{measure}"), F.col("treatment_n_users"),
            F.col(f"treatment_mean_{measure}"), F.col(f"treatment_var_{measure}"), alpha,
        ),
    )


def sample_stats(values: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """Count, mean and variance per group: raw samples to t-test inputs."""
    return values.groupBy(*by).agg(
        F.count(value).alias("n_users"),
        F.avg(value).alias(f"mean_{value}"),
        F.var_samp(value).alias(f"var_{value}"),
    )


def minimum_detectable_effect(
    n_control: Column, n_treatment: Column, baseline: Column,
    alpha: float = 0.05, power: float = 0.8,
) -> Column:
    """Smallest upward change of a rate the two arms can detect, and whether it was capped.

    Arms so small that the detectable rate would pass 1 report the distance to 1.
    """
    h = detectable_shift(alpha, power) * F.sqrt(1 / _users(n_control) + 1 / _users(n_treatment))

    def effect(s: Column) -> Column:
        reached = F.sin(F.least(s["angle"], F.lit(math.pi / 2)))
        return F.struct(
            F.abs(reached * reached - s["rate"]).alias("mde"),
            (s["angle"] > math.pi / 2).alias("mde_capped"),
        )

    return let(effect, angle=F.asin(F.sqrt(baseline)) + h / 2, rate=baseline)


def required_sample_size(
    baseline: Column, mde: Column, alpha: float = 0.05, power: float = 0.8
) -> Column:
    """Users per arm to detect an absolute change ``mde``; NULL if the rate would pass 1."""
    target = baseline + mde
    possible = (target >= 0) & (target <= 1)
    h = 2 * F.asin(F.sqrt(baseline)) - 2 * F.asin(F.sqrt(F.when(possible, target)))
    shift = detectable_shift(alpha, power)
    return F.ceil(2 * F.try_divide(F.lit(shift * shift), h * h)).cast("bigint")


def novelty_effect_test(
    daily: DataFrame,
    window_days: int = 7,
    by: Sequence[str] = ("experiment_id", "variant"),
    control: str | Column = "control",
) -> DataFrame:
    """Are the first ``window_days`` daily rates of a treatment arm above the later ones?

    One-sided Welch test per arm; the split is by row, not by calendar gap. Days are few,
    so each arm's window holds a bounded number of rows.
    """
    order = Window.partitionBy(*by).orderBy("date")
    control = F.lit(control) if isinstance(control, str) else control
    early = F.col("day") <= window_days
    rate = F.col("conversion_rate")

    def part(name: str, rows: Column) -> list[Column]:
        kept = F.when(rows, rate)
        return [
            F.count(kept).cast("double").alias(f"{name}_n"),
            F.avg(kept).alias(f"{name}_mean"),
            F.var_samp(kept).alias(f"{name}_var"),
        ]

    stats = (
        daily.withColumn("_control", control)
        .filter(F.col("variant") != F.col("_control"))
        .withColumn("day", F.row_number().over(order))
        .groupBy(*by)
        .agg(F.count(F.lit(1)).alias("n_days"), *part("early", early), *part("post", ~early))
    )
    t, df, _ = welch_statistic(
        *[F.col(f"early_{c}") for c in ("n", "mean")],
        F.when(F.col("early_n") > 1, F.col("early_var")),
        *[F.col(f"post_{c}") for c in ("n", "mean")],
        F.when(F.col("post_n") > 1, F.col("post_var")),
    )
    enough = F.col("n_days") > window_days
    return (
        stats.withColumn("t_stat", F.when(enough, t))
        .withColumn("df", F.when(enough, df))
        .withColumn(
            "p_value",
            F.when(
                F.col("t_stat") > 0, welch_p_value(F.col("t_stat"), F.col("df")) / 2
            ).otherwise(F.lit(1.0)),
        )
        .select(
            *by,
            (F.col("p_value") < NOVELTY_ALPHA).alias("novelty_detected"),
            "p_value",
            F.col("early_mean"),
            F.when(enough, F.col("post_mean")).alias("post_early_mean"),
            "t_stat",
            "n_days",
        )
    )
