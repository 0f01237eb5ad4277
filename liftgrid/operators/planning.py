"""Sample size, power and time-to-decision planning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from liftgrid.operators.frequentist import minimum_detectable_effect, required_sample_size
from liftgrid.operators.metrics import control_of

# Planning defaults (fixed values).
DEFAULT_BASELINE = 0.05
SMALLEST_MDE = 0.001
CURVE_POINTS = 40
CURVE_STEP = 0.005

# Rate metrics and the arm statistic that holds them.
RATES = {"conversion_rate": "conversion_rate", "add_to_cart_rate": "add_to_cart_rate"}


def check_mde(mde: float) -> None:
    if not 0 < mde < 1:
        raise ValueError(f"mde must lie strictly between 0 and 1, got {mde!r}")


def power_analysis(
    stats: DataFrame, mde: float, metric: str = "conversion_rate",
    alpha: float = 0.05, power: float = 0.8,
) -> DataFrame:
    """Required against current users per arm for an absolute change ``mde``."""
    check_mde(mde)
    if metric not in RATES:
        raise ValueError(f"power analysis is defined for rates {sorted(RATES)}, not {metric!r}")
    arms = Window.partitionBy("experiment_id")
    rate = F.when(F.col("variant") == control_of(stats), F.col(RATES[metric]))
    return (
        stats.withColumn("control_rate", rate)
        .groupBy("experiment_id")
        .agg(
            F.coalesce(F.max("control_rate"), F.lit(DEFAULT_BASELINE)).alias("baseline_rate"),
            F.floor(F.sum("n_users") / F.count(F.lit(1))).cast("bigint").alias(
                "current_n_per_variant"
            ),
        )
        .select(
            "experiment_id",
            F.lit(metric).alias("metric"),
            F.lit(mde).alias("mde"),
            "baseline_rate",
            required_sample_size(F.col("baseline_rate"), F.lit(mde), alpha, power).alias(
                "required_n_per_variant"
            ),
            "current_n_per_variant",
        )
    )


def usable_baseline(rate: Column) -> Column:
    return F.when(rate > 0, rate).otherwise(F.lit(DEFAULT_BASELINE))


def with_sizing(pairs: DataFrame) -> DataFrame:
    """``pairs`` with baseline, arm size, detectable effect and required size."""
    sized = pairs.withColumn(
        "baseline_rate", usable_baseline(F.col("control_conversion_rate"))
    ).withColumn(
        "_effect",
        minimum_detectable_effect(
            F.col("control_n_users"), F.col("treatment_n_users"), F.col("baseline_rate")
        ),
    )
    mde = F.col("_effect")["mde"]
    return sized.withColumns(
        {
            "current_n_per_variant": F.floor(
                (F.col("control_n_users") + F.col("treatment_n_users")) / 2
            ).cast("bigint"),
            "minimum_detectable_effect": mde,
            "mde_capped": F.col("_effect")["mde_capped"],
            "required_n_for_80pct_power": required_sample_size(
                F.col("baseline_rate"), F.greatest(mde, F.lit(SMALLEST_MDE))
            ),
        }
    ).drop("_effect")


def sample_size_block(pairs: DataFrame) -> DataFrame:
    """Baseline, arm size, detectable effect and required size per treatment arm."""
    return with_sizing(pairs).select(
        "experiment_id", "variant", "baseline_rate", "current_n_per_variant",
        "minimum_detectable_effect", "mde_capped", "required_n_for_80pct_power",
    )


def mde_curve(power: DataFrame) -> DataFrame:
    """Required users per arm over a grid of effects, for each experiment's baseline."""
    return (
        power.select("experiment_id", usable_baseline(F.col("baseline_rate")).alias("baseline_rate"))
        .withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(CURVE_POINTS - 1))))
        .withColumn("mde", CURVE_STEP + F.col("step") * CURVE_STEP)
        .withColumn(
            "required_n", required_sample_size(F.col("baseline_rate"), F.col("mde"))
        )
    )


def days_to_significance(required_n: Column, current_n: Column, days_running: Column) -> Column:
    """Days left at the enrolment rate so far; 0 when done or when nothing has started."""
    missing = F.greatest(required_n - current_n, F.lit(0))
    rate = current_n / days_running
    return F.when(
        (current_n > 0) & (days_running > 0), F.ceil(missing / rate).cast("bigint")
    ).otherwise(F.lit(0).cast("bigint"))


def progress_to_power(power: DataFrame, days_running: int | Column) -> DataFrame:
    """Share of the required sample reached, readiness and days left."""
    days = F.lit(days_running) if isinstance(days_running, int) else days_running
    required, current = F.col("required_n_per_variant"), F.col("current_n_per_variant")
    return power.withColumns(
        {
            "pct_of_required": F.least(
                current / F.greatest(required, F.lit(1)) * 100, F.lit(100.0)
            ),
            "has_power": current >= required,
            "days_left": days_to_significance(required, current, days),
        }
    )
