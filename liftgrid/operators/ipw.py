"""Inverse-probability weighting of a treated-against-control comparison."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from liftgrid.functions.distributions import normal_quantile, student_two_sided
from liftgrid.operators.frequentist import spread_struct

# Bounds of a weight (fixed values).
WEIGHT_MIN = 0.1
WEIGHT_MAX = 10.0
EXPERIMENT = ("experiment_id",)


def compute_weights(propensity: Column, treatment: Column) -> Column:
    """1/p for treated, 1/(1-p) for control, clipped; a certain outcome gets the maximum."""
    chance = F.when(treatment == 1, propensity).otherwise(1 - propensity)
    weight = F.coalesce(F.try_divide(F.lit(1.0), chance), F.lit(WEIGHT_MAX))
    clipped = F.least(F.greatest(weight, F.lit(WEIGHT_MIN)), F.lit(WEIGHT_MAX))
    return F.when(propensity.isNotNull(), clipped)


def adjusted_conversion_rate(weighted: DataFrame, by: Sequence[str] = EXPERIMENT) -> DataFrame:
    """Weighted and raw conversion per experiment from (converted, weight, treatment)."""
    y, w = F.col("converted").cast("double"), F.col("weight")

    def mean(arm: int, weight: Column) -> Column:
        kept = F.col("treatment") == arm
        return F.coalesce(
            F.try_divide(F.sum(F.when(kept, weight * y)), F.sum(F.when(kept, weight))),
            F.lit(0.0),
        )

    sums = weighted.groupBy(*by).agg(
        mean(0, w).alias("control"),
        mean(1, w).alias("treatment"),
        (mean(1, F.lit(1.0)) - mean(0, F.lit(1.0))).alias("unadjusted_lift"),
    )
    adjusted = F.col("treatment") - F.col("control")
    return sums.select(
        *by, "control", "treatment",
        adjusted.alias("adjusted_lift"),
        "unadjusted_lift",
        F.abs(adjusted - F.col("unadjusted_lift")).alias("adjustment_magnitude"),
    )


def _merged(states: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """States (w, mean, ss) of the same key as one: squares add up around the common mean."""
    total = states.assign(wm=states.w * states["mean"]).groupby(keys, dropna=False, sort=False)
    centre = total.wm.transform("sum") / total.w.transform("sum")
    ss = states.ss + states.w * (states["mean"] - centre) ** 2
    rows = states.assign(ss=ss, mean=centre).groupby(keys, dropna=False, sort=False, as_index=False)
    return rows.agg(w=("w", "sum"), mean=("mean", "first"), ss=("ss", "sum"))


def weighted_moments(weighted: DataFrame, value: str, by: Sequence[str] = EXPERIMENT) -> DataFrame:
    """Weight sum, weighted mean and weighted variance (ddof 1) of both arms, in one read.

    A task turns its rows into one state (weight, mean, squared deviation) per arm, Arrow batch
    by batch, and states merge around their common mean, so nothing cancels when the mean is
    large against the spread. (Spark's own weighted summary loses the variance there: it adds
    a term of the mean's square times a rounding error.) Rows without a value or with no
    positive weight do not count.
    """
    keys = [*by, "treatment"]
    x, w = F.col(value).cast("double"), F.col("weight").cast("double")
    rows = weighted.filter(x.isNotNull() & (w > 0)).select(*keys, x.alias("mean"), w.alias("w"), F.lit(0.0).alias("ss"))

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states = [_merged(batch, keys) for batch in batches if len(batch)]
        if states:
            yield _merged(pd.concat(states), keys)

    spec = T.StructType([*[rows.schema[c] for c in keys], *[T.StructField(c, T.DoubleType()) for c in ("w", "mean", "ss")]])
    states = rows.mapInPandas(summed, spec)  # at most one row per arm and task
    arm = Window.partitionBy(*keys)
    centre = F.sum(F.col("w") * F.col("mean")).over(arm) / F.sum("w").over(arm)
    states = states.withColumn("centre", centre)
    gap = F.col("mean") - F.col("centre")
    arms = states.groupBy(*keys).agg(
        F.struct(
            F.sum("w").alias("w"), F.first("centre").alias("mean"),
            F.sum(F.col("ss") + F.col("w") * gap * gap).alias("ss"),
        ).alias("arm")
    )
    both = arms.groupBy(*by).agg(
        *[F.max(F.when(F.col("treatment") == flag, F.col("arm"))).alias(name) for name, flag in (("c", 0), ("t", 1))]
    )
    columns = {f"{name}_{part}": F.col(name)[part] for name in ("c", "t") for part in ("w", "mean", "ss")}
    columns |= {
        f"{name}_var": F.when(F.col(name)["w"] > 1, F.col(name)["ss"] / (F.col(name)["w"] - 1)) for name in ("c", "t")
    }
    return both.withColumns(columns).drop("c", "t")


def adjusted_t_test(
    weighted: DataFrame, value: str, alpha: float = 0.05, by: Sequence[str] = EXPERIMENT
) -> DataFrame:
    """Weighted test of the treatment mean against the control mean taken as fixed.

    The statistic has W-1 degrees of freedom with W the treated weight; the interval is a
    two-sample normal one. ``two_sample_adjusted_t_test`` treats both arms as samples.
    """
    moments = weighted_moments(weighted, value, by)
    difference = F.col("t_mean") - F.col("c_mean")
    # Standard error of a weighted mean: sqrt(S / W) / sqrt(W - 1).
    error = F.when(
        F.col("t_w") > 1, F.sqrt(F.col("t_ss") / F.col("t_w")) / F.sqrt(F.col("t_w") - 1)
    )
    t = F.try_divide(difference, error)
    p_value = student_two_sided(t, F.col("t_w") - 1)
    return _test_frame(moments, by, t, p_value, alpha)


def two_sample_adjusted_t_test(
    weighted: DataFrame, value: str, alpha: float = 0.05, by: Sequence[str] = EXPERIMENT
) -> DataFrame:
    """Weighted Welch test with the weight sums as sample sizes."""
    moments = weighted_moments(weighted, value, by)
    share_t = F.col("t_var") / F.col("t_w")
    share_c = F.col("c_var") / F.col("c_w")
    t = F.try_divide(F.col("t_mean") - F.col("c_mean"), F.sqrt(share_t + share_c))
    df = F.try_divide(
        (share_t + share_c) * (share_t + share_c),
        share_t * share_t / (F.col("t_w") - 1) + share_c * share_c / (F.col("c_w") - 1),
    )
    return _test_frame(moments, by, t, student_two_sided(t, df), alpha)


def _test_frame(
    moments: DataFrame, by: Sequence[str], t: Column, p_value: Column, alpha: float
) -> DataFrame:
    difference = F.col("t_mean") - F.col("c_mean")
    pooled_std = F.sqrt((F.col("t_var") + F.col("c_var")) / 2)
    half = normal_quantile(1 - alpha / 2) * F.sqrt(
        F.col("t_var") / F.col("t_w") + F.col("c_var") / F.col("c_w")
    )
    fields = F.struct(
        t.alias("t_stat"),
        p_value.alias("p_value"),
        F.coalesce(F.try_divide(difference, pooled_std), F.lit(0.0)).alias("cohens_d"),
        (difference - half).alias("ci_lower"),
        (difference + half).alias("ci_upper"),
        F.coalesce(p_value < alpha, F.lit(False)).alias("significant"),
    )
    names = ["t_stat", "p_value", "cohens_d", "ci_lower", "ci_upper", "significant"]
    return spread_struct(moments, fields).select(*by, *names)
