"""Covariate balance between arms before and after weighting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftgrid.operators.propensity import NUMERIC_FEATURES

SMD_LIMIT = 0.1


def covariate_balance(
    weighted: DataFrame,
    covariates: Sequence[str] = NUMERIC_FEATURES,
    by: Sequence[str] = ("experiment_id",),
) -> DataFrame:
    """Absolute standardised mean difference per covariate, raw and weighted.

    Both are scaled by the raw pooled deviation and are 0 when that is 0. All covariates
    are summed up in one wide pass; only the per-arm rows are turned long.
    """
    w = F.col("weight")
    sums = [F.sum(w).alias("w")]
    for c in covariates:
        sums += [
            F.avg(c).alias(f"{c}__mean"),
            F.var_samp(c).alias(f"{c}__var"),
            F.sum(w * F.col(c)).alias(f"{c}__wx"),
        ]
    arms = weighted.groupBy(*by, "treatment").agg(*sums)
    cells = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("covariate"),
                    F.col(f"{c}__mean").alias("mean"),
                    F.col(f"{c}__var").alias("var"),
                    (F.col(f"{c}__wx") / F.col("w")).alias("weighted_mean"),
                )
                for c in covariates
            ]
        )
    )
    long = arms.select(*by, "treatment", cells.alias("cell")).select(*by, "treatment", "cell.*")
    treated = F.col("treatment") == 1

    def gap(column: str):
        return F.abs(
            F.max(F.when(treated, F.col(column))) - F.max(F.when(~treated, F.col(column)))
        )

    wide = long.groupBy(*by, "covariate").agg(
        gap("mean").alias("raw_gap"),
        gap("weighted_mean").alias("weighted_gap"),
        F.sqrt(
            (F.max(F.when(treated, F.col("var"))) + F.max(F.when(~treated, F.col("var")))) / 2
        ).alias("pooled_std"),
    )

    def smd(column: str):
        return F.when(F.col("pooled_std") == 0, F.lit(0.0)).otherwise(
            F.col(column) / F.col("pooled_std")
        )

    return wide.select(
        *by,
        "covariate",
        smd("raw_gap").alias("smd_before"),
        smd("weighted_gap").alias("smd_after"),
        (smd("weighted_gap") < SMD_LIMIT).alias("balanced_after"),
    )
