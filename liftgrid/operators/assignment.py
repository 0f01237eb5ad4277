"""Deterministic hash assignment of users to variants, and the split check."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from liftgrid.functions.distributions import chi_square_tail

# Hash space and the split alarm level (fixed values).
BUCKETS = 10_000
SRM_ALPHA = 0.01


@dataclass(frozen=True)
class Experiment:
    """Definition of one experiment; ``variants`` are names in assignment order.

    ``start`` and ``end`` bound its metrics, half-open; without them the log does.
    """

    experiment_id: str
    variants: tuple[str, ...] = ("control", "treatment")
    traffic_pct: float = 1.0
    name: str | None = None
    description: str | None = None
    control: str = "control"
    start: dt.datetime | None = None
    end: dt.datetime | None = None

    @property
    def threshold(self) -> int:
        """First bucket outside the experiment; truncates, so 0.57 gives 5699."""
        return int(self.traffic_pct * BUCKETS)

    def variant_id(self, variant: str) -> str:
        return f"{self.experiment_id}_{variant}"


def bucket(user_id: Column, experiment_id: Column) -> Column:
    """Bucket of a user: first 32 bits of sha256("user:experiment") modulo the space."""
    digest = F.sha2(F.concat(user_id.cast("string"), F.lit(":"), experiment_id), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % BUCKETS


def assign_variant(user_id: Column, experiment: Experiment) -> Column:
    """Variant name, or NULL when the user is outside the experiment's traffic."""
    slot = bucket(user_id, F.lit(experiment.experiment_id))
    names = F.array(*[F.lit(v) for v in experiment.variants])
    index = (slot % len(experiment.variants)).cast("int") + 1
    return F.when(slot < experiment.threshold, F.element_at(names, index))


def distinct_users(features: DataFrame) -> DataFrame:
    return features.select(F.col("user_id").cast("string").alias("user_id")).distinct()


def assign_all_users(users: DataFrame, experiments: Sequence[Experiment]) -> DataFrame:
    """Every enrolled (user, experiment) pair with its variant.

    The definitions travel inside the plan as a literal array, so this is a narrow
    transformation: no join and no shuffle. Further columns of ``users`` are kept.
    """
    definitions = F.array(
        *[
            F.struct(
                F.lit(e.experiment_id).alias("experiment_id"),
                F.lit(e.threshold).alias("threshold"),
                F.array(*[F.lit(v) for v in e.variants]).alias("variants"),
            )
            for e in experiments
        ]
    )
    extra = [c for c in users.columns if c not in ("user_id", "experiment_id", "variant")]
    definition = F.col("definition")
    return (
        users.select(
            F.col("user_id").cast("string").alias("user_id"),
            *extra,
            F.explode(definitions).alias("definition"),
        )
        .withColumn("bucket", bucket(F.col("user_id"), definition["experiment_id"]))
        .filter(F.col("bucket") < definition["threshold"])
        .select(
            "user_id",
            definition["experiment_id"].alias("experiment_id"),
            F.element_at(
                definition["variants"],
                (F.col("bucket") % F.size(definition["variants"])).cast("int") + 1,
            ).alias("variant"),
            *extra,
        )
    )


def experiments_frame(spark: SparkSession, experiments: Sequence[Experiment]) -> DataFrame:
    """Definitions as rows of the experiment dimension, running and without an end."""
    rows = [(e.experiment_id, e.name or e.experiment_id, e.description) for e in experiments]
    return (
        spark.createDataFrame(rows, "experiment_id string, name string, description string")
        .withColumn("start_date", F.current_timestamp())
        .withColumn("end_date", F.lit(None).cast("timestamp"))
        .withColumn("status", F.lit("running"))
    )


def variants_frame(spark: SparkSession, experiments: Sequence[Experiment]) -> DataFrame:
    rows = [
        (e.variant_id(v), e.experiment_id, v, v == e.control)
        for e in experiments
        for v in e.variants
    ]
    return spark.createDataFrame(
        rows, "variant_id string, experiment_id string, name string, is_control boolean"
    )


def variant_counts(assignments: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """Users per experiment and variant; ``declared`` variants without users count 0."""
    counts = assignments.groupBy("experiment_id", "variant").agg(
        F.count(F.lit(1)).alias("n_users")
    )
    if declared is None:
        return counts
    return declared.select("experiment_id", "variant").join(
        counts, ["experiment_id", "variant"], "left"
    ).fillna(0, ["n_users"])


def _srm_fields(k: Column, chi2: Column, chi2_gof: Column, counts: Column) -> list[Column]:
    p_value, p_value_gof = chi_square_tail(chi2, k - 1), chi_square_tail(chi2_gof, k - 1)
    return [
        F.coalesce(p_value < SRM_ALPHA, F.lit(False)).alias("srm_detected"),
        p_value.alias("p_value"),
        F.try_divide(F.lit(1.0), k).alias("expected_ratio"),
        F.map_from_entries(F.sort_array(counts)).alias("actual_counts"),
        chi2.alias("chi2"),
        F.coalesce(p_value_gof < SRM_ALPHA, F.lit(False)).alias("srm_detected_gof"),
        p_value_gof.alias("p_value_gof"),
        chi2_gof.alias("chi2_gof"),
    ]


def _srm_sums() -> dict[str, Column]:
    observed, expected = F.col("n_users").cast("double"), F.col("_expected")
    gap = (observed - expected) * (observed - expected)
    return {
        "_k": F.count(F.lit(1)),
        "_chi2": F.sum(F.try_divide(gap, observed + expected)),
        "_chi2_gof": F.sum(F.try_divide(gap, expected)),
        "_counts": F.collect_list(F.struct("variant", "n_users")),
    }


def _with_expected(counts: DataFrame) -> DataFrame:
    everyone = Window.partitionBy("experiment_id")
    return counts.withColumn("_expected", F.avg(F.col("n_users").cast("double")).over(everyone))


def srm_from_counts(counts: DataFrame) -> DataFrame:
    """Sample-ratio check per experiment from (experiment_id, variant, n_users).

    ``p_value`` compares the counts with an equal split as a 2 x k contingency table;
    ``p_value_gof`` is the goodness-of-fit test against the same split, which is about
    twice as sensitive. Both have k-1 degrees of freedom.
    """
    sums = _srm_sums()
    checked = _with_expected(counts).groupBy("experiment_id").agg(*[c.alias(n) for n, c in sums.items()])
    return checked.select("experiment_id", *_srm_fields(*map(F.col, sums)))


def with_srm(counts: DataFrame) -> DataFrame:
    """``counts`` with the same check as a struct ``srm`` beside every arm."""
    everyone, sums = Window.partitionBy("experiment_id"), _srm_sums()
    summed = _with_expected(counts).withColumns({n: c.over(everyone) for n, c in sums.items()})
    return summed.withColumn("srm", F.struct(*_srm_fields(*map(F.col, sums)))).drop("_expected", *sums)


def check_srm(assignments: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    return srm_from_counts(variant_counts(assignments, declared))


def assignment_summary(
    experiments: DataFrame, variants: DataFrame, assignments: DataFrame
) -> DataFrame:
    """Users per declared variant, empty ones included; assignments hold variant ids."""
    counts = assignments.groupBy("experiment_id", "variant_id").agg(
        F.count("user_id").alias("n_users")
    )
    return (
        experiments.select("experiment_id", "name")
        .join(
            variants.select("experiment_id", "variant_id", F.col("name").alias("variant")),
            "experiment_id",
        )
        .join(counts, ["experiment_id", "variant_id"], "left")
        .groupBy("experiment_id", "name", "variant")
        .agg(F.coalesce(F.sum("n_users"), F.lit(0)).alias("n_users"))
        .orderBy("experiment_id", "variant")
    )


def experiment_listing(experiments: DataFrame, assignments: DataFrame) -> DataFrame:
    """Experiments with the number of distinct users assigned to them.

    Users are made distinct on (experiment, user) first: one experiment may hold most
    of the rows, its users do not meet in one task.
    """
    users = (
        assignments.select("experiment_id", "user_id")
        .distinct()
        .groupBy("experiment_id")
        .agg(F.count("user_id").alias("n_users"))
    )
    return experiments.join(users, "experiment_id", "left").select(
        "experiment_id", "name", "status", "start_date", "end_date",
        F.coalesce("n_users", F.lit(0)).alias("n_users"),
    )
