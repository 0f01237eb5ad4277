"""End-to-end jobs: raw files to features, users to persisted assignments, analysis."""

from __future__ import annotations

import datetime as dt
import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftgrid.operators.assignment import (
    Experiment,
    assign_all_users,
    assignment_summary,
    check_srm,
    distinct_users,
    experiments_frame,
    variants_frame,
)
from liftgrid.operators.cleaning import clean_events
from liftgrid.operators.features import FEATURE_COLUMNS, user_features
from liftgrid.operators.metrics import METRICS, compute_all_metrics, pair_with_control, user_outcomes
from liftgrid.operators.propensity import propensity_analysis
from liftgrid.plans.analysis import analyze, result_rows
from liftgrid.plans.testing import run_tests
from liftgrid.session import materialize
from liftgrid.sources.control_tables import ControlTables
from liftgrid.sources.events import (
    read_events,
    read_raw_events,
    write_events,
    write_features,
)


def build_tables(spark: SparkSession, raw_dir: str, events_path: str, features_path: str) -> None:
    """Raw CSV directory to the clean event table, and that to the feature table."""
    write_events(clean_events(read_raw_events(spark, raw_dir)), events_path)
    features = user_features(read_events(spark, events_path))
    write_features(features.select(*FEATURE_COLUMNS), features_path)


def enroll(tables: ControlTables, features: DataFrame, experiments: Sequence[Experiment]) -> DataFrame:
    """Register experiments and variants, assign all users, return the summary.

    The split is checked before anything of the assignment is stored; a mismatch is
    reported, as a wrong split is a finding and no reason to lose the assignment.
    """
    spark = tables.spark
    tables.add_experiments(experiments_frame(spark, experiments))
    tables.add_variants(variants_frame(spark, experiments))
    assigned = assign_all_users(distinct_users(features), experiments)
    uneven = [r.experiment_id for r in check_srm(assigned).filter("srm_detected").collect()]
    if uneven:
        logging.getLogger(__name__).warning("sample ratio mismatch in %s", ", ".join(sorted(uneven)))
    tables.add_assignments(
        assigned.withColumn("variant_id", F.concat_ws("_", "experiment_id", "variant")),
        [e.experiment_id for e in experiments],
    )
    return assignment_summary(
        tables.experiments(), tables.variants(), tables.user_assignments()
    )


def analyze_and_store(
    tables: ControlTables,
    events: DataFrame,
    experiment_id: str | None = None,
    start: dt.datetime | None = None,
    end: dt.datetime | None = None,
    metrics: Sequence[str] = METRICS,
    method: str = "benjamini_hochberg",
    use_propensity: str | None = None,
    **parts,
) -> DataFrame:
    """Analyse one or all experiments of the tables and append their result rows.

    ``use_propensity`` names a classifier and adds the propensity part to the documents.
    """
    if experiment_id is not None:
        tables.experiment(experiment_id)
    assignments = tables.assignments(experiment_id)
    stats = materialize(compute_all_metrics(events, assignments, start, end), "arm-stats")
    if experiment_id is not None and stats.isEmpty():
        raise ValueError(f"No user assignments found for experiment {experiment_id!r}")
    flags = tables.variants().select(
        "experiment_id", F.col("name").alias("variant"), "is_control"
    )
    stats = stats.join(flags, ["experiment_id", "variant"], "left")
    if use_propensity is not None:
        parts["propensity"] = propensity_analysis(
            user_features(events), assignments, user_outcomes(events, start, end), None, use_propensity
        )
    tests = run_tests(pair_with_control(stats), metrics, method)
    tables.add_results(result_rows(stats, tests))
    return analyze(stats, tables.experiments(), metrics, method, **parts)
