"""Logical schemas: event log, user features, control tables, result documents."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields.items()])


_S, _L, _D, _I, _B = T.StringType(), T.LongType(), T.DoubleType(), T.IntegerType(), T.BooleanType()
_TS, _DATE = T.TimestampType(), T.DateType()

# Column names and order of the raw clickstream files (fixed values).
RAW_EVENTS = _struct(
    event_time=_S, event_type=_S, product_id=_S, category_id=_S, category_code=_S,
    brand=_S, price=_S, user_id=_S, user_session=_S,
)

CLEAN_EVENTS = _struct(
    event_time=_TS, event_type=_S, product_id=_S, category_id=_S, category_code=_S,
    brand=_S, price=_D, user_id=_S, user_session=_S, date=_DATE, hour_of_day=_I,
)

USER_FEATURES = _struct(
    user_id=_S, total_sessions=_L, total_views=_L, total_carts=_L, total_purchases=_L,
    total_revenue=_D, avg_session_length=_D, days_active=_L, first_seen=_TS, last_seen=_TS,
    favorite_category=_S, avg_price_viewed=_D,
)

ASSIGNMENTS = _struct(user_id=_S, experiment_id=_S, variant=_S)

# Control tables. ``updated_at`` orders the versions of an experiment row: the table is
# append-only and the newest version of a row is the current one.
EXPERIMENTS = _struct(
    experiment_id=_S, name=_S, description=_S, start_date=_TS, end_date=_TS, status=_S,
    updated_at=_TS,
)
VARIANTS = _struct(variant_id=_S, experiment_id=_S, name=_S, is_control=_B)
USER_ASSIGNMENTS = _struct(user_id=_S, variant_id=_S, assigned_at=_TS, experiment_id=_S)
EXPERIMENT_RESULTS = _struct(
    experiment_id=_S, variant_id=_S, metric_name=_S, value=_D, ci_lower=_D, ci_upper=_D,
    p_value=_D, computed_at=_TS,
)
MODEL_RUNS = _struct(
    experiment_id=_S, cv_auc=_D, feature_names=T.ArrayType(_S), training_date=_TS,
    model_path=_S,
)

# Parts of the analysis document, one row per experiment.
VARIANT_METRICS = _struct(
    variant=_S, n_users=_L, conversion_rate=_D, mean_revenue=_D, add_to_cart_rate=_D,
)
TEST_RESULT = _struct(
    metric=_S, variant=_S, p_value=_D, significant=_B, significant_corrected=_B,
    absolute_lift=_D, relative_lift=_D, ci_lower=_D, ci_upper=_D,
)
BAYESIAN_RESULT = _struct(
    variant=_S, probability_treatment_better=_D, expected_loss=_D,
    credible_interval_lower=_D, credible_interval_upper=_D,
)
PROPENSITY_RESULT = _struct(
    cv_auc=_D, imbalance_detected=_B, adjustment_magnitude=_D, unadjusted_lift=_D,
    adjusted_lift=_D,
)
SRM_RESULT = _struct(
    srm_detected=_B, p_value=_D, expected_ratio=_D, actual_counts=T.MapType(_S, _L),
)
NOVELTY_RESULT = _struct(
    variant=_S, novelty_detected=_B, p_value=_D, early_mean=_D, post_early_mean=_D,
)
SAMPLE_SIZE = _struct(
    variant=_S, baseline_rate=_D, current_n_per_variant=_L, minimum_detectable_effect=_D,
    required_n_for_80pct_power=_L,
)
EXPERIMENT_RESULT = _struct(
    experiment_id=_S, name=_S, status=_S, computed_at=_TS, srm_check=SRM_RESULT,
    variants=T.ArrayType(VARIANT_METRICS), frequentist=T.ArrayType(TEST_RESULT),
    bayesian=T.ArrayType(BAYESIAN_RESULT), propensity=PROPENSITY_RESULT,
    novelty_check=T.ArrayType(NOVELTY_RESULT),
    sample_size_analysis=T.ArrayType(SAMPLE_SIZE),
)
EXPERIMENT_SUMMARY = _struct(
    experiment_id=_S, name=_S, status=_S, start_date=_TS, end_date=_TS, n_users=_L,
)
