"""Registered queries over the given tables.

Rates (conversion, carts) count the events within each experiment's own dates, as over a whole
log every user converts and no test is defined; revenue counts the whole log everywhere.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from liftgrid.operators import assignment as asg
from liftgrid.operators import bayes, cleaning, convergence, corrections, features, frequentist, ipw, metrics, planning
from liftgrid.operators.assignment import Experiment
from liftgrid.operators.balance import covariate_balance
from liftgrid.operators.propensity import (
    CATEGORICAL_FEATURES,
    NUMERIC_FEATURES,
    PropensityModel,
    imbalance_detected,
    propensity_analysis,
    rank_auc,
    score_all,
    stratified_folds,
    training_set,
)
from liftgrid.plans import analysis, report
from liftgrid.plans.testing import run_tests
from liftgrid.session import materialize, prepare, scratch_path
from liftgrid.sources import adapters
from liftgrid.sources.control_tables import ControlTables, absent_rows, newest_results, resolve_variants, stopped
from liftgrid.sources.events import (
    read_events,
    read_features,
    read_raw_events,
    register_events,
    write_events,
    write_features,
)

EXPERIMENTS = (
    Experiment("exp_A", name="Page layout", start=dt.datetime(2024, 1, 1), end=dt.datetime(2024, 1, 3)),
    Experiment("exp_B", name="Banner", start=dt.datetime(2024, 1, 9, 6), end=dt.datetime(2024, 1, 11)),
    Experiment(
        "exp_C", ("control", "layout_a", "layout_b"), name="Checkout layouts",
        start=dt.datetime(2024, 1, 10), end=dt.datetime(2024, 1, 12, 18),
    ),
    Experiment("exp_D", traffic_pct=0.57, name="Partial rollout", start=dt.datetime(2024, 1, 29)),
)
# The same experiments at the time of the orders.
ORDER_EXPERIMENTS = tuple(
    replace(e, start=start, end=end) for e, start, end in zip(
        EXPERIMENTS,
        (dt.datetime(1995, 1, 1), dt.datetime(1996, 3, 15), dt.datetime(1996, 6, 1), dt.datetime(2001, 1, 1)),
        (dt.datetime(1995, 7, 1), dt.datetime(1996, 9, 1), dt.datetime(1996, 12, 1), None),
    )
)
MDE = 0.02
DAYS_RUNNING = 14
LOSS_THRESHOLD = 0.01
# Fewer and shallower trees than the default: these runs check plumbing, not fit quality.
SMALL_BOOSTING = {"maxIter": 5, "maxDepth": 3}

Query = Callable[[SparkSession, str], DataFrame]


# Shared inputs ------------------------------------------------------------------------

def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_events(adapters.events_table(prepare(spark), sf_dir))


def clean_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_events(adapters.lineitem_table(prepare(spark), sf_dir))


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asg.assign_all_users(asg.distinct_users(clean(spark, sf_dir)), EXPERIMENTS)


def assignment_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assignments as the platform stores them: by variant id."""
    return assignments(spark, sf_dir).select(
        "user_id", "experiment_id",
        F.concat_ws("_", "experiment_id", "variant").alias("variant_id"),
    )


def enrolled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of every assigned user, rates within the experiment's dates; no join."""
    return metrics.assigned_outcomes(clean(spark, sf_dir), EXPERIMENTS, metrics.RATES)


def arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.arm_stats(enrolled(spark, sf_dir))


def order_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.arm_stats(
        metrics.assigned_outcomes(clean_orders(spark, sf_dir), ORDER_EXPERIMENTS, metrics.RATES)
    )


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily rates; users are assigned on top of their days, so the log is read once."""
    return metrics.daily_rates(asg.assign_all_users(metrics.user_days(clean(spark, sf_dir)), EXPERIMENTS))


def whole_arms(spark: SparkSession, sf_dir: str, log=clean) -> DataFrame:
    """Arm statistics over the whole log: for money and carts, which need no window."""
    return metrics.arm_stats(asg.assign_all_users(metrics.all_user_outcomes(log(spark, sf_dir)), EXPERIMENTS))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.pair_with_control(arms(spark, sf_dir))


def order_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.pair_with_control(order_arms(spark, sf_dir))


def experiment_dims(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return (
        asg.experiments_frame(spark, EXPERIMENTS),
        asg.variants_frame(spark, EXPERIMENTS),
    )


def given_propensity() -> Column:
    """A fixed formula of two features, in (0, 1), so weighting can be checked exactly."""
    return (F.col("total_carts") + 1) / (F.col("total_carts") + F.col("total_views") + 2)


def weighted_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows with the given propensity, weights and outcomes."""
    events = clean(spark, sf_dir)
    data = training_set(features.user_features(events), assignments(spark, sf_dir))
    outcomes = metrics.assigned_outcomes(events, EXPERIMENTS, metrics.RATES).drop("variant")
    return (
        data.withColumn("propensity", given_propensity())
        .withColumn("weight", ipw.compute_weights(F.col("propensity"), F.col("treatment")))
        .join(outcomes, ["user_id", "experiment_id"])
        .withColumn("converted", (F.col("n_purchases") > 0).cast("int"))
    )


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Round columns for comparison: sums of doubles depend on their order."""
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


# Queries ------------------------------------------------------------------------------

def q_clean_events(spark, sf_dir):
    return clean(spark, sf_dir).select(
        F.col("event_time").cast("timestamp_ntz").alias("event_time"),
        "event_type", "product_id", "category_code", "price", "user_id", "user_session",
        "date", "hour_of_day",
    )


def raw_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as cells of raw files, with unreadable times and prices for some products."""
    events = adapters.events_table(prepare(spark), sf_dir)
    time = F.concat(F.date_format("event_time", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(" UTC"))
    return events.withColumns({
        "event_time": F.when(F.col("product_id") == "17", "some day").otherwise(time),
        "price": F.when(F.col("product_id") == "13", "n/a").otherwise(F.col("price").cast("string")),
    })


def q_raw_event_files(spark, sf_dir):
    """Files of two headers, one with fewer columns in another order, read as one clean log."""
    folder = scratch_path(prepare(spark), "raw")
    cells = raw_texts(spark, sf_dir)
    short = ["user_session", "user_id", "price", "event_type", "event_time", "product_id", "category_code"]
    odd = F.col("product_id").cast("bigint") % 2 == 1
    cells.filter(~odd).write.csv(folder, header=True)
    cells.filter(odd).select(*short).write.mode("append").csv(folder, header=True)
    return cleaning.clean_events(read_raw_events(spark, folder)).select(
        F.col("event_time").cast("timestamp_ntz").alias("event_time"),
        "event_type", "product_id", "category_code", "price", "user_id", "user_session",
        "date", "hour_of_day",
    )


def control_tables(spark: SparkSession) -> ControlTables:
    """New tables in a database and folder of their own, with the experiments in them."""
    tables = ControlTables(prepare(spark), f"liftgrid_{uuid.uuid4().hex}", scratch_path(spark, "control"))
    tables.create()
    for _ in range(2):  # repeating it changes nothing
        tables.add_experiments(asg.experiments_frame(spark, EXPERIMENTS))
        tables.add_variants(asg.variants_frame(spark, EXPERIMENTS))
    return tables


def q_stored_assignments(spark, sf_dir):
    """Stored once, then again with the arms swapped: the first assignment of a user wins."""
    tables = control_tables(spark)
    users = asg.distinct_users(clean(spark, sf_dir))
    for experiments in (EXPERIMENTS, [replace(e, variants=e.variants[::-1]) for e in EXPERIMENTS]):
        rows = asg.assign_all_users(users, experiments)
        tables.add_assignments(rows.withColumn("variant_id", F.concat_ws("_", "experiment_id", "variant")))
    return tables.assignments()


def q_stored_results(spark, sf_dir):
    """Result rows appended to the table and read back, newest of each metric."""
    tables = control_tables(spark)
    stats = materialize(arms(spark, sf_dir), "arm-stats")
    rows = analysis.result_rows(stats, run_tests(metrics.pair_with_control(stats)))
    tables.add_results(rows.withColumn("value", F.col("value") - 1))
    tables.add_results(rows)
    newest = newest_results(tables.read("experiment_results"))
    return rounded(newest.drop("computed_at"), value=6, ci_lower=4, ci_upper=4, p_value=6)


def q_stored_features(spark, sf_dir):
    """The feature table written and read back."""
    path = scratch_path(prepare(spark), "features")
    write_features(_feature_columns(features.user_features(clean_orders(spark, sf_dir))), path)
    return read_features(spark, path)


def q_cleaning_report(spark, sf_dir):
    return cleaning.cleaning_report(adapters.events_table(prepare(spark), sf_dir))


def q_events_table(spark, sf_dir):
    """Write the clean table, read four of its columns back, query them as a view."""
    path = scratch_path(prepare(spark), "events")
    write_events(clean(spark, sf_dir), path)
    stored = read_events(spark, path, ["date", "event_type", "user_id", "price"])
    register_events(stored, "liftgrid_events")
    return spark.sql(
        "SELECT date, event_type, count(*) AS n_events, count(DISTINCT user_id) AS n_users, "
        "round(sum(price), 4) AS total_price FROM liftgrid_events GROUP BY date, event_type"
    )


def _feature_columns(df: DataFrame) -> DataFrame:
    """Averages of prices in cents often end on a rounding tie; the shift decides it."""
    return rounded(
        df.withColumns(
            {c: F.col(c).cast("timestamp_ntz") for c in ("first_seen", "last_seen")}
        ).withColumn("avg_price_viewed", F.col("avg_price_viewed") + 1e-8),
        total_revenue=4, avg_session_length=6, avg_price_viewed=5,
        avg_session_length_event_weighted=6,
    )


def q_user_features(spark, sf_dir):
    return _feature_columns(features.user_features(clean(spark, sf_dir)))


def q_user_features_orders(spark, sf_dir):
    return _feature_columns(features.user_features(clean_orders(spark, sf_dir)))


def q_user_features_as_of(spark, sf_dir):
    return _feature_columns(features.user_features(clean(spark, sf_dir), dt.date(2024, 1, 16)))


def q_favorite_category(spark, sf_dir):
    return features.favorite_category(clean(spark, sf_dir))


def q_assign_users(spark, sf_dir):
    return assignments(spark, sf_dir)


def q_assign_variant(spark, sf_dir):
    """The one-experiment form over all customers; NULL outside the traffic."""
    customers = prepare(spark).read.parquet(f"{sf_dir}/customer.parquet")
    user = F.col("c_custkey").cast("string")
    return customers.select(
        user.alias("user_id"),
        asg.assign_variant(user, EXPERIMENTS[2]).alias("exp_c_variant"),
        asg.assign_variant(user, EXPERIMENTS[3]).alias("exp_d_variant"),
    )


def q_resolved_assignments(spark, sf_dir):
    _, variants = experiment_dims(prepare(spark))
    return resolve_variants(assignment_ids(spark, sf_dir), variants)


def q_assignment_summary(spark, sf_dir):
    experiments, variants = experiment_dims(prepare(spark))
    return asg.assignment_summary(experiments, variants, assignment_ids(spark, sf_dir))


def q_experiment_listing(spark, sf_dir):
    experiments, _ = experiment_dims(prepare(spark))
    return asg.experiment_listing(experiments, assignments(spark, sf_dir)).select(
        "experiment_id", "name", "status", "n_users"
    )


def q_stop_experiment(spark, sf_dir):
    experiments, _ = experiment_dims(prepare(spark))
    listing = asg.experiment_listing(stopped(experiments, "exp_B"), assignments(spark, sf_dir))
    return listing.select(
        "experiment_id", "status", F.col("end_date").isNotNull().alias("has_ended"), "n_users"
    )


def q_srm_check(spark, sf_dir):
    srm = asg.check_srm(assignments(spark, sf_dir))
    counts = F.transform(
        F.map_entries("actual_counts"),
        lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")),
    )
    return rounded(
        srm.withColumn("actual_counts", F.array_join(counts, ",")),
        p_value=8, expected_ratio=8, chi2=8, p_value_gof=8, chi2_gof=8,
    )


def q_srm_orders(spark, sf_dir):
    """Split of the customers with orders, one segment at a time, as own experiments."""
    orders = prepare(spark).read.parquet(f"{sf_dir}/orders.parquet")
    users = orders.select(F.col("o_custkey").alias("user_id"), "o_orderpriority").distinct()
    assigned = asg.assign_all_users(users, EXPERIMENTS)
    by_segment = assigned.withColumn(
        "experiment_id", F.concat_ws("/", "experiment_id", "o_orderpriority")
    )
    return rounded(
        asg.check_srm(by_segment).drop("actual_counts"),
        p_value=8, expected_ratio=8, chi2=8, p_value_gof=8, chi2_gof=8,
    )


def q_insert_if_absent(spark, sf_dir):
    """First assignment wins: customers with orders keep theirs, the others get a new one."""
    spark = prepare(spark)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    existing = asg.assign_all_users(
        orders.select(F.col("o_custkey").alias("user_id")).distinct(), EXPERIMENTS
    )
    swapped = [replace(e, variants=e.variants[::-1]) for e in EXPERIMENTS]
    new = asg.assign_all_users(customers.select(F.col("c_custkey").alias("user_id")), swapped)
    fresh = absent_rows(new, existing, ["user_id", "experiment_id"])
    return existing.unionByName(fresh)


def q_conversion_rate(spark, sf_dir):
    return rounded(metrics.conversion_rate(arms(spark, sf_dir)), conversion_rate=8)


def q_windowed_outcomes(spark, sf_dir):
    """All measures within the experiments' own dates, one row per user and experiment."""
    return rounded(metrics.assigned_outcomes(clean(spark, sf_dir), EXPERIMENTS), revenue=4)


def q_revenue_per_user(spark, sf_dir):
    return rounded(
        metrics.revenue_per_user(whole_arms(spark, sf_dir)), mean_revenue=6, std_revenue=6
    )


def q_add_to_cart_rate(spark, sf_dir):
    return rounded(metrics.add_to_cart_rate(whole_arms(spark, sf_dir)), add_to_cart_rate=8)


def q_all_metrics(spark, sf_dir):
    return rounded(
        metrics.variant_cards(arms(spark, sf_dir)),
        conversion_rate=8, mean_revenue=6, add_to_cart_rate=8,
    )


def q_all_metrics_orders(spark, sf_dir):
    return rounded(
        metrics.variant_cards(order_arms(spark, sf_dir)),
        conversion_rate=8, mean_revenue=4, add_to_cart_rate=8,
    )


def q_segment_metrics(spark, sf_dir):
    """The same statistics split by market segment of the customer."""
    outcomes = metrics.assigned_outcomes(clean_orders(spark, sf_dir), ORDER_EXPERIMENTS, metrics.RATES)
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.col("c_custkey").cast("string").alias("user_id"), F.col("c_mktsegment").alias("segment")
    )
    stats = metrics.arm_stats(outcomes.join(customers, "user_id"), ["segment", "experiment_id", "variant"])
    return rounded(
        stats.select("segment", "experiment_id", "variant", "n_users", "n_converters", "mean_revenue"),
        mean_revenue=4,
    )


def q_arm_sufficient_stats(spark, sf_dir):
    return rounded(
        metrics.pair_with_control(whole_arms(spark, sf_dir)).select(
            "experiment_id", "control", "variant",
            "control_n_users", "control_n_converters", "control_mean_revenue",
            "control_var_revenue", "treatment_n_users", "treatment_n_converters",
            "treatment_mean_revenue", "treatment_var_revenue",
        ),
        control_mean_revenue=6, control_var_revenue=4,
        treatment_mean_revenue=6, treatment_var_revenue=4,
    )


def q_daily_conversion(spark, sf_dir):
    return rounded(
        daily(spark, sf_dir),
        conversion_rate=8,
    )


def _z(df: DataFrame) -> DataFrame:
    return rounded(
        df.select(
            "experiment_id", "control", "variant", "z_stat", "p_value", "relative_lift",
            "absolute_lift", "ci_lower", "ci_upper", "significant",
        ),
        z_stat=6, p_value=8, relative_lift=8, absolute_lift=8, ci_lower=8, ci_upper=8,
    )


def q_z_test(spark, sf_dir):
    return _z(frequentist.two_proportion_z_test(pairs(spark, sf_dir), "n_converters"))


def q_z_test_orders(spark, sf_dir):
    return _z(frequentist.two_proportion_z_test(order_pairs(spark, sf_dir), "n_converters"))


def _t(df: DataFrame) -> DataFrame:
    return rounded(
        df.select(
            "experiment_id", "control", "variant", "t_stat", "p_value", "cohens_d",
            "ci_lower", "ci_upper", "significant",
        ),
        t_stat=6, p_value=6, cohens_d=6, ci_lower=4, ci_upper=4,
    )


def q_welch_t_test(spark, sf_dir):
    return _t(frequentist.two_sample_t_test(metrics.pair_with_control(whole_arms(spark, sf_dir))))


def q_welch_t_test_orders(spark, sf_dir):
    arms_ = whole_arms(spark, sf_dir, clean_orders)
    return _t(frequentist.two_sample_t_test(metrics.pair_with_control(arms_)))


def q_novelty(spark, sf_dir):
    rates = daily(spark, sf_dir)
    return rounded(
        frequentist.novelty_effect_test(rates),
        p_value=6, early_mean=8, post_early_mean=8, t_stat=6,
    )


def _corrected(spark, sf_dir, method):
    return run_tests(pairs(spark, sf_dir), method=method)


def _correction_columns(df: DataFrame) -> DataFrame:
    return rounded(
        df.select("experiment_id", "variant", "metric", "p_value", "significant",
                  "significant_corrected"),
        p_value=6,
    )


def q_corrections_bh(spark, sf_dir):
    return _correction_columns(_corrected(spark, sf_dir, "benjamini_hochberg"))


def q_corrections_bonferroni(spark, sf_dir):
    return _correction_columns(_corrected(spark, sf_dir, "bonferroni"))


def q_corrections_daily(spark, sf_dir):
    """One family per day: is the daily rate of any arm off 50 percent?"""
    rates = daily(spark, sf_dir)
    n = F.col("n_active")
    z = (F.col("n_purchasers") - n / 2) / F.sqrt(n / 4)
    tests = rates.select(
        "date", "experiment_id", "variant",
        frequentist.normal_two_sided(z).alias("p_value"),
    )
    both = corrections.benjamini_hochberg(
        tests, family=["date"], order=["experiment_id", "variant"]
    ).withColumnRenamed("significant_corrected", "bh")
    both = corrections.bonferroni(both, family=["date"]).withColumnRenamed(
        "significant_corrected", "bonferroni"
    )
    return rounded(both, p_value=8)


def q_corrections_summary(spark, sf_dir):
    return corrections.rejection_summary(_corrected(spark, sf_dir, "benjamini_hochberg"))


def q_mde(spark, sf_dir):
    effect = frequentist.minimum_detectable_effect(
        F.col("control_n_users"), F.col("treatment_n_users"), F.col("control_conversion_rate")
    )
    return rounded(
        frequentist.spread_struct(pairs(spark, sf_dir), effect).select(
            "experiment_id", "variant", "mde", "mde_capped"
        ),
        mde=8,
    )


def q_required_n(spark, sf_dir):
    rate = F.col("conversion_rate")
    return arms(spark, sf_dir).select(
        "experiment_id", "variant",
        frequentist.required_sample_size(rate, F.lit(MDE)).alias("required_n"),
    )


def _power(spark, sf_dir):
    return planning.power_analysis(arms(spark, sf_dir), MDE)


def q_power_analysis(spark, sf_dir):
    return rounded(_power(spark, sf_dir), baseline_rate=8)


def q_sample_size_block(spark, sf_dir):
    return rounded(
        planning.sample_size_block(pairs(spark, sf_dir)),
        baseline_rate=8, minimum_detectable_effect=8,
    )


def q_mde_curve(spark, sf_dir):
    return rounded(planning.mde_curve(_power(spark, sf_dir)), baseline_rate=8, mde=8)


def q_days_to_significance(spark, sf_dir):
    return rounded(
        planning.progress_to_power(_power(spark, sf_dir), DAYS_RUNNING),
        baseline_rate=8, pct_of_required=6,
    )


def _params(spark, sf_dir):
    return bayes.posterior_params(pairs(spark, sf_dir))


def q_posterior_params(spark, sf_dir):
    return _params(spark, sf_dir).select(
        "experiment_id", "variant", "control_alpha", "control_beta",
        "treatment_alpha", "treatment_beta",
    )


def q_prob_treatment_better(spark, sf_dir):
    return rounded(
        _params(spark, sf_dir).select(
            "experiment_id", "variant",
            bayes.probability_treatment_better().alias("probability_treatment_better"),
        ),
        probability_treatment_better=6,
    )


def q_expected_loss(spark, sf_dir):
    return rounded(
        _params(spark, sf_dir).select(
            "experiment_id", "variant", bayes.expected_loss().alias("expected_loss"),
            bayes.expected_loss(LOSS_THRESHOLD).alias("expected_loss_above_threshold"),
        ),
        expected_loss=6, expected_loss_above_threshold=6,
    )


def q_posterior_density(spark, sf_dir):
    return rounded(
        bayes.posterior_density(_params(spark, sf_dir)),
        x=8, control_density=5, treatment_density=5,
    )


def q_hdi(spark, sf_dir):
    return rounded(
        bayes.credible_intervals(_params(spark, sf_dir)),
        credible_interval_lower=4, credible_interval_upper=4,
    )


def q_rhat(spark, sf_dir):
    """Whole-log revenue of each arm's users, dealt into four chains by hash."""
    users = asg.assign_all_users(metrics.all_user_outcomes(clean(spark, sf_dir)), EXPERIMENTS)
    chains = convergence.deal_chains(users.select(*metrics.ARM, "user_id", "revenue"), metrics.ARM)
    return rounded(convergence.convergence(chains, metrics.ARM, "revenue"), rhat=6, effective_size=4)


def q_propensity_training_set(spark, sf_dir):
    data = training_set(
        features.user_features(clean(spark, sf_dir)), assignments(spark, sf_dir)
    )
    return rounded(
        data.withColumn("avg_price_viewed", F.col("avg_price_viewed") + 1e-8),
        total_revenue=4, avg_price_viewed=5, avg_session_length=6,
    )


def q_ipw_weights(spark, sf_dir):
    return rounded(
        weighted_users(spark, sf_dir).select(
            "experiment_id", "user_id", "treatment", "propensity", "weight"
        ),
        propensity=8, weight=8,
    )


def q_ipw_conversion(spark, sf_dir):
    adjusted = report.propensity_verdict(
        ipw.adjusted_conversion_rate(weighted_users(spark, sf_dir))
    )
    return rounded(
        adjusted, control=8, treatment=8, adjusted_lift=8, unadjusted_lift=8,
        adjustment_magnitude=8,
    )


_IPW_DIGITS = {"t_stat": 6, "p_value": 6, "cohens_d": 6, "ci_lower": 5, "ci_upper": 5}


def q_ipw_t_test(spark, sf_dir):
    users = weighted_users(spark, sf_dir)
    return rounded(ipw.adjusted_t_test(users, "revenue"), **_IPW_DIGITS)


def q_ipw_two_sample_t_test(spark, sf_dir):
    users = weighted_users(spark, sf_dir)
    return rounded(ipw.two_sample_adjusted_t_test(users, "revenue"), **_IPW_DIGITS)


def q_covariate_balance(spark, sf_dir):
    return rounded(
        covariate_balance(weighted_users(spark, sf_dir)), smd_before=6, smd_after=6
    )


def q_rank_auc(spark, sf_dir):
    aucs = rank_auc(weighted_users(spark, sf_dir))
    return rounded(
        aucs.withColumn("imbalance_detected", imbalance_detected(F.col("auc"))), auc=8
    )


def q_stratified_folds(spark, sf_dir):
    """Rows per fold; every stratum is dealt out evenly."""
    data = training_set(
        features.user_features(clean_orders(spark, sf_dir)),
        asg.assign_all_users(asg.distinct_users(clean_orders(spark, sf_dir)), EXPERIMENTS),
    ).select("experiment_id", "user_id", "treatment")
    dealt = stratified_folds(data, strata=["experiment_id", "treatment"])
    return dealt.groupBy("experiment_id", "treatment", "fold").agg(
        F.count(F.lit(1)).alias("n_rows")
    )


def q_propensity_scores(spark, sf_dir):
    """Out-of-the-box training on one experiment of the order log, then scoring all of it."""
    events = clean_orders(spark, sf_dir)
    data = materialize(
        training_set(
            features.user_features(events),
            asg.assign_all_users(asg.distinct_users(events), EXPERIMENTS[:1]),
        ),
        "propensity-rows",
    )
    model = PropensityModel(**SMALL_BOOSTING)
    model.train(data)
    return model.predict_propensity(data).select(
        "experiment_id", "user_id", "treatment", "propensity"
    )


def _ipw_end_to_end(spark, sf_dir, classifier):
    events = clean(spark, sf_dir)
    return propensity_analysis(
        features.user_features(events),
        assignments(spark, sf_dir),
        metrics.assigned_outcomes(events, EXPERIMENTS, metrics.RATES).drop("variant"),
        [e.experiment_id for e in EXPERIMENTS],
        classifier,
    )


def q_ipw_end_to_end(spark, sf_dir):
    """All experiments and folds at once, logistic scores fitted to convergence."""
    return _ipw_end_to_end(spark, sf_dir, "logistic")


def q_ipw_by_category(spark, sf_dir):
    """The same with the model of category levels, whose folds come by subtraction."""
    return rounded(
        _ipw_end_to_end(spark, sf_dir, "category"),
        cv_auc=8, adjustment_magnitude=8, unadjusted_lift=8, adjusted_lift=8,
    )


def q_propensity_score_equations(spark, sf_dir):
    """Sums of (treated - chance) times each input: zero at the maximum of the likelihood."""
    scored = score_all(features.user_features(clean(spark, sf_dir)), assignments(spark, sf_dir))
    rest = F.col("treatment") - F.col("propensity")
    category = F.concat(F.lit("category "), F.col(CATEGORICAL_FEATURES[0]))
    inputs = F.array(
        F.struct(category.alias("input"), F.lit(1.0).alias("x")),
        *[F.struct(F.lit(c).alias("input"), F.col(c).alias("x")) for c in NUMERIC_FEATURES],
    )
    parts = scored.select("experiment_id", rest.alias("rest"), F.inline(inputs))
    sums = parts.groupBy("experiment_id", "input").agg(F.sum(F.col("rest") * F.col("x")).alias("residual"))
    return sums.withColumn("residual", F.round("residual", 4) + 0.0)


def q_latest_results(spark, sf_dir):
    """Daily rates as successive runs of the result table; the last run counts."""
    runs = daily(spark, sf_dir).select(
        "experiment_id",
        F.concat_ws("_", "experiment_id", "variant").alias("variant_id"),
        F.lit("conversion_rate").alias("metric_name"),
        F.col("conversion_rate").alias("value"),
        F.col("date").alias("computed_at"),
    )
    return rounded(newest_results(runs), value=8)


def q_result_rows(spark, sf_dir):
    stats = materialize(arms(spark, sf_dir), "arm-stats")
    rows = analysis.result_rows(stats, run_tests(metrics.pair_with_control(stats)))
    return rounded(rows, value=6, ci_lower=4, ci_upper=4, p_value=6)


def q_decision_view(spark, sf_dir):
    stats = materialize(arms(spark, sf_dir), "arm-stats")
    return report.decision_view(
        run_tests(metrics.pair_with_control(stats)),
        asg.srm_from_counts(stats.select("experiment_id", "variant", "n_users")),
    )


def q_analyze(spark, sf_dir):
    experiments, _ = experiment_dims(prepare(spark))
    rates = daily(spark, sf_dir)
    return analysis.analyze(arms(spark, sf_dir), experiments, daily=rates)


def q_analyze_parts(spark, sf_dir):
    """Every number of the documents in long form, with the propensity and novelty parts."""
    experiments, _ = experiment_dims(prepare(spark))
    documents = analysis.analyze(
        arms(spark, sf_dir), experiments,
        propensity=_ipw_end_to_end(spark, sf_dir, "category"), daily=daily(spark, sf_dir),
    )
    kept = {
        "variants": ["n_users", "conversion_rate", "mean_revenue", "add_to_cart_rate"],
        "frequentist": ["p_value"],
        "bayesian": ["probability_treatment_better", "expected_loss", "credible_interval_lower", "credible_interval_upper"],
        "sample_size_analysis": ["baseline_rate", "current_n_per_variant", "minimum_detectable_effect", "required_n_for_80pct_power"],
        "novelty_check": ["p_value", "early_mean", "post_early_mean"],
        "propensity": ["cv_auc", "adjustment_magnitude", "unadjusted_lift", "adjusted_lift"],
        "srm_check": ["p_value", "expected_ratio"],
    }

    digits = {
        "mean_revenue": 6, "probability_treatment_better": 6, "expected_loss": 6, "credible_interval_lower": 4,
        "credible_interval_upper": 4, ("frequentist", "p_value"): 6, ("novelty_check", "p_value"): 6,
    }

    def numbers(part: str, row: Column) -> Column:
        place = F.lit("") if part in ("propensity", "srm_check") else row["variant"]
        if part == "frequentist":
            place = F.concat_ws(" ", row["metric"], place)
        return F.array(*[
            F.struct(
                F.lit(part).alias("part"), place.alias("place"), F.lit(n).alias("name"),
                F.round(row[n].cast("double"), digits.get((part, n), digits.get(n, 8))).alias("value"),
            )
            for n in kept[part]
        ])

    def listed(part: str) -> Column:
        if part in ("propensity", "srm_check"):
            return numbers(part, F.col(part))
        return F.flatten(F.transform(part, lambda row: numbers(part, row)))

    lists = [listed(part) for part in kept]
    return documents.select("experiment_id", F.inline(F.concat(*lists)))


def q_analyze_tests(spark, sf_dir):
    """The documents of ``analyze`` laid flat: one row per test with its split check."""
    experiments, _ = experiment_dims(prepare(spark))
    documents = analysis.analyze(arms(spark, sf_dir), experiments)
    tests = documents.select(
        "experiment_id", "name",
        F.col("srm_check")["p_value"].alias("srm_p_value"),
        F.size("variants").alias("n_variants"),
        F.size("sample_size_analysis").alias("n_sizings"),
        F.size("bayesian").alias("n_posteriors"),
        F.explode("frequentist").alias("test"),
    ).select("*", "test.*").drop("test")
    return rounded(
        tests, srm_p_value=8, p_value=6, absolute_lift=8, relative_lift=8, ci_lower=4, ci_upper=4
    )


def all_queries() -> dict[str, Query]:
    return {
        name[2:]: function
        for name, function in globals().items()
        if name.startswith("q_") and callable(function)
    }


__all__ = ["EXPERIMENTS", "NUMERIC_FEATURES", "all_queries"]
