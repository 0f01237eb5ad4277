import datetime as dt

import pytest
from pyspark.sql import functions as F

from liftgrid.functions import display
from liftgrid.operators import planning
from liftgrid.operators.assignment import srm_from_counts
from liftgrid.operators.metrics import pair_with_control
from liftgrid.plans import analysis, report
from liftgrid.plans.testing import run_tests
from liftgrid.sources.control_tables import newest_results
from tests.conftest import one

ARM = (
    "experiment_id string, variant string, n_users long, n_converters long, n_carted long, "
    "mean_revenue double, var_revenue double, conversion_rate double, std_revenue double, "
    "add_to_cart_rate double"
)


def stats(spark, *arms):
    return spark.createDataFrame(
        [(e, v, n, x, k, m, var, x / n, var**0.5, k / n) for e, v, n, x, k, m, var in arms], ARM
    )


@pytest.fixture(scope="module")
def arms(spark):
    return stats(
        spark,
        ("e1", "control", 10000, 500, 2000, 5.0, 100.0),
        ("e1", "treatment", 10000, 800, 2010, 5.1, 101.0),
        ("e2", "control", 900, 0, 0, 0.0, 0.0),
        ("e2", "a", 60, 0, 0, 0.0, 0.0),
        ("e2", "b", 40, 0, 1, 0.0, 0.0),
    )


def test_power_analysis(spark, arms):
    rows = {r.experiment_id: r for r in planning.power_analysis(arms, 0.01).collect()}
    assert rows["e1"].baseline_rate == 0.05 and rows["e1"].required_n_per_variant == 8143
    assert rows["e1"].current_n_per_variant == 10000
    assert rows["e2"].baseline_rate == 0.0 and rows["e2"].current_n_per_variant == 333
    cart = {r.experiment_id: r.baseline_rate for r in planning.power_analysis(arms, 0.01, "add_to_cart_rate").collect()}
    assert cart["e1"] == 0.2
    with pytest.raises(ValueError):
        planning.power_analysis(arms, 0.01, "revenue_per_user")
    with pytest.raises(ValueError):
        planning.power_analysis(arms, 1.0)
    empty = arms.filter("false")
    assert planning.power_analysis(empty, 0.01).count() == 0


def test_smaller_effects_need_more_users(spark, arms):
    curve = planning.mde_curve(planning.power_analysis(arms, 0.01)).orderBy("experiment_id", "step").collect()
    assert len(curve) == 80 and curve[0].mde == 0.005 and curve[39].mde == pytest.approx(0.2)
    for e in ("e1", "e2"):
        sizes = [r.required_n for r in curve if r.experiment_id == e]
        assert sizes == sorted(sizes, reverse=True)
    assert curve[0].required_n == 31218


def test_sample_size_block(spark, arms):
    rows = {(r.experiment_id, r.variant): r for r in planning.sample_size_block(pair_with_control(arms)).collect()}
    row = rows["e1", "treatment"]
    assert row.current_n_per_variant == 10000 and row.minimum_detectable_effect == pytest.approx(0.00898596, abs=5e-8)
    assert row.required_n_for_80pct_power == pytest.approx(10000, abs=2)
    assert rows["e2", "a"].baseline_rate == 0.05 and rows["e2", "b"].current_n_per_variant == 470


@pytest.mark.parametrize("required, current, days, left", [(1000, 500, 10, 10), (500, 1000, 10, 0), (1000, 0, 10, 0), (1000, 5, 0, 0), (1000, 999, 14, 1)])
def test_days_to_significance(spark, required, current, days, left):
    got = one(spark.range(1).select(planning.days_to_significance(F.lit(required), F.lit(current), F.lit(days)).alias("d")))
    assert got.d == left


def test_progress(spark, arms):
    row = {r.experiment_id: r for r in planning.progress_to_power(planning.power_analysis(arms, 0.005), 14).collect()}["e1"]
    assert row.pct_of_required == pytest.approx(10000 / 31218 * 100) and not row.has_power
    assert row.days_left == 30


@pytest.mark.parametrize("lift", [0.023, -0.015, 0.0, 0.0125, 0.0015, -0.00049, 1.005, 12.345678, 0.1235, -0.3])
def test_texts_match_printf_rules(spark, lift):
    row = one(spark.range(1).select(
        display.format_lift(F.lit(lift)).alias("lift"),
        display.format_p_value(F.lit(abs(lift))).alias("p"),
        display.format_ci(F.lit(lift), F.lit(lift * 1000)).alias("ci"),
    ))
    pct = lift * 100
    assert row.lift == (f"+{pct:.1f}%" if pct >= 0 else f"{pct:.1f}%")
    assert row.p == ("p < 0.001" if abs(lift) < 0.001 else f"p = {abs(lift):.3f}")
    assert row.ci == f"[{lift:+.4f}, {lift * 1000:+.4f}]"


def test_missing_values_and_labels(spark):
    null = F.lit(None).cast("double")
    row = one(spark.range(1).select(
        display.format_lift(null).alias("a"), display.format_ci(null, F.lit(1.0)).alias("b"),
        display.significance_label(F.lit(True), "BH").alias("c"), display.significance_label(F.lit(False)).alias("d"),
        display.srm_color(F.lit(True)).alias("e"), display.srm_color(F.lit(False)).alias("f"),
        display.srm_message(F.lit(True)).alias("g"),
    ))
    assert (row.a, row.b, row.e, row.f) == ("N/A", "N/A", "red", "green")
    assert "Significant" in row.c and "BH" in row.c and "Not significant" in row.d
    assert "Mismatch detected" in row.g


def test_all_tests_of_an_experiment_form_one_family(spark, arms):
    pairs = pair_with_control(arms)
    rows = {(r.experiment_id, r.variant, r.metric): r for r in run_tests(pairs).collect()}
    assert len(rows) == 9
    hit = rows["e1", "treatment", "conversion_rate"]
    assert hit.significant and hit.significant_corrected and hit.relative_lift == pytest.approx(0.6)
    assert rows["e1", "treatment", "revenue_per_user"].absolute_lift is None
    assert rows["e2", "a", "conversion_rate"].p_value is None
    two = run_tests(pairs, ["conversion_rate", "revenue_per_user"], "bonferroni")
    assert two.count() == 6
    with pytest.raises(ValueError, match="Unknown metrics"):
        run_tests(pairs, ["clicks"])


@pytest.fixture(scope="module")
def dims(spark):
    return spark.createDataFrame([("e1", "One", "running"), ("e2", "Two", "stopped"), ("e3", "No users", "running")], "experiment_id string, name string, status string")


def test_analysis_document(spark, arms, dims):
    day = dt.date(2024, 1, 1)
    daily = spark.createDataFrame(
        [("e1", "treatment", day + dt.timedelta(days=i), 0.2 - 0.001 * i) for i in range(20)],
        "experiment_id string, variant string, date date, conversion_rate double",
    )
    propensity = spark.createDataFrame([("e1", 0.7, True, 0.02, 0.03, 0.01)], "experiment_id string, cv_auc double, imbalance_detected boolean, adjustment_magnitude double, unadjusted_lift double, adjusted_lift double")
    documents = analysis.analyze(arms, dims, propensity=propensity, daily=daily)
    rows = {r.experiment_id: r for r in documents.collect()}
    assert set(rows) == {"e1", "e2"}
    e1, e2 = rows["e1"], rows["e2"]
    assert e1.srm_check.actual_counts == {"control": 10000, "treatment": 10000} and not e1.srm_check.srm_detected
    assert [v.variant for v in e1.variants] == ["control", "treatment"]
    assert [t.metric for t in e1.frequentist] == ["add_to_cart_rate", "conversion_rate", "revenue_per_user"]
    assert e1.bayesian[0].probability_treatment_better > 0.999
    assert e1.bayesian[0].credible_interval_lower < 0.03 < e1.bayesian[0].credible_interval_upper
    assert e1.propensity.cv_auc == 0.7 and e1.novelty_check[0].novelty_detected
    assert e2.srm_check.srm_detected and len(e2.frequentist) == 6 and e2.propensity is None
    blocked = {r.experiment_id: r for r in analysis.analyze(arms, dims, block_on_srm=True).collect()}
    assert blocked["e2"].frequentist is None and len(blocked["e2"].variants) == 3
    assert len(blocked["e1"].frequentist) == 3


def test_result_rows_cover_every_metric_and_arm(spark, arms):
    tests = run_tests(pair_with_control(arms))
    rows = {(r.experiment_id, r.variant, r.metric_name): r for r in analysis.result_rows(arms, tests).collect()}
    assert len(rows) == 15
    control, treated = rows["e1", "control", "conversion_rate"], rows["e1", "treatment", "conversion_rate"]
    assert control.value == 0.05 and treated.value == 0.08 and control.p_value == treated.p_value


def test_latest_results_and_views(spark, arms):
    runs = spark.createDataFrame(
        [("e", "v", "m", 1.0, dt.datetime(2024, 1, 1)), ("e", "v", "m", 2.0, dt.datetime(2024, 1, 2)), ("e", "w", "m", 3.0, dt.datetime(2023, 1, 1))],
        "experiment_id string, variant_id string, metric_name string, value double, computed_at timestamp",
    )
    assert {r.value for r in newest_results(runs).collect()} == {2.0, 3.0}
    view = report.decision_view(run_tests(pair_with_control(arms)), srm_from_counts(arms.select("experiment_id", "variant", "n_users")))
    row = view.filter("experiment_id = 'e1' AND metric = 'conversion_rate'").first()
    assert (row.p_value_text, row.absolute_lift_text, row.relative_lift_text) == ("p < 0.001", "+3.0%", "+60.0%")
    assert row.ci_text == "[+0.0232, +0.0368]" and row.srm_color == "green"
    verdicts = report.propensity_verdict(spark.createDataFrame([(0.011,), (0.01,)], "adjustment_magnitude double")).collect()
    assert [r.adjustment_warning for r in verdicts] == [True, False]
