import datetime as dt
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from liftgrid.functions import distributions as dist
from liftgrid.operators import corrections, frequentist as fq
from tests.conftest import one


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def z_row(spark, n_c, x_c, n_t, x_t):
    frame = spark.createDataFrame([(n_c, x_c, n_t, x_t)], "control_n_users long, control_x long, treatment_n_users long, treatment_x long")
    return one(fq.two_proportion_z_test(frame, "x"))


def test_z_test_golden(spark):
    row = z_row(spark, 10000, 500, 10000, 800)
    assert row.z_stat == pytest.approx(8.604859293, rel=1e-9)
    assert row.p_value == pytest.approx(7.641e-18, rel=1e-3) and row.significant
    assert row.absolute_lift == pytest.approx(0.03) and row.relative_lift == pytest.approx(0.6)
    assert (row.ci_lower, row.ci_upper) == pytest.approx((0.023179438, 0.036820562), abs=1e-9)
    row = z_row(spark, 500, 25, 500, 26)
    assert row.z_stat == pytest.approx(0.143741379, rel=1e-8)
    assert row.p_value == pytest.approx(0.885704695, rel=1e-8) and not row.significant
    assert (row.ci_lower, row.ci_upper) == pytest.approx((-0.025270418, 0.029270418), abs=1e-9)


@pytest.mark.parametrize("counts", [(10, 0, 10, 0), (10, 10, 10, 10), (0, 0, 10, 3)])
def test_z_test_undefined_is_null(spark, counts):
    row = z_row(spark, *counts)
    assert row.z_stat is None and row.p_value is None and row.significant is False


def t_row(spark, control, treatment):
    stat = lambda xs: (len(xs), statistics.fmean(xs), statistics.variance(xs) if len(xs) > 1 else None)
    frame = spark.createDataFrame(
        [(*stat(control), *stat(treatment))],
        "control_n_users long, control_mean_x double, control_var_x double, "
        "treatment_n_users long, treatment_mean_x double, treatment_var_x double",
    )
    return one(fq.two_sample_t_test(frame, "x"))


def test_welch_matches_an_independent_library(spark):
    """Compared with the statistics library Spark itself ships."""
    rng = random.Random(3)
    a = [rng.gauss(10, 3) for _ in range(40)]
    b = [rng.gauss(11.5, 5) for _ in range(23)]
    row = t_row(spark, a, b)
    jvm = spark.sparkContext._jvm
    test = jvm.org.apache.commons.math3.stat.inference.TTest()
    gateway = spark.sparkContext._gateway

    def array(xs):
        out = gateway.new_array(jvm.double, len(xs))
        for i, x in enumerate(xs):
            out[i] = x
        return out

    assert row.t_stat == pytest.approx(test.t(array(b), array(a)), rel=1e-10)
    assert row.p_value == pytest.approx(test.tTest(array(b), array(a)), rel=1e-9)
    t = jvm.org.apache.commons.math3.distribution.TDistribution(float(len(a) + len(b) - 2))
    half = t.inverseCumulativeProbability(0.975) * math.sqrt(
        statistics.variance(a) / len(a) + statistics.variance(b) / len(b)
    )
    difference = statistics.fmean(b) - statistics.fmean(a)
    assert row.ci_lower == pytest.approx(difference - half, rel=1e-8)
    assert (row.ci_lower_welch > 0 or row.ci_upper_welch < 0) == row.significant
    pooled = math.sqrt((statistics.variance(a) + statistics.variance(b)) / 2)
    assert row.cohens_d == pytest.approx(difference / pooled)


def test_welch_interval_covers_a_clear_difference(spark):
    rng = random.Random(1)
    row = t_row(spark, [rng.gauss(10, 2) for _ in range(1000)], [rng.gauss(12, 2) for _ in range(1000)])
    assert row.ci_lower < 2.0 < row.ci_upper and row.significant


def test_welch_degenerate_samples(spark):
    row = t_row(spark, [1.0], [2.0, 3.0])
    assert row.t_stat is None and row.p_value is None and row.significant is False
    row = t_row(spark, [2.0, 2.0], [2.0, 2.0])
    assert row.t_stat is None and row.significant is False and row.cohens_d == 0.0
    row = t_row(spark, [1.0, 1.0], [2.0, 2.0])
    assert row.t_stat == float("inf") and row.p_value == 0.0 and row.significant


def test_sample_stats_feed_the_t_test(spark):
    frame = spark.createDataFrame([("c", 1.0), ("c", 3.0), ("t", 2.0)], "arm string, value double")
    rows = {r.arm: r for r in fq.sample_stats(frame, ["arm"]).collect()}
    assert (rows["c"].n_users, rows["c"].mean_value, rows["c"].var_value) == (2, 2.0, 2.0)
    assert rows["t"].var_value is None


@pytest.mark.parametrize("t, df, p", [(2.0, 10, 0.0733880348), (29.0, 6, 1.1138087e-07), (1.96, 5000, 0.0500512523), (-2.0, 10, 0.0733880348), (0.0, 4, 1.0)])
def test_t_tail_golden(spark, t, df, p):
    assert value(spark, dist.student_two_sided(F.lit(t), F.lit(float(df)))) == pytest.approx(p, rel=1e-8)


@pytest.mark.parametrize("z", [0.0, 0.3, 1.96, 8.604859293, 20.0])
def test_normal_tail(spark, z):
    assert value(spark, dist.normal_two_sided(F.lit(-z))) == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-12)


@pytest.mark.parametrize("df", [1.0, 2.0, 3.5, 30.0, 1e5, 1e7])
def test_t_critical_inverts_the_tail(spark, df):
    critical = dist.student_critical(0.05, F.lit(df))
    assert value(spark, dist.student_two_sided(critical, F.lit(df))) == pytest.approx(0.05, rel=1e-6)


def test_power_golden(spark):
    size = lambda mde: value(spark, fq.required_sample_size(F.lit(0.05), F.lit(mde)))
    assert (size(0.02), size(0.01), size(0.005)) == (2199, 8143, 31218)
    assert size(0.96) is None and size(0.0) is None
    mde = lambda n_c, n_t, p: value(spark, fq.minimum_detectable_effect(F.lit(n_c), F.lit(n_t), F.lit(p)))
    assert mde(10000, 10000, 0.05).mde == pytest.approx(0.008985960, abs=5e-8)
    assert mde(49823, 50177, 0.0312).mde == pytest.approx(0.003153998, abs=2e-8)
    small = mde(2, 2, 0.9)
    assert small.mde_capped and small.mde == pytest.approx(0.1)


def test_detectable_shift_reaches_the_power():
    normal = statistics.NormalDist()
    for alpha, power in ((0.05, 0.8), (0.2, 0.3), (0.01, 0.99)):
        shift, critical = dist.detectable_shift(alpha, power), normal.inv_cdf(1 - alpha / 2)
        assert normal.cdf(shift - critical) + normal.cdf(-shift - critical) == pytest.approx(power, abs=1e-12)


def daily(spark, rates, variant="treatment", experiment="e"):
    day = dt.date(2024, 1, 1)
    return spark.createDataFrame(
        [(experiment, variant, day + dt.timedelta(days=i), r) for i, r in enumerate(rates)],
        "experiment_id string, variant string, date date, conversion_rate double",
    )


def test_novelty_golden_and_short_series(spark):
    # A decaying series (fixed values).
    early = [0.15, 0.14, 0.15, 0.13, 0.14, 0.15, 0.14]
    frames = [
        daily(spark, early + [0.06] * 14), daily(spark, [0.2] * 21, "control"),
        daily(spark, early, experiment="short"), daily(spark, [0.06] * 14 + early, experiment="rising"),
        daily(spark, [0.1] * 7 + [0.05] * 7, experiment="flat"),
    ]
    union = frames[0]
    for f in frames[1:]:
        union = union.unionByName(f)
    rows = {r.experiment_id: r for r in fq.novelty_effect_test(union).collect()}
    assert len(rows) == 4 and all(r.variant == "treatment" for r in rows.values())
    row = rows["e"]
    assert row.novelty_detected and row.t_stat == pytest.approx(29.0)
    assert row.p_value == pytest.approx(5.569e-08, rel=1e-3) and row.early_mean > row.post_early_mean
    short = rows["short"]
    assert (short.novelty_detected, short.p_value, short.post_early_mean) == (False, 1.0, None)
    assert short.early_mean == pytest.approx(statistics.fmean(early))
    assert rows["rising"].p_value == 1.0 and not rows["rising"].novelty_detected
    assert rows["flat"].p_value == 0.0 and rows["flat"].novelty_detected


def test_novelty_follows_the_chosen_control(spark):
    from liftgrid.operators.metrics import control_of

    frame = daily(spark, [0.2] * 9, "a").unionByName(daily(spark, [0.2] * 9, "b"))
    got = fq.novelty_effect_test(frame, control=control_of(frame)).collect()
    assert [r.variant for r in got] == ["b"]


def p_values(spark, ps, experiment="e"):
    return spark.createDataFrame(
        [(experiment, f"m{i:02d}", "t", p) for i, p in enumerate(ps)],
        "experiment_id string, metric string, variant string, p_value double",
    )


# Two lists of p-values (fixed values).
FIRST = [0.001, 0.003, 0.01, 0.08, 0.12, 0.25, 0.40, 0.55, 0.70, 0.90]
SECOND = [0.001, 0.01, 0.03, 0.04, 0.06, 0.10, 0.20, 0.40, 0.60, 0.80]


def test_corrections_golden(spark):
    both = p_values(spark, FIRST, "first").unionByName(p_values(spark, SECOND, "second"))
    for method, expected in (("benjamini_hochberg", {"first": 3, "second": 2}), ("bonferroni", {"first": 2, "second": 1})):
        summary = corrections.rejection_summary(corrections.apply_corrections(both, method))
        assert {r.experiment_id: r.n_rejected for r in summary.collect()} == expected
    with pytest.raises(ValueError, match="Unknown correction method"):
        corrections.apply_corrections(both, "holm")


def test_step_up_rejects_ranks_below_a_passing_one_and_never_nulls(spark):
    rows = corrections.benjamini_hochberg(p_values(spark, [0.04, 0.045, 0.049, None])).collect()
    assert {r.p_value: r.significant_corrected for r in rows} == {0.04: False, 0.045: False, 0.049: False, None: False}
    rows = corrections.benjamini_hochberg(p_values(spark, [0.03, 0.04, 0.049])).collect()
    assert all(r.significant_corrected for r in rows)
    assert not any(r.significant_corrected for r in corrections.bonferroni(p_values(spark, [None, 0.03])).collect())


def test_t_tail_falls_with_df_without_a_jump(spark):
    """Near and far beyond a million degrees of freedom, against the normal tail and its first terms."""
    import math

    for t in (1.5, 8.0, 20.0, 37.0):
        previous = None
        for df in (9.99e5, 1e6 - 1, 1e6 + 1, 1.001e6, 1e8, 1e10):
            p = value(spark, dist.student_two_sided(F.lit(t), F.lit(df)))
            # log of the ratio to the normal tail, to first order in 1 / df, over t = 1.5 only
            if t == 1.5:
                phi = math.exp(-t * t / 2) / math.sqrt(2 * math.pi)
                first = math.erfc(t / math.sqrt(2)) + 2 * phi * t * (t * t + 1) / (4 * df)
                assert p == pytest.approx(first, rel=1e-9)
            assert previous is None or p <= previous * (1 + 1e-10)
            previous = p
