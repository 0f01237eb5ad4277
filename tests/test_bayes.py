import numpy as np
import pytest
from pyspark.sql import functions as F

from liftgrid.operators import bayes, convergence
from tests.conftest import one


def pairs(spark, *counts):
    return spark.createDataFrame(
        [(f"e{i}", "treatment", *c) for i, c in enumerate(counts)],
        "experiment_id string, variant string, control_n_users long, control_n_converters long, "
        "treatment_n_users long, treatment_n_converters long",
    )


CASES = [
    (1000, 50, 1000, 65), (10000, 500, 10000, 560), (20, 0, 20, 0), (5, 5, 100000, 50000),
    (1000000, 500, 30, 1), (0, 0, 0, 0), (10**9, 5 * 10**7, 10**9, 5 * 10**7 + 9000),
]


@pytest.fixture(scope="module")
def compared(spark):
    return {
        r.experiment_id: r
        for r in bayes.compare_posteriors(bayes.posterior_params(pairs(spark, *CASES))).collect()
    }


def test_golden_probability_and_loss(compared):
    assert compared["e0"].probability_treatment_better == pytest.approx(0.924480, abs=1e-5)
    assert compared["e0"].expected_loss == pytest.approx(3.5497e-04, rel=1e-3)
    assert compared["e1"].probability_treatment_better == pytest.approx(0.970838, abs=5e-6)
    assert compared["e1"].expected_loss == pytest.approx(3.5675e-05, rel=1e-3)


@pytest.mark.parametrize("case", range(len(CASES)))
def test_against_simulation(compared, case):
    n_c, x_c, n_t, x_t = CASES[case]
    rng = np.random.default_rng(0)
    c = rng.beta(1 + x_c, 1 + n_c - x_c, 400_000)
    t = rng.beta(1 + x_t, 1 + n_t - x_t, 400_000)
    row = compared[f"e{case}"]
    assert row.probability_treatment_better == pytest.approx((t > c).mean(), abs=4e-3)
    loss = np.maximum(c - t, 0)
    assert row.expected_loss == pytest.approx(loss.mean(), abs=5 * loss.std() / 600 + 1e-12)


def test_identical_arms_are_even(compared):
    assert compared["e2"].probability_treatment_better == pytest.approx(0.5, abs=1e-10)
    assert compared["e5"].probability_treatment_better == pytest.approx(0.5, abs=1e-10)
    assert compared["e5"].expected_loss == pytest.approx(1 / 6, rel=1e-9)


@pytest.mark.parametrize("threshold", [-0.01, 0.004, 0.5])
def test_loss_with_threshold(spark, threshold):
    params = bayes.posterior_params(pairs(spark, (1000, 50, 1200, 65), (50, 10, 3000, 500)))
    rows = params.select("control_alpha", "control_beta", "treatment_alpha", "treatment_beta", bayes.expected_loss(threshold).alias("loss")).collect()
    rng = np.random.default_rng(1)
    for r in rows:
        draws = np.maximum(rng.beta(r.control_alpha, r.control_beta, 500_000) - rng.beta(r.treatment_alpha, r.treatment_beta, 500_000), threshold)
        assert r.loss == pytest.approx(draws.mean(), abs=6 * draws.std() / 700 + 1e-9)


def test_density_integrates_to_one(spark):
    rows = bayes.posterior_density(bayes.posterior_params(pairs(spark, CASES[0], CASES[1]))).orderBy("experiment_id", "point").toPandas()
    assert len(rows) == 600
    for _, curve in rows.groupby("experiment_id"):
        for arm in ("control", "treatment"):
            area = np.trapezoid(curve[f"{arm}_density"], curve["x"])
            assert area == pytest.approx(1.0, abs=2e-3)


def simulated_interval(case, n=2_000_000):
    n_c, x_c, n_t, x_t = case
    rng = np.random.default_rng(4)
    d = np.sort(rng.beta(1 + x_t, 1 + n_t - x_t, n) - rng.beta(1 + x_c, 1 + n_c - x_c, n))
    return d


INTERVALS = [(1000, 50, 1000, 65), (70, 45, 80, 52), (100, 0, 50, 0), (10000, 0, 50, 0), (0, 0, 0, 0), (100_000, 5000, 100_000, 5100), (5, 2, 998, 899)]


def test_interval_golden(spark):
    row = one(bayes.credible_intervals(bayes.posterior_params(pairs(spark, (1000, 50, 1000, 65)))))
    assert (row.credible_interval_lower, row.credible_interval_upper) == pytest.approx((-0.0055401, 0.0355365), abs=1e-7)


@pytest.mark.parametrize("alpha", [0.05, 0.3])
def test_intervals_hold_their_mass_and_are_narrowest(spark, alpha):
    rows = bayes.credible_intervals(bayes.posterior_params(pairs(spark, *INTERVALS)), alpha).orderBy("experiment_id").collect()
    for case, row in zip(INTERVALS, rows, strict=True):
        d = simulated_interval(case)
        low, high = row.credible_interval_lower, row.credible_interval_upper
        assert (np.searchsorted(d, high) - np.searchsorted(d, low)) / len(d) == pytest.approx(1 - alpha, abs=2e-3)
        run = int((1 - alpha) * len(d))
        assert high - low == pytest.approx((d[run:] - d[:-run]).min(), rel=6e-3)


def test_fit_conversion_joins_all_parts(spark):
    df = bayes.fit_conversion(pairs(spark, *CASES[:2]))
    assert "MapInPandas" not in df._jdf.queryExecution().toString()
    rows = df.collect()
    assert len(rows) == 2
    assert all(r.credible_interval_lower < r.credible_interval_upper for r in rows)


def test_normal_scores_equal_the_standard_library(spark):
    from statistics import NormalDist

    from liftgrid.functions.distributions import normal_score
    chances = [1e-300, 1e-12, 0.001, 0.0749, 0.0751, 0.3, 0.5, 0.7, 0.925, 0.9999, 1 - 1e-12]
    rows = spark.createDataFrame([(p,) for p in [*chances, 0.0, 1.0]], "p double").select("p", normal_score(F.col("p")).alias("z")).collect()
    got = {r.p: r.z for r in rows}
    assert got[0.0] is None and got[1.0] is None
    for p in chances:
        assert got[p] == pytest.approx(NormalDist().inv_cdf(p), rel=1e-12, abs=1e-12)


def chains_of(spark, values, chains=4):
    rows = [("e", k % chains, k // chains, float(v)) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "experiment_id string, chain int, draw long, value double")


def plain_rhat(values, chains=4):
    from statistics import NormalDist
    order = np.sort(values)
    rank = (np.searchsorted(order, values, "left") + np.searchsorted(order, values, "right") + 1) / 2
    z = np.array([NormalDist().inv_cdf((r - 0.375) / (len(values) + 0.25)) for r in rank])
    length = len(values) // chains // 2 * 2
    halves = [h for c in range(chains) for h in np.split(z[c::chains][:length], 2)]
    w, n = np.mean([h.var(ddof=1) for h in halves]), length // 2
    pooled = (n - 1) / n * w + np.var([h.mean() for h in halves], ddof=1)
    width = int(np.sqrt(n))
    means = [b.mean() for h in halves for b in np.split(h[: n // width * width], n // width)]
    return np.sqrt(pooled / w), n * len(halves) * pooled / (np.var(means, ddof=1) * width)


def test_convergence_against_a_plain_computation(spark):
    rng = np.random.default_rng(2)
    for values in (rng.standard_cauchy(403), np.round(rng.normal(size=200), 1), np.cumsum(rng.normal(size=160)), np.arange(64) % 4 + rng.normal(size=64)):
        row = one(convergence.convergence(chains_of(spark, values), ["experiment_id"]))
        assert (row.rhat, row.effective_size) == pytest.approx(plain_rhat(values), rel=1e-9)
        assert row.converged == (row.rhat < 1.1)


def test_convergence_of_nothing_much(spark):
    assert convergence.convergence(chains_of(spark, []), ["experiment_id"]).collect() == []
    for values in ([1.0] * 40, [1.0, 2.0, 3.0]):
        row = convergence.convergence(chains_of(spark, values), ["experiment_id"]).collect()
        assert [r.converged for r in row] in ([], [False])
    assert one(convergence.convergence(chains_of(spark, [1.0] * 40), ["experiment_id"])).rhat is None
