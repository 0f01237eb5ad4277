"""Plans that read the log once, and what they compute, against brute force."""

import datetime as dt
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from liftgrid.operators import metrics
from liftgrid.operators.assignment import Experiment
from liftgrid.operators.features import user_features
from liftgrid.operators.ipw import weighted_moments
from liftgrid.plans.analysis import analyze_experiments
from tests.conftest import one
from workload import queries

SMALL = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans(df):
    return re.findall(r"parquet .*?/(\w+)\.parquet", plan_of(df)), len(re.findall(r"Scan parquet|FileScan", plan_of(df)))


def test_features_read_the_log_once(spark):
    for log, tables in ((queries.clean, 1), (queries.clean_orders, 3)):
        df = user_features(log(spark, SMALL))
        assert len(re.findall(r"FileScan parquet", plan_of(df))) == tables
        # first shuffle by cells finer than the user, so that a hot user is spread
        assert re.search(r"hashpartitioning\(user_id#\d+, user_session#\d+, date#\d+, liked#\d+", plan_of(df))


def test_windows_of_all_experiments_come_from_one_scan(spark):
    df = metrics.assigned_outcomes(queries.clean(spark, SMALL), queries.EXPERIMENTS)
    assert len(re.findall(r"FileScan parquet", plan_of(df))) == 1 and "Join" not in plan_of(df)


EXPERIMENTS = [
    Experiment("a", start=dt.datetime(2024, 1, 2), end=dt.datetime(2024, 1, 4)),
    Experiment("b", start=dt.datetime(2024, 1, 3, 12)),
    Experiment("c", end=dt.datetime(2024, 1, 4)),
    Experiment("d"),
    Experiment("e", start=dt.datetime(2024, 1, 4), end=dt.datetime(2024, 1, 4)),
]


@pytest.mark.parametrize("windowed", [metrics.MEASURES, metrics.RATES, ()])
def test_outcomes_in_each_experiments_dates(spark, windowed):
    rng = random.Random(5)
    rows = []
    for _ in range(400):
        time = rng.choice([None, *[dt.datetime(2024, 1, d, h) for d in range(1, 6) for h in (0, 11, 12, 23)]])
        user = "hot" if rng.random() < 0.4 else f"u{rng.randrange(12)}"
        rows.append((user, rng.choice(["view", "cart", "purchase"]), float(rng.randint(1, 9)), time))
    events = spark.createDataFrame(rows, "user_id string, event_type string, price double, event_time timestamp")
    got = {
        (r.user_id, r.experiment_id): (r.n_purchases, r.revenue, r.n_carts)
        for r in metrics.assigned_outcomes(events, EXPERIMENTS, windowed).collect()
    }
    assert len(got) == len({r[0] for r in rows}) * len(EXPERIMENTS)
    for e in EXPERIMENTS:
        def inside(t, measure):
            if measure not in windowed or (e.start is None and e.end is None):
                return True
            return t is not None and (e.start is None or t >= e.start) and (e.end is None or t < e.end)

        for user in {r[0] for r in rows}:
            own = [r for r in rows if r[0] == user]
            want = (
                sum(k == "purchase" and inside(t, "n_purchases") for _, k, _, t in own),
                sum(p for _, k, p, t in own if k == "purchase" and inside(t, "revenue")),
                sum(k == "cart" and inside(t, "n_carts") for _, k, _, t in own),
            )
            assert got[user, e.experiment_id] == want


def test_no_experiments_and_no_events(spark):
    none = spark.createDataFrame([], "user_id string, event_type string, price double, event_time timestamp")
    assert metrics.assigned_outcomes(none, EXPERIMENTS).collect() == []


def test_weighted_moments_do_not_cancel(spark):
    rng = np.random.default_rng(1)
    x, w, t = 1e9 + rng.normal(size=500), rng.uniform(0.1, 10, 500), rng.integers(0, 2, 500)
    rows = [("e", float(a), float(b), int(c)) for a, b, c in zip(x, w, t)] + [("e", None, 1.0, 0), ("e", 5.0, None, 1)]
    df = spark.createDataFrame(rows, "experiment_id string, v double, weight double, treatment int").repartition(7)
    moments = weighted_moments(df, "v")
    assert len(re.findall("Scan ExistingRDD", plan_of(moments))) == 1
    row = one(moments)
    for arm, flag in (("c", 0), ("t", 1)):
        a, b = x[t == flag], w[t == flag]
        mean = (a * b).sum() / b.sum()
        squares = (b * (a - mean) ** 2).sum()
        assert row[f"{arm}_w"] == pytest.approx(b.sum())
        assert row[f"{arm}_mean"] == pytest.approx(mean, rel=1e-14)
        assert row[f"{arm}_ss"] == pytest.approx(squares, rel=1e-5)
        assert row[f"{arm}_var"] == pytest.approx(squares / (b.sum() - 1), rel=1e-5)


def test_moments_of_one_arm_and_one_row(spark):
    df = spark.createDataFrame([("e", 2.0, 3.0, 1)], "experiment_id string, v double, weight double, treatment int")
    row = one(weighted_moments(df, "v"))
    assert (row.t_w, row.t_mean, row.t_ss, row.c_w, row.c_mean) == (3.0, 2.0, 0.0, None, None)


def test_propensity_part_in_one_call(spark):
    events = queries.clean(spark, SMALL)
    experiments, _ = queries.experiment_dims(spark)
    assignments = queries.assignments(spark, SMALL)
    documents = analyze_experiments(events, assignments, experiments, use_propensity="category").collect()
    assert len(documents) == 4
    for d in documents:
        assert d.propensity is not None and d.propensity.adjustment_magnitude is not None
        assert len(d.bayesian) == len(d.variants) - 1 and len(d.frequentist) == 3 * len(d.bayesian)
    plain = analyze_experiments(events, assignments, experiments)
    assert plain.filter(F.col("propensity").isNotNull()).count() == 0
