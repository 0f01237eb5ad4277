import datetime as dt
import random
import statistics

import pytest

from liftgrid.operators import metrics
from liftgrid.operators.assignment import Experiment, assign_all_users
from tests.conftest import one

EVENTS = "user_id string, event_type string, price double, event_time timestamp, date date"


def log(spark, rows):
    return spark.createDataFrame(
        [(u, k, p, dt.datetime(2024, 1, d, 8), dt.date(2024, 1, d)) for u, k, p, d in rows], EVENTS
    )


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(42)
    rows = []
    for i in range(200):
        rows.append((f"u{i}", "view", 5.0, 1))
        if rng.random() < 0.4:
            rows.append((f"u{i}", "cart", 5.0, rng.randint(1, 5)))
        if rng.random() < 0.2:
            rows += [(f"u{i}", "purchase", rng.random() * 90, rng.randint(1, 5))] * rng.randint(1, 3)
    rows += [("stranger", "purchase", 1e6, 1)]
    assigned = [(f"u{i}", "e", "control" if i % 2 else "treatment") for i in range(210)]
    return rows, assigned, log(spark, rows), spark.createDataFrame(
        assigned, "user_id string, experiment_id string, variant string"
    )


@pytest.mark.parametrize("window", [(None, None), (dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 4))])
def test_all_metrics_match_brute_force(world, window):
    rows, assigned, events, assignments = world
    start, end = window
    stats = metrics.compute_all_metrics(events, assignments, start, end)
    got = {r.variant: r for r in stats.collect()}
    inside = [
        r for r in rows
        if start is None or start <= dt.datetime(2024, 1, r[3], 8) < end
    ]
    for variant in ("control", "treatment"):
        users = [u for u, _, v in assigned if v == variant]
        revenue = [sum(p for w, k, p, _ in inside if w == u and k == "purchase") for u in users]
        bought = sum(any(w == u and k == "purchase" for w, k, _, _ in inside) for u in users)
        carted = sum(any(w == u and k == "cart" for w, k, _, _ in inside) for u in users)
        row = got[variant]
        assert (row.n_users, row.n_converters, row.n_carted) == (len(users), bought, carted)
        assert row.conversion_rate == bought / len(users)
        assert row.add_to_cart_rate == carted / len(users)
        assert row.mean_revenue == pytest.approx(statistics.fmean(revenue))
        assert row.std_revenue == pytest.approx(statistics.stdev(revenue))


def test_metric_tables_have_their_columns(world):
    _, _, events, assignments = world
    stats = metrics.compute_all_metrics(events, assignments)
    assert metrics.conversion_rate(stats).columns[2:] == ["n_users", "n_converters", "conversion_rate"]
    assert metrics.revenue_per_user(stats).columns[2:] == ["n_users", "mean_revenue", "std_revenue"]
    assert metrics.add_to_cart_rate(stats).columns[2:] == ["n_users", "n_carted", "add_to_cart_rate"]
    assert metrics.variant_cards(stats).count() == 2


def test_one_user_arm_has_zero_deviation(spark):
    events = log(spark, [("a", "purchase", 3.0, 1)])
    assigned = spark.createDataFrame([("a", "e", "control")], "user_id string, experiment_id string, variant string")
    row = one(metrics.compute_all_metrics(events, assigned))
    assert row.std_revenue == 0.0 and row.var_revenue is None and row.mean_revenue == 3.0


def test_single_pass_path_agrees_with_the_join_path(world):
    _, _, events, _ = world
    experiments = [Experiment("x"), Experiment("y", ("control", "b", "c"))]
    users = events.select("user_id").distinct()
    joined = metrics.compute_all_metrics(events, assign_all_users(users, experiments))
    single = metrics.arm_stats(assign_all_users(metrics.all_user_outcomes(events), experiments))
    key = lambda r: (r.experiment_id, r.variant)
    for a, b in zip(sorted(joined.collect(), key=key), sorted(single.collect(), key=key)):
        for name, value in a.asDict().items():
            assert b[name] == (pytest.approx(value) if isinstance(value, float) else value)


def arm_rows(spark, rows, flags=False):
    schema = "experiment_id string, variant string, n_users long" + (", is_control boolean" if flags else "")
    return spark.createDataFrame(rows, schema)


def test_control_arm_choice(spark):
    stats = arm_rows(spark, [("named", "control", 1), ("named", "a", 2), ("plain", "b", 3), ("plain", "a", 4), ("plain", "c", 5)])
    got = {(r.experiment_id, r.control, r.variant, r.control_n_users, r.treatment_n_users)
           for r in metrics.pair_with_control(stats).collect()}
    assert got == {("named", "control", "a", 1, 2), ("plain", "a", "b", 4, 3), ("plain", "a", "c", 4, 5)}
    flagged = arm_rows(spark, [("e", "control", 1, False), ("e", "z", 2, True)], flags=True)
    row = one(metrics.pair_with_control(flagged))
    assert (row.control, row.variant) == ("z", "control")


def test_daily_conversion_counts_distinct_users(spark):
    events = log(spark, [("a", "view", 1.0, 1), ("a", "purchase", 1.0, 1), ("a", "purchase", 1.0, 1),
                         ("b", "view", 1.0, 1), ("b", "view", 1.0, 2)])
    assigned = spark.createDataFrame([("a", "e", "t"), ("b", "e", "t")], "user_id string, experiment_id string, variant string")
    got = {(r.date.day, r.n_active, r.n_purchasers, r.conversion_rate) for r in metrics.daily_conversion(events, assigned).collect()}
    assert got == {(1, 2, 1, 0.5), (2, 1, 0, 0.0)}
