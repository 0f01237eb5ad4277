"""Every registered query beside its DuckDB twin, and the shape of the plans."""

import datetime as dt
import importlib.util
import re
from pathlib import Path

import pytest

from workload import compare, oracles, queries

DATA = Path("/root/testdata/sf0.01")
SMALL = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="test tables are not mounted")


@pytest.fixture(scope="module")
def connection():
    return compare.connect(str(DATA))


@pytest.mark.parametrize("name", sorted(oracles.all_oracles()))
def test_query_matches_its_twin(spark, connection, name):
    assert compare.compare(spark, str(DATA), name, connection) is None


@pytest.mark.parametrize("name", sorted(set(queries.all_queries()) - set(oracles.all_oracles())))
def test_query_without_twin_returns_rows(spark, name):
    assert queries.all_queries()[name](spark, str(DATA)).count() > 0


def test_driver_contract(spark):
    spec = importlib.util.spec_from_file_location("entry", Path(__file__).parents[1] / "__spark_entry__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    flagship = module.entry(spark)
    assert flagship.count() == 5 and "p_value" in flagship.columns
    assert set(module.oracle_sql()) <= set(module.queries())


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


SQL_ONLY = [
    "user_features", "user_features_orders", "favorite_category", "assign_users", "srm_check",
    "all_metrics", "daily_conversion", "z_test_orders", "welch_t_test", "corrections_bh",
    "novelty", "prob_treatment_better", "ipw_conversion", "covariate_balance",
]


@pytest.mark.parametrize("name", SQL_ONLY)
def test_plans_stay_in_the_jvm_without_cross_products(spark, name):
    text = plan(queries.all_queries()[name](spark, str(SMALL)))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "InPandas", "SinglePartition"):
        assert operator not in text, (name, operator)


def test_single_pass_metrics_need_two_shuffles(spark):
    """User and arm; with windows per experiment also user and slot, before the user."""
    for frame, shuffles in ((queries.whole_arms, 2), (queries.arms, 3)):
        text = plan(frame(spark, str(SMALL)))
        assert text.count("Exchange hashpartitioning") == shuffles
        assert text.count("FileScan") == 1 and "Join" not in text


def test_features_need_one_scan_and_two_shuffles(spark):
    """Cells of user and session, day or category together, then users; nothing is joined."""
    text = plan(queries.q_user_features(spark, str(SMALL)))
    assert text.count("Exchange hashpartitioning") == 2
    assert text.count("FileScan") == 1 and "Join" not in text


def test_outcome_filters_reach_the_scan(spark, tmp_path):
    from liftgrid.operators.metrics import user_outcomes
    from liftgrid.sources.events import read_events, write_events

    write_events(queries.clean(spark, str(SMALL)), str(tmp_path / "events"))
    stored = read_events(spark, str(tmp_path / "events"))
    text = plan(user_outcomes(stored, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 3)))
    assert re.search(r"PartitionFilters: \[[^\]]*date", text)
    assert re.search(r"PushedFilters: \[[^\]]*In\(event_type", text)
    assert "GreaterThanOrEqual(event_time" in text
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"event_time", "event_type", "price", "user_id"}
