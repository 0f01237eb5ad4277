"""Control tables, the end-to-end jobs, and incremental ingestion."""

import random
from multiprocessing.pool import ThreadPool

import pytest
from pyspark import inheritable_thread_target
from pyspark.sql import functions as F

from liftgrid.operators.assignment import Experiment, experiments_frame, variants_frame
from liftgrid.plans.pipeline import analyze_and_store, build_tables, enroll
from liftgrid.schemas import CLEAN_EVENTS, USER_FEATURES
from liftgrid.sources.control_tables import ControlTables, absent_rows, newest_results
from liftgrid.sources.events import read_events, read_features
from liftgrid.streaming.ingest import ingest_events, raw_event_stream
from tests.test_cleaning import write_csv

EXPERIMENTS = [Experiment("exp_A", name="Page"), Experiment("exp_B", name="Banner")]


@pytest.fixture
def tables(spark, tmp_path):
    tables = ControlTables(spark, f"db_{tmp_path.name}".lower(), str(tmp_path / "control"))
    tables.create()
    tables.create()
    return tables


def test_inserts_are_idempotent(spark, tables):
    for _ in range(2):
        tables.add_experiments(experiments_frame(spark, EXPERIMENTS))
        tables.add_variants(variants_frame(spark, EXPERIMENTS))
    assert tables.read("experiments").count() == 2 and tables.read("variants").count() == 4
    schema = "user_id string, experiment_id string, variant_id string"
    tables.add_assignments(spark.createDataFrame([("u1", "exp_A", "exp_A_control")], schema))
    tables.add_assignments(spark.createDataFrame(
        [("u1", "exp_A", "exp_A_treatment"), ("u2", "exp_A", "exp_A_treatment"), ("u2", "exp_A", "exp_A_treatment"), ("u1", "exp_B", "exp_B_control")], schema
    ))
    got = {(r.user_id, r.experiment_id): r.variant for r in tables.assignments().collect()}
    assert got == {("u1", "exp_A"): "control", ("u2", "exp_A"): "treatment", ("u1", "exp_B"): "control"}
    assert tables.read("user_assignments").count() == 3
    assert tables.assignments("exp_B").count() == 1
    assert tables.read("user_assignments").filter("assigned_at IS NULL").count() == 0


def test_stop_appends_a_version(spark, tables):
    tables.add_experiments(experiments_frame(spark, EXPERIMENTS))
    tables.stop("exp_A")
    rows = {r.experiment_id: r for r in tables.experiments().collect()}
    assert rows["exp_A"].status == "stopped" and rows["exp_A"].end_date is not None
    assert rows["exp_B"].status == "running" and rows["exp_B"].end_date is None
    assert tables.experiment("exp_A").name == "Page"
    tables.add_experiments(experiments_frame(spark, EXPERIMENTS))
    assert tables.experiment("exp_A").status == "stopped"
    with pytest.raises(LookupError):
        tables.stop("exp_Z")


def raw_files(directory, seed=0, users=120):
    rng = random.Random(seed)
    for month in ("2020-01", "2020-02"):
        lines = []
        for i in range(600):
            kind = rng.choice(["view"] * 6 + ["cart", "purchase", "bogus"])
            lines.append(f"{month}-{rng.randint(1, 28):02d} 10:00:00 UTC,{kind},p{i % 9},1,cat{i % 4},b,{rng.random() * 40:.2f},u{rng.randrange(users)},s{i % 50}")
        write_csv(directory / f"{month}.csv", *lines)


def test_from_raw_files_to_stored_results(spark, tables, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    raw_files(raw)
    events_path, features_path = str(tmp_path / "events"), str(tmp_path / "features")
    build_tables(spark, str(raw), events_path, features_path)
    features = read_features(spark, features_path)
    assert [f.name for f in features.schema] == USER_FEATURES.names
    assert [f.dataType for f in features.schema] == [f.dataType for f in USER_FEATURES]
    assert read_features(spark, features_path, ["user_id"]).columns == ["user_id"]
    n_users = features.count()
    for _ in range(2):
        summary = enroll(tables, features, EXPERIMENTS).collect()
    assert [(r.experiment_id, r.variant) for r in summary] == [
        (e, v) for e in ("exp_A", "exp_B") for v in ("control", "treatment")
    ]
    assert sum(r.n_users for r in summary) == 2 * n_users
    events = read_events(spark, events_path)
    one_experiment = analyze_and_store(tables, events, "exp_A").collect()
    assert len(one_experiment) == 1 and one_experiment[0].name == "Page"
    documents = analyze_and_store(tables, events, metrics=["conversion_rate", "revenue_per_user"]).collect()
    assert {len(d.frequentist) for d in documents} == {2}
    results = tables.read("experiment_results")
    assert results.count() == 6 + 12
    newest = newest_results(results).collect()
    assert len(newest) == 12 and {r.variant_id for r in newest} == {
        "exp_A_control", "exp_A_treatment", "exp_B_control", "exp_B_treatment"
    }
    with pytest.raises(LookupError):
        analyze_and_store(tables, events, "exp_Z")
    assert tables.latest_results("exp_B").count() == 6


def test_experiment_without_users_is_refused(spark, tables):
    tables.add_experiments(experiments_frame(spark, EXPERIMENTS))
    with pytest.raises(LookupError, match="No results"):
        tables.latest_results("exp_A")
    with pytest.raises(ValueError, match="No user assignments"):
        analyze_and_store(tables, spark.createDataFrame([], CLEAN_EVENTS), "exp_A")


def test_assigned_users_without_events_have_undefined_tests(spark, tables):
    tables.add_experiments(experiments_frame(spark, EXPERIMENTS[:1]))
    tables.add_variants(variants_frame(spark, EXPERIMENTS[:1]))
    users = [(f"u{i}", "exp_A", f"exp_A_{'control' if i < 100 else 'treatment'}") for i in range(200)]
    tables.add_assignments(spark.createDataFrame(users, "user_id string, experiment_id string, variant_id string"))
    document = analyze_and_store(tables, spark.createDataFrame([], CLEAN_EVENTS), "exp_A").first()
    assert [v.n_users for v in document.variants] == [100, 100]
    assert all(t.p_value is None and not t.significant for t in document.frequentist)
    assert document.bayesian[0].probability_treatment_better == pytest.approx(0.5, abs=1e-9)


def test_flagged_control_arm_is_used(spark, tables):
    experiment = Experiment("exp_F", ("new", "old"), control="old")
    tables.add_experiments(experiments_frame(spark, [experiment]))
    tables.add_variants(variants_frame(spark, [experiment]))
    users = [(f"u{i}", "exp_F", f"exp_F_{'old' if i % 2 else 'new'}") for i in range(40)]
    tables.add_assignments(spark.createDataFrame(users, "user_id string, experiment_id string, variant_id string"), ["exp_F"])
    document = analyze_and_store(tables, spark.createDataFrame([], CLEAN_EVENTS)).first()
    assert {t.variant for t in document.frequentist} == {"new"}


def test_stream_ingests_each_file_once(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    raw_files(raw)
    out, checkpoint = str(tmp_path / "events"), str(tmp_path / "checkpoint")

    def run():
        ingest_events(raw_event_stream(spark, str(raw), 1), out, checkpoint).awaitTermination()
        return read_events(spark, out)

    first = run().count()
    assert run().count() == first
    write_csv(raw / "2020-03.csv", "2020-03-01 10:00:00 UTC,view,p1,1,c,b,1,u1,s1", "2020-03-01 10:00:00 UTC,bogus,p1,1,c,b,1,u1,s1")
    again = run()
    assert again.count() == first + 1 and again.filter(F.col("date") == "2020-03-01").count() == 1


def test_jobs_that_insert_at_once_leave_one_row_per_key(spark, tables):
    """Both jobs find every user absent; all readers agree on one variant of each."""
    tables.add_experiments(experiments_frame(spark, EXPERIMENTS))
    schema = "user_id string, experiment_id string, variant_id string"

    def job(variant):
        mine = ControlTables(spark, tables.database, tables.location)
        mine.add_variants(variants_frame(spark, EXPERIMENTS))
        rows = [(f"u{i}", e, f"{e}_{variant}") for i in range(200) for e in ("exp_A", "exp_B")]
        mine._append("user_assignments", absent_rows(
            spark.createDataFrame(rows, schema), mine.read("user_assignments").filter("false"), ["user_id", "experiment_id"]
        ).withColumn("assigned_at", F.current_timestamp()))

    with ThreadPool(4) as pool:
        pool.map(inheritable_thread_target(spark)(job), ["control", "treatment", "control", "treatment"])
    assert tables.read("user_assignments").count() == 4 * 400
    first = {(r.user_id, r.experiment_id): r.variant for r in tables.assignments().collect()}
    assert len(first) == 400 == tables.assignments().count() and tables.variants().count() == 4
    again = ControlTables(spark, f"{tables.database}_again", tables.location)
    again.create()
    assert {(r.user_id, r.experiment_id): r.variant for r in again.assignments().collect()} == first
    tables.add_assignments(spark.createDataFrame([("u1", "exp_A", "exp_A_treatment"), ("new", "exp_A", "exp_A_control")], schema))
    assert tables.assignments("exp_A").count() == 201


def test_a_batch_is_seen_whole_or_not_at_all(spark, tables):
    rows = variants_frame(spark, EXPERIMENTS)
    broken = rows.withColumn("name", F.raise_error(F.lit("lost")))
    with pytest.raises(Exception, match="lost"):
        tables._append("variants", broken)
    assert tables.read("variants").count() == 0
    tables.add_variants(rows)
    assert tables.variants().count() == 4
