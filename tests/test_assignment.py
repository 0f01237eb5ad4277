import hashlib

import pytest
from pyspark.sql import functions as F

from liftgrid.operators import assignment as asg
from liftgrid.operators.assignment import Experiment
from tests.conftest import one


def reference_variant(user, experiment, variants, traffic=1.0):
    slot = int(hashlib.sha256(f"{user}:{experiment}".encode()).hexdigest()[:8], 16) % 10000
    return variants[slot % len(variants)] if slot < int(traffic * 10000) else None


@pytest.fixture(scope="module")
def users(spark):
    return spark.range(10000).select(F.col("id").cast("string").alias("user_id"))


def test_known_buckets(spark, users):
    rows = users.withColumn("b", asg.bucket(F.col("user_id"), F.lit("exp_A"))).collect()
    slots = {r.user_id: r.b for r in rows}
    assert slots["1"] == 9507
    assert sum(s % 2 for s in slots.values()) == 4995


def test_bulk_assignment_agrees_with_the_definition(spark, users):
    experiments = [
        Experiment("exp_A"),
        Experiment("exp_C", ("control", "a", "b")),
        Experiment("exp_D", traffic_pct=0.57),
        Experiment("exp_0", traffic_pct=0.0),
    ]
    got = {(r.user_id, r.experiment_id): r.variant for r in asg.assign_all_users(users, experiments).collect()}
    expected = {}
    for e in experiments:
        for i in range(10000):
            variant = reference_variant(str(i), e.experiment_id, e.variants, e.traffic_pct)
            if variant is not None:
                expected[str(i), e.experiment_id] = variant
    assert got == expected
    single = users.withColumn("v", asg.assign_variant(F.col("user_id"), experiments[2]))
    assert {r.user_id: r.v for r in single.collect() if r.v} == {
        u: v for (u, e), v in expected.items() if e == "exp_D"
    }


def test_threshold_truncates_and_extra_columns_survive(spark):
    assert Experiment("e", traffic_pct=0.57).threshold == 5699
    frame = spark.createDataFrame([(7, 1.5)], "user_id long, revenue double")
    assert asg.assign_all_users(frame, [Experiment("exp_A")]).columns == [
        "user_id", "experiment_id", "variant", "revenue"
    ]


def counts(spark, *rows):
    return spark.createDataFrame(list(rows), "experiment_id string, variant string, n_users long")


@pytest.mark.parametrize(
    "control, treatment, chi2, p, gof, p_gof, detected",
    [
        (900, 100, 380.952381, 0.0, 640.0, 0.0, True),
        (5200, 4800, 8.003201281, 0.004669472, 16.0, 6.334e-05, True),
        (49823, 50177, 0.626581963, 0.428611851, 1.25316, 0.262949792, False),
        (500, 500, 0.0, 1.0, 0.0, 1.0, False),
    ],
)
def test_srm_golden(spark, control, treatment, chi2, p, gof, p_gof, detected):
    row = one(asg.srm_from_counts(counts(spark, ("e", "control", control), ("e", "treatment", treatment))))
    assert row.chi2 == pytest.approx(chi2, rel=1e-8) and row.chi2_gof == pytest.approx(gof, rel=1e-8)
    assert row.p_value == pytest.approx(p, abs=1e-9) and row.p_value_gof == pytest.approx(p_gof, abs=1e-8)
    assert row.srm_detected is detected and row.expected_ratio == 0.5
    assert row.actual_counts == {"control": control, "treatment": treatment}


def test_srm_of_many_experiments_single_and_empty_variants(spark):
    assigned = spark.createDataFrame(
        [(str(i), "skewed", "control" if i < 900 else "treatment") for i in range(1000)]
        + [(str(i), "alone", "control") for i in range(10)],
        "user_id string, experiment_id string, variant string",
    )
    rows = {r.experiment_id: r for r in asg.check_srm(assigned).collect()}
    assert rows["skewed"].srm_detected and rows["skewed"].p_value < 1e-15
    assert rows["alone"].p_value == 1.0 and not rows["alone"].srm_detected
    declared = spark.createDataFrame(
        [("alone", "control"), ("alone", "treatment"), ("none", "x"), ("none", "y")],
        "experiment_id string, variant string",
    )
    rows = {r.experiment_id: r for r in asg.check_srm(assigned, declared).collect()}
    assert rows["alone"].actual_counts == {"control": 10, "treatment": 0}
    assert rows["alone"].srm_detected_gof
    assert rows["none"].srm_detected is False


def test_summary_and_listing_count_empty_arms(spark):
    experiments = [Experiment("e1", name="One"), Experiment("e2", name="Two")]
    dims = asg.experiments_frame(spark, experiments), asg.variants_frame(spark, experiments)
    assigned = spark.createDataFrame(
        [("u1", "e1", "e1_control"), ("u2", "e1", "e1_control")],
        "user_id string, experiment_id string, variant_id string",
    )
    summary = [tuple(r) for r in asg.assignment_summary(*dims, assigned).collect()]
    assert summary == [
        ("e1", "One", "control", 2), ("e1", "One", "treatment", 0),
        ("e2", "Two", "control", 0), ("e2", "Two", "treatment", 0),
    ]
    listing = {r.experiment_id: r.n_users for r in asg.experiment_listing(dims[0], assigned).collect()}
    assert listing == {"e1": 2, "e2": 0}
