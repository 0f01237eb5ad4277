"""Batched treatment models against a plain numpy fit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from liftgrid.operators.logistic import score_categories, score_logistic
from liftgrid.operators.propensity import cross_validation

FOLDS = 3


def data(seed=7, n=240, groups=("a", "b")):
    rng = np.random.default_rng(seed)
    rows = []
    for g in groups:
        for k in range(n):
            x, u = float(rng.normal(50, 10)), float(rng.integers(0, 4))
            c = "abc"[int(rng.integers(0, 3))]
            y = int(rng.random() < 1 / (1 + np.exp(-((x - 50) / 8 + ("abc".index(c) - 1) - (g == "b") * u / 2))))
            rows.append((g, f"{g}{k}", y, k % FOLDS, x, u, 3.0, c))
    return rows


COLUMNS = "experiment_id string, user_id string, treatment int, fold int, x double, u double, flat double, c string"


def plain_fit(rows):
    """Chances of a function of (x, u, c), fitted by Newton steps on dense matrices."""
    cats = sorted({r[7] for r in rows})
    inputs = lambda r: [(r[4] - 50) / 10, r[5], *[float(r[7] == c) for c in cats]]
    x, y = np.array([inputs(r) for r in rows]), np.array([r[2] for r in rows])
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ b))
        b += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ (y - p))
    return lambda r: 1 / (1 + np.exp(-np.array(inputs(r)) @ b))


def test_all_models_equal_plain_fits(spark):
    rows = data()
    scored = score_logistic(spark.createDataFrame(rows, COLUMNS).repartition(5), ["x", "u", "flat"], "c", FOLDS).collect()
    got = {r.user_id: (r.propensity, r.held_out) for r in scored}
    assert len(scored) == len(rows)
    for g in "ab":
        own = [r for r in rows if r[0] == g]
        whole, without = plain_fit(own), [plain_fit([r for r in own if r[3] != k]) for k in range(FOLDS)]
        for r in own:
            assert got[r[1]] == pytest.approx((whole(r), without[r[3]](r)), abs=1e-8)


def test_separable_and_unseen_categories_stay_finite(spark):
    rows = [("a", f"u{k}", int(k >= 30), k % FOLDS, float(k), 0.0, 1.0, "abc"[k % 3] if k else "rare") for k in range(60)]
    scored = score_logistic(spark.createDataFrame(rows, COLUMNS), ["x"], "c", FOLDS).collect()
    for r in scored:
        assert 0 <= r.propensity <= 1 and 0 <= r.held_out <= 1
        assert (r.propensity > 0.5) == bool(r.treatment)


def test_category_shares_without_a_fold(spark):
    rows = [*data(3, 60), ("a", "only", 1, 0, 1.0, 1.0, 1.0, "once")]
    scored = score_categories(spark.createDataFrame(rows, COLUMNS), "c").collect()
    for r in scored:
        own = [x for x in rows if x[0] == r.experiment_id]
        share = lambda some: sum(x[2] for x in some) / len(some) if some else None
        same, rest = [x for x in own if x[7] == r.c], [x for x in own if x[3] != r.fold]
        assert r.propensity == pytest.approx(share(same))
        held = share([x for x in same if x[3] != r.fold])
        assert r.held_out == pytest.approx(share(rest) if held is None else held)
    assert len(scored) == len(rows)


def test_a_fold_of_one_class_has_no_mean_area(spark):
    rows = [("a", f"u{k}", int(k < 2), k % 3, 1.0, 1.0, 1.0, "x") for k in range(9)]
    scored = spark.createDataFrame(rows, COLUMNS).withColumn("held_out", F.lit(0.5))
    assert [r.cv_auc for r in cross_validation(scored, 3).collect()] == [None]
