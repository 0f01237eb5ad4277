import random

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from liftgrid.operators import ipw
from liftgrid.operators.balance import covariate_balance
from liftgrid.operators.propensity import (
    NUMERIC_FEATURES,
    PropensityModel,
    feature_pipeline,
    propensity_analysis,
    rank_auc,
    score_propensity,
    stratified_folds,
    training_set,
)
from tests.conftest import one


def world(spark, n, imbalanced, seed):
    rng = np.random.default_rng(seed)
    revenue = rng.uniform(0, 1000, n) if imbalanced else rng.uniform(0, 500, n)
    treated = revenue > 500 if imbalanced else np.arange(n) % 2 == 1
    rows = []
    for i in range(n):
        rows.append((
            str(i), float(rng.integers(1, 20)), float(revenue[i]), float(rng.integers(1, 30)),
            float(revenue[i] / 5 if imbalanced else rng.uniform(10, 200)), float(rng.integers(1, 100)),
            float(rng.integers(0, 20)), float(rng.integers(0, 10)), float(rng.uniform(1, 30)),
            str(rng.choice(["electronics", "apparel", "beauty"])) if i % 10 else None,
        ))
    features = spark.createDataFrame(
        rows, "user_id string, " + ", ".join(f"{c} double" for c in NUMERIC_FEATURES) + ", favorite_category string"
    )
    assignments = spark.createDataFrame(
        [(str(i), "exp_test", "treatment" if t else "control") for i, t in enumerate(treated)],
        "user_id string, experiment_id string, variant string",
    )
    return features, assignments


def test_weights_golden(spark):
    frame = spark.createDataFrame(
        [(0.001, 1), (0.01, 1), (0.5, 0), (0.99, 0), (0.999, 1), (0.0, 1), (1.0, 0), (0.5, 1), (None, 1)],
        "p double, a int",
    )
    got = [r.w for r in frame.select(ipw.compute_weights(F.col("p"), F.col("a")).alias("w")).collect()]
    assert got[:8] == pytest.approx([10, 10, 2, 10, 1 / 0.999, 10, 10, 2]) and got[8] is None


@pytest.fixture(scope="module")
def weighted(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(900):
        treated = int(rng.random() < 0.4)
        rows.append(("e", str(i), treated, int(rng.random() < 0.3), float(rng.uniform(0.1, 10)),
                     float(1e6 + rng.gamma(2, 20) * (1.1 if treated else 1))))
    rows += [("lonely", "x", 1, 1, 2.0, 5.0), ("lonely", "y", 1, 0, 2.0, 6.0)]
    frame = spark.createDataFrame(rows, "experiment_id string, user_id string, treatment int, converted int, weight double, revenue double")
    arrays = {k: np.array([r[j] for r in rows if r[0] == "e"]) for j, k in enumerate(("_", "__", "a", "y", "w", "x")) if j > 1}
    return frame, arrays


def test_adjusted_conversion(weighted):
    frame, v = weighted
    rows = {r.experiment_id: r for r in ipw.adjusted_conversion_rate(frame).collect()}
    t, c = v["a"] == 1, v["a"] == 0
    adj = np.average(v["y"][t], weights=v["w"][t]) - np.average(v["y"][c], weights=v["w"][c])
    raw = v["y"][t].mean() - v["y"][c].mean()
    assert rows["e"].adjusted_lift == pytest.approx(adj) and rows["e"].unadjusted_lift == pytest.approx(raw)
    assert rows["e"].adjustment_magnitude == pytest.approx(abs(adj - raw))
    assert rows["lonely"].control == 0.0 and rows["lonely"].adjusted_lift == 0.5


def test_adjusted_t_tests(spark, weighted):
    frame, v = weighted
    t, c = v["a"] == 1, v["a"] == 0

    def moments(mask):
        w, x = v["w"][mask], v["x"][mask]
        mean = np.average(x, weights=w)
        return w.sum(), mean, (w * (x - mean) ** 2).sum()

    (wt, mt, st), (wc, mc, sc) = moments(t), moments(c)
    row = {r.experiment_id: r for r in ipw.adjusted_t_test(frame, "revenue").collect()}["e"]
    assert row.t_stat == pytest.approx((mt - mc) / (np.sqrt(st / wt) / np.sqrt(wt - 1)), rel=1e-7)
    vt, vc = st / (wt - 1), sc / (wc - 1)
    half = 1.959963984540054 * np.sqrt(vt / wt + vc / wc)
    assert (row.ci_lower, row.ci_upper) == pytest.approx((mt - mc - half, mt - mc + half), rel=1e-6)
    assert row.cohens_d == pytest.approx((mt - mc) / np.sqrt((vt + vc) / 2), rel=1e-7)
    assert row.significant == (row.p_value < 0.05)
    two = {r.experiment_id: r for r in ipw.two_sample_adjusted_t_test(frame, "revenue").collect()}["e"]
    assert two.t_stat == pytest.approx((mt - mc) / np.sqrt(vt / wt + vc / wc), rel=1e-7)
    assert two.p_value > row.p_value


def test_covariate_balance(spark, weighted):
    frame, v = weighted
    frame = frame.filter("experiment_id = 'e'").withColumn("constant", F.lit(3.0))
    rows = {r.covariate: r for r in covariate_balance(frame, ["revenue", "constant"]).collect()}
    t, c = v["a"] == 1, v["a"] == 0
    sd = np.sqrt((v["x"][t].var(ddof=1) + v["x"][c].var(ddof=1)) / 2)
    assert rows["revenue"].smd_before == pytest.approx(abs(v["x"][t].mean() - v["x"][c].mean()) / sd, rel=1e-6)
    after = abs(np.average(v["x"][t], weights=v["w"][t]) - np.average(v["x"][c], weights=v["w"][c])) / sd
    assert rows["revenue"].smd_after == pytest.approx(after, rel=1e-5)
    assert rows["constant"].smd_before == 0.0 and rows["constant"].smd_after == 0.0 and rows["constant"].balanced_after


def test_rank_auc_with_ties_and_a_hot_score(spark):
    rng = random.Random(2)
    rows = []
    for g in ("a", "b"):
        for i in range(700):
            score = 0.5 if i % 3 == 0 else round(rng.random(), 2)
            rows.append((g, score, int(rng.random() < 0.3 + 0.4 * score)))
    got = {r.experiment_id: r for r in rank_auc(spark.createDataFrame(rows, "experiment_id string, propensity double, treatment int").repartition(7)).collect()}
    for g in ("a", "b"):
        ones = [s for h, s, y in rows if h == g and y]
        zeros = [s for h, s, y in rows if h == g and not y]
        wins = sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros)
        assert got[g].auc == pytest.approx(wins / len(ones) / len(zeros), rel=1e-12)
        assert (got[g].n_treated, got[g].n_control) == (len(ones), len(zeros))


def test_folds_deal_every_stratum_evenly(spark):
    data = spark.range(1003).select(F.col("id").cast("string").alias("user_id"), (F.col("id") % 3 == 0).cast("int").alias("treatment"))
    dealt = stratified_folds(data).collect()
    assert len(dealt) == 1003
    for label in (0, 1):
        sizes = [sum(r.fold == k and r.treatment == label for r in dealt) for k in range(5)]
        assert max(sizes) - min(sizes) <= 1
    again = {r.user_id: r.fold for r in stratified_folds(data.repartition(3)).collect()}
    assert again == {r.user_id: r.fold for r in dealt}


def test_training_set_fills_and_labels(spark):
    features, assignments = world(spark, 40, False, 0)
    data = training_set(features, assignments).collect()
    assert len(data) == 40 and {r.treatment for r in data} == {0, 1}
    assert {r.favorite_category for r in data if int(r.user_id) % 10 == 0} == {"unknown"}


@pytest.fixture(scope="module")
def fitted(spark):
    result = {}
    for name, imbalanced, seed in (("balanced", False, 0), ("imbalanced", True, 1)):
        features, assignments = world(spark, 600, imbalanced, seed)
        data = training_set(features, assignments)
        model = PropensityModel(maxIter=10)
        auc = model.train(data)
        result[name] = features, data, model, auc
    return result


def test_auc_tells_balance_from_imbalance(fitted):
    assert 0.4 <= fitted["balanced"][3] <= 0.65
    assert fitted["imbalanced"][3] > 0.6


def test_scores_are_probabilities_also_for_unseen_categories(fitted):
    features, _, model, _ = fitted["imbalanced"]
    scored = model.predict_propensity(features.withColumn("favorite_category", F.lit("never seen")))
    low, high, n = scored.agg(F.min("propensity"), F.max("propensity"), F.count("propensity")).first()
    assert 0 < low <= high < 1 and n == 600


@pytest.mark.parametrize("name, check", [("imbalanced", lambda m: m > 0), ("balanced", lambda m: m < 0.05)])
def test_adjustment_size(spark, fitted, name, check):
    _, data, model, _ = fitted[name]
    rng = np.random.default_rng(99)
    outcome = spark.createDataFrame([(str(i), int(rng.random() < 0.05)) for i in range(600)], "user_id string, converted int")
    scored = model.predict_propensity(data).join(outcome, "user_id")
    scored = scored.withColumn("weight", ipw.compute_weights(F.col("propensity"), F.col("treatment")))
    assert check(one(ipw.adjusted_conversion_rate(scored)).adjustment_magnitude)


def test_hashed_categories_are_an_explicit_choice(spark, fitted):
    _, data, _, _ = fitted["balanced"]
    model = feature_pipeline("logistic", hash_categories=64, maxIter=2).fit(data)
    assert score_propensity(model, data).filter("propensity > 0 AND propensity < 1").count() == 600
    with pytest.raises(ValueError, match="Unknown classifier"):
        feature_pipeline("forest")


def test_untrained_model_refuses(spark, tmp_path):
    with pytest.raises(RuntimeError, match="not trained"):
        PropensityModel().predict_propensity(spark.range(1))
    with pytest.raises(RuntimeError, match="not trained"):
        PropensityModel().save(str(tmp_path), "e", str(tmp_path))


def test_model_is_saved_with_a_run_row(spark, fitted, tmp_path):
    _, data, model, auc = fitted["balanced"]
    runs = str(tmp_path / "runs")
    for _ in range(2):
        model.save(str(tmp_path / "model"), "exp_test", runs)
    rows = spark.read.parquet(runs).collect()
    assert len(rows) == 2 and rows[0].cv_auc == auc and len(rows[0].feature_names) == 9
    assert PipelineModel.load(str(tmp_path / "model")).transform(data).count() == 600


def test_end_to_end_step(spark):
    features, assignments = world(spark, 300, True, 3)
    outcomes = spark.createDataFrame([(str(i), 1, 5.0, 0) for i in range(0, 300, 7)], "user_id string, n_purchases long, revenue double, n_carts long")
    row = one(propensity_analysis(features, assignments, outcomes, ["exp_test"], "logistic", maxIter=5))
    assert row.imbalance_detected and row.cv_auc > 0.6
    assert row.adjustment_magnitude == pytest.approx(abs(row.adjusted_lift - row.unadjusted_lift))


def test_every_category_keeps_its_own_column(spark):
    rows = spark.range(10_001).select(
        F.col("id").cast("string").alias("user_id"), (F.col("id") % 2).cast("int").alias("treatment"),
        F.concat(F.lit("c"), "id").alias("favorite_category"), *(F.lit(1.0).alias(c) for c in NUMERIC_FEATURES))
    stages = feature_pipeline("logistic", maxIter=1).getStages()[:-1]
    coded = Pipeline(stages=stages).fit(rows).transform(rows)
    assert coded.select(F.col("category_onehot").cast("string")).distinct().count() == 10_001


def test_input_layout_does_not_move_a_score(spark, fitted):
    _, data, _, _ = fitted["imbalanced"]
    scores = []
    for partitions in (1, 6, 20):
        model = PropensityModel(maxIter=3, maxDepth=2)
        model.train(data.repartition(partitions), folds=2)
        rows = model.predict_propensity(data).select("user_id", "propensity").collect()
        scores.append({r.user_id: r.propensity for r in rows})
    assert scores[0] == scores[1] == scores[2]


def test_a_fold_of_one_class_is_an_error(spark, fitted):
    _, data, _, _ = fitted["balanced"]
    few = data.filter("treatment = 0").limit(30).unionByName(data.filter("treatment = 1").limit(3))
    with pytest.raises(ValueError, match="one class"):
        PropensityModel("logistic", maxIter=2).train(few)
