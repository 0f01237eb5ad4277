"""Full analysis of experiments: one nested result document per experiment."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftgrid.operators.assignment import with_srm
from liftgrid.operators.bayes import (
    expected_loss,
    highest_density_interval,
    posterior_params,
    probability_treatment_better,
    spread,
)
from liftgrid.operators.corrections import apply_corrections
from liftgrid.operators.features import user_features
from liftgrid.operators.frequentist import novelty_effect_test
from liftgrid.operators.metrics import (
    METRICS,
    compute_all_metrics,
    control_of,
    pair_with_control,
    user_outcomes,
)
from liftgrid.operators.planning import with_sizing
from liftgrid.operators.propensity import propensity_analysis
from liftgrid.plans.testing import metric_tests
from liftgrid.schemas import (
    BAYESIAN_RESULT,
    EXPERIMENT_RESULT,
    NOVELTY_RESULT,
    PROPENSITY_RESULT,
    SAMPLE_SIZE,
    SRM_RESULT,
    TEST_RESULT,
    VARIANT_METRICS,
)
from liftgrid.session import materialize_small

KEY = "experiment_id"
_POSTERIOR = (
    "struct<probability_treatment_better: double, expected_loss: double, "
    "ends: struct<lower: double, upper: double>>"
)
_TEST = (
    "struct<metric: string, statistic: double, p_value: double, significant: boolean, "
    "absolute_lift: double, relative_lift: double, ci_lower: double, ci_upper: double>"
)


# Parts of a document: name, schema, and whether there are several per experiment.
_PARTS = {
    "variants": (VARIANT_METRICS, True),
    "frequentist": (TEST_RESULT, True),
    "bayesian": (BAYESIAN_RESULT, True),
    "sample_size_analysis": (SAMPLE_SIZE, True),
    "novelty_check": (NOVELTY_RESULT, True),
    "propensity": (PROPENSITY_RESULT, False),
}


def _part(rows: DataFrame, name: str, place: Column | None = None, *extra: Column | str) -> DataFrame:
    """Rows (experiment, part, place, doc) of one part; ``extra`` columns go along."""
    schema, _ = _PARTS[name]
    place = F.col("variant") if place is None else place
    doc = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    return rows.select(KEY, place.alias("place"), doc.alias(name), *extra)


def _arm_parts(pairs: DataFrame, metrics: Sequence[str], method: str) -> DataFrame:
    """Tests, posterior and sizing of every treatment arm, from one read of the pairs.

    An arm's row explodes into its part rows; the correction ranks the tests alone, as other
    parts have no family with them.
    """
    posterior = F.struct(
        probability_treatment_better().alias("probability_treatment_better"),
        expected_loss().alias("expected_loss"), highest_density_interval().alias("ends"),
    )
    tests = F.transform(metric_tests(metrics), lambda t: F.struct(
        F.lit("frequentist").alias("part"), t.alias("test"), F.lit(None).cast(_POSTERIOR).alias("posterior")))
    nothing = F.lit(None).cast(_TEST)
    others = F.array(
        F.struct(F.lit("bayesian").alias("part"), nothing.alias("test"), posterior.alias("posterior")),
        F.struct(F.lit("sample_size_analysis").alias("part"), nothing.alias("test"), F.lit(None).cast(_POSTERIOR).alias("posterior")),
    )
    rows = with_sizing(posterior_params(spread(pairs))).withColumn("_row", F.explode(F.concat(tests, others)))
    rows = rows.select(
        KEY, "variant", *[c for c in SAMPLE_SIZE.names if c != "variant"], F.col("_row.part").alias("part"),
        "_row.test.*", F.col("_row.posterior").alias("posterior"),
    )
    rows = apply_corrections(rows, method, (KEY, "part"))
    rows = rows.withColumns({
        "probability_treatment_better": F.col("posterior.probability_treatment_better"),
        "expected_loss": F.col("posterior.expected_loss"),
        "credible_interval_lower": F.col("posterior.ends.lower"),
        "credible_interval_upper": F.col("posterior.ends.upper"),
    })
    def own(name: str) -> Column:
        fields = [F.col(f.name).cast(f.dataType).alias(f.name) for f in _PARTS[name][0].fields]
        return F.when(F.col("part") == name, F.struct(*fields)).alias(name)

    return rows.select(
        KEY, F.concat_ws(" ", "metric", "variant").alias("place"),
        *map(own, ("frequentist", "bayesian", "sample_size_analysis")),
    )


def analyze(
    stats: DataFrame,
    experiments: DataFrame,
    metrics: Sequence[str] = METRICS,
    method: str = "benjamini_hochberg",
    propensity: DataFrame | None = None,
    daily: DataFrame | None = None,
    block_on_srm: bool = False,
) -> DataFrame:
    """Result documents from arm statistics.

    ``stats`` (a few rows per experiment, from ``arm_stats``) is computed once. Every part
    becomes rows of one long table, and one grouping by experiment assembles the documents.
    ``propensity`` and ``daily`` add the optional parts. An ``is_control`` column in ``stats``
    names the control arm. With ``block_on_srm`` experiments with a broken split keep only
    the split check and the cards.
    """
    checked = with_srm(materialize_small(stats, "arm-stats"))
    detected = checked.withColumn("_detected", F.col("srm.srm_detected")).drop("srm")
    pairs = pair_with_control(detected)
    if block_on_srm:
        pairs = pairs.filter(~F.col("treatment__detected"))
    parts = [_part(checked, "variants", None, "srm"), _arm_parts(pairs, metrics, method)]
    if propensity is not None:
        parts.append(_part(propensity, "propensity", F.lit("")))
    if daily is not None:
        controls = detected.select(KEY, control_of(detected).alias("control")).distinct()
        novelty = novelty_effect_test(daily.join(controls, KEY), control=F.col("control"))
        parts.append(_part(novelty, "novelty_check"))
    long = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def gathered(name: str) -> Column:
        schema, several = _PARTS[name]
        if not several:
            return F.first(name, ignorenulls=True).alias(name)
        entries = F.sort_array(F.collect_list(F.when(F.col(name).isNotNull(), F.struct("place", name))))
        docs = F.transform(entries, lambda e: e[name])
        return F.when(F.size(docs) > 0, docs).alias(name)

    there = [name for name in _PARTS if name in long.columns]
    documents = long.groupBy(KEY).agg(
        F.first("srm", ignorenulls=True).alias("_srm"), *map(gathered, there)
    ).filter(F.col("_srm").isNotNull())
    srm = F.struct(*[F.col("_srm")[f.name].cast(f.dataType).alias(f.name) for f in SRM_RESULT.fields])
    documents = documents.withColumn("srm_check", srm).withColumn("computed_at", F.current_timestamp())
    result = experiments.select(KEY, "name", "status").join(documents, KEY)
    return result.select(
        *[
            F.col(field.name) if field.name in result.columns
            else F.lit(None).cast(field.dataType).alias(field.name)
            for field in EXPERIMENT_RESULT.fields
        ]
    )


def analyze_experiments(
    events: DataFrame,
    assignments: DataFrame,
    experiments: DataFrame,
    start: dt.datetime | None = None,
    end: dt.datetime | None = None,
    use_propensity: str | None = None,
    **options,
) -> DataFrame:
    """``analyze`` straight from the event log and an assignment table.

    ``use_propensity`` names the classifier of the propensity part and adds it.
    """
    if use_propensity is not None:
        options["propensity"] = propensity_analysis(
            user_features(events), assignments, user_outcomes(events, start, end), None, use_propensity
        )
    return analyze(compute_all_metrics(events, assignments, start, end), experiments, **options)


def result_rows(stats: DataFrame, tests: DataFrame) -> DataFrame:
    """Rows for the result table: every metric of every arm, with its test if it has one.

    A control arm carries the test of the first treatment arm.
    """
    values = stats.select(
        KEY, "variant",
        F.explode(
            F.create_map(
                F.lit("conversion_rate"), F.col("conversion_rate"),
                F.lit("revenue_per_user"), F.col("mean_revenue"),
                F.lit("add_to_cart_rate"), F.col("add_to_cart_rate"),
            )
        ).alias("metric_name", "value"),
    )
    interval = F.struct("ci_lower", "ci_upper", "p_value")
    own = tests.select(KEY, "variant", F.col("metric").alias("metric_name"), interval.alias("test"))
    of_control = tests.groupBy(KEY, F.col("control").alias("variant"), "metric").agg(
        F.min_by(interval, "variant").alias("test")
    ).withColumnRenamed("metric", "metric_name")
    return values.join(
        own.unionByName(of_control), [KEY, "variant", "metric_name"], "left"
    ).select(KEY, "variant", "metric_name", "value", "test.*")
