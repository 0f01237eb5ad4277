"""Beta-Binomial comparison of two conversion rates.

With a uniform prior the posterior of each rate is Beta(1 + converters, 1 + the rest), so
probabilities, losses and the highest-density interval of the difference come from integrals
over two known densities; no sampling is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftgrid.functions.binding import bind, quadrature, sql_integral, sql_let

DENSITY_POINTS = 300
DENSITY_MARGIN = 0.005


#: Partitions over which rows of pairs are spread before the integrals below: an arm's take
#: longer than moving the row.
SPREAD = 16


def spread(pairs: DataFrame, by: Sequence[str] = ("experiment_id", "variant")) -> DataFrame:
    """``pairs`` dealt out, as the few rows of usual runs would otherwise meet in one task."""
    return pairs.repartition(SPREAD, *by)


def posterior_params(
    pairs: DataFrame, successes: str = "n_converters", users: str = "n_users"
) -> DataFrame:
    """Posterior parameters of both arms as columns."""
    return pairs.withColumns(
        {
            f"{arm}_{name}": value.cast("double")
            for arm in ("control", "treatment")
            for name, value in (
                ("alpha", 1 + F.col(f"{arm}_{successes}")),
                ("beta", 1 + F.col(f"{arm}_{users}") - F.col(f"{arm}_{successes}")),
            )
        }
    )


def _posterior_sql(a: str, b: str) -> str:
    """Shape, mode, spread and a range that holds all but e^-40 of the mass."""
    sd = f"sqrt({a} * {b} / (({a} + {b}) * ({a} + {b}) * ({a} + {b} + 1)))"
    mean = f"{a} / ({a} + {b})"
    return (
        f"named_struct('a', {a}, 'b', {b}, "
        f"'mode', CASE WHEN {a} + {b} > 2 THEN ({a} - 1) / ({a} + {b} - 2) ELSE 0.5D END, "
        f"'mean', {mean}, 'sd', {sd}, "
        f"'low', greatest(0D, {mean} - {sd} * (9 + 40 / sqrt({b}))), "
        f"'high', least(1D, {mean} + {sd} * (9 + 40 / sqrt({a}))))"
    )


def _density_sql(arm: str, x: str) -> str:
    """Density up to a constant, 1 at the mode; log1p keeps it exact for huge counts."""
    shift = f"({x} - {arm}.mode)"
    return (
        f"CASE WHEN {x} > 0 AND {x} < 1 THEN exp("
        f"CASE WHEN {arm}.a > 1 THEN ({arm}.a - 1) * log1p({shift} / {arm}.mode) ELSE 0D END + "
        f"CASE WHEN {arm}.b > 1 THEN ({arm}.b - 1) * log1p(-{shift} / (1 - {arm}.mode)) ELSE 0D END"
        f") ELSE 0D END"
    )


def _mass_sql(arm: str) -> str:
    position = f"({arm}.low + ({arm}.high - {arm}.low) * <m>)"
    return f"(({arm}.high - {arm}.low) * {sql_integral('m', _density_sql(arm, position))})"


def _with_arms(body: str, **values: Column) -> Column:
    """``body`` with the posteriors of both arms bound as ``c`` and ``t``, others in ``s``."""
    arms = sql_let(
        "c",
        _posterior_sql("s.ca", "s.cb"),
        sql_let("t", _posterior_sql("s.ta", "s.tb"), body),
    )
    return bind(
        arms,
        ca=F.col("control_alpha"), cb=F.col("control_beta"),
        ta=F.col("treatment_alpha"), tb=F.col("treatment_beta"), **values,
    )


def _control_ahead_sql(margin: float, weigh_by_gap: bool) -> str:
    """E[1 or (c - t - margin)] over the region c - t > margin.

    The outer integral runs over the narrower posterior ``x``, where the inner one, over
    the wider posterior ``y``, is smooth; so arms of very different size lose no accuracy.
    ``sign`` is 1 when the control arm is the narrower one.
    """
    margin_sql = f"{float(margin)!r}D"
    position = "(edge.start + (edge.stop - edge.start) * <v>)"
    inner = _density_sql("o.y", position)
    if weigh_by_gap:
        inner = f"(o.sign * (x - {position}) - {margin_sql}) * ({inner})"

    def clip(edge: str) -> str:
        return f"least(greatest({edge}, o.y.low), o.y.high)"

    edges = (
        f"named_struct("
        f"'start', CASE WHEN o.sign > 0 THEN o.y.low ELSE {clip(f'x + {margin_sql}')} END, "
        f"'stop', CASE WHEN o.sign > 0 THEN {clip(f'x - {margin_sql}')} ELSE o.y.high END)"
    )
    at_x = (
        f"({_density_sql('o.x', 'x')}) * "
        + sql_let("edge", edges, f"(edge.stop - edge.start) * {sql_integral('v', inner)}")
    )
    outer = sql_integral("u", sql_let("x", "o.x.low + (o.x.high - o.x.low) * <u>", at_x))
    order = (
        "CASE WHEN c.sd <= t.sd THEN named_struct('x', c, 'y', t, 'sign', 1D) "
        "ELSE named_struct('x', t, 'y', c, 'sign', -1D) END"
    )
    return sql_let(
        "o", order, f"(o.x.high - o.x.low) * {outer} / ({_mass_sql('o.x')} * {_mass_sql('o.y')})"
    )


def probability_treatment_better() -> Column:
    """P(treatment rate > control rate) from the posterior parameter columns."""
    ahead = _control_ahead_sql(0.0, weigh_by_gap=False)
    return _with_arms(f"least(1D, greatest(0D, 1 - {ahead}))")


def expected_loss(threshold: float = 0.0) -> Column:
    """E[max(control - treatment, threshold)]: the rate lost by a wrong switch."""
    return _with_arms(f"{float(threshold)!r}D + {_control_ahead_sql(threshold, weigh_by_gap=True)}")


def _difference_density_sql(d: str) -> str:
    """Density of treatment - control at ``d``: an integral over the narrower posterior ``o.x``.

    The other rate is x + sign d; the range is where both lie in theirs, so it ends smoothly.
    """
    reach = (
        f"named_struct('from', greatest(o.x.low, o.y.low - o.sign * {d}), "
        f"'to', least(o.x.high, o.y.high - o.sign * {d}))"
    )
    place = "(reach.from + (reach.to - reach.from) * <q>)"
    both = sql_let(
        "rate", place, f"({_density_sql('o.x', 'rate')}) * ({_density_sql('o.y', f'(rate + o.sign * {d})')})"
    )
    area = f"CASE WHEN reach.to > reach.from THEN (reach.to - reach.from) * {sql_integral('q', both, 'many')} ELSE 0D END"
    return sql_let("reach", reach, area)


def _trimmed_sql(arm: str) -> str:
    """The arm with a range that holds all but e^-20 of its mass: enough for an interval."""
    low = f"greatest(0D, {arm}.mean - {arm}.sd * (6.5D + 20 / sqrt({arm}.b)))"
    high = f"least(1D, {arm}.mean + {arm}.sd * (6.5D + 20 / sqrt({arm}.a)))"
    return (
        f"named_struct('a', {arm}.a, 'b', {arm}.b, 'mode', {arm}.mode, 'mean', {arm}.mean, "
        f"'sd', {arm}.sd, 'low', {low}, 'high', {high})"
    )


def _crossing_sql(outer: str, steps: int = 10) -> str:
    """Where the density passes ``level`` between ``outer`` and the top, by a bracketing secant
    (Illinois) on its logarithm, which is concave."""
    log_at = f"greatest(ln({_difference_density_sql('x')} / level), -60D)"
    at_x = sql_let("v", log_at, (
        "CASE WHEN v < 0 THEN named_struct('out', x, 'vout', v, 'in', h.in, "
        "'vin', CASE WHEN h.last < 0 THEN h.vin / 2 ELSE h.vin END, 'last', -1D) "
        "ELSE named_struct('out', h.out, 'vout', CASE WHEN h.last > 0 THEN h.vout / 2 ELSE h.vout END, "
        "'in', x, 'vin', v, 'last', 1D) END"
    ))
    # far below the level a secant gains nothing on halving
    place = "CASE WHEN h.vout < -12 THEN (h.out + h.in) / 2 ELSE (h.out * h.vin - h.in * h.vout) / (h.vin - h.vout) END"
    step = f"CASE WHEN h.vin > h.vout THEN {sql_let('x', place, at_x)} ELSE h END"
    start = (
        f"named_struct('out', {outer}, 'vout', -60D, 'in', top.d, 'vin', ln(top.f / level), 'last', 0D)"
    )
    return sql_let("done", f"aggregate(sequence(1, {steps}), {start}, (h, i) -> {step})",
                   "CASE WHEN abs(done.vin) <= abs(done.vout) THEN done.in ELSE done.out END")


def highest_density_interval(alpha: float = 0.05) -> Column:
    """(lower, upper) of treatment - control: the narrowest interval of mass 1 - alpha.

    Both rates have log-concave densities, so their difference has one mode and the interval
    is a level set: its ends are found on either side of the mode, and the level by a
    bracketing secant on the mass between them. Steep edges need no special case; a top that
    is flat (an arm without users) is taken whole.
    """
    wanted = f"({1 - alpha!r}D)"
    at = _difference_density_sql
    rising = f"{at('x')} < {sql_let('x', '(x + o.tiny)', at('x'))}"
    halved = sql_let("x", "(h.low + h.high) / 2", (
        f"CASE WHEN {rising} THEN named_struct('low', x, 'high', h.high) "
        "ELSE named_struct('low', h.low, 'high', x) END"
    ))
    mode = sql_let(
        "left", f"aggregate(sequence(1, 18), named_struct('low', o.low, 'high', o.high), (h, i) -> {halved})",
        "(left.low + left.high) / 2",
    )
    ends = f"named_struct('a', {_crossing_sql('o.low')}, 'b', {_crossing_sql('o.high')})"
    side = lambda v, low, high: f"({high} - {low}) * " + sql_integral(
        v, sql_let("d1", f"{low} + ({high} - {low}) * <{v}>", at("d1")), "few"
    )
    mass = f"({side('v', 'ends.a', 'top.d')} + {side('v', 'top.d', 'ends.b')}) / o.mass - {wanted}"
    moved = sql_let("ends", ends, sql_let("m", mass, (
        "CASE WHEN m > 0 THEN named_struct('low', level, 'mlow', m, 'high', k.high, "
        "'mhigh', CASE WHEN k.last > 0 THEN k.mhigh / 2 ELSE k.mhigh END, 'last', 1D, 'a', ends.a, 'b', ends.b) "
        "ELSE named_struct('low', k.low, 'mlow', CASE WHEN k.last < 0 THEN k.mlow / 2 ELSE k.mlow END, "
        "'high', level, 'mhigh', m, 'last', -1D, 'a', ends.a, 'b', ends.b) END"
    )))
    level = (
        "CASE WHEN k.last = 0 THEN top.f * 0.15D "
        "ELSE (k.low * -k.mhigh + k.high * k.mlow) / (k.mlow - k.mhigh) END"
    )
    start = (
        f"named_struct('low', 0D, 'mlow', 1D - {wanted}, 'high', top.f, 'mhigh', -{wanted}, "
        "'last', 0D, 'a', o.low, 'b', o.high)"
    )
    settled = "k.mlow < 1e-10D AND k.last > 0 OR k.mhigh > -1e-10D AND k.last < 0"
    found = (
        f"aggregate(sequence(1, 9), {start}, (k, i) -> CASE WHEN {settled} THEN k ELSE {sql_let('level', level, moved)} END)"
    )
    result = sql_let("last", found, "named_struct('lower', last.a, 'upper', last.b)")
    top = sql_let("d0", mode, f"named_struct('d', d0, 'f', {at('d0')})")
    order = (
        "CASE WHEN c.sd <= t.sd THEN named_struct('x', tc, 'y', tt, 'sign', 1D) "
        "ELSE named_struct('x', tt, 'y', tc, 'sign', -1D) END"
    )
    shape = (
        "named_struct('x', w.x, 'y', w.y, 'sign', w.sign, 'low', tt.low - tc.high, 'high', tt.high - tc.low, "
        f"'tiny', w.x.sd / 1000, 'mass', {_mass_sql('w.x')} * {_mass_sql('w.y')})"
    )
    body = sql_let("w", order, sql_let("o", shape, sql_let("top", top, result)))
    trimmed = sql_let("tc", _trimmed_sql("c"), sql_let("tt", _trimmed_sql("t"), body))
    return _with_arms(trimmed, many=quadrature(48), few=quadrature(24))


def credible_intervals(
    params: DataFrame, alpha: float = 0.05, by: Sequence[str] = ("experiment_id", "variant")
) -> DataFrame:
    """Highest-density interval of treatment - control per row of ``posterior_params``."""
    return spread(params, by).select(*by, highest_density_interval(alpha).alias("ends")).select(
        *by,
        F.col("ends.lower").alias("credible_interval_lower"),
        F.col("ends.upper").alias("credible_interval_upper"),
    )


def compare_posteriors(params: DataFrame, threshold: float = 0.0) -> DataFrame:
    return params.withColumns(
        {
            "probability_treatment_better": probability_treatment_better(),
            "expected_loss": expected_loss(threshold),
        }
    )


def posterior_density(params: DataFrame, by: Sequence[str] = ("experiment_id", "variant")) -> DataFrame:
    """Exact density of both arms on a common grid: the curves behind a posterior plot.

    The grid spans four standard deviations around both means plus a fixed margin.
    """
    low = "least(c.mean - 4 * c.sd, t.mean - 4 * t.sd)"
    high = "greatest(c.mean + 4 * c.sd, t.mean + 4 * t.sd)"
    grid = _with_arms(
        f"named_struct('c', c, 't', t, 'c_mass', {_mass_sql('c')}, 't_mass', {_mass_sql('t')}, "
        f"'low', {low} - {DENSITY_MARGIN}D, 'high', {high} + {DENSITY_MARGIN}D)"
    )
    return (
        params.select(*by, grid.alias("g"))
        .withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(DENSITY_POINTS - 1))))
        .withColumn("x", F.expr(f"g.low + (g.high - g.low) * point / {DENSITY_POINTS - 1}"))
        .select(
            *by,
            "point",
            "x",
            F.expr(f"({_density_sql('g.c', 'x')}) / g.c_mass").alias("control_density"),
            F.expr(f"({_density_sql('g.t', 'x')}) / g.t_mass").alias("treatment_density"),
        )
    )


def fit_conversion(pairs: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Probability, loss and credible interval per treatment arm, each exact, in one pass."""
    by = ("experiment_id", "variant")
    ends = F.col("ends")
    return compare_posteriors(posterior_params(spread(pairs))).withColumn("ends", highest_density_interval(alpha)).select(
        *by, "probability_treatment_better", "expected_loss",
        ends["lower"].alias("credible_interval_lower"), ends["upper"].alias("credible_interval_upper"),
    )
