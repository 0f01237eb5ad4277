"""Tail probabilities the tests need, as Column expressions.

Each tail is the integral of a log-concave function from the observed point outwards,
so one fixed quadrature over a window that holds all but e^-40 of the mass keeps full
relative accuracy however small the p-value is. NULL in, NULL out.
"""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

from liftgrid.functions.binding import bind, sql_integral, sql_let

_NEGLIGIBLE = "40D"
_NEWTON_STEPS = 10


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


@lru_cache(maxsize=256)
def detectable_shift(alpha: float, power: float) -> float:
    """Mean shift, in standard errors, that a two-sided z-test finds with this power.

    Both rejection tails count. Depends on two settings only, never on data.
    """
    normal = NormalDist()
    critical = normal.inv_cdf(1 - alpha / 2)
    low, high = 0.0, critical + 40.0
    for _ in range(200):
        middle = (low + high) / 2
        reached = normal.cdf(middle - critical) + normal.cdf(-middle - critical)
        low, high = (middle, high) if reached < power else (low, middle)
    return (low + high) / 2


def _normal_sql(z: str) -> str:
    """P(|Z| > z) for the name ``z`` of a value >= 0."""
    step = "z_width * <v>"
    area = sql_integral("v", f"exp(-{step} * ({z} + {step} / 2))")
    return sql_let(
        "z_width",
        f"least(try_divide({_NEGLIGIBLE}, {z}), 9D)",
        f"{math.sqrt(2 / math.pi)!r}D * exp(-{z} * {z} / 2) * z_width * {area}",
    )


def _sine_mass_sql(angle: str, rest: str, df: str, slope: str) -> str:
    """Integral of sin^(df-1) from 0 to ``angle``; ``slope`` is (df-1) angle cot(angle) + 1.

    ``rest`` is pi/2 - angle. With many degrees of freedom the mass sits near pi/2, where a
    sine is 1 but for its last digits; its logarithm is taken from the distance to pi/2,
    which is known to full relative accuracy.
    """
    inner = f"{angle} * exp(-width * <v>)"
    away = f"({rest} * exp(-width * <v>) - {math.pi / 2!r}D * expm1(-width * <v>))"
    log_sine = f"if({inner} < 0.8D, ln(sin({inner})), log1p(-sin({away}) * sin({away})) / 2)"
    area = sql_integral("v", f"exp(({df} - 1) * {log_sine} - width * <v>)")
    return sql_let(
        "width",
        f"least({_NEGLIGIBLE} / ({slope}), {_NEGLIGIBLE} / {df} + 6 / sqrt({df}))",
        f"width * {angle} * {area}",
    )


def _half_mass_sql(df: str) -> str:
    return _sine_mass_sql(f"{math.pi / 2!r}D", "0D", df, "1D")


def _tail_mass_sql(t: str, df: str) -> str:
    slope = f"({df} - 1) * angle * {t} / sqrt({df}) + 1"
    mass = _sine_mass_sql("angle", "rest", df, slope)
    return sql_let("angle", f"atan2(sqrt({df}), {t})", sql_let("rest", f"atan2({t}, sqrt({df}))", mass))


def normal_two_sided(z: Column) -> Column:
    """P(|Z| > |z|)."""
    return bind(_normal_sql("s.z"), z=F.abs(z))


def student_two_sided(t: Column, df: Column) -> Column:
    """P(|T| > |t|) of Student's t with a positive, possibly fractional, df."""
    exact = f"{_tail_mass_sql('s.t', 's.df')} / {_half_mass_sql('s.df')}"
    return bind(
        f"CASE WHEN s.t IS NULL OR s.df <= 0 THEN NULL ELSE {exact} END",
        t=F.abs(t), df=df.cast("double"),
    )


def student_critical(alpha: float, df: Column) -> Column:
    """t with P(|T| > t) = alpha: Newton steps on the logarithms, from an expansion in 1/df."""
    z = normal_quantile(1 - alpha / 2)
    start = (
        f"({z!r}D + {(z**3 + z) / 4!r}D / s.df"
        f" + {(5 * z**5 + 16 * z**3 + 3 * z) / 96!r}D / (s.df * s.df))"
    )
    density = (
        "exp(-(s.df - 1) / 2 * log1p(t * t / s.df)) * sqrt(s.df) / (s.df + t * t) / half"
    )
    step = sql_let(
        "p",
        f"{_tail_mass_sql('t', 's.df')} / half",
        f"t * exp((ln(p) - {math.log(alpha)!r}D) * p / (t * {density}))",
    )
    solved = sql_let(
        "half",
        _half_mass_sql("s.df"),
        f"aggregate(sequence(1, {_NEWTON_STEPS}), {start}, (t, i) -> {step})",
    )
    return bind(
        f"CASE WHEN s.df > 0 THEN {solved} END", df=df.cast("double"),
    )


def chi_square_tail(x: Column, df: Column) -> Column:
    """P(X > x) of a chi-square with integer df: closed finite sums; 1 when df is 0."""
    # After the leading term: odd df have (df-3)/2 terms x^r / (3 5 .. 2r+1), even df
    # (df-2)/2 terms (x/2)^r / r!. Odd df also carry the normal tail.
    count = "CAST(floor((s.df - 2 - s.df % 2) / 2) AS INT)"
    steps = f"CASE WHEN {count} > 0 THEN sequence(1, {count}) ELSE CAST(array() AS ARRAY<INT>) END"
    next_term = sql_let(
        "term",
        "a.term * s.x / (2 * r + s.df % 2)",
        "named_struct('term', term, 'total', a.total + term)",
    )
    series = (
        f"aggregate({steps}, named_struct('term', 1D, 'total', 1D), "
        f"(a, r) -> {next_term}, a -> a.total)"
    )
    normal = sql_let("z", "sqrt(s.x)", _normal_sql("z"))
    return bind(
        f"CASE WHEN s.x IS NULL THEN NULL WHEN s.df <= 0 THEN 1D WHEN s.df = 1 THEN {normal} "
        f"WHEN s.df % 2 = 1 THEN {normal} "
        f"+ sqrt(s.x) * {math.sqrt(2 / math.pi)!r}D * exp(-s.x / 2) * {series} "
        f"ELSE exp(-s.x / 2) * {series} END",
        x=x.cast("double"), df=df.cast("int"),
    )


# Rational approximations of the normal quantile (Wichura's algorithm AS 241; fixed values):
# numerator and denominator, lowest power first, for the middle, the tails and far tails.
_QUANTILE = (
    (
        (3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125,
         45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727),
        (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077,
         21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610),
    ),
    (
        (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504,
         1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 0.000774545014278341407640),
        (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550,
         0.148103976427480074590, 0.0151986665636164571966, 0.000547593808499534494600, 1.05075007164441684324e-9),
    ),
    (
        (6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230,
         0.0265321895265761230930, 0.00124266094738807843860, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
        (1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525,
         0.000786869131145613259100, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
    ),
)


def _ratio(x: Column, part: int) -> Column:
    def value(terms: tuple[float, ...]) -> Column:
        total = F.lit(terms[-1])
        for term in terms[-2::-1]:
            total = total * x + term
        return total

    return value(_QUANTILE[part][0]) / value(_QUANTILE[part][1])


def normal_score(p: Column) -> Column:
    """The normal quantile of a chance in (0, 1); NULL outside."""
    q = p - 0.5
    away = F.sqrt(-F.log(F.least(p, 1 - p)))
    tail = F.when(away <= 5, _ratio(away - 1.6, 1)).otherwise(_ratio(away - 5, 2))
    score = F.when(F.abs(q) <= 0.425, q * _ratio(0.180625 - q * q, 0)).otherwise(F.signum(q) * tail)
    return F.when((p > 0) & (p < 1), score)
