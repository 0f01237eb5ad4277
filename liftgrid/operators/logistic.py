"""Treatment models of all experiments and folds in common jobs.

``score_logistic`` fits by Newton steps. A model has a slope per number and a level per
category, so its Hessian is a small dense block bordered by a diagonal: one aggregate per
step sums gradient and Hessian per category, combined on the map side, and a second one over
these few rows eliminates the levels. The driver solves one system of the size of the numbers
per model; what it sees grows with neither rows nor categories.

``score_categories`` is the model of category levels alone, whose fit is the treated share.
Leaving a fold out is a subtraction from the totals, so all folds come from one aggregate.

Both return the rows with ``propensity`` (model of all rows) and ``held_out`` (model without
the row's fold).
"""

from __future__ import annotations

import logging
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from liftgrid.session import lookup_join, materialize

#: Number of the model that is fitted to all rows; others are those of the fold they leave out.
ALL = -1
#: A step moves no level and no standardised slope by more than this.
LONGEST_STEP = 4.0
#: Level of a category whose rows all have one label: its chances are then 0 or 1.
CERTAIN = 40.0
#: Rows of the coefficient table that may be broadcast; beyond it the planner shuffles.
BROADCAST_ROWS = 200_000


def standardized(data: DataFrame, numbers: Sequence[str], by: Sequence[str]) -> DataFrame:
    """``z0``, ``z1`` ... of the numbers: centred and scaled per group, 0 where they never vary."""
    scales = data.groupBy(*by).agg(
        *[F.avg(c).alias(f"_m{j}") for j, c in enumerate(numbers)],
        *[F.stddev_pop(c).alias(f"_s{j}") for j, c in enumerate(numbers)],
    )
    z = {
        f"z{j}": F.coalesce(F.try_divide(F.col(c) - F.col(f"_m{j}"), F.col(f"_s{j}")), F.lit(0.0))
        for j, c in enumerate(numbers)
    }
    return lookup_join(data, scales, list(by)).withColumns(z).drop(
        *[f"_{k}{j}" for k in "ms" for j in range(len(numbers))]
    )


def _sums(k: int, label: str) -> list[Column]:
    """Gradient and Hessian of the log-likelihood, for one level and ``k`` slopes."""
    e, w = f"({label} - p)", "(p * (1 - p))"
    terms = {"n": "1D", "g": e, "h": w}
    terms |= {f"g{j}": f"{e} * z{j}" for j in range(k)} | {f"h{j}": f"{w} * z{j}" for j in range(k)}
    terms |= {f"h{i}_{j}": f"{w} * z{i} * z{j}" for i in range(k) for j in range(i, k)}
    return [F.expr(f"sum({term})").alias(name) for name, term in terms.items()]


def _eliminated(k: int) -> list[Column]:
    """The slopes' system with the levels eliminated, and the levels' share of the decrement."""
    terms = {f"s{i}_{j}": f"h{i}_{j} - coalesce(try_divide(h{i} * h{j}, h), 0D)" for i in range(k) for j in range(i, k)}
    terms |= {f"r{j}": f"g{j} - coalesce(try_divide(h{j} * g, h), 0D)" for j in range(k)}
    terms |= {"decrement": "coalesce(try_divide(g * g, h), 0D)", "n_rows": "1"}
    return [F.expr(f"sum({term})").alias(name) for name, term in terms.items()]


def _linear(k: int) -> Column:
    return F.expr(" + ".join(["level", *[f"slopes[{j}] * z{j}" for j in range(k)]]))


def _chance(linear: Column) -> Column:
    return 1 / (1 + F.exp(-linear))


def fit_logistic(
    rows: DataFrame, k: int, folds: int, by: Sequence[str], label: str, category: str,
    max_steps: int = 40, tolerance: float = 1e-10,
) -> tuple[DataFrame, bool]:
    """Levels and slopes (``by``, model, category, level, slopes, n) of every model at once.

    ``rows`` hold ``by``, the label, the category, ``fold`` and ``z0`` ... Steps end when the
    Newton decrement of every model is within ``tolerance``. A category whose rows all have one
    label has no finite level; the first step, where all chances are even, tells and sets it to
    ``CERTAIN``. Returns the coefficients and whether all converged within ``max_steps``.
    """
    spark, keys = rows.sparkSession, [*by, "model"]
    numbers = F.array(*[F.lit(m) for m in (ALL, *range(folds))])
    seen = rows.select(*by, label, category, "fold", *[f"z{j}" for j in range(k)], F.explode(numbers).alias("model"))
    seen = seen.filter(F.col("model") != F.col("fold"))
    spec = T.StructType([
        *[rows.schema[c] for c in by], T.StructField("model", T.IntegerType()),
        T.StructField("slopes", T.ArrayType(T.DoubleType())), T.StructField("step", T.ArrayType(T.DoubleType())),
    ])
    slopes: dict[tuple, np.ndarray] = {}
    placed = seen.withColumns({"level": F.lit(0.0), "p": F.lit(0.5)})
    for turn in range(max_steps):
        sums = materialize(
            placed.groupBy(*keys, category).agg(F.first("level").alias("level"), *_sums(k, label)), "newton-sums"
        )
        systems = sums.groupBy(*keys).agg(*_eliminated(k)).collect()  # one row per model
        moves, decrement, size = [], 0.0, 0
        for row in systems:
            matrix = np.array([[row[f"s{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]).reshape(k, k)
            right = np.array([row[f"r{j}"] for j in range(k)])
            step = np.linalg.pinv(matrix, hermitian=True) @ right
            decrement = max(decrement, row["decrement"] + float(right @ step))
            step *= min(1.0, LONGEST_STEP / max(np.abs(step).max(initial=0.0), 1e-300))
            key = tuple(row[c] for c in keys)
            slopes[key] = slopes.get(key, np.zeros(k)) + step
            moves.append((*key, slopes[key].tolist(), step.tolist()))
            size += row["n_rows"]
        moved = sums.join(F.broadcast(spark.createDataFrame(moves, spec)), keys)
        by_slopes = " + ".join(["0D", *[f"h{j} * step[{j}]" for j in range(k)]])
        shift = f"greatest(least(coalesce(try_divide(g - ({by_slopes}), h), 0D), {LONGEST_STEP}D), -{LONGEST_STEP}D)"
        if turn == 0:
            shift = f"CASE WHEN abs(g) = n / 2 THEN signum(g) * {CERTAIN}D ELSE {shift} END"
        coefficients = moved.select(*keys, category, F.expr(f"level + {shift}").alias("level"), "slopes", "n")
        if decrement <= tolerance:
            return materialize(coefficients, "newton-coefficients"), True
        few = F.broadcast(coefficients) if size <= BROADCAST_ROWS else coefficients
        placed = seen.join(few.drop("n"), [*keys, category]).withColumn("p", _chance(_linear(k)))
    return materialize(coefficients, "newton-coefficients"), False


def _with_models(rows: DataFrame) -> DataFrame:
    """Each row once for the model of all rows and once for that without its fold."""
    return rows.withColumn("model", F.explode(F.array(F.lit(ALL), F.col("fold"))))


def _both(scored: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """``propensity`` and ``held_out`` side by side, by an aggregate instead of a join."""
    kept = [c for c in rows.columns if c not in key]
    return scored.groupBy(*key).agg(
        *[F.first(c).alias(c) for c in kept],
        F.max(F.when(F.col("model") == ALL, F.col("p"))).alias("propensity"),
        F.max(F.when(F.col("model") != ALL, F.col("p"))).alias("held_out"),
    )


def score_logistic(
    data: DataFrame, numbers: Sequence[str], category: str, folds: int,
    by: Sequence[str] = ("experiment_id",), label: str = "treatment", **settings,
) -> DataFrame:
    """Rows of ``data`` (with ``fold``) with the chances by logistic models of every group.

    A category that a model has not seen has the mean level of the rows it was fitted to.
    """
    k = len(numbers)
    rows = materialize(standardized(data, numbers, by), "newton-rows")
    coefficients, converged = fit_logistic(rows, k, folds, by, label, category, **settings)
    if not converged:
        logging.getLogger(__name__).warning("logistic models stopped before they converged")
    keys = [*by, "model"]
    usual = coefficients.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("level") * F.col("n")), F.sum("n")).alias("usual"), F.first("slopes").alias("slopes")
    )
    scored = lookup_join(_with_models(rows), usual, keys).join(
        coefficients.select(*keys, category, "level"), [*keys, category], "left"
    ).withColumn("level", F.coalesce("level", "usual"))
    scored = scored.withColumn("p", _chance(_linear(k)))
    return _both(scored, data, [*by, "user_id"])


def score_categories(
    data: DataFrame, category: str, by: Sequence[str] = ("experiment_id",), label: str = "treatment"
) -> DataFrame:
    """Rows of ``data`` (with ``fold``) with the treated share of their category.

    Shares without a fold are totals less that fold's counts, from the same aggregate. A
    category with no rows outside the fold has the group's share without the fold.
    """
    cells = data.groupBy(*by, category, "fold").agg(
        F.count(F.lit(1)).alias("n"), F.sum(label).alias("n1")
    )
    same = Window.partitionBy(*by, category)
    group, fold = Window.partitionBy(*by), Window.partitionBy(*by, "fold")
    less = lambda c, over, out: F.sum(c).over(over) - out
    shares = cells.select(
        *by, category, "fold",
        F.try_divide(F.sum("n1").over(same), F.sum("n").over(same)).alias("propensity"),
        F.coalesce(
            F.try_divide(less("n1", same, F.col("n1")), less("n", same, F.col("n"))),
            F.try_divide(less("n1", group, F.sum("n1").over(fold)), less("n", group, F.sum("n").over(fold))),
        ).alias("held_out"),
    )
    return lookup_join(data, shares, [*by, category, "fold"])
