"""Column helpers for numeric work inside one row.

The formulas behind them are Spark SQL text with lambda functions: one parse instead of
hundreds of Column calls, and a value bound by ``let`` is computed once per row, where a
plain sub-expression inside a lambda would be evaluated again for every element.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

_ORDER = 64


@lru_cache(maxsize=8)
def _nodes(_context: int, order: int = _ORDER) -> Column:
    """Gauss-Legendre positions and weights on [0, 1] as one literal per context."""
    nodes, weights = np.polynomial.legendre.leggauss(order)
    return F.arrays_zip(F.lit((nodes + 1) / 2), F.lit(weights / 2))


def bind(body: str, **values: Column) -> Column:
    """``body`` evaluated with the values as fields of ``s``; ``s.nodes`` is added."""
    values["nodes"] = _nodes(id(SparkContext._active_spark_context))
    bound = F.struct(*[value.alias(name) for name, value in values.items()])
    return F.element_at(
        F.call_function("transform", F.array(bound), F.expr(f"s -> {body}")), 1
    )


def quadrature(order: int) -> Column:
    """Nodes of another order, to be bound under a name of their own."""
    return _nodes(id(SparkContext._active_spark_context), order)


def sql_let(name: str, value: str, body: str) -> str:
    """SQL text of ``body`` with ``name`` standing for ``value``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def sql_integral(variable: str, integrand: str, nodes: str = "nodes") -> str:
    """SQL text of the integral of ``integrand`` over ``variable`` in [0, 1]."""
    total, node = f"{variable}_total", f"{variable}_node"
    at_node = integrand.replace(f"<{variable}>", f"{node}.`0`")
    return (
        f"aggregate(s.{nodes}, 0D, ({total}, {node}) -> {total} + {node}.`1` * ({at_node}))"
    )


def let(body: Callable[[Column], Column], **values: Column) -> Column:
    """The same binding for bodies built from Columns."""
    bound = F.struct(*[value.alias(name) for name, value in values.items()])
    return F.element_at(F.transform(F.array(bound), body), 1)
