"""Naming an intermediate value inside one column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once per row.

    Using a Python variable several times copies its expression, and inside a
    lambda the copy runs once per element.  Here the value is bound to a lambda
    variable of a one-element array instead.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
