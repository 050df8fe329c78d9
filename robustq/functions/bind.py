"""Evaluate a column expression once per row and use it many times.

A lambda body that names an expression (the words of a text, the maximum of an array) has it
evaluated again for every element of the array the lambda runs over: work that is quadratic in
the length of the row. A column of its own is no cure where the optimizer merges projections.
``bind`` wraps the expression in a one-element array instead, so that it is evaluated once and
the body reads a lambda variable.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bind2(first: Column, second: Column, body: Callable[[Column, Column], Column]) -> Column:
    """``body(first, second)`` with both evaluated once a row."""
    return bind(first, lambda a: bind(second, lambda b: body(a, b)))
