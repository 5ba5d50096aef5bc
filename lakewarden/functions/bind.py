"""Evaluate once, use often."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once a row.

    A column that a lambda or several branches mention is evaluated at each
    mention; a lambda's own variable is not.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))
