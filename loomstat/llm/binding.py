"""Naming a value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once.

    A column used several times is copied into each use when the optimizer merges
    projections; a few levels of that make code that no longer compiles. A lambda's
    variable isn't copied.
    """
    return F.transform(F.array(value), body)[0]
