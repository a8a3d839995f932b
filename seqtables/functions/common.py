"""Helpers for nested column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``.

    An expression repeated inside a lambda would be evaluated for every element.
    """
    return F.transform(F.array(value), body)[0]
