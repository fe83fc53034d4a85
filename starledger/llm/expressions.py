"""Small column helpers shared by the text operators that use SQL functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, also where ``use`` has lambdas."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.array_remove(F.split(text, SPACE), "")


def total(values: Column, zero: Column) -> Column:
    return F.aggregate(values, zero, lambda a, v: a + v)
